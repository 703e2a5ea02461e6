"""Token counts through a digest cache.

Each text is known by its SHA-256 digest, each tokenizer by a digest of its file and
library. Counts are stored in a table keyed by both. A run joins the documents to the
stored counts, encodes every distinct text that is missing once, appends its count, and
joins again. A stored row is a fact about a text, true whatever becomes of the run that
wrote it: a run that stops halfway leaves fewer misses to the next, and a digest that two
runs stored at once, or one run twice, counts once, as a cache is read by distinct digest.

Texts cross the network once per distinct missing text and map task; the last join
carries ids and digests only, and Spark splits it where one digest is frequent.

A null text counts as empty, with no tokens and no bytes. Repeated rows each get a row.
Columns beyond ``doc_id`` and ``text`` are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellcast.llm.bpe import cut_pieces
from cellcast.llm.text import SLICE_BYTES, Words, slices, small_batches, utf8, word_hashes
from cellcast.session import scratch_dir

CACHE_SCHEMA = "tokenizer string, digest string, n_tokens long"
MEMO_PIECES = 400_000
LIMIT = 512


def read_tokenizer(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def version(path: str, source: bytes) -> str:
    """What the counts of a tokenizer are stored under."""
    kind = "sentencepiece" if path.endswith(".model") else "tokenizers"
    return hashlib.sha256(kind.encode() + b"\0" + source).hexdigest()


class PieceCounter:
    """Counts of a ``tokenizers`` file; byte-level BPE counts each distinct piece once.

    Byte-level BPE never merges across the pieces that its pattern cuts, so a text's
    count is the sum over its pieces, each counted by the library. Texts that hold an
    added token, and all texts of other models, go to the library whole.
    """

    def __init__(self, source: bytes):
        import json

        from tokenizers import Tokenizer
        text = source.decode()
        self.library = Tokenizer.from_str(text)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(text)
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.by_piece = (spec["model"]["type"] == "BPE" and not spec.get("normalizer")
                         and byte_level.items() <= (spec.get("pre_tokenizer") or {}).items())
        self.added = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.known, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _library(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        raw = data.tobytes()
        rows = [raw[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)]
        if not self.by_piece:
            return np.array(self._library([x.decode() for x in rows]), np.int64)
        if len(self.known) > MEMO_PIECES:
            self.known, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        start = cut_pieces(data, offs)
        end = np.append(start[1:], len(data))
        key = word_hashes(data, Words(start, end, start))
        distinct, one, inverse = np.unique(key, return_index=True, return_inverse=True)
        new = ~np.isin(distinct, self.known, assume_unique=True)
        if new.any():
            pieces = [raw[start[k]:end[k]].decode() for k in one[new]]
            known = np.concatenate([self.known, distinct[new]])
            count = np.concatenate([self.count, np.array(self._library(pieces), np.int64)])
            order = np.argsort(known)
            self.known, self.count = known[order], count[order]
        upto = np.concatenate([[0], np.cumsum(self.count[np.searchsorted(self.known, distinct)][inverse])])
        total = np.diff(upto[np.searchsorted(start, offs)])
        for k, row in enumerate(rows):
            if any(t in row for t in self.added):
                total[k] = self._library([row.decode()])[0]
        return total


class ModelCounter:
    """Counts of a ``sentencepiece`` model."""

    def __init__(self, source: bytes):
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_proto=source)

    def counts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(offs[:-1], offs[1:], strict=True)]
        return np.array([len(x) for x in self.library.encode(texts, num_threads=1)], np.int64)


_loaded: dict[str, PieceCounter | ModelCounter] = {}


def counter(tokenizer: str, path: str, source: bytes) -> PieceCounter | ModelCounter:
    """The worker's counter, built once; the library must not start threads of its own."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if tokenizer not in _loaded:
        _loaded.clear()
        _loaded[tokenizer] = (ModelCounter if path.endswith(".model") else PieceCounter)(source)
    return _loaded[tokenizer]


def read_cache(spark, cache: str, tokenizer: str) -> DataFrame:
    """Stored counts of one tokenizer, one row per digest; none where no cache has been written."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache) if files.exists(folder) else spark.createDataFrame([], CACHE_SCHEMA)
    return stored.filter(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit, digest)`` for every row of ``docs``."""
    spark = docs.sparkSession
    source = read_tokenizer(path)
    tokenizer = version(path, source)
    cache = cache or scratch_dir(spark, "token-counts")
    shared = spark.sparkContext.broadcast(source)
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("digest", F.sha2("text", 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer, path, shared.value)
        for part in slices(batches, "text", SLICE_BYTES):
            n = count.counts(*utf8(part.column(1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([tokenizer] * len(n), pa.string()), part.column(0), pa.array(n, pa.int64())],
                ["tokenizer", "digest", "n_tokens"])

    missing = (texts.join(read_cache(spark, cache, tokenizer), "digest", "left_anti")
               .groupBy("digest").agg(F.first("text").alias("text")))
    missing.mapInArrow(run, CACHE_SCHEMA).write.mode("append").parquet(cache)
    counts = read_cache(spark, cache, tokenizer)
    return (texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
            .join(counts, "digest")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "digest"))
