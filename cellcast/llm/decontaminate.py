"""Benchmark decontamination by containment search.

Test items are short, documents may be long, so the search asks what share of an item's
word shingles a document holds. Items are partitioned by size; each partition has its own
sketch length. An item's sketch is its ``m`` least shingle hashes (a bottom-m MinHash).
A document that holds the share ``threshold`` of an item's ``n`` shingles lacks at most
``n - threshold * n`` of them, so a longer sketch always meets the document; sketches of
large items end at ``MAX_SKETCH`` values, of which all are missing with probability
``(1 - threshold) ** MAX_SKETCH``. Each document probes all its shingles against the
sketches; what meets is verified by exact containment of the item's word shingles.

Items are taken in blocks of about ``BLOCK_BYTES`` of text. One block at a time is collected
and sent to all executors, as flat arrays of words, shingle hashes and sketches, so what is
broadcast is bounded whatever the benchmark's size. A benchmark of one block takes one pass
over the documents, which are not shuffled. A larger one takes a pass per block, each
written before the next begins; dropping documents then joins them to the written digests
of the texts found.

Words are runs of letters, digits, underscores and non-ASCII characters of the lower-case
text. An item with fewer than five words is one shingle of all its words; an item without
words, or null, matches nothing, and neither does a document without words. Equal items
and repeated rows match each for itself (equal rows of an item id count once). Empty
tables give empty results. Columns beyond id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellcast.llm.text import (
    SHINGLE_WORDS, find_words, mix64, packed, packed_schema, row_of, sequence_hashes, slices, small_batches, unpacked, utf8, word_hashes)
from cellcast.session import scratch_dir

THRESHOLD = 0.8
MAX_SKETCH = 32
BLOCK_BYTES = 8 << 20
PAIRS_SCHEMA = "doc_id long, item_id long, n_item_shingles int, n_shared int, containment double"


def lower_words(column: pa.Array):
    """Bytes, words and word hashes of the lower-case texts of a column."""
    data, offs = utf8(pc.utf8_lower(column))
    words = find_words(data, offs)
    return data, words, word_hashes(data, words)


class Index:
    """Sketches of a block of items, partitioned by size."""

    def __init__(self, items: list[tuple[int, str | None]], threshold: float = THRESHOLD):
        self.threshold = threshold
        data, words, h = lower_words(pa.array([t for _, t in items], pa.string()))
        self.ids = [i for i, _ in items]
        self.raw = data.tobytes()
        #: words and sorted shingle hashes of item k: [first[k], first[k + 1]) of each
        self.start, self.end, self.first = words.start.astype(np.int32), words.end.astype(np.int32), words.first
        self.width = np.minimum(SHINGLE_WORDS, np.diff(words.first))
        hashes: list[np.ndarray] = []
        sketch: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, width in enumerate(self.width.tolist()):
            grams = np.unique(sequence_hashes(h[words.first[k]:words.first[k + 1]], width)) if width else np.zeros(0, np.uint64)
            hashes.append(grams)
            if not width:
                continue
            # Bottom-m sketch; the size partition (powers of two) decides m.
            largest = 2 ** math.ceil(math.log2(len(grams)))
            m = min(MAX_SKETCH, math.floor((1 - threshold) * largest + 1e-9) + 1)
            sketch.setdefault(width, []).append((grams[np.argsort(mix64(grams))[:m]], k))
        self.grams = np.concatenate([np.zeros(0, np.uint64), *hashes])
        self.gram_first = np.concatenate([[0], np.cumsum([len(x) for x in hashes], dtype=np.int64)]).astype(np.int64)
        #: by shingle width: sorted sketch values, the item of each, and a table that most others miss
        self.sketch = {}
        for width, parts in sketch.items():
            value = np.concatenate([v for v, _ in parts])
            item = np.concatenate([np.full(len(v), at) for v, at in parts])
            order = np.argsort(value, kind="stable")
            bits = max(16, math.ceil(math.log2(64 * len(value))))
            hit = np.zeros(1 << bits, bool)
            hit[(value >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.sketch[width] = (value[order], item[order], hit, np.uint64(64 - bits))

    def shared(self, k: int, text_words: list[bytes]) -> int:
        """How many distinct shingles of item ``k`` the words of a text hold, exactly."""
        w = int(self.width[k])
        mine = slice(self.first[k], self.first[k + 1])
        words = [self.raw[a:b] for a, b in zip(self.start[mine], self.end[mine], strict=True)]
        grams = lambda x: {tuple(x[i:i + w]) for i in range(len(x) - w + 1)}
        return len(grams(words) & grams(text_words))

    def search(self, column: pa.Array) -> list[tuple[int, int, int, int]]:
        """``(row, item, item's shingles, shared shingles)`` of every match in a slice."""
        data, words, h = lower_words(column)
        row = row_of(words.first)
        found: set[tuple[int, int]] = set()
        for width, (value, item, hit, shift) in self.sketch.items():
            grams = sequence_hashes(h, width)
            at = np.flatnonzero(hit[(grams >> shift).astype(np.int64)])
            at = at[row[at] == row[at + width - 1]]
            lo, hi = np.searchsorted(value, grams[at], "left"), np.searchsorted(value, grams[at], "right")
            for p in np.flatnonzero(hi > lo):
                found.update((int(row[at[p]]), int(k)) for k in item[lo[p]:hi[p]])
        out = []
        have: dict[tuple[int, int], np.ndarray] = {}
        for r, k in sorted(found):
            a, b, w = int(words.first[r]), int(words.first[r + 1]), int(self.width[k])
            mine = self.grams[self.gram_first[k]:self.gram_first[k + 1]]
            if (r, w) not in have:
                have = {(r, w): np.unique(sequence_hashes(h[a:b], w))}
            need = self.threshold * len(mine) - 1e-9
            if np.isin(mine, have[r, w], assume_unique=True).sum() < need:
                continue  # equal shingles have equal hashes, so no match is lost here
            n = self.shared(k, [data[s:e].tobytes() for s, e in zip(words.start[a:b], words.end[a:b], strict=True)])
            if n >= need:
                out.append((r, k, len(mine), n))
        return out


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """The items in hashed blocks of about ``block_bytes`` of text."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.filter(F.col("text").isNotNull()).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def shared_index(block: DataFrame, threshold: float):
    """The index of one block, for all executors."""
    items = sorted(((r[0], r[1]) for r in block.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    return block.sparkSession.sparkContext.broadcast(Index(items, threshold))


def contaminated_pairs(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, folder: str | None = None,
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every pair of a document and a test item whose shingles it holds."""
    spark = docs.sparkSession
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def search(index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                found = index.value.search(part.column(1))
                ids = part.column(0).take(pa.array([r for r, *_ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array([index.value.ids[k] for _, k, _, _ in found], pa.int64()),
                    pa.array([n for _, _, n, _ in found], pa.int32()), pa.array([s for *_, s in found], pa.int32()),
                    pa.array([s / n for _, _, n, s in found], pa.float64()),
                ], ["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"])

        return texts.mapInArrow(run, PAIRS_SCHEMA)

    blocks = item_blocks(items, block_bytes)
    if len(blocks) == 1:
        return search(shared_index(blocks[0], threshold))
    folder = folder or scratch_dir(spark, "leaks")
    for k, block in enumerate(blocks):
        index = shared_index(block, threshold)
        search(index).write.parquet(f"{folder}/{k}")
        index.destroy()
    return spark.read.schema(PAIRS_SCHEMA).parquet(*[f"{folder}/{k}" for k in range(len(blocks))])


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, folder: str | None = None,
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no test item."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    blocks = item_blocks(items, block_bytes)
    if len(blocks) == 1:
        index = shared_index(blocks[0], threshold)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                clean = np.ones(part.num_rows, bool)
                clean[[r for r, *_ in index.value.search(part.column(1))]] = False
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(clean))], ["row"])

        rows = small_batches(docs).select(packed(docs), text.alias("text"))
        return unpacked(rows.mapInArrow(keep, packed_schema(docs)), docs)

    def find(index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                rows = sorted({r for r, *_ in index.value.search(part.column(1))})
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64()))], ["digest"])

        texts = small_batches(docs).select(F.sha2(text, 256).alias("digest"), text.alias("text"))
        return texts.mapInArrow(run, "digest string").distinct()

    folder = folder or scratch_dir(spark, "leaks")
    for k, block in enumerate(blocks):
        index = shared_index(block, threshold)
        find(index).write.parquet(f"{folder}/{k}")
        index.destroy()
    found = spark.read.schema("digest string").parquet(*[f"{folder}/{k}" for k in range(len(blocks))])
    rows = docs.select(packed(docs), F.sha2(text, 256).alias("digest"))
    return unpacked(rows.join(found, "digest", "left_anti"), docs)
