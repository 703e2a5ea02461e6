"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last 16 bytes is taken at every word end; a chunk ends where
that hash is greatest among the four word ends before and the four after it. Cuts depend
on the text around them alone, so an insertion moves only the cuts beside it, and a
passage that stands in two documents is cut alike in both but for its edges. Where a
phrase repeats, equal greatest hashes follow each other; every fourth of them ends a chunk.
No chunk has more than ``MAX_CHUNK_WORDS`` words. Chunks are known by a 64-bit digest of
their bytes. Of each digest the document with the least id keeps its chunk; elsewhere, and
further on in the same document, the chunk is a repeat and knows its place in the owner.

Repeated chunks that adjoin here and in one owner are a stretch. The edges of a passage lie
in chunks that the text around them shapes, so a stretch is grown word by word for as long
as the words beside it equal those beside its place in the owner. What is not repeated there
is less than one chunk, so ``MAX_CHUNK_WORDS`` words on either side are enough; a longer
passage has stretches of its own further on. Grown stretches of at least
``MIN_PASSAGE_WORDS`` words are cut out of the text: each equals, word by word, a stretch of
its owner's text. A shorter repeat stays. A passage is missed if no whole chunk lies inside
it, or if documents that don't hold it own all that do.

Words are runs without white space; characters of scripts written without blanks (Han, kana,
Thai, Lao) count as one word each. A text that repeats one phrase keeps its first.

A digest's documents are never brought together: owners come from an aggregation with
partial sums, and joins that Spark can split mark the repeats and bring the words beside
them, which are read once per place in an owner. Chunks, owners, repeats and those words are
written to the shared folder, so a lost executor costs one step.

A null text stays null and an empty one empty; neither has chunks. A document of copies
of earlier text ends empty, and stays as a row. Rows with equal ids are taken as copies of
one document and all treated alike. A null id never owns a chunk and loses none. An empty
table gives an empty result. Other columns are carried along; ``n_chars``, where there is
one, follows the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellcast.llm.text import (
    Words, mix64, packed, packed_schema, row_of, slices, small_batches, solid_words, utf8, word_hashes)
from cellcast.session import scratch_dir

WINDOW_BYTES = 16
REACH = 4
TIES = 4
MAX_CHUNK_WORDS = 64
MIN_PASSAGE_WORDS = 50
CHUNKS_SCHEMA = "doc_id long, digest long, words int, at int, source int, again boolean"
EDGES_SCHEMA = "doc_id long, owner long, place int, before boolean"

_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of the gear values of the last 16 bytes, each shifted by its age."""
    h = _GEAR[data]
    span = 1
    while span < WINDOW_BYTES:
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    return h


def text_words(data: np.ndarray, offs: np.ndarray) -> Words:
    """Runs without white space, cut at each character of a script written without blanks."""
    words = solid_words(data, offs)
    alone = (data >= 0xE3) & (data <= 0xE9)  # first bytes of U+3000 to U+9FFF
    alone[:-1] |= (data[:-1] == 0xE0) & (data[1:] >= 0xB8) & (data[1:] <= 0xBB)  # U+0E00 to U+0EFF
    if not alone.any():
        return words
    mark = np.zeros(len(data) + 3, bool)
    mark[words.start] = True
    at = np.flatnonzero(alone)
    mark[at] = True
    solid = np.append(~np.isin(data, np.frombuffer(b" \t\n\v\f\r", np.uint8)), [False] * 3)
    mark[at + 3] |= solid[at + 3]
    start = np.flatnonzero(mark)
    run_end = words.end[np.searchsorted(words.start, start, "right") - 1]
    return Words(start, np.minimum(run_end, np.append(start[1:], len(data))), np.searchsorted(start, offs))


def find_chunks(data: np.ndarray, offs: np.ndarray, words: Words) -> tuple[Words, np.ndarray]:
    """Chunks of a slice as byte spans (white space after a chunk belongs to it) and the
    number of words in each."""
    n = len(words.end)
    row = row_of(words.first)
    value = gear_hashes(data)[words.end - 1].astype(np.int64) if n else np.zeros(0, np.int64)
    # Windows that reach back beyond a document's start depend on what stands before it.
    value[words.end - offs[row] < WINDOW_BYTES] = -1
    cut = value >= 0
    for k in range(1, REACH + 1):
        same = row[k:] == row[:-k]
        cut[k:] &= ~same | (value[k:] >= value[:-k])
        cut[:-k] &= ~same | (value[:-k] >= value[k:])
    # Greatest values within reach of each other are equal; counted from the first of them.
    at = np.flatnonzero(cut)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > REACH) | (np.diff(row[at]) > 0)
    number = np.arange(len(at))
    cut[at[(number - np.maximum.accumulate(np.where(new, number, 0))) % TIES > 0]] = False
    if n:
        cut[words.first[1:][np.diff(words.first) > 0] - 1] = True
    last = np.flatnonzero(cut)
    begin = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    inside = np.arange(n) - np.repeat(begin, last - begin + 1)
    cut[inside % MAX_CHUNK_WORDS == MAX_CHUNK_WORDS - 1] = True
    last = np.flatnonzero(cut)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    start = words.start[first]
    following = np.append(words.start, len(data))[last + 1]
    stop = np.minimum(following, offs[row[last] + 1])
    return Words(start, stop, np.searchsorted(last, words.first)), last - first + 1


def chunk_table(docs: DataFrame) -> DataFrame:
    """One row per chunk; ``at`` is its first word's number in the document, ``source`` that of the
    document's first chunk of the digest, ``again`` where that is another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, offs = utf8(part.column(1))
            ends = text_words(data, offs)
            chunks, n_words = find_chunks(data, offs, ends)
            # A digest is that of the words and what stands between them, not of what follows.
            end = ends.end[np.cumsum(n_words) - 1] if len(n_words) else chunks.end
            digest = word_hashes(data, Words(chunks.start, end, chunks.first))
            row = row_of(chunks.first)
            at = np.cumsum(n_words) - n_words
            at = at - ends.first[row]
            _, one, same = np.unique(mix64(digest ^ mix64(row.astype(np.uint64))), return_index=True, return_inverse=True)
            again = np.ones(len(row), bool)
            again[one] = False
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array(row)), pa.array(digest.view(np.int64)),
                pa.array(n_words.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(at[one[same]].astype(np.int32)),
                pa.array(again),
            ], ["doc_id", "digest", "words", "at", "source", "again"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, CHUNKS_SCHEMA)


def repeats(docs: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, repeats)``: the repeated chunks of each document that has any, with their places."""
    spark = docs.sparkSession
    chunk_table(docs).write.parquet(f"{folder}/chunks")
    chunks = spark.read.parquet(f"{folder}/chunks")
    first = chunks.filter(~F.col("again"))
    (first.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.min_by("at", "doc_id").alias("place"))
     .filter(F.col("owner") < F.col("last")).select("digest", "owner", "place").write.parquet(f"{folder}/owners"))
    owners = spark.read.parquet(f"{folder}/owners")
    piece = ["at", "words", "owner", "place"]
    elsewhere = first.join(owners, "digest").filter(F.col("doc_id") != F.col("owner")).select("doc_id", *piece)
    within = chunks.filter(F.col("again") & F.col("doc_id").isNotNull()).withColumns(
        {"owner": F.col("doc_id"), "place": F.col("source")}).select("doc_id", *piece)
    (elsewhere.unionAll(within).groupBy("doc_id").agg(F.collect_set(F.struct(*piece)).alias("repeats"))
     .write.parquet(f"{folder}/repeats"))
    return spark.read.parquet(f"{folder}/repeats")


class Stretches(NamedTuple):
    """Words ``at`` to ``stop`` of a row that stand at ``place`` in an owner, by row and place."""
    row: np.ndarray
    at: np.ndarray
    stop: np.ndarray
    owner: np.ndarray
    place: np.ndarray


def ints(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(np.int64)


def list_rows(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """The row of each element of a column of lists, and the elements."""
    return row_of(np.concatenate([[0], np.cumsum(ints(lists.value_lengths().fill_null(0)))])), lists.flatten()


def stretches(chunks: pa.ListArray) -> Stretches:
    """The repeated chunks of each row that adjoin in it and in one owner."""
    row, pieces = list_rows(chunks)
    at, words, owner, place = (ints(pieces.field(k)) for k in ("at", "words", "owner", "place"))
    order = np.lexsort((at, place - at, owner, row))
    row, at, words, owner, place = (x[order] for x in (row, at, words, owner, place))
    new = np.ones(len(row), bool)
    new[1:] = ((row[1:] != row[:-1]) | (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + words[:-1])
               | (place[1:] != place[:-1] + words[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row))[:len(first)] - 1
    return Stretches(row[first], at[first], at[last] + words[last], owner[first], place[first])


def contexts(docs: DataFrame, found: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, contexts)``: the words beside the places in the owners of each document's runs."""
    spark = docs.sparkSession

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = stretches(batch.column(1))
            doc = ints(batch.column(0))[found.row]
            after = found.place + found.stop - found.at
            rows = np.unique(np.concatenate([
                np.stack([doc, found.owner, found.place, np.ones_like(doc)], axis=1),
                np.stack([doc, found.owner, after, np.zeros_like(doc)], axis=1)]), axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2].astype(np.int32)), pa.array(rows[:, 3] > 0)],
                ["doc_id", "owner", "place", "before"])

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, offs = utf8(part.column(1))
            words = text_words(data, offs)
            h = word_hashes(data, words).view(np.int64)
            owner, place, before, beside_ = [], [], [], []
            for k, (doc_id, places) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
                mine = h[words.first[k]:words.first[k + 1]]
                for p in places:
                    at = p["place"]
                    owner.append(doc_id)
                    place.append(at)
                    before.append(p["before"])
                    beside_.append(mine[max(0, at - MAX_CHUNK_WORDS):at][::-1] if p["before"] else mine[at:at + MAX_CHUNK_WORDS])
            yield pa.RecordBatch.from_arrays(
                [pa.array(owner, pa.int64()), pa.array(place, pa.int32()), pa.array(before, pa.bool_()),
                 pa.array(beside_, pa.list_(pa.int64()))], ["owner", "place", "before", "beside"])

    found.mapInArrow(edges, EDGES_SCHEMA).write.parquet(f"{folder}/edges")
    asked = spark.read.parquet(f"{folder}/edges")
    key = ["owner", "place", "before"]
    places = asked.select(*key).distinct().groupBy("owner").agg(F.collect_list(F.struct("place", "before")).alias("places"))
    texts = docs.select(F.col("doc_id").cast("long").alias("owner"), F.col("text").cast("string").alias("text"))
    (small_batches(texts).join(places, "owner").select("owner", "text", "places")
     .mapInArrow(beside, "owner long, place int, before boolean, beside array<long>").distinct()
     .write.parquet(f"{folder}/beside"))
    return (asked.join(spark.read.parquet(f"{folder}/beside"), key).groupBy("doc_id")
            .agg(F.collect_list(F.struct(*key, "beside")).alias("contexts")))


def equal_words(mine: np.ndarray, theirs: np.ndarray) -> int:
    """How many words two texts have in common from the start."""
    n = min(len(mine), len(theirs))
    differ = np.flatnonzero(mine[:n] != theirs[:n])
    return int(differ[0]) if len(differ) else n


def passages(column: pa.Array, chunks: pa.ListArray, around: pa.ListArray, min_words: int) -> list[list[tuple[int, int]]]:
    """Byte spans of the passages to remove from each text of a slice."""
    data, offs = utf8(column)
    words = text_words(data, offs)
    h = word_hashes(data, words).view(np.int64)
    row, asked = list_rows(around)
    beside: dict[tuple[int, int, int, bool], list[np.ndarray]] = {}
    if len(asked):
        hashes, ends = ints(asked.field("beside").flatten()), np.cumsum(ints(asked.field("beside").value_lengths().fill_null(0)))
        for key, a, b in zip(zip(row.tolist(), *(asked.field(k).to_pylist() for k in ("owner", "place", "before")), strict=True),
                             [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            beside.setdefault(key, []).append(hashes[a:b])
    spans: list[list[tuple[int, int]]] = [[] for _ in range(len(column))]
    found = stretches(chunks)
    for r, at, stop, owner, place in sorted(zip(*(x.tolist() for x in found), strict=True)):
        a, b = int(words.first[r]), int(words.first[r + 1])
        mine = h[a:b]
        left = max((equal_words(mine[max(0, at - MAX_CHUNK_WORDS):at][::-1], x) for x in beside.get((r, owner, place, True), ())), default=0)
        right = max((equal_words(mine[stop:], x) for x in beside.get((r, owner, place + stop - at, False), ())), default=0)
        if stop + right - (at - left) >= min_words:
            spans[r].append((at - left, stop + right))
    for r, mine in enumerate(spans):
        merged: list[tuple[int, int]] = []
        for lo, hi in sorted(mine):
            if merged and lo <= merged[-1][1]:
                lo, hi = merged[-1][0], max(hi, merged.pop()[1])
            merged.append((lo, hi))
        a, b, at = int(words.first[r]), int(words.first[r + 1]), int(offs[r])
        spans[r] = [(int(words.start[a + lo]) - at, (int(words.start[a + hi]) if a + hi < b else int(offs[r + 1])) - at)
                    for lo, hi in merged]
    return spans


def remove_repeats(docs: DataFrame, folder: str | None = None, min_words: int = MIN_PASSAGE_WORDS) -> DataFrame:
    """``docs`` without repeated passages, and ``removed``: their byte spans in the old text."""
    folder = folder or scratch_dir(docs.sparkSession, "chunks")
    found = repeats(docs, folder)
    around = contexts(docs, found, folder).withColumnRenamed("doc_id", "key")
    found = found.withColumnRenamed("doc_id", "key")
    rows = docs.select(packed(docs), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("key"))
    joined = rows.join(found, "key", "left").join(around, "key", "left").select("row", "text", "repeats", "contexts")
    span_type = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
    schema = packed_schema(docs, T.StructField("text", T.StringType()), T.StructField("removed", T.ArrayType(span_type)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
        for part in slices(batches):
            texts = part.column(1).to_pylist()
            spans = passages(*(part.column(k) for k in (1, 2, 3)), min_words)
            for k, cuts in enumerate(spans):
                if cuts:
                    raw, parts, done = texts[k].encode(), [], 0
                    for a, b in cuts:
                        parts.append(raw[done:a])
                        done = b
                    texts[k] = b"".join([*parts, raw[done:]]).decode()
            spans = [[{"start": a, "stop": b} for a, b in cuts] for cuts in spans]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(spans, pa.list_(span))],
                                             ["row", "text", "removed"])

    out = joined.mapInArrow(run, schema)
    types = dict(docs.dtypes)
    new = {"text": F.col("text").cast(types["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("text").cast(types["n_chars"])
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns], "removed")
