"""Interaction audit of document filters by a Gray-code walk over their subsets.

Five filters judge every whole text; a document's failures are a mask of five bits. Per
part of the corpus (its source) documents are counted by mask, so that at most 32 cells per
part are left, whatever the number of documents. The walk then visits the 32 subsets of
filters in Gray-code order and toggles one filter at a time: each cell has a counter of the
active filters that it fails, and the running survivors change by the cells whose counter
leaves or reaches zero. The survivors of all 32 states are stored; every step of every
order of filters is a difference of two of them.

A fails a text of fewer than 200 words, B one whose distinct words are under half of its
words, C one with over 2 % of capitals A-Z, D one with any of ``#$%&*|``, E one that equals
the text of any document with a lesser id in the whole table. Words are runs without white
space, case-sensitive.

A null text is an empty one; a null source is the part of the empty string. A null id is
neither less nor greater than another, so E never fails such a row nor fails others by it.
Repeated rows count each; rows that share an id fail E together or not at all if their texts
are equal too. A label counts if any row of ``labels`` for the id has it. Columns beyond
``doc_id``, ``text`` and ``source`` are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellcast.llm.components import stored
from cellcast.session import scratch_dir

FILTERS = "ABCDE"
STATES = 1 << len(FILTERS)
#: Parts of one output batch: 600 rows each.
PARTS = 50
#: What is counted per cell: documents, those of good quality, toxic ones.
COUNTS = ["n", "good", "toxic"]
AUDIT_SCHEMA = ("part string, filter_order string, step int, kept long, removed long, redundant long, "
                "unique_fails long, good_lost long, toxic_lost long, shapley long")

ORDERS = ["".join(p) for p in permutations(FILTERS)]


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    # One-element arrays bind the words, so that they are split once.
    counts = F.element_at(F.transform(F.array(words), lambda w: F.struct(
        F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct"))), 1)
    return F.element_at(F.transform(F.array(counts), lambda c: (
        F.when(c["words"] < 200, 1).otherwise(0)
        + F.when(100 * c["distinct"].cast("long") < 50 * c["words"].cast("long"), 2).otherwise(0))), 1) + (
        F.when(100 * capitals.cast("long") > 2 * F.length(text).cast("long"), 4).otherwise(0)
        + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0))


def failure_masks(docs: DataFrame, labels: DataFrame, folder: str) -> DataFrame:
    """``(part, mask, good, toxic)`` of every row; texts are read once and not shuffled."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        text_failures(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest")), f"{folder}/rows")
    # Only texts that several rows hold can fail E; a hot text is one row of this side.
    first = (slim.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
             .filter("rows > 1").select("digest", "first"))
    marks = (labels.groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
             .filter("good = 1 or toxic = 1"))
    repeated = F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)
    return (slim.join(first.hint("merge"), "digest", "left").join(marks.hint("merge"), "doc_id", "left")
            .select("part", (F.col("mask") + repeated).alias("mask"),
                    F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")))


def survivors(cells: np.ndarray) -> np.ndarray:
    """Running survivors of each of the 32 sets of active filters.

    ``cells`` has the counts by part and mask (further axes are carried along), the result
    by part and set.
    """
    mask = np.arange(STATES)
    active = np.zeros(STATES, np.int64)  # how many active filters each cell fails
    running = cells.sum(1)
    out = np.empty_like(cells)
    state = 0
    out[:, state] = running
    for step in range(1, STATES):
        toggled = step & -step  # the bit in which neighbours of the Gray code differ
        state ^= toggled
        fails = (mask & toggled) > 0
        if state & toggled:
            gone = fails & (active == 0)
            active[fails] += 1
            running = running - cells[:, gone].sum(1)
        else:
            active[fails] -= 1
            running = running + cells[:, fails & (active == 0)].sum(1)
        out[:, state] = running
    return out


def audit_table(parts: list[str], cells: np.ndarray) -> pa.RecordBatch:
    """All steps of all orders for some parts, as differences of stored states."""
    alive = survivors(cells)
    letter = np.array([[FILTERS.index(c) for c in order] for order in ORDERS])
    bit = 1 << letter
    after = np.cumsum(bit, axis=1)
    before = after - bit
    fails = np.stack([alive[:, 0, 0] - alive[:, 1 << f, 0] for f in range(len(FILTERS))], 1)
    alone = np.stack([alive[:, (STATES - 1) ^ (1 << f), 0] - alive[:, STATES - 1, 0] for f in range(len(FILTERS))], 1)
    lost = alive[:, before] - alive[:, after]  # part, order, step, count
    removed = lost[..., 0]
    shapley = np.zeros((len(parts), len(FILTERS)), np.int64)
    for f in range(len(FILTERS)):
        shapley[:, f] = removed[:, letter == f].sum(1)
    n = len(parts)
    columns = [
        np.repeat(np.array(parts, object), len(ORDERS) * len(FILTERS)), np.tile(np.repeat(np.array(ORDERS, object), len(FILTERS)), n),
        np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), n * len(ORDERS)), alive[:, after, 0], removed,
        fails[:, letter] - removed, alone[:, letter], lost[..., 1], lost[..., 2], shapley[:, letter]]
    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
    names = [c.split()[0] for c in AUDIT_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c.reshape(-1), k) for c, k in zip(columns, kinds, strict=True)], names)


def audit(masks: DataFrame) -> DataFrame:
    """One row per part, order of filters and step, from :func:`failure_masks`."""
    cells = masks.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    # At most 32 cells a part.
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                rows = batch.slice(at, PARTS).to_pylist()
                table = np.zeros((len(rows), STATES, len(COUNTS)), np.int64)
                for k, row in enumerate(rows):
                    for cell in row["cells"]:
                        table[k, cell["mask"]] = [cell[c] for c in COUNTS]
                yield audit_table([r["part"] for r in rows], table)

    return parts.mapInArrow(walk, AUDIT_SCHEMA)


def audit_documents(docs: DataFrame, labels: DataFrame, folder: str | None = None) -> DataFrame:
    return audit(failure_masks(docs, labels, folder or scratch_dir(docs.sparkSession, "audit")))
