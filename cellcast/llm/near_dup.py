"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles of the lower-case text. Two documents are linked
when the Jaccard similarity of their sets is at least ``THRESHOLD``; documents joined by
links form a class. The result has one row per document with its class and the number of
documents it is linked to.

1. One pass gives each document the size and a digest of its set and a MinHash signature,
   cut into bands. Documents with equal sets are copies; one of them stands for all.
2. Representatives that share a band are tied together, and the ties are closed into
   groups. Every pair that shares a band lies within one group.
3. Groups are cut into blocks of bounded size, and each pair of blocks is one unit of work.
   Within it, signatures are compared a few values at a time; a pair is dropped as soon as
   the posterior probability that its similarity reaches the threshold, given the matches
   so far, falls below ``TOLERANCE``. What is left is verified exactly. The unit returns a
   number of links per document and one link toward the least document of each of its
   clusters, so pairs are never listed, however large the group.
4. The links are closed into classes.

A pair at the threshold shares a band with probability 0.9995. No task holds more than two
blocks; hot groups of copies are counted with partial sums, and the joins are between
written tables, which Spark can split at hot keys. The large joins are sort-merge joins at
every size, so that a small run shows the plan of a large one.

Texts with fewer than five words have one shingle of all their words. A null text, or one
without words, has none: it is a class of its own with no links. ``doc_id`` names a
document: rows with equal ids and texts are copies of each other (linked, and counted as
such). Rows with a null id are left out of the result. An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellcast.llm.components import components, stored
from cellcast.llm.decontaminate import lower_words
from cellcast.llm.text import mix64, packed, row_of, shingles, slices, small_batches, unpacked
from cellcast.session import scratch_dir

THRESHOLD = 0.8
N_BANDS = 32
BAND_ROWS = 7
STEP = 16
TOLERANCE = 1e-6
BLOCK_SHINGLES = 50_000

_SIZE = N_BANDS * BAND_ROWS
_SALT = (mix64(np.arange(1, _SIZE + 1, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
_ODD = (mix64(np.arange(1001, 1001 + _SIZE, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, sorted, and the range of each row."""
    _, words, h = lower_words(column)
    s = shingles(h, words.first)
    row = row_of(s.first)
    order = np.lexsort((s.value, row))
    value, row = s.value[order], row[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[keep], np.searchsorted(row[keep], np.arange(len(s.first)))


def signatures(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash values of each set, one row per set; those of an empty set are all ones."""
    full = np.flatnonzero(np.diff(first) > 0)
    out = np.full((len(first) - 1, _SIZE), 0xFFFFFFFF, np.uint32)
    if len(full):
        low = (value >> np.uint64(32)).astype(np.uint32)
        for k in range(_SIZE):
            out[full, k] = np.minimum.reduceat((low ^ _SALT[k]) * _ODD[k], first[full])
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and band."""
    wide = sig.astype(np.uint64)
    out = np.empty((len(sig), N_BANDS), np.uint64)
    for b in range(N_BANDS):
        key = np.full(len(sig), b + 1, np.uint64)
        for k in range(b * BAND_ROWS, (b + 1) * BAND_ROWS):
            key = mix64(key ^ wide[:, k])
        out[:, b] = key
    return out


@lru_cache(maxsize=8)
def fewest_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For each number of compared values, the fewest matches that keep a pair.

    With a uniform prior and ``m`` of ``n`` matches the similarity is Beta(m+1, n-m+1).
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = [0]
    for n in range(1, _SIZE + 1):
        def reaches(m: int) -> float:
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(log - log.max())
            return density[grid >= threshold].sum() / density.sum()

        lo, hi = 0, n
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if reaches(mid) >= tolerance else (mid + 1, hi)
        out.append(lo)
    return out


def similar_pairs(sig: np.ndarray, side: np.ndarray, across: bool, threshold: float = THRESHOLD) -> np.ndarray:
    """Index pairs that survive the pruning: those across sides 0 and 1, or else all pairs."""
    fewest = fewest_matches(threshold)
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if across else (np.arange(len(sig)),) * 2
    step = max(1, (1 << 22) // max(len(right) * STEP, 1))
    kept = []
    for at in range(0, len(left), step):
        mine = left[at:at + step]
        match = (sig[mine][:, None, :STEP] == sig[right][None, :, :STEP]).sum(2)
        i, j = np.nonzero(match >= fewest[STEP])
        match, i, j = match[i, j], mine[i], right[j]
        if not across:
            match, i, j = match[i < j], i[i < j], j[i < j]
        for n in range(STEP, _SIZE, STEP):
            if not len(i):
                break
            match = match + (sig[i, n:n + STEP] == sig[j, n:n + STEP]).sum(1)
            ok = match >= fewest[n + STEP]
            match, i, j = match[ok], i[ok], j[ok]
        kept.append(np.column_stack([i, j]))
    return np.concatenate(kept) if kept else np.zeros((0, 2), np.int64)


def verify(pairs: np.ndarray, value: np.ndarray, first: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """The pairs whose sets have a Jaccard similarity of at least the threshold, exactly."""
    if not len(pairs):
        return pairs
    size = np.diff(first)
    used = np.unique(pairs)
    place = np.full(len(size), -1)
    place[used] = np.arange(len(used))
    a, b = place[pairs[:, 0]], place[pairs[:, 1]]
    shared = np.zeros(len(pairs), np.int64)
    if len(pairs) < 4 * len(used):
        sets = [value[first[k]:first[k + 1]] for k in used]
        for p, (x, y) in enumerate(zip(a, b, strict=True)):
            shared[p] = np.isin(sets[x], sets[y], assume_unique=True).sum()
    else:
        # Many pairs of few documents: count by products of document x shingle tables.
        at = np.concatenate([np.arange(first[k], first[k + 1]) for k in used])
        row = np.repeat(np.arange(len(used)), size[used])
        names, column = np.unique(value[at], return_inverse=True)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        width = max(256, (1 << 23) // len(used))
        total = np.zeros((len(used), len(used)), np.float32)
        for c in range(0, len(names), width):
            lo, hi = np.searchsorted(column, [c, c + width])
            has = np.zeros((len(used), min(width, len(names) - c)), np.float32)
            has[row[lo:hi], column[lo:hi] - c] = 1
            total += has @ has.T
        shared = total[a, b].astype(np.int64)
    union = size[pairs[:, 0]] + size[pairs[:, 1]] - shared
    return pairs[shared >= threshold * union - 1e-9]


def cluster(n: int, pairs: np.ndarray, name: np.ndarray) -> np.ndarray:
    """For each of ``n`` elements the least name among those it is tied to by pairs."""
    root = np.arange(n)
    while True:
        # Hook the greater root of each pair to the lesser, then shorten all paths.
        a, b = root[pairs[:, 0]], root[pairs[:, 1]]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, root, name)
    return least[root]


def signature_table(docs: DataFrame) -> DataFrame:
    """Size and digest of the shingle set and the band keys of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            value, first = shingle_sets(part.column(1))
            upto = np.concatenate([[np.uint64(0)], np.cumsum(mix64(value), dtype=np.uint64)])
            digest = mix64(upto[first[1:]] - upto[first[:-1]])
            keys = band_keys(signatures(value, first)).reshape(-1).view(np.int64)
            offs = np.arange(0, len(keys) + 1, N_BANDS, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(first).astype(np.int32)), pa.array(digest.view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(offs), pa.array(keys))], ["doc_id", "n_shingles", "digest", "bands"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(
        F.col("doc_id").isNotNull()).mapInArrow(run, "doc_id long, n_shingles int, digest long, bands array<long>")


def block_links(units: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links within units of work.

    ``units`` has ``(unit, side, doc_id, copies, text)``, each unit's rows adjoining. A unit of
    two blocks has the pairs across them, none if one is empty; that of a block with itself has
    all pairs. The result has, per unit and document, the number of documents it is linked to
    and the least document of its cluster.
    """

    def solve(t: pa.Table) -> pa.RecordBatch:
        unit = t.column("unit")[0].as_py()
        ids, one = np.unique(t.column("doc_id").to_numpy(), return_index=True)  # equal rows once
        side, copies = t.column("side").to_numpy()[one], t.column("copies").to_numpy()[one]
        value, first = shingle_sets(t.column("text").combine_chunks().take(pa.array(one)))
        pairs = verify(similar_pairs(signatures(value, first), side, unit["low"] != unit["high"], threshold), value, first, threshold)
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, pairs[:, 0], copies[pairs[:, 1]])
        np.add.at(links, pairs[:, 1], copies[pairs[:, 0]])
        root = cluster(len(ids), pairs, ids)
        some = links > 0
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(root[some])],
                                          ["doc_id", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = batch.column(0).to_pylist()
            cuts = [k for k in range(1, len(unit)) if unit[k] != unit[k - 1]]
            for a, b in zip([0, *cuts], [*cuts, len(unit)], strict=True):
                if held and held[0].column(0)[0].as_py() != unit[a]:
                    yield solve(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield solve(pa.Table.from_batches(held))

    return units.mapInArrow(run, "doc_id long, links long, root long")


def jaccard_classes(docs: DataFrame, folder: str | None = None, threshold: float = THRESHOLD,
                    block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``(doc_id, class_id, n_links, representative)``, one row per row of ``docs``.

    ``class_id`` is the least id of the class; ``representative`` the least id among the
    documents with the same shingles.
    """
    folder = folder or scratch_dir(docs.sparkSession, "near-dup")
    sigs = stored(signature_table(docs), f"{folder}/signatures")
    sets = ["digest", "n_shingles"]
    copies = stored(sigs.filter("n_shingles > 0").groupBy(*sets)
                    .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), f"{folder}/copies")
    members = stored(sigs.filter("n_shingles > 0").select("doc_id", *sets).join(copies.hint("merge"), sets)
                     .select("doc_id", "rep", "copies"), f"{folder}/members")
    # Band rows of representatives only.
    reps = sigs.filter("n_shingles > 0").join(copies.hint("merge"), sets).filter("doc_id = rep")
    bands = stored(reps.select("rep", F.explode("bands").alias("band")), f"{folder}/bands")
    shared = stored(bands.groupBy("band").agg(F.min("rep").alias("least"), F.max("rep").alias("most"))
                    .filter("least < most").select("band", "least"), f"{folder}/shared-bands")
    ties = bands.join(shared.hint("merge"), "band").filter("rep != least").select("rep", "least").distinct()
    groups = stored(components(ties, f"{folder}/groups"), f"{folder}/grouped")

    # Blocks of about block_shingles; a unit of work for each pair of blocks of a group.
    info = (groups.withColumnRenamed("node", "rep")
            .join(copies.select("rep", "n_shingles", "copies").dropDuplicates(["rep"]), "rep"))
    info = stored(info, f"{folder}/grouped-sizes")
    blocks = stored(info.groupBy("root").agg(F.ceil(F.sum("n_shingles") / block_shingles).cast("int").alias("blocks")),
                    f"{folder}/blocks")
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    placed = stored(info.join(blocks, "root").select("rep", "copies", "root", "blocks", mine.alias("mine")),
                    f"{folder}/placed")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    units = (texts.join(placed.hint("merge"), "rep").select("rep", "copies", "root", "mine", "text", other)
             .select(F.struct("root", low.alias("low"), high.alias("high")).alias("unit"),
                     F.when(F.col("mine") == low, 0).otherwise(1).alias("side"), F.col("rep").alias("doc_id"), "copies", "text"))
    units = units.repartition(F.col("unit")).sortWithinPartitions("unit")
    found = stored(block_links(units, threshold), f"{folder}/links")

    classes = components(found.filter("doc_id != root").select("doc_id", "root"), f"{folder}/classes")
    verdict = (found.groupBy("doc_id").agg(F.sum("links").alias("links"))
               .join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left")
               .select(F.col("doc_id").alias("rep"), "links", "root"))
    verdict = stored(verdict, f"{folder}/verdicts")
    linked = members.join(verdict, "rep", "left").select(
        "doc_id", F.coalesce("root", "rep").alias("class_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.col("rep").alias("representative"))
    alone = sigs.filter("n_shingles = 0").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
        F.col("doc_id").alias("representative"))
    return linked.unionAll(alone)


def own_keys(docs: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, shared)``: rows packed, with the text and a ``key`` that is the id, or a number of its
    own for each text of an id that different texts share; ``shared`` are such ids. Rows with a
    null id have a null key."""
    rows = docs.select(packed(docs), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    ids = stored(rows.filter("id is not null").groupBy("id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")), f"{folder}/ids")
    shared = ids.filter("lo != hi").select("id")
    if shared.isEmpty():  # texts are moved only where ids clash
        return rows.select("row", "text", F.col("id").alias("key")), shared
    top = ids.agg(F.max("id")).first()[0]
    # Written once, so that the numbers are the same wherever they are read.
    named = stored(rows.join(shared.hint("merge"), "id", "left_semi").select("id", "h").distinct().withColumn(
        "own", F.lit(max(top, 0) + 1) + F.monotonically_increasing_id()), f"{folder}/own-keys")
    keyed = rows.join(named.hint("merge"), ["id", "h"], "left")
    return keyed.select("row", "text", F.coalesce("own", "id").alias("key")), shared


def keep_one(docs: DataFrame, folder: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stand for their class, all columns: its least id. Rows with a
    null id stay. Of rows with equal ids and texts one stays; different texts are different
    documents whatever their ids, and those with an id of their own go before others in a class."""
    folder = folder or scratch_dir(docs.sparkSession, "near-dup")
    rows, _ = own_keys(docs, f"{folder}/keys")
    found = jaccard_classes(rows.select(F.col("key").alias("doc_id"), "text"), folder, threshold).groupBy("doc_id").agg(
        F.min("class_id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    marked = stored(found.filter("doc_id != class_id or n > 1").select(
        F.col("doc_id").alias("key"), (F.col("doc_id") != F.col("class_id")).alias("gone")), f"{folder}/marked")
    rows = rows.select("row", "key")
    left = rows.join(marked, "key", "left_anti")
    several = marked.filter("not gone")
    if not several.isEmpty():  # only rows that share a key need to be compared with one another
        left = left.unionAll(rows.join(several.select("key"), "key", "left_semi").dropDuplicates(["key"]))
    return unpacked(left, docs)
