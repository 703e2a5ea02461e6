"""Quality rules: an isolation forest over rule statistics of whole documents.

Every document gets counts (words, symbols, repeated lines, repeated three-word
windows, capitals, marks). Fixed base rules reject documents that are too short or
too repetitive. For the rest, random trees split the statistics at random points; a
document that few splits set apart from the others is anomalous. The limit of the
anomaly score is calibrated on labelled rows: it separates the two labels best among
the limits that keep ``KEEP_GOOD`` of the rows labelled good.

The forest is grown on all labelled documents that have a word, and the limit is set by
all of them that the base rules leave to it; neither is fitted on a sample. What the forest sees of a
document is written once, as numbers; the trees grow by one level at a time, each level
in one pass that counts the rows of every part and finds their ranges. The verdicts need
one more pass over the texts. No text is shuffled.

A null text has no words and fails the base rules, as does an empty one. Repeated rows
get equal verdicts, and count each time in the fit, as do repeated labels. Without
labelled rows of both kinds there is no limit, and the base rules alone decide; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellcast.llm.text import (
    Words, find_words, mix64, packed, packed_schema, row_of, sequence_hashes, slices, small_batches, solid_words, unpacked, utf8, word_hashes)
from cellcast.session import scratch_dir, scratch_scope

N_TREES = 100
TREE_ROWS = 256
MAX_DEPTH = 8  # log2 of TREE_ROWS
BLOCK_ROWS = 16384
SCORE_PARTS = 4096
KEEP_GOOD = 0.998
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_letters", "n_marks"]
FEATURES = ["symbols", "capitals", "marks", "shortness"]
EXAMPLES_SCHEMA = "doc_id long, " + ", ".join(f"{c} double" for c in FEATURES) + ", judged boolean"
RANGES = [f"{side}_{c}" for side in ("low", "high") for c in FEATURES]

_SYMBOL, _NEWLINE, _CAPITAL, _LETTER, _MARK = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NEWLINE[10] = True
_CAPITAL[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_MARK[[ord(c) for c in "!?"]] = True


def _per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return upto[offs[1:]] - upto[offs[:-1]]


def rule_counts(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The rule statistics of each text of a slice (UTF-8 bytes and row offsets)."""
    rows = len(offs) - 1
    words = solid_words(data, offs)
    n_words = np.diff(words.first)
    solid = np.zeros(len(data) + 1, np.int64)
    np.add.at(solid, words.start, 1)
    np.add.at(solid, words.end, -1)
    lead = (data & 0xC0) != 0x80  # first byte of a character
    out = {"n_words": n_words, "word_chars": _per_row(lead & (np.cumsum(solid[:-1]) > 0), offs)}
    out["n_symbols"] = _per_row(_SYMBOL[data], offs)

    lines = find_words(data, offs, ~_NEWLINE)
    with_word = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    line_row = row_of(lines.first)[with_word]
    hashed = word_hashes(data, Words(lines.start[with_word], lines.end[with_word], lines.first))
    n_lines = np.bincount(line_row, minlength=rows)
    distinct = np.unique(mix64(hashed ^ mix64(line_row.astype(np.uint64))), return_index=True)[1]
    out["n_dup_lines"] = n_lines - np.bincount(line_row[distinct], minlength=rows)

    word_row = row_of(words.first)
    three = sequence_hashes(word_hashes(data, words), 3)
    at = np.flatnonzero(word_row[:len(three)] == word_row[2:]) if len(three) else np.zeros(0, np.int64)
    key = mix64(three[at] ^ mix64(word_row[at].astype(np.uint64)))
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = at[count[inverse] > 1] if len(at) else at
    covered = np.zeros(len(word_row), bool)
    for k in range(3):
        covered[twice + k] = True
    out["n_repeat_words"] = np.bincount(word_row[covered], minlength=rows)

    for name, table in (("n_capitals", _CAPITAL), ("n_letters", _LETTER), ("n_marks", _MARK)):
        out[name] = _per_row(table[data], offs)
    return {c: out[c].astype(np.int64) for c in COUNTS}


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """What the forest sees, one row per document: shares that a text's length leaves alone.

    All lie in 0 to 1, so that a few extreme texts don't stretch the range that splits are drawn
    from. Repetition is left to its base rule: in short clean texts one repeated line is rare
    enough to look like an anomaly.
    """
    words = np.maximum(c["n_words"], 1)
    return np.column_stack([
        np.minimum(c["n_symbols"] / words, 1.0),
        c["n_capitals"] / np.maximum(c["n_letters"], 1),
        np.minimum(c["n_marks"] / words, 1.0),
        c["n_words"] / np.maximum(c["word_chars"], 1),
    ])


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])


class Tree(NamedTuple):
    """Nodes in arrays: ``feature`` is -1 in a leaf, where ``length`` is the path length."""
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a random tree over n rows."""
    n = np.asarray(n, float)
    big = np.maximum(n, 3)
    return np.where(n > 2, 2 * (np.log(big - 1) + np.euler_gamma) - 2 * (big - 1) / big, np.where(n == 2, 1.0, 0.0))


class Forest(NamedTuple):
    trees: list[Tree]
    tree_rows: int  # path lengths are those of trees over this many rows
    limit: float | None  # documents with a higher score are rejected; None: no limit known


def leaf_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    while True:
        f = tree.feature[at]
        live = np.flatnonzero(f >= 0)
        if not len(live):
            return at
        goes = x[live, f[live]] <= tree.limit[at[live]]
        at[live] = np.where(goes, tree.left[at[live]], tree.right[at[live]])


def anomaly(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Score in (0, 1): the shorter the mean path, the higher."""
    total = np.zeros(len(x))
    for t in forest.trees:
        total += t.length[leaf_of(t, x)]
    return 2.0 ** -(total / max(len(forest.trees), 1) / max(float(mean_path(forest.tree_rows)), 1e-9))


def _docs(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def examples(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every labelled document with a word: what the forest sees, whether the base rules leave it to the
    forest (``judged``), and how many labels call it ``good`` and ``bad``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            c = rule_counts(*utf8(part.column(1)))
            some = c["n_words"] > 0  # a document without a word is no example of anything
            x = np.asfortranarray(features(c)[some])
            yield pa.RecordBatch.from_arrays(
                [part.column(0).filter(pa.array(some)), *(pa.array(x[:, k]) for k in range(len(FEATURES))),
                 pa.array(~base_failed(c)[some])], ["doc_id", *FEATURES, "judged"])

    good = F.col("quality").cast("int") == 1
    marks = (labels.filter(F.col("quality").cast("int").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.sum(good.cast("long")).alias("good"), F.sum((~good).cast("long")).alias("bad")))
    return (_docs(docs).mapInArrow(run, EXAMPLES_SCHEMA).join(marks, "doc_id")
            .select(*FEATURES, "judged", "good", "bad"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of numbers, joined to blocks of about ``BLOCK_ROWS`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK_ROWS:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _matrix(block: pa.Table) -> np.ndarray:
    return np.column_stack([block.column(c).to_numpy() for c in FEATURES])


def open_parts(rows: DataFrame, trees: list[Tree], first: list[int]) -> DataFrame:
    """Number of rows and range of each feature in every part whose node is ``first[tree]`` or a later one."""
    todo = [(k, t, first[k], len(t.feature) - first[k]) for k, t in enumerate(trees) if first[k] < len(t.feature)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(size, np.int64) for *_, size in todo]
        low = [np.full((size, len(FEATURES)), np.inf) for *_, size in todo]
        high = [np.full((size, len(FEATURES)), -np.inf) for *_, size in todo]
        for block in _blocks(batches):
            x = _matrix(block)
            for i, (_, tree, begin, _) in enumerate(todo):
                node = leaf_of(tree, x) - begin
                order = np.argsort(node, kind="stable")
                order = order[np.searchsorted(node[order], 0):]
                at, start, n = np.unique(node[order], return_index=True, return_counts=True)
                if len(at):
                    count[i][at] += n
                    low[i][at] = np.minimum(low[i][at], np.minimum.reduceat(x[order], start))
                    high[i][at] = np.maximum(high[i][at], np.maximum.reduceat(x[order], start))
        for i, (k, _, begin, _) in enumerate(todo):
            at = np.flatnonzero(count[i])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), k)), pa.array(at + begin), pa.array(count[i][at]),
                 *(pa.array(v[at, f]) for v in (low[i], high[i]) for f in range(len(FEATURES)))],
                ["tree", "node", "n", *RANGES])

    schema = "tree long, node long, n long, " + ", ".join(f"{c} double" for c in RANGES)
    return rows.select(*FEATURES).mapInArrow(run, schema).groupBy("tree", "node").agg(
        F.sum("n").alias("n"), *((F.min if c.startswith("low") else F.max)(c).alias(c) for c in RANGES))


def grow_forest(rows: DataFrame, n_trees: int = N_TREES, tree_rows: int = TREE_ROWS, seed: int = 11) -> Forest:
    """Trees over all rows of :func:`examples`, one level a pass; the limit is left open.

    A part is split at a random point of a random feature while it holds more than one in
    ``tree_rows`` of the rows. A path ends with the mean path of what its part would hold of
    ``tree_rows`` rows, so that lengths don't depend on the size of the table.
    """
    rng = np.random.default_rng(seed)
    grown: list[list[list]] = [[[-1, 0.0, 0, 0, 0.0]] for _ in range(n_trees)]
    first = [0] * n_trees  # the nodes from here on are not measured yet
    total = 0
    for depth in range(MAX_DEPTH + 1):
        trees = [Tree(*map(np.array, zip(*nodes, strict=True))) for nodes in grown]
        # At most 2 ** depth rows of numbers for each tree.
        measured = open_parts(rows, trees, first).toPandas()
        parts = {(int(t), int(node)): (int(n), np.array(v[:len(FEATURES)]), np.array(v[len(FEATURES):]))
                 for t, node, n, *v in measured.itertuples(index=False)}
        if not parts:
            break
        total = total or parts[0, 0][0]
        size = min(tree_rows, total)
        for t, nodes in enumerate(grown):
            begin, first[t] = first[t], len(nodes)
            for at in range(begin, first[t]):
                n, low, high = parts.get((t, at), (0, np.zeros(1), np.zeros(1)))
                nodes[at][4] = float(depth + mean_path(n * size / total))
                varied = np.flatnonzero(high > low) if n * size > total and depth < MAX_DEPTH else []
                if len(varied):
                    f = int(rng.choice(varied))
                    nodes[at][:4] = f, float(rng.uniform(low[f], high[f])), len(nodes), len(nodes) + 1
                    nodes += [[-1, 0.0, 0, 0, 0.0], [-1, 0.0, 0, 0, 0.0]]
        if all(first[t] == len(nodes) for t, nodes in enumerate(grown)):
            break
    if not total:
        return Forest([], tree_rows, None)
    return Forest([Tree(*map(np.array, zip(*nodes, strict=True))) for nodes in grown], min(tree_rows, total), None)


def scores(rows: DataFrame, forest: Forest) -> DataFrame:
    """Each anomaly score among the labelled rows that the base rules leave to the forest, with its labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            yield from pa.table({"score": anomaly(forest, _matrix(block)), "good": block.column("good"),
                                 "bad": block.column("bad")}).combine_chunks().to_batches()

    return (rows.filter("judged")
            .mapInArrow(run, "score double, good long, bad long")
            .groupBy("score").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))


def calibrate(scored: DataFrame, keep_good: float = KEEP_GOOD) -> float | None:
    """The limit with the most rejected bad rows, less rejected good ones, that keeps enough good rows.

    ``scored`` has each score once, with its numbers of good and bad labels. Every score is tried.
    """
    good, bad = scored.agg(F.sum("good"), F.sum("bad")).first()
    if not good or not bad:
        return None  # also without any rows
    parts = scored.withColumn("part", F.floor(F.col("score") * SCORE_PARTS))
    # Running sums over the parts, of which there are few, and then over the scores of each.
    by_part = Window.orderBy("part")
    lower = parts.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).select(
        "part", *((F.sum(c).over(by_part) - F.col(c)).alias(f"lower_{c}") for c in ("good", "bad")))
    by_score = Window.partitionBy("part").orderBy("score")
    out = parts.join(F.broadcast(lower), "part").select("score", *(
        (1 - (F.col(f"lower_{c}") + F.sum(c).over(by_score)) / n).alias(f"{c}_out") for c, n in (("good", good), ("bad", bad))))
    gain = F.when(F.col("good_out") <= 1 - keep_good, F.col("bad_out") - F.col("good_out")).otherwise(-1.0)
    best = out.orderBy(gain.desc(), "score").first()["score"]
    following = scored.filter(F.col("score") > best).agg(F.min("score")).first()[0]
    # Halfway to the next score, so that the limit doesn't hang on one row.
    return (best + (best if following is None else following)) / 2


def fit(docs: DataFrame, labels: DataFrame) -> Forest:
    """Grow the forest on all labelled documents and set its limit by them."""
    spark = docs.sparkSession
    with scratch_scope(spark):
        folder = scratch_dir(spark, "quality-fit")
        examples(docs, labels).write.parquet(f"{folder}/examples")
        rows = spark.read.parquet(f"{folder}/examples")
        forest = grow_forest(rows)
        if not forest.trees:
            return forest
        scores(rows, forest).write.parquet(f"{folder}/scores")
        return forest._replace(limit=calibrate(spark.read.parquet(f"{folder}/scores")))


def judge(docs: DataFrame, forest: Forest) -> DataFrame:
    """Statistics, anomaly score and verdict of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            c = rule_counts(*utf8(part.column(1)))
            failed = base_failed(c)
            score = anomaly(forest, features(c)) if forest.trees else np.zeros(len(failed))
            kept = ~failed & (score <= (np.inf if forest.limit is None else forest.limit))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c[k]) for k in COUNTS[:5]), pa.array(failed), pa.array(kept), pa.array(score)],
                ["doc_id", *COUNTS[:5], "base_failed", "kept", "anomaly"])

    return _docs(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS[:5])
                                  + ", base_failed boolean, kept boolean, anomaly double")


def keep_good(docs: DataFrame, forest: Forest) -> DataFrame:
    """The rows of ``docs``, all columns, that pass base rules and forest; repeated rows stay."""
    plain = small_batches(docs).select(packed(docs), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            c = rule_counts(*utf8(part.column(1)))
            score = anomaly(forest, features(c)) if forest.trees else np.zeros(part.num_rows)
            kept = ~base_failed(c) & (score <= (np.inf if forest.limit is None else forest.limit))
            yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(kept))], ["row"])

    return unpacked(plain.mapInArrow(run, packed_schema(docs)), docs)
