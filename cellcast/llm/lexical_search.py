"""Ranked lexical search by an Aho-Corasick scan of the documents.

The terms of all items form one automaton. Each is guarded by a blank on either side, and
texts are folded first (A-Z to lower case, every character outside of terms to a blank), so
that the automaton reports whole terms only. Documents are scanned as they are, without an
index of them: a first scan counts how many documents hold each term, a second one scores,
and every task keeps the best ``TOP`` documents per item only. The outputs of the automaton
are numbers of terms, which lead to the items that hold them.

The score is integer arithmetic throughout: a term's weight is
``floor(1000 * ln((2 N + 2) / (2 df + 1)))``, a document's length factor
``10 + (90 * n * N) div L``, and a document gains ``w * ((10**9 * tf) div (1000 tf + 8 m))``
for each term of the item, once. Sums are exact up to 2**53.

Items are taken in blocks of at most ``BLOCK_BYTES`` of distinct terms (one item at least),
the only thing sent to all executors; each block costs two scans and is released when its
best documents are written. What the tasks found is ranked in two steps, so that no task
ever gets more than ``TOP`` rows of an item from each of ``SALTS`` groups.

Terms are runs of ASCII digits and letters and of characters beyond ASCII. A null text, or
one without terms, is no hit and counts nowhere; an item without terms has no rows. Rows
with equal item ids are one item with the terms of all. Repeated documents rank each for
itself, equal scores by ascending id, null ids last. Empty tables give empty results.
Columns beyond id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellcast.llm.text import find_words, slices, small_batches, utf8
from cellcast.session import scratch_dir

TOP = 10
BLOCK_BYTES = 2 << 20
SCAN_BYTES = 1 << 19
SALTS = 64
CELLS = 1 << 21
#: Numbers that stand for the counts of documents and of terms among the counts by term.
N_DOCS, N_TERMS = -1, -2

_TERM = np.zeros(256, bool)
for _lo, _hi in ((48, 57), (65, 90), (97, 122), (128, 255)):
    _TERM[_lo:_hi + 1] = True
#: Bytes of terms with A-Z in lower case, blanks for all others.
_FOLD = np.where(_TERM, np.arange(256), 32).astype(np.uint8)
_FOLD[65:91] += 32


class Block(NamedTuple):
    """Some items: their ids, the terms of all, and per term the range of its items."""
    ids: list[int | None]
    terms: tuple[bytes, ...]
    first: np.ndarray  # terms + 1
    items: np.ndarray


def terms_of(text: str | None) -> set[bytes]:
    data = np.frombuffer((text or "").encode(), np.uint8)
    words = find_words(data, np.array([0, len(data)]), _TERM)
    raw = _FOLD[data].tobytes()
    return {raw[a:b] for a, b in zip(words.start, words.end, strict=True)}


def block_of(items: dict[int | None, set[bytes]]) -> Block:
    ids = sorted(items, key=lambda x: (x is None, x or 0))
    holders: dict[bytes, list[int]] = {}
    for k, item_id in enumerate(ids):
        for term in items[item_id]:
            holders.setdefault(term, []).append(k)
    terms = tuple(sorted(holders))
    first = np.concatenate([[0], np.cumsum([len(holders[t]) for t in terms], dtype=np.int64)]).astype(np.int64)
    return Block(ids, terms, first, np.array([k for t in terms for k in holders[t]], np.int64))


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The items, by id, in blocks of a bounded size; rows arrive one at a time."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    held: dict[int | None, set[bytes]] = {}
    size = 0
    for row in rows.orderBy("item_id").toLocalIterator():
        if row.item_id not in held and size >= block_bytes:
            yield block_of(held)
            held, size = {}, 0
        new = terms_of(row.text) - held.get(row.item_id, set())
        held.setdefault(row.item_id, set()).update(new)
        size += sum(map(len, new))
    if held:
        yield block_of(held)


@lru_cache(maxsize=1)
def automaton(terms: tuple[bytes, ...]) -> ahocorasick.Automaton:
    """Bytes are read as Latin-1 characters, so that the automaton works on UTF-8."""
    a = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        a.add_word(f" {term.decode('latin-1')} ", k)
    a.make_automaton()
    return a


def scan(column: pa.Array, terms: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(n, row, term, tf)``: all terms of each row, and how often a row holds a listed term."""
    data, offs = utf8(column)
    n = np.diff(find_words(data, offs, _TERM).first)
    none = np.zeros(0, np.int64)
    if not terms or not n.any():
        return n, none, none, none
    # A blank before each row and one at the end guard the outermost terms.
    guarded = np.append(np.insert(_FOLD[data], offs[:-1], 32), 32).astype(np.uint8).tobytes().decode("latin-1")
    hits = np.fromiter(chain.from_iterable(automaton(terms).iter(guarded)), np.int64).reshape(-1, 2)
    begin = offs[:-1] + np.arange(len(n))
    row = np.searchsorted(begin, hits[:, 0] - 1, "right") - 1
    key, tf = np.unique(row * len(terms) + hits[:, 1], return_counts=True)
    return n, key // len(terms), key % len(terms), tf


def count_terms(texts: DataFrame, terms) -> DataFrame:
    """Documents that hold each term, and the numbers of documents and of terms: one row per
    count, ``(term, count)``. ``terms`` is a broadcast of a block's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = terms.value
        held, documents, total = np.zeros(len(listed), np.int64), 0, 0
        for part in slices(batches, "text", SCAN_BYTES):
            n, _, term, _ = scan(part.column(1), listed)
            held += np.bincount(term, minlength=len(listed))
            documents, total = documents + int((n > 0).sum()), total + int(n.sum())
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [N_DOCS, N_TERMS]), pa.int64()),
                                          pa.array(np.append(held[some], [documents, total]), pa.int64())], ["term", "count"])

    return texts.mapInArrow(run, "term long, count long").groupBy("term").agg(F.sum("count").alias("count"))


class Best:
    """The ``top`` best documents of each item seen so far."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.null = np.zeros(0, bool)
        self.least = np.ones(n_items, np.int64)  # the score that a new document must reach

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        item, score = np.append(self.item, item), np.append(self.score, score)
        doc, null = np.append(self.doc, doc), np.append(self.null, null)
        order = np.lexsort((doc, null, -score, item))
        rank = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        order, rank = order[rank < self.top], rank[rank < self.top]
        self.item, self.score, self.doc, self.null = item[order], score[order], doc[order], null[order]
        full = rank == self.top - 1
        self.least[self.item[full]] = self.score[full]


def scores(row: np.ndarray, term: np.ndarray, gain: np.ndarray, n_rows: int, block: Block) -> np.ndarray:
    """Summed gains by row and item; the outputs of the automaton are mapped to items here."""
    width = len(block.ids)
    total = np.zeros(n_rows * width)
    spread = np.diff(block.first)[term]
    upto = np.cumsum(spread)
    at = 0
    while at < len(row):  # so many terms at once as lead to about CELLS cells
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CELLS, "right")))
        each = np.repeat(np.arange(at, end), spread[at:end])
        nth = np.arange(len(each)) - np.repeat(upto[at:end] - spread[at:end] - (upto[at - 1] if at else 0), spread[at:end])
        cell = row[each] * width + block.items[block.first[term[each]] + nth]
        total += np.bincount(cell, weights=gain[each], minlength=len(total))
        at = end
    return total.astype(np.int64).reshape(n_rows, width)


def best_documents(texts: DataFrame, shared, top: int = TOP) -> DataFrame:
    """Each task's best documents per item: ``(item_id, doc_id, score)``. ``shared`` is a
    broadcast of a block, its terms' weights and the numbers of documents and of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weight, documents, total = shared.value
        best = Best(len(block.ids), top)
        step = max(1, CELLS // max(1, len(block.ids)))
        for part in slices(batches, "text", SCAN_BYTES):
            n, row, term, tf = scan(part.column(1), block.terms)
            if not len(row):
                continue
            m = 10 + (90 * n * documents) // total
            gain = weight[term] * ((10**9 * tf) // (1000 * tf + 8 * m[row]))
            null = part.column(0).is_null().to_numpy(zero_copy_only=False)
            doc = part.column(0).fill_null(0).to_numpy()
            for at in range(0, len(n), step):
                a, b = np.searchsorted(row, [at, at + step])
                table = scores(row[a:b] - at, term[a:b], gain[a:b], min(step, len(n) - at), block)
                r, item = np.nonzero(table >= best.least)
                best.add(item, table[r, item], doc[r + at], null[r + at])
        yield pa.RecordBatch.from_arrays([
            pa.array([block.ids[k] for k in best.item], pa.int64()), pa.array(best.doc, pa.int64(), mask=best.null),
            pa.array(best.score, pa.int64())], ["item_id", "doc_id", "score"])

    return texts.mapInArrow(run, "item_id long, doc_id long, score long")


def term_weights(counts: dict[int, int], n_terms: int) -> np.ndarray:
    documents = counts.get(N_DOCS, 0)
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * counts.get(k, 0) + 1))) for k in range(n_terms)], np.int64)


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` best rows of each item, numbered; first within groups of documents."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    few = (found.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order)))
           .filter(F.col("rank") <= top).select("item_id", "doc_id", "score"))
    return (few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
            .filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score"))


def search(docs: DataFrame, items: DataFrame, folder: str | None = None, top: int = TOP,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` documents of each item, best first."""
    spark = docs.sparkSession
    folder = folder or scratch_dir(spark, "search")
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    paths = []
    for block in item_blocks(items, block_bytes):
        terms = spark.sparkContext.broadcast(block.terms)
        counts = {r.term: r["count"] for r in count_terms(texts, terms).collect()}  # one row per listed term
        terms.destroy()
        if not counts.get(N_DOCS):
            break
        shared = spark.sparkContext.broadcast((block, term_weights(counts, len(block.terms)), counts[N_DOCS], counts[N_TERMS]))
        paths.append(f"{folder}/{len(paths)}")
        best_documents(texts, shared, top).write.parquet(paths[-1])
        shared.destroy()
    if not paths:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return ranked(spark.read.parquet(*paths), top)
