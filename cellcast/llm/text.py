"""Vectorised text kernels shared by the operators of this subpackage.

Texts arrive as Arrow string columns; the kernels work on the UTF-8 bytes of a
slice of rows with numpy, so that no Python object is made per word. A slice
holds at most ``SLICE_BYTES`` of text (or one document, if that is longer), which
bounds the memory of a task whatever the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 2 << 20
SHINGLE_WORDS = 5
BATCH_ROWS = 1000

_MULT = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX_B
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null row is an empty one."""
    column = pa.concat_arrays([column]) if column.offset else column
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    start = column.offset
    offs = np.frombuffer(offsets, np.int32)[start:start + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offs[0]:offs[-1]], offs - offs[0]


def small_batches(df: DataFrame) -> DataFrame:
    """Have Spark send rows to Python in batches of at most ``BATCH_ROWS`` rows, so that what a
    task holds at once, in the JVM and in Python, stays a few MB of ordinary texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with at most ``limit`` bytes of text each."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        _, offs = utf8(col)
        at = 0
        while at < n:
            end = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
            end = min(max(end, at + 1), n)
            yield batch.slice(at, end - at)
            at = end
    pa.default_memory_pool().release_unused()  # workers are reused: give back what the task took


# Word bytes: ASCII letters, digits and underscore, and every byte of a non-ASCII
# character (so combining marks and scripts without case stay inside words).
_WORD = np.zeros(256, bool)
for _lo, _hi in ((48, 57), (65, 90), (95, 95), (97, 122), (128, 255)):
    _WORD[_lo:_hi + 1] = True
# White space as the contracts write it: U+0020 and U+0009 to U+000D.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SOLID = ~_SPACE


class Words(NamedTuple):
    """Words of a slice: byte spans, and per row the range of its words."""
    start: np.ndarray  # first byte
    end: np.ndarray    # one past the last byte
    first: np.ndarray  # rows + 1: words of row i are first[i]:first[i+1]


def find_words(data: np.ndarray, offs: np.ndarray, table: np.ndarray = _WORD) -> Words:
    inside = table[data]
    n = len(data)
    before = np.zeros(n, bool)
    after = np.zeros(n, bool)
    if n:
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        edge = offs[:-1]
        before[edge[edge < n]] = False
        last = offs[1:] - 1
        after[last[last >= 0]] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(start, offs))


def solid_words(data: np.ndarray, offs: np.ndarray) -> Words:
    """Maximal runs without white space."""
    return find_words(data, offs, _SOLID)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, at least ``n``."""
    if len(_powers[0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        inverse = pow(int(_MULT), -1, 1 << 64)
        for k, base in ((0, int(_MULT)), (1, inverse)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes, equal wherever the word stands."""
    n = len(data)
    if not len(words.start):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    h = (total[words.end] - total[words.start]) * inverse[words.start]
    return mix64(h ^ (words.end - words.start).astype(np.uint64))


def sequence_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of ``width`` consecutive values at each position (rows not regarded)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64) * _MIX_A
    for k in range(width):
        out = (out ^ h[k:k + n]) * _MULT
        out ^= out >> np.uint64(29)
    return mix64(out)


class Shingles(NamedTuple):
    """Shingle hashes of a slice; those of row i are value[first[i]:first[i+1]]."""
    value: np.ndarray
    first: np.ndarray


def shingles(h: np.ndarray, first: np.ndarray, width: int = SHINGLE_WORDS) -> Shingles:
    """Hashes of all runs of ``width`` words in each row, repeats included.

    A row with fewer words, but at least one, has one shingle: all its words. A row
    without words has none.
    """
    count = np.diff(first)
    n = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    out_first = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    value = np.empty(out_first[-1], np.uint64)
    full = sequence_hashes(h, width)
    row = np.repeat(np.arange(len(count)), n)
    at = np.arange(len(value)) - out_first[row] + first[row]
    long = count[row] >= width
    value[long] = full[at[long]]
    for i in np.flatnonzero((count > 0) & (count < width)):
        value[out_first[i]] = sequence_hashes(h[first[i]:first[i + 1]], int(count[i]))[0]
    return Shingles(value, out_first)


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each element, from the ranges of rows."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def packed(docs: DataFrame) -> Column:
    """All columns of a table as one, so that their names meet no others."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def packed_schema(docs: DataFrame, *more: T.StructField) -> T.StructType:
    return T.StructType([T.StructField("row", T.StructType(docs.schema.fields)), *more])


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
