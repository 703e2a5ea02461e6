"""Trailing and lagged counts per cell.

The generic form is a fan-out: each input row ``(cell, q, v)`` is copied to
``(cell, q + x, v)`` for every offset ``x`` and the copies are summed. Unlike a
range window, this yields rows at later hours where the cell had no trip, which
is what a dense raster of the trailing sum contains.

:func:`lag_layers` computes every base layer (observed, 2 h, 4 h, 8 h,
previous day, previous week) together: the counts are exchanged by cell, and
within each task 11 offsets fan out at once and conditional sums pick each
layer, so that only un-copied counts cross the network. The per-layer functions remain for composition and tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellcast.functions.periods import shift_period

KEYS = ["period_h", "row", "col"]


def offsets(start: int, end: int, step: int) -> list[int]:
    """The offsets ``range(start, end, step)``; empty when the range is empty."""
    return list(range(int(start), int(end), int(step)))


def trailing_sum(df: DataFrame, start: int, end: int, step: int = 1,
                 value_col: str = "n", out_col: str = "n", strict: bool = False) -> DataFrame:
    """result(q) = sum of ``value_col`` at q - x for x in ``range(start, end, step)``.
    ``strict`` fails when a shifted period leaves the 2012-2015 hour calendar."""
    xs = offsets(start, end, step)
    if not xs:
        return df.filter(F.lit(False)).select(*KEYS, F.col(value_col).alias(out_col))
    if len(xs) == 1:
        # A single offset is a shift: a projection, no shuffle (keys stay unique).
        return df.select(shift_period(F.col("period_h"), xs[0], strict).alias("period_h"),
                         "row", "col", F.col(value_col).alias(out_col))
    fan = df.select(F.explode(F.array(*[F.lit(x) for x in xs])).alias("_x"), "row", "col",
                    "period_h", value_col)
    return (fan.select(shift_period(F.col("period_h"), F.col("_x"), strict).alias("period_h"),
                       "row", "col", value_col)
            .groupBy(*KEYS).agg(F.sum(value_col).alias(out_col)))


def two_hour(counts: DataFrame) -> DataFrame:
    """Trips in the two previous hours (q-1, q-2)."""
    return trailing_sum(counts, 1, 3, 1)


def four_hour(two: DataFrame) -> DataFrame:
    """q-1..q-4, built as a pyramid over the two-hour layer."""
    return trailing_sum(two, 0, 4, 2)


def eight_hour(four: DataFrame) -> DataFrame:
    """q-1..q-8, built as a pyramid over the four-hour layer."""
    return trailing_sum(four, 0, 8, 4)


def previous_day(counts: DataFrame) -> DataFrame:
    """Same hour yesterday."""
    return trailing_sum(counts, 24, 25, 1)


def previous_week(counts: DataFrame) -> DataFrame:
    """Same hour last week."""
    return trailing_sum(counts, 168, 169, 1)


# Offsets (hours back) each base layer sums.
LAG_OFFSETS = {
    "observed": [0],
    "two_hour": [1, 2],
    "four_hour": [1, 2, 3, 4],
    "eight_hour": [1, 2, 3, 4, 5, 6, 7, 8],
    "previous_day": [24],
    "previous_week": [168],
}


def lag_layers(counts: DataFrame, layers=tuple(LAG_OFFSETS), by_cell: bool = False) -> DataFrame:
    """Sparse wide table ``(period_h, row, col, <layer>...)`` in one shuffle of the counts.

    The counts are partitioned by cell before they fan out: all hours of a cell meet in
    one task, so the sums need no second exchange. A cell has one count per hour, however
    many trips it had. ``by_cell`` says that they are partitioned so already
    (``counts.write_by_cell``).

    A layer column is NULL where that layer has no row (a zero of the dense
    raster); a row exists where at least one requested layer has one.
    """
    wanted = {k: LAG_OFFSETS[k] for k in layers}
    xs = sorted({x for v in wanted.values() for x in v})
    placed = counts.select("period_h", "row", "col", "n")
    fan = (placed if by_cell else placed.repartition("row", "col")).select(
        F.explode(F.array(*[F.lit(x) for x in xs])).alias("_x"), "period_h", "row", "col", "n")
    fan = fan.select((F.col("period_h") + F.col("_x")).cast("int").alias("period_h"),
                     "row", "col", "_x", "n")
    aggs = []
    for name, offs in wanted.items():
        hit = F.col("_x").isin(*offs) if len(offs) > 1 else (F.col("_x") == offs[0])
        aggs.append(F.sum(F.when(hit, F.col("n"))).cast("double").alias(name))
    return fan.groupBy(*KEYS).agg(*aggs)


def trailing_window(counts: DataFrame, start: int, end: int) -> DataFrame:
    """Like :func:`trailing_sum` over ``range(start, end)``, by a RANGE frame.

    A frame yields rows where its input has rows only, so every cell is made dense first, from
    its first hour to the last one that its trips reach. One exchange by cell serves the ends,
    the join and the window; a cell's rows are bounded by the hours of the calendar.
    """
    if end <= start:
        return trailing_sum(counts, start, end)
    cells = counts.select(*KEYS, "n").repartition("row", "col")
    ends = cells.groupBy("row", "col").agg(F.min("period_h").alias("lo"), F.max("period_h").alias("hi"))
    spine = ends.select(F.explode(F.sequence(F.col("lo"), F.col("hi") + (end - 1))).alias("period_h"), "row", "col")
    frame = Window.partitionBy("row", "col").orderBy("period_h").rangeBetween(-(end - 1), -start)
    dense = spine.join(cells.hint("merge"), KEYS, "left")
    return dense.select(*KEYS, F.sum("n").over(frame).alias("n")).filter(F.col("n").isNotNull())
