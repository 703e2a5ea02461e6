"""Neighbourhood filters on sparse layers: Gaussian kernel density and focal mean.

A separable filter is applied one axis at a time (rows, then columns). Each
pass is a scatter: a source cell sends ``value * w`` to every target whose
window reads it, then targets are summed with ``groupBy`` (partial aggregation
before the shuffle). Only cells within the kernel radius of a non-zero cell are
produced, so work follows the data, not the grid.

Edges use reflection (``d c b a | a b c d | d c b a``). For a kernel defined
by gather, ``out[i] = sum_k w_k * in[reflect(i + k)]``, the source ``s`` is
read by target ``i = p - k`` for each ``p`` of ``s``'s mirror images
``{s, -s-1, 2N-1-s}`` that lands in ``[0, N)``; that holds for asymmetric
kernels too, as long as the radius does not exceed ``N``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellcast.functions.grid import GridSpec


def gaussian_kernel(sigma: float = 1.0, truncate: float = 4.0) -> list[tuple[int, float]]:
    """Normalised 1-D Gaussian taps ``(offset, weight)``, radius ``int(truncate*sigma + 0.5)``."""
    radius = int(truncate * sigma + 0.5)
    raw = [(k, math.exp(-0.5 * k * k / (sigma * sigma))) for k in range(-radius, radius + 1)]
    total = sum(w for _, w in raw)
    return [(k, w / total) for k, w in raw]


def uniform_kernel(size: int = 1) -> list[tuple[int, float]]:
    """Mean over ``size`` cells; window ``[i - size//2, i + size - size//2 - 1]``."""
    if size < 1:
        raise ValueError("size must be >= 1")
    return [(j - size // 2, 1.0 / size) for j in range(size)]


def scatter_axis(df: DataFrame, kernel, axis: str, n: int, keys: list[str]) -> DataFrame:
    """One axis of a separable filter, before summing: one row per (source, target)."""
    radius = max(abs(k) for k, _ in kernel)
    if radius > n:
        raise ValueError(f"kernel radius {radius} exceeds axis length {n}")
    other = "col" if axis == "row" else "row"
    s = F.col(axis)
    def taps(m):
        return F.array(*[F.struct(F.lit(m).alias("m"), F.lit(k).alias("k"), F.lit(w).alias("w"))
                         for k, w in kernel])
    # Mirror images only matter within the radius of an edge; interior cells
    # emit one tap per kernel offset.
    none = F.slice(taps(0), 1, 0)
    all_taps = F.concat(taps(0),
                        F.when(s < radius, taps(1)).otherwise(none),
                        F.when(s >= n - radius, taps(2)).otherwise(none))
    fan = df.select(*keys, other, s.alias("_s"), "value", F.explode(all_taps).alias("_t"))
    mirror = (F.when(F.col("_t.m") == 0, F.col("_s"))
              .when(F.col("_t.m") == 1, -F.col("_s") - 1)
              .otherwise(2 * n - 1 - F.col("_s")))
    target = (mirror - F.col("_t.k")).cast("int")
    moved = fan.select(*keys, other, target.alias(axis), (F.col("value") * F.col("_t.w")).alias("value"))
    return moved.filter(F.col(axis).between(0, n - 1)).select(*keys, "row", "col", "value")


def axis_pass(df: DataFrame, kernel, axis: str, n: int, keys: list[str]) -> DataFrame:
    moved = scatter_axis(df, kernel, axis, n, keys)
    return moved.groupBy(*keys, "row", "col").agg(F.sum("value").alias("value"))


def separable_filter(layers: DataFrame, kernel, grid: GridSpec,
                     keys=("layer", "period_h")) -> DataFrame:
    """Apply a 1-D kernel along rows then columns to every (layer, period) raster."""
    keys = list(keys)
    if len(kernel) == 1 and kernel[0][0] == 0:
        w = kernel[0][1]
        return layers.select(*keys, "row", "col", (F.col("value") * (w * w)).alias("value"))
    rows_done = axis_pass(layers.select(*keys, "row", "col", "value"), kernel, "row", grid.n_rows, keys)
    return axis_pass(rows_done, kernel, "col", grid.n_cols, keys)


def kernel_density(layers: DataFrame, grid: GridSpec, sigma: float = 1.0, truncate: float = 4.0,
                   keys=("layer", "period_h")) -> DataFrame:
    """Gaussian smoothing (sigma 1, radius 4 by default); mass is preserved."""
    return separable_filter(layers, gaussian_kernel(sigma, truncate), grid, keys)


def focal_mean(layers: DataFrame, grid: GridSpec, size: int = 1, keys=("layer", "period_h")) -> DataFrame:
    """Uniform ``size x size`` mean; ``size=1`` is the identity."""
    return separable_filter(layers, uniform_kernel(size), grid, keys)


def running_axis(df: DataFrame, size: int, axis: str, n: int, keys: list[str]) -> DataFrame:
    """Sums over ``size`` cells along one axis, by running sums.

    A line of the raster (one per row or column that has a non-zero cell) is laid out with its
    mirrored edges, ``n + size - 1`` places; a window sum is the difference of two running
    sums, so the work per place does not depend on ``size``. Cells are counted the same way,
    so that a window without any has no row, whatever the last bits of the sums.
    """
    other = "col" if axis == "row" else "row"
    left, right = size // 2, size - 1 - size // 2
    line = [*keys, other]
    at = F.explode(F.sequence(F.lit(-left), F.lit(n - 1 + right))).alias("_p")
    lines = df.select(*keys, "row", "col", "value").repartition(*line)
    places = lines.select(*line).distinct().select(*line, at)
    turn = F.pmod(F.col("_p"), F.lit(2 * n))
    places = places.withColumn(axis, F.when(turn < n, turn).otherwise(2 * n - 1 - turn).cast("int"))
    laid = places.join(lines.hint("merge"), [*line, axis], "left")
    upto = Window.partitionBy(*line).orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = laid.select(*line, "_p", F.sum(F.coalesce("value", F.lit(0.0))).over(upto).alias("_s"), F.count("value").over(upto).alias("_c"))
    order = Window.partitionBy(*line).orderBy("_p")

    def span(c: str):
        return F.lead(c, right).over(order) - F.coalesce(F.lag(c, left + 1).over(order), F.lit(0))

    out = run.select(*line, F.col("_p").cast("int").alias(axis), span("_s").alias("value"), span("_c").alias("_c"))
    return out.filter(F.col(axis).between(0, n - 1) & (F.col("_c") > 0)).select(*keys, "row", "col", "value")


def wide_focal_mean(layers: DataFrame, grid: GridSpec, size: int, keys=("layer", "period_h")) -> DataFrame:
    """:func:`focal_mean` for large windows: the cost per cell does not grow with ``size``, which
    may exceed the axes. Sums of whole numbers are exact until they are divided."""
    if size < 1:
        raise ValueError("size must be >= 1")
    keys = list(keys)
    rows_done = running_axis(layers, size, "row", grid.n_rows, keys)
    both = running_axis(rows_done, size, "col", grid.n_cols, keys)
    return both.select(*keys, "row", "col", (F.col("value") / float(size * size)).alias("value"))
