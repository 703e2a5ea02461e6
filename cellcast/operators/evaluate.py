"""Concentration of demand: how much of a raster's total its top cells hold.

For each (period, layer) raster, the values of the top 1, 5, 10 and 20 % of the
evaluation area are summed, greatest first. Only stored (non-zero) cells count;
zeros add nothing to a prefix sum because all values are non-negative.

No cell is ranked: which of several equal cells comes first does not change a
sum, so a raster is a histogram of its values, combined in the map tasks, and
the window runs over its distinct values. ``ranked_top_share`` ranks the cells
and gives the same sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The share cut-offs and their column names.
SHARE_FRACTIONS = [("one_percent", 0.01), ("five_percent", 0.05),
                   ("ten_percent", 0.10), ("twenty_percent", 0.20)]
STAT_COLUMNS = [name for name, _ in SHARE_FRACTIONS] + ["total"]


def top_k_sizes(area: int) -> dict[str, int]:
    """Cells in each top share, truncated like ``int(area * fraction)``."""
    return {name: int(area * f) for name, f in SHARE_FRACTIONS}


def _sizes(area) -> dict:
    """``area`` is an int or a Column, e.g. a scalar subquery that counts the mask cells, which
    keeps the count inside the same plan."""
    if isinstance(area, int):
        return top_k_sizes(area)
    return {name: F.floor(area.cast("double") * f) for name, f in SHARE_FRACTIONS}


def top_share(layers: DataFrame, area, keys=("period_h", "layer")) -> DataFrame:
    """``(period_h, layer, one_percent, five_percent, ten_percent, twenty_percent, total)``.

    The exchange by raster carries one row per distinct value, at most one per grid cell.
    """
    keys = list(keys)
    histogram = layers.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_n"))
    above = Window.partitionBy(*keys).orderBy(F.col("value").desc()).rowsBetween(Window.unboundedPreceding, -1)
    placed = histogram.select(*keys, "value", "_n", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"))

    def taken(k):
        return F.greatest(F.lit(0), F.least(F.col("_n"), k - F.col("_above")))

    aggs = [F.sum(F.col("value") * taken(F.lit(k) if isinstance(k, int) else k)).alias(name) for name, k in _sizes(area).items()]
    return placed.groupBy(*keys).agg(*aggs, F.sum(F.col("value") * F.col("_n")).alias("total"))


def ranked_top_share(layers: DataFrame, area, keys=("period_h", "layer")) -> DataFrame:
    """The same by ranking every cell, ties broken by cell: one window per raster."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(F.col("value").desc(), "row", "col")
    ranked = layers.select(*keys, "value", F.row_number().over(w).alias("_rn"))
    aggs = [F.coalesce(F.sum(F.when(F.col("_rn") <= k, F.col("value"))), F.lit(0.0)).alias(name)
            for name, k in _sizes(area).items()]
    return ranked.groupBy(*keys).agg(*aggs, F.sum("value").alias("total"))


def common_periods(*period_sets: DataFrame) -> DataFrame:
    """Periods present in every input (semi joins on a small key)."""
    out = period_sets[0].select("period_h").distinct()
    for other in period_sets[1:]:
        out = out.join(other.select("period_h"), "period_h", "left_semi")
    return out


def combined_stats(rasters: dict[str, DataFrame], periods: dict[str, DataFrame], area) -> DataFrame:
    """Stats per period and layer for periods present in every named raster set.

    ``rasters[name]`` is ``(period_h, row, col, value)``; ``periods[name]`` lists
    the periods where that raster exists (an all-zero raster still counts).
    Periods without any stored cell get zero stats.
    """
    common = common_periods(*periods.values())
    parts = []
    for name, r in rasters.items():
        parts.append(r.join(common, "period_h", "left_semi").select(
            "period_h", F.lit(name).alias("layer"), "row", "col", "value"))
    allr = parts[0]
    for p in parts[1:]:
        allr = allr.unionByName(p)
    stats = top_share(allr, area)
    frame = common.select("period_h", F.explode(F.array(*[F.lit(n) for n in rasters])).alias("layer"))
    out = frame.join(stats, ["period_h", "layer"], "left")
    return out.select("period_h", "layer", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in STAT_COLUMNS])
