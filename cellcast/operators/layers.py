"""Layers: named sparse rasters ``(layer, period_h, row, col, value)``.

A layer stores the non-zero in-extent cells of one raster per period; zeros are
implicit. Which periods *have* a raster (even an all-zero one) is tracked
separately in the period manifest, taken before the extent gate, because a
period whose trips all fall outside the grid still has a raster.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellcast.functions.grid import GridSpec, in_extent
from cellcast.operators.lags import LAG_OFFSETS

LONG = ["layer", "period_h", "row", "col", "value"]

# Layer names and the two feature orderings.
OBSERVED = "observed"
BASE_LAYERS = ["two_hour", "four_hour", "eight_hour", "previous_day", "previous_week"]
SMOOTHED_BASES = ["two_hour", "four_hour", "eight_hour"]
MAIN_ORDERING = [
    "two_hour", "two_hour_kd", "two_hour_neighbor_avg",
    "four_hour", "four_hour_kd", "four_hour_neighbor_avg",
    "eight_hour", "eight_hour_kd", "eight_hour_neighbor_avg",
    "previous_day", "previous_week",
]
OLDER_ORDERING = ["two_hour", "four_hour", "eight_hour", "previous_day", "previous_week"]


def rasterize(df: DataFrame, grid: GridSpec, value_col: str = "n", unique_keys: bool = False) -> DataFrame:
    """Extent gate + per-cell sum -> ``(period_h, row, col, value)``.

    Repeated cells add up. ``unique_keys=True`` skips the aggregation (and its
    shuffle) when the input already has one row per key, as counts and lag
    layers do.
    """
    gated = df.filter(in_extent(F.col("row"), F.col("col"), grid)).select(
        "period_h", "row", "col", F.col(value_col).cast("double").alias("value"))
    if unique_keys:
        return gated
    return gated.groupBy("period_h", "row", "col").agg(F.sum("value").alias("value"))


def tag_layer(raster: DataFrame, name: str) -> DataFrame:
    """``(period_h, row, col, value)`` -> long form with ``layer = name``."""
    return raster.select(F.lit(name).alias("layer"), "period_h", "row", "col", "value")


def union_layers(layers: list[DataFrame]) -> DataFrame:
    """Bag union of long layers (no de-duplication)."""
    return reduce(lambda a, b: a.unionByName(b), layers)


def wide_to_long(wide: DataFrame, names: list[str]) -> DataFrame:
    """Sparse wide table -> long layers, dropping NULL (absent) and zero cells."""
    stacked = wide.select("period_h", "row", "col", F.explode(F.array(*[
        F.struct(F.lit(k).alias("layer"), F.col(k).cast("double").alias("value")) for k in names
    ])).alias("s"))
    return stacked.select("s.layer", "period_h", "row", "col", "s.value").filter(
        F.col("value").isNotNull() & (F.col("value") != 0))


def pivot_layers(long: DataFrame, names: list[str]) -> DataFrame:
    """Long -> wide ``(period_h, row, col, <name>...)``; NULL where a layer has no cell.
    Each (period, cell) holds at most one value per layer, so ``first`` is exact."""
    return long.groupBy("period_h", "row", "col").pivot("layer", list(names)).agg(F.first("value"))


# ---- period manifest and eligibility ------------------------------------------------

def observed_periods(counts: DataFrame) -> DataFrame:
    """Hours with at least one trip anywhere (out-of-extent trips count)."""
    return counts.select("period_h").distinct()


def period_manifest(counts: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``(layer, period_h)`` for every layer raster that exists.

    Built from the distinct observed hours (at most one row per hour), not from
    cell rows: a lag layer exists at q when the observed layer exists at q - x
    for one of its offsets, and a smoothed layer exists whenever its base does.
    """
    names = names or ([OBSERVED] + MAIN_ORDERING)
    pairs = []
    for name in names:
        for x in LAG_OFFSETS[_base_of(name)]:
            pairs.append(F.struct(F.lit(name).alias("layer"), F.lit(x).alias("x")))
    hours = observed_periods(counts)
    fan = hours.select(F.explode(F.array(*pairs)).alias("p"), "period_h")
    return fan.select(F.col("p.layer").alias("layer"),
                      (F.col("period_h") + F.col("p.x")).cast("int").alias("period_h")).distinct()


def eligible_periods(manifest: DataFrame, ordering: list[str] = MAIN_ORDERING) -> DataFrame:
    """Periods with an observed raster whose other layers are exactly ``ordering``."""
    want = F.array_sort(F.array(*[F.lit(k) for k in ordering]))
    per = manifest.groupBy("period_h").agg(F.collect_set("layer").alias("layers"))
    return per.filter(
        F.array_contains("layers", OBSERVED)
        & (F.array_sort(F.array_remove("layers", OBSERVED)) == want)
    ).select("period_h")


# ---- the layer stack ----------------------------------------------------------------

def _base_of(name: str) -> str:
    for suffix in ("_kd", "_neighbor_avg"):
        if name.endswith(suffix):
            return name[: -len(suffix)]
    return name


def long_layers(counts: DataFrame, grid: GridSpec, ordering: list[str] = MAIN_ORDERING,
                sigma: float = 1.0, truncate: float = 4.0, focal_size: int = 1) -> DataFrame:
    """The labelled layer union (observed + ``ordering``) in long form.

    Base layers come from one fused lag aggregation; the smoothed layers run
    one filter over the union of their bases, keyed by layer.
    """
    from cellcast.operators import lags, smooth

    bases = [OBSERVED] + sorted({_base_of(k) for k in ordering}, key=ordering_index(ordering))
    wide = lags.lag_layers(counts, bases)
    base_long = wide_to_long(
        wide.filter(in_extent(F.col("row"), F.col("col"), grid)), bases)
    parts = [base_long.filter(F.col("layer").isin(*([OBSERVED] + [k for k in ordering if k == _base_of(k)])))]
    kd = [k for k in ordering if k.endswith("_kd")]
    nb = [k for k in ordering if k.endswith("_neighbor_avg")]
    if kd:
        src = base_long.filter(F.col("layer").isin(*[_base_of(k) for k in kd]))
        parts.append(smooth.kernel_density(src, grid, sigma, truncate).select(
            F.concat(F.col("layer"), F.lit("_kd")).alias("layer"), "period_h", "row", "col", "value"))
    if nb:
        src = base_long.filter(F.col("layer").isin(*[_base_of(k) for k in nb]))
        parts.append(smooth.focal_mean(src, grid, focal_size).select(
            F.concat(F.col("layer"), F.lit("_neighbor_avg")).alias("layer"), "period_h", "row", "col", "value"))
    return union_layers(parts)


def ordering_index(ordering):
    order = {k: i for i, k in enumerate(ordering)}
    return lambda k: order.get(k, len(order))


def wide_layers(counts: DataFrame, grid: GridSpec, ordering: list[str] = MAIN_ORDERING,
                sigma: float = 1.0, truncate: float = 4.0, focal_size: int = 1) -> DataFrame:
    """Sparse wide table ``(period_h, row, col, observed, <ordering>...)``, in-extent cells.

    Shuffles: one of the counts by cell for all lag layers, one by period, which both
    smoothing axes and the final per-cell aggregation share (a period is bounded by the
    grid). The last column pass is summed inside that aggregation, which also lays the
    layers side by side. A size-1 focal mean is its base column.
    """
    from cellcast.operators import lags, smooth

    bases = [OBSERVED] + sorted({_base_of(k) for k in ordering}, key=ordering_index(ordering))
    base_wide = lags.lag_layers(counts, bases).filter(in_extent(F.col("row"), F.col("col"), grid))
    kd = [k for k in ordering if k.endswith("_kd")]
    nb = [k for k in ordering if k.endswith("_neighbor_avg")]
    need_long = [k for k in ordering if k in kd or (k in nb and focal_size != 1)]
    if not need_long:
        return base_wide.select("period_h", "row", "col", OBSERVED,
                                *[F.col(_base_of(k)).alias(k) for k in ordering])
    base_long = wide_to_long(base_wide.repartition("period_h"), bases)
    streams = [base_long]
    for suffix, kernel in (("_kd", smooth.gaussian_kernel(sigma, truncate)),
                           ("_neighbor_avg", smooth.uniform_kernel(focal_size))):
        names = [k for k in need_long if k.endswith(suffix)]
        if not names:
            continue
        src = base_long.filter(F.col("layer").isin(*[_base_of(k) for k in names]))
        src = src.select(F.concat(F.col("layer"), F.lit(suffix)).alias("layer"), "period_h", "row", "col", "value")
        rows_done = smooth.axis_pass(src, kernel, "row", grid.n_rows, ["layer", "period_h"])
        streams.append(smooth.scatter_axis(rows_done, kernel, "col", grid.n_cols, ["layer", "period_h"])
                       .select("layer", "period_h", "row", "col", "value"))
    allv = union_layers(streams)
    aggs = [F.sum(F.when(F.col("layer") == OBSERVED, F.col("value"))).alias(OBSERVED)]
    for k in ordering:
        src_name = _base_of(k) if (k in nb and focal_size == 1) else k
        aggs.append(F.sum(F.when(F.col("layer") == src_name, F.col("value"))).alias(k))
    return allv.groupBy("period_h", "row", "col").agg(*aggs)
