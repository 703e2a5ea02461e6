"""The training/scoring table: one row per (eligible period, study-area cell).

Shape of the plan:

1. Dense keys. The mask cells are partitioned by cell; each task expands its cells
   over the eligible hours, which it has as one array (a scalar subquery: one
   number per hour). No other hour is ever produced, and no cross join is planned.
2. Layer values. The sparse wide layer table, restricted to eligible periods and
   mask cells, is partitioned by cell too and left-joined on ``(period_h, row,
   col)`` with a hash table on the sparse side; a missing row is a zero of the
   dense raster. The dense side, by far the larger one, is neither exchanged nor
   sorted after its expansion. One cell has at most one sparse row per hour.
3. Covariates. The static geo values (one row per grid cell) are attached by a
   broadcast join behind a bound on the grid's cells; weather has one row per hour
   and is left to Spark's own choice by size. Calendar parts are expressions of
   ``period_h``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellcast.functions.grid import GridSpec
from cellcast.functions.periods import WEEKDAY_COLUMNS, period_date, period_parts, weekday_onehot
from cellcast.operators.layers import MAIN_ORDERING, OBSERVED
from cellcast.sources.geo import GEO_LAYERS, bounded_broadcast
from cellcast.sources.weather import WEATHER_KEYS

CALENDAR_COLUMNS = ["month", "day", "hour"]
# Target size of one expansion task (rows), used to spread the mask.
ROWS_PER_TASK = 4_000_000


# Hours one expansion task is sized for (a leap year).
DEFAULT_SPAN_HOURS = 8784


def cell_partitions(grid: GridSpec, hours: int = DEFAULT_SPAN_HOURS) -> int:
    """Partitions by cell such that one expands about ``ROWS_PER_TASK`` rows."""
    return max(1, math.ceil(grid.n_cells * hours / ROWS_PER_TASK))


def dense_keys(eligible: DataFrame, mask: DataFrame, grid: GridSpec, hours: int = DEFAULT_SPAN_HOURS,
               by_cell: bool = False) -> DataFrame:
    """``(period_h, row, col)`` for every mask cell at every eligible period.

    The eligible hours are a scalar subquery of the same plan, one array with a number
    per hour. The result stays partitioned by cell; ``hours`` only sizes the tasks.
    ``by_cell`` says that the mask is partitioned so already.
    """
    periods = eligible.agg(F.sort_array(F.collect_set("period_h"))).scalar()
    cells = mask.select("row", "col")
    if not by_cell:
        cells = cells.repartition(cell_partitions(grid, hours), "row", "col")
    return cells.select(F.explode(periods).alias("period_h"), "row", "col")


def calendar_columns(h: Column) -> dict[str, Column]:
    """month, day, hour and the seven weekday indicators of a period."""
    out = dict(period_parts(h))
    out.update(weekday_onehot(period_date(h)))
    return out


def feature_columns(ordering: list[str] = MAIN_ORDERING, repeat_static: bool = False,
                    weather: bool = True) -> list[str]:
    """Feature order: row, col, month, day, hour, 7 weekday, 23 weather, then per
    layer its value (followed by the 6 geo values when ``repeat_static``); without
    repetition the geo values come once at the end."""
    cols = ["row", "col"] + CALENDAR_COLUMNS + WEEKDAY_COLUMNS + (WEATHER_KEYS if weather else [])
    for k in ordering:
        cols.append(k)
        if repeat_static:
            cols.extend(GEO_LAYERS)
    if not repeat_static:
        cols.extend(GEO_LAYERS)
    return cols


def feature_table(wide: DataFrame, eligible: DataFrame, mask: DataFrame, geo: DataFrame,
                  weather: DataFrame | None, grid: GridSpec, ordering: list[str] = MAIN_ORDERING,
                  on_missing_weather: str = "fail", hours: int = DEFAULT_SPAN_HOURS) -> DataFrame:
    """``(period_h, row, col, label, <feature columns>)`` with zeros filled at the join only.

    ``wide`` is the sparse wide layer table (``observed`` plus ``ordering``);
    ``geo`` is ``(row, col, <6 geo>)``; ``weather`` is ``(period_h, <23>)`` or None
    (the older job has no weather). ``on_missing_weather``: ``'fail'`` raises on a
    period without weather or with a blank value, ``'drop'`` removes such periods.
    """
    keys = dense_keys(eligible, mask, grid, hours)
    mask_b = bounded_broadcast(mask.select("row", "col"), grid.n_cells, 8)
    sparse = (wide.select("period_h", "row", "col", OBSERVED, *ordering)
              .join(eligible.select("period_h"), "period_h", "left_semi")
              .join(mask_b, ["row", "col"], "left_semi")
              .repartition(cell_partitions(grid, hours), "row", "col"))
    dense = keys.join(sparse.hint("shuffle_hash"), ["period_h", "row", "col"], "left")
    vals = [F.coalesce(F.col(k), F.lit(0.0)).cast("double").alias(k) for k in ordering]
    dense = dense.select("period_h", "row", "col",
                         F.coalesce(F.col(OBSERVED), F.lit(0.0)).cast("double").alias("label"), *vals)

    geo_b = bounded_broadcast(geo.select("row", "col", *GEO_LAYERS), grid.n_cells, 16 + 8 * len(GEO_LAYERS))
    out = dense.join(geo_b, ["row", "col"], "left")
    geo_cols = [F.coalesce(F.col(g), F.lit(0.0)).alias(g) for g in GEO_LAYERS]

    h = F.col("period_h")
    cal = calendar_columns(h)
    cal_cols = [cal[k].alias(k) for k in CALENDAR_COLUMNS + WEEKDAY_COLUMNS]
    if weather is None:
        return out.select("period_h", "row", "col", "label", *cal_cols, *ordering, *geo_cols)

    # Completeness is decided once per hour on the (small) weather side: ``_w``
    # is true for an hour with all 23 values and NULL after the join otherwise.
    complete = F.lit(True)
    for k in WEATHER_KEYS:
        complete = complete & F.col(k).isNotNull()
    w = weather.select("period_h", *WEATHER_KEYS).filter(complete).withColumn("_w", F.lit(True))
    out = out.join(w, "period_h", "left")
    if on_missing_weather == "fail":
        # Every weather column carries the check, so it survives column pruning.
        msg = F.concat(F.lit("no complete weather for period "), h.cast("string"))
        wcols = [F.when(F.col("_w").isNull(), F.raise_error(msg)).otherwise(F.col(k)).alias(k)
                 for k in WEATHER_KEYS]
    elif on_missing_weather == "drop":
        out = out.filter(F.col("_w").isNotNull())
        wcols = [F.col(k) for k in WEATHER_KEYS]
    else:
        raise ValueError("on_missing_weather must be 'fail' or 'drop'")
    return out.select("period_h", "row", "col", "label", *cal_cols, *wcols, *ordering, *geo_cols)


def assemble(features: DataFrame, ordering: list[str] = MAIN_ORDERING, repeat_static: bool = False,
             weather: bool = True, output_col: str = "features") -> DataFrame:
    """Add the ML vector column in the pinned feature order."""
    from pyspark.ml.feature import VectorAssembler

    cols = feature_columns(ordering, repeat_static, weather)
    return VectorAssembler(inputCols=cols, outputCol=output_col, handleInvalid="error").transform(features)
