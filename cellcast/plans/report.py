"""Concentration report over the layer store: for every period stored under all
three groupings (predicted, observed, two_hour), the top-share stats of each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcast.operators import evaluate as E
from cellcast.sources.rasters import list_rasters, read_layers, write_layers
from cellcast.functions.grid import GridSpec

# Store groupings and their short names in the report.
GROUPINGS = {"observed": "obs", "predicted": "pred", "two_hour": "two"}


def store_outputs(result, path: str, grid: GridSpec) -> None:
    """Write the predicted, observed and halved two-hour rasters of the test periods: each
    grouping for all test periods that have its raster, not only those that have all three."""
    rasters = [r.select(F.lit(g).alias("grouping"), "period_h", "row", "col", "value") for g, r in result.rasters.items()]
    periods = [p.select(F.lit(g).alias("grouping"), "period_h") for g, p in result.raster_periods.items()]
    write_layers(reduce(DataFrame.unionByName, rasters), reduce(DataFrame.unionByName, periods), path, grid)


def concentration_report(spark: SparkSession, path: str, area: int) -> DataFrame:
    """``(period_h, layer, one_percent, ..., total)`` for periods in all three groupings."""
    listing = list_rasters(spark, path)
    cells = read_layers(spark, path)
    rasters = {short: cells.filter(F.col("grouping") == g).select("period_h", "row", "col", "value")
               for g, short in GROUPINGS.items()}
    periods = {short: listing.filter(F.col("grouping") == g) for g, short in GROUPINGS.items()}
    return E.combined_stats(rasters, periods, area)
