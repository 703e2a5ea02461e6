"""The layer store: rasters kept as cell tables, versioned by a commit log.

A write goes to folders of its own first: the cells of its rasters, partitioned by write,
grouping and period, and the list of the rasters it replaces. Then one row ``(version,
write_id)`` is appended to the log, as one file that the writer renames into place. Only
writes in the log exist for readers, and a raster's cells are those of the last such write
that lists it. So a write that stops at any point before its commit changes nothing, a
raster rewritten without any non-zero cell is an empty raster, and a reader that began
earlier keeps the version it read. ``vacuum`` deletes what no reader of the newest version
needs. Two writers of the same rasters may commit at the same time; one of them wins whole.

Tables are read with the schema given here, so that a store without a single cell is read
like any other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcast.functions.grid import GridSpec, cell_center
from cellcast.session import delete_folder, modified_at, path_exists

RASTER = ["grouping", "period_h"]
CELL_SCHEMA = "row int, col int, value double, x double, y double, write_id string, grouping string, period_h int"
LISTED_SCHEMA = "grouping string, period_h int, write_id string"
LOG_SCHEMA = "version long, write_id string"


def with_centres(raster: DataFrame, grid: GridSpec) -> DataFrame:
    """Add map coordinates ``x``, ``y`` of each cell centre."""
    x, y = cell_center(F.col("row"), F.col("col"), grid)
    return raster.withColumn("x", x).withColumn("y", y)


def _table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    folder = f"{path}/{name}"
    if not path_exists(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder)


def stage_layers(cells: DataFrame, periods: DataFrame, path: str, grid: GridSpec) -> str:
    """Write cells and list of rasters under a new write id, unseen by readers; returns the id."""
    spark, write_id = cells.sparkSession, f"w{uuid.uuid4().hex}"
    listed = f"{path}/listed/write_id={write_id}"
    periods.select("grouping", F.col("period_h").cast("int").alias("period_h")).distinct().write.parquet(listed)
    rasters = spark.read.parquet(listed)
    kept = cells.filter(F.col("value") != 0).join(rasters, RASTER, "left_semi")
    out = with_centres(kept, grid).select(
        F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"),
        F.col("value").cast("double").alias("value"), "x", "y", F.lit(write_id).alias("write_id"), *RASTER)
    out.repartition(*RASTER).write.mode("append").partitionBy("write_id", *RASTER).parquet(f"{path}/cells")
    return write_id


def commit_layers(spark: SparkSession, path: str, write_id: str) -> int:
    """Make a staged write the newest version; returns its number. Repeating it is harmless."""
    version = (_table(spark, path, "log", LOG_SCHEMA).agg(F.max("version")).first()[0] or 0) + 1
    # One file: its rename is the moment at which the write exists.
    spark.createDataFrame([(version, write_id)], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/log")
    return version


def write_layers(cells: DataFrame, periods: DataFrame, path: str, grid: GridSpec) -> int:
    """Replace the rasters that the ``(grouping, period_h)`` list names by the non-zero
    ``(grouping, period_h, row, col, value)`` cells; cells of other rasters are left out.
    Returns the version that has them."""
    return commit_layers(cells.sparkSession, path, stage_layers(cells, periods, path, grid))


def _log(spark: SparkSession, path: str, version: int | None) -> DataFrame:
    log = _table(spark, path, "log", LOG_SCHEMA)
    return log if version is None else log.filter(F.col("version") <= version)


def _owners(spark: SparkSession, path: str, version: int | None, only: Column | None) -> DataFrame:
    """``(grouping, period_h, write_id)``: the write that holds each raster of a version."""
    listed = _table(spark, path, "listed", LISTED_SCHEMA)
    if only is not None:
        listed = listed.filter(only)
    return listed.join(_log(spark, path, version), "write_id").groupBy(*RASTER).agg(
        F.max_by("write_id", F.struct("version", "write_id")).alias("write_id"))


def read_layers(spark: SparkSession, path: str, grouping: str | None = None, version: int | None = None) -> DataFrame:
    """Cells of the newest version, or of an earlier one; a grouping filter prunes partitions."""
    only = None if grouping is None else F.col("grouping") == grouping
    cells = _table(spark, path, "cells", CELL_SCHEMA)
    if only is not None:
        cells = cells.filter(only)
    return cells.join(_owners(spark, path, version, only), [*RASTER, "write_id"], "left_semi").select(
        *RASTER, "row", "col", "value", "x", "y")


def list_rasters(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """``(grouping, period_h)`` of every stored raster, all-zero ones included."""
    return _owners(spark, path, version, None).select(*RASTER)


def vacuum(spark: SparkSession, path: str, min_age_s: float = 24 * 3600.0) -> int:
    """Delete writes that hold no raster of the newest version and are older than ``min_age_s``
    (writes and reads in progress are younger); returns how many. Earlier versions lose the
    rasters that only those writes held."""
    on_disk = {r.write_id for r in _table(spark, path, "listed", LISTED_SCHEMA).select("write_id").distinct().collect()}
    needed = {r.write_id for r in _owners(spark, path, None, None).select("write_id").distinct().collect()}
    gone = 0
    for write_id in sorted(on_disk - needed):
        listed = f"{path}/listed/write_id={write_id}"
        if modified_at(spark, listed) + min_age_s > modified_at(spark, None):
            continue
        # The list goes last: a vacuum that stops halfway is taken up by the next one.
        delete_folder(spark, f"{path}/cells/write_id={write_id}")
        delete_folder(spark, listed)
        gone += 1
    return gone
