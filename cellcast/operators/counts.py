"""Cell-hour counts and calendar summaries.

``groupBy(...).count()`` plans a partial HashAggregate before the shuffle, so a
hot cell-hour (an airport at rush hour) is combined inside each map task and
crosses the network once per task, not once per trip.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellcast.functions.periods import day_key

KEYS = ["period_h", "row", "col"]


def cell_hour_counts(cells: DataFrame) -> DataFrame:
    """``(period_h, row, col)`` per trip -> ``(period_h, row, col, n)``; out-of-extent cells kept."""
    return cells.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))


def persist_counts(counts: DataFrame, storage=StorageLevel.MEMORY_AND_DISK) -> DataFrame:
    """Keep the counts for the several layers built from them."""
    return counts.persist(storage)


def write_by_cell(df: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Write a table of cells in buckets by ``(row, col)``, one file each, and read it back.

    What is joined or summed by cell from it needs no exchange, and a lost executor costs the
    reading of its buckets. The table lies in ``path``, a folder that all executors share;
    dropping it from the catalog leaves the files.
    """
    spark = df.sparkSession
    order = [c for c in ("row", "col", "period_h") if c in df.columns]
    (df.repartition(buckets, "row", "col").write.bucketBy(buckets, "row", "col").sortBy(*order)
       .mode("overwrite").option("path", path).saveAsTable(table))
    # Else Spark reads the buckets of one cell in several tasks where it sees no use for them
    # directly above the scan, as below the fan-out of the lag layers.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    return spark.table(table)


def trips_by_day(counts: DataFrame) -> DataFrame:
    """Trips per calendar day (``day_key`` = yyyymmdd), out-of-extent trips included."""
    return counts.groupBy(day_key(F.col("period_h")).alias("day_key")).agg(
        F.sum("n").cast("long").alias("n"))


def trips_by_month(by_day: DataFrame) -> DataFrame:
    """Trips per month (``month_key`` = yyyymm) from the daily totals."""
    return by_day.groupBy((F.col("day_key") / 100).cast("int").alias("month_key")).agg(
        F.sum("n").cast("long").alias("n"))


def trips_rollup(counts: DataFrame) -> DataFrame:
    """Month and day totals in one aggregation (``rollup``); ``day_key`` NULL marks a month row."""
    d = day_key(F.col("period_h"))
    return (counts.select((d / 100).cast("int").alias("month_key"), d.alias("day_key"), "n")
            .rollup("month_key", "day_key").agg(F.sum("n").cast("long").alias("n"))
            .filter(F.col("month_key").isNotNull()))
