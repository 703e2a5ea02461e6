"""Landed trip files, counted once each: a ledger of files, their counts and their bad lines.

One pass over the new files gives everything: each line becomes a cell-hour or, if it is
bad, itself with its file and the reason, and both are counted by the same aggregation
(combined in the map tasks, so a hot cell crosses the network once per task, and so does a
line that is repeated very often). The batch is written to folders of its own. Then one row
is appended to the log, as one file that is renamed into place; readers see the batches in
the log only. So a job that stops halfway leaves nothing behind that counts, and running it
again counts every file once. Files are known by path, size and time; a known path with
another size or time is an error, as its lines were counted already.

The driver gets the paths of new files, never lines. Files of no bytes hold no
lines and are not entered; no new files is no batch.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cellcast.functions.grid import GridSpec
from cellcast.operators.counts import KEYS
from cellcast.session import path_exists
from cellcast.sources.trips import USED_COLUMNS, judged_lines, project_trips, read_trip_lines

FILE_SCHEMA = "path string, bytes long, modified timestamp, batch string"
LOG_SCHEMA = "batch string"
ROW_SCHEMA = "period_h int, row int, col int, file string, reason string, line string, n long, batch string, bad boolean"


class Ingested(NamedTuple):
    batch: str | None
    files: int
    lines: int
    bad: int


def _table(spark: SparkSession, store: str, name: str, schema: str) -> DataFrame:
    folder = f"{store}/{name}"
    if not path_exists(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder)


def _committed(spark: SparkSession, store: str, name: str, schema: str) -> DataFrame:
    log = _table(spark, store, "log", LOG_SCHEMA)
    return _table(spark, store, name, schema).join(log, "batch", "left_semi")


def ledger(spark: SparkSession, store: str) -> DataFrame:
    """``(path, bytes, modified, batch)`` of every file that was counted."""
    return _committed(spark, store, "files", FILE_SCHEMA).select("path", "bytes", "modified", "batch")


def landed_files(spark: SparkSession, paths) -> DataFrame:
    """Path, size and time of the files under some paths; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def counted_lines(lines: DataFrame, grid: GridSpec, zone: int | None = None, partitions: int | None = None) -> DataFrame:
    """Counts of ``(value, file)`` lines: by cell and hour, or by file, reason and line where bad."""
    judged = judged_lines(lines, ("file",))
    if partitions is not None:
        judged = judged.repartition(partitions, *USED_COLUMNS, "line")
    bad = F.col("reason").isNotNull()
    cells = project_trips(judged, grid, zone, keep=("file", "reason", "line"))
    return (cells.select(*[F.when(~bad, F.col(k)).alias(k) for k in KEYS], F.when(bad, F.col("file")).alias("file"), "reason", "line")
            .groupBy(*KEYS, "file", "reason", "line").agg(F.count(F.lit(1)).alias("n")))


def ingest_new(spark: SparkSession, paths, store: str, grid: GridSpec, on_bad: str = "quarantine",
               zone: int | None = None, partitions: int | None = None) -> Ingested:
    """Count the files that the ledger does not list. ``on_bad='fail'`` commits nothing if a line
    is bad; ``'quarantine'`` keeps bad lines beside the counts."""
    if on_bad not in ("fail", "quarantine"):
        raise ValueError(f"on_bad must be 'fail' or 'quarantine', not {on_bad!r}")
    known = ledger(spark, store).select("path", F.col("bytes").alias("known_bytes"), F.col("modified").alias("known_modified"))
    found = landed_files(spark, paths).join(known, "path", "left")
    changed = found.filter((F.col("bytes") != F.col("known_bytes")) | (F.col("modified") != F.col("known_modified")))
    first = changed.select("path").first()
    if first:
        raise ValueError(f"a counted file has changed: {first.path}")
    batch = f"b{uuid.uuid4().hex}"
    new = found.filter(F.col("known_bytes").isNull()).select("path", "bytes", "modified")
    folder = f"{store}/files/batch={batch}"
    new.write.parquet(folder)  # what was listed is what is read
    files = [r.path for r in spark.read.schema("path string").parquet(folder).collect()]
    if not files:
        return Ingested(None, 0, 0, 0)
    seen = Observation()
    lines = read_trip_lines(spark, files).select("value", F.col("_metadata.file_path").alias("file"))
    counted = counted_lines(lines, grid, zone, partitions)
    bad = F.col("reason").isNotNull()
    counted = counted.observe(seen, F.sum("n").alias("lines"), F.sum(F.when(bad, F.col("n"))).alias("bad"))
    counted.withColumn("bad", bad).write.partitionBy("bad").parquet(f"{store}/rows/batch={batch}")
    lines_seen, bad_seen = seen.get["lines"] or 0, seen.get["bad"] or 0
    if bad_seen and on_bad == "fail":
        raise ValueError(f"{bad_seen} of {lines_seen} lines are bad; nothing was committed")
    spark.createDataFrame([(batch,)], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(f"{store}/log")
    return Ingested(batch, len(files), lines_seen, bad_seen)


def stored_counts(spark: SparkSession, store: str) -> DataFrame:
    """``(period_h, row, col, n)`` over all committed batches."""
    rows = _committed(spark, store, "rows", ROW_SCHEMA).filter(~F.col("bad"))
    return rows.groupBy(*KEYS).agg(F.sum("n").alias("n"))


def bad_lines(spark: SparkSession, store: str) -> DataFrame:
    """``(file, reason, line, n)``: every bad line of the committed batches, with its repeats."""
    return _committed(spark, store, "rows", ROW_SCHEMA).filter("bad").groupBy("file", "reason", "line").agg(F.sum("n").alias("n"))
