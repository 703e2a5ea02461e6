"""Trip records: plain comma-separated text with 14 fields, no header, no quoting.

The text is read with ``spark.read.text`` and split with ``F.split(..., -1)``
rather than the CSV reader: with CSV column pruning, a short line would go
unnoticed when only 3 of the 14 columns are selected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcast.functions.grid import GridSpec, with_cells_from_text
from cellcast.functions.periods import hour_index_from_parts

# The 14 fields of a trip line, in file order.
TRIP_COLUMNS = [
    "medallion", "hack_license", "vendor_id", "rate_code", "store_and_fwd_flag",
    "pickup_datetime", "dropoff_datetime", "passenger_count", "trip_time_in_secs",
    "trip_distance", "pickup_longitude", "pickup_latitude", "dropoff_longitude",
    "dropoff_latitude",
]

# 'YYYY-MM-DD HH:MM:SS': two whitespace-separated parts, three '-' parts and three ':' parts.
_DATETIME = r"^\s*([0-9]+)-([0-9]+)-([0-9]+)\s+([0-9]+):([0-9]+):([^:\s]*)\s*$"


# Fields that the projection reads.
USED_COLUMNS = ["pickup_datetime", "pickup_longitude", "pickup_latitude"]


def read_trip_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One ``value`` row per line; gzip files are read as they are, one task each."""
    return spark.read.text(path)


def spread(trips: DataFrame, partitions: int | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Spread the used fields of the trips by their hash over ``partitions`` tasks, for sources
    of a few files that cannot be split; the costly projection runs after this. ``None``
    leaves the trips where the scan put them, without a shuffle."""
    narrow = trips.select(*keep, *USED_COLUMNS)
    return narrow if partitions is None else narrow.repartition(partitions, *USED_COLUMNS)


def _datetime_parts(text: Column) -> Column:
    """Year, month, day, hour, minute, second of a text that has the shape of a datetime."""
    return F.split(F.trim(text), r"[-:\s]+")


def good_datetime(text: Column) -> Column:
    """Whether a text is a datetime of the calendar: right shape, real date, hour below 24."""
    parts = _datetime_parts(text)
    number = [parts[i].try_cast("int") for i in range(4)]
    date = F.try_make_timestamp(number[0], number[1], number[2], F.lit(0), F.lit(0), F.lit(0))
    return F.coalesce(text.rlike(_DATETIME) & date.isNotNull() & (number[3] < 24), F.lit(False))


def split_trip_lines(lines: DataFrame, on_bad: str = "fail", value_col: str = "value"):
    """Split lines into the 14 named string columns.

    A line is bad without exactly 14 fields, or without a good pickup time (a header line,
    an impossible date, an hour past 23). ``on_bad``: ``'fail'`` raises on the first bad
    line, ``'drop'`` removes bad lines, ``'quarantine'`` returns ``(good, bad)`` where bad
    has the line, its number of fields and the reason.
    """
    parts = F.split(F.col(value_col), ",", -1)
    with_parts = lines.select(F.col(value_col).alias("_line"), parts.alias("_parts"))
    whole = F.size("_parts") == len(TRIP_COLUMNS)
    timed = good_datetime(F.get("_parts", F.lit(TRIP_COLUMNS.index("pickup_datetime"))))
    ok = whole & timed
    fields = [F.col("_parts")[i].alias(name) for i, name in enumerate(TRIP_COLUMNS)]
    if on_bad == "fail":
        # The pickup time is checked where it is parsed, so that no line is parsed twice.
        checked = with_parts.select(
            F.when(whole, F.col("_parts")).otherwise(
                F.raise_error(F.concat(F.lit("trip line without 14 fields: "), F.col("_line")))
            ).alias("_parts"))
        return checked.select(*fields)
    if on_bad == "drop":
        return with_parts.filter(ok).select(*fields)
    if on_bad == "quarantine":
        reason = F.when(~whole, "fields").otherwise("datetime")
        return with_parts.filter(ok).select(*fields), with_parts.filter(~ok).select(
            F.col("_line").alias("line"), F.size("_parts").alias("n_fields"), reason.alias("reason"))
    raise ValueError(f"on_bad must be 'fail', 'drop' or 'quarantine', not {on_bad!r}")


def pickup_period(text: Column) -> Column:
    """Hour index of a 'YYYY-MM-DD HH:MM:SS' text; other shapes and hours past 23 fail the task."""
    parts = _datetime_parts(text)
    year, month, day, hour = (parts[i].try_cast("int") for i in range(4))
    return F.when(text.rlike(_DATETIME) & (hour < 24), hour_index_from_parts(year, month, day, hour)) \
        .otherwise(F.raise_error(F.concat(F.lit("bad pickup_datetime: "), F.coalesce(text, F.lit("NULL")))))


def project_trips(trips: DataFrame, grid: GridSpec, zone: int | None = None,
                  keep: tuple = ()) -> DataFrame:
    """Trip fields -> ``(period_h, row, col)`` per trip; out-of-extent cells are kept.
    Columns (or Column expressions) in ``keep`` are carried along in front."""
    # The one-element inline() keeps later filters on period_h from being
    # rewritten down into the line parsing (see functions.grid.with_utm).
    base = trips.select(*keep, F.inline(F.array(F.struct(
        pickup_period(F.col("pickup_datetime")).alias("period_h"),
        F.col("pickup_latitude").alias("_lat_t"), F.col("pickup_longitude").alias("_lng_t")))))
    out = with_cells_from_text(base, F.col("_lat_t"), F.col("_lng_t"), grid, zone=zone)
    return out.drop("_lat_t", "_lng_t")


# Fields that stand in where a line is bad, so that the projection runs over all lines.
_STAND_IN = {"pickup_datetime": "2012-01-01 00:00:00", "pickup_longitude": "0", "pickup_latitude": "0"}


def judged_lines(lines: DataFrame, keep: tuple[str, ...] = (), value_col: str = "value") -> DataFrame:
    """Every line once: ``keep``, the used fields of a good one, and for a bad one ``reason``
    (``fields`` or ``datetime``) and the ``line`` itself; both are null for a good line."""
    parts = F.split(F.col(value_col), ",", -1)
    split = lines.select(*keep, F.inline(F.array(F.struct(F.col(value_col).alias("line"), parts.alias("parts")))))
    whole = F.size("parts") == len(TRIP_COLUMNS)
    timed = good_datetime(F.get("parts", F.lit(TRIP_COLUMNS.index("pickup_datetime"))))
    judged = split.select(*keep, F.inline(F.array(F.struct(
        F.when(~whole, "fields").when(~timed, "datetime").alias("reason"), F.col("line"), F.col("parts")))))
    bad = F.col("reason").isNotNull()
    fields = [F.when(bad, F.lit(_STAND_IN[c])).otherwise(F.get("parts", F.lit(TRIP_COLUMNS.index(c)))).alias(c) for c in USED_COLUMNS]
    return judged.select(*keep, "reason", F.when(bad, F.col("line")).alias("line"), *fields)


def trip_cells(spark: SparkSession, path, grid: GridSpec, on_bad: str = "fail",
               zone: int | None = None, partitions: int | None = None):
    """Scan, split and project; ``partitions`` spreads the lines of a few large files. With
    ``on_bad='quarantine'`` the result is ``(cells, bad lines)``; ``sources.trip_store`` keeps
    both from one pass."""
    good = split_trip_lines(read_trip_lines(spark, path), on_bad=on_bad)
    if on_bad == "quarantine":
        return project_trips(spread(good[0], partitions), grid, zone), good[1]
    return project_trips(spread(good, partitions), grid, zone)
