"""Derive the job's inputs from the driver's generic test tables.

The test tables hold no trips, weather or rasters, so these functions build
them from ``events`` (and the grid) with fixed rules. Every derived table is
computed by Spark from the given tables, so its size follows theirs. The same
rules are written in SQL by the oracle (``cellcast.plans.oracle``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcast.functions.grid import GridSpec
from cellcast.functions.periods import hour_index, hour_spine_between, period_date
from cellcast.sources.geo import GEO_LAYERS
from cellcast.sources.trips import TRIP_COLUMNS
from cellcast.sources.weather import WEATHER_KEYS


def _num_text(x: Column) -> Column:
    return x.cast("double").cast("string")


def pickup_latitude_text(event_id: Column, user_id: Column) -> Column:
    """Rule order: unparsable, out of range, north-west strip, else one of 5 latitudes."""
    return (F.when(event_id % 97 == 0, F.lit("bad"))
            .when(event_id % 101 == 0, F.lit("95.0"))
            .when(event_id % 107 == 0, F.lit("40.92"))
            .otherwise(_num_text((4060 + 6 * F.floor((user_id % 25) / 5)) / 100.0)))


def pickup_longitude_text(event_id: Column, user_id: Column) -> Column:
    """Rule order: empty, 6 degrees east (zone alias), north-west strip, else one of 5 longitudes."""
    return (F.when(event_id % 97 == 0, F.lit(""))
            .when(event_id % 103 == 0, _num_text((-6820 + 9 * (user_id % 5)) / 100.0))
            .when(event_id % 107 == 0, F.lit("-74.262"))
            .otherwise(_num_text((-7420 + 9 * (user_id % 5)) / 100.0)))


def trip_lines_from_events(events: DataFrame) -> DataFrame:
    """One 14-field trip line (``value``) per event."""
    e, u = F.col("event_id"), F.col("user_id")
    ts_text = F.date_format(F.col("ts"), "yyyy-MM-dd HH:mm:ss")
    fields = {
        "medallion": e.cast("string"),
        "hack_license": u.cast("string"),
        "vendor_id": F.coalesce(F.col("event_type"), F.lit("")),
        "rate_code": F.lit("1"),
        "store_and_fwd_flag": F.lit("N"),
        "pickup_datetime": ts_text,
        "dropoff_datetime": ts_text,
        "passenger_count": F.lit("1"),
        "trip_time_in_secs": F.lit("0"),
        "trip_distance": F.coalesce(F.col("value").cast("string"), F.lit("")),
        "pickup_longitude": pickup_longitude_text(e, u),
        "pickup_latitude": pickup_latitude_text(e, u),
        "dropoff_longitude": F.lit(""),
        "dropoff_latitude": F.lit(""),
    }
    return events.select(F.concat_ws(",", *[fields[c] for c in TRIP_COLUMNS]).alias("value"))


def event_hour_bounds(events: DataFrame) -> DataFrame:
    """One row ``(lo, hi)``: first and last event hour."""
    h = hour_index(F.col("ts"))
    return events.agg(F.min(h).alias("lo"), F.max(h).alias("hi"))


def weather_value(period_h: Column, j: int) -> Column:
    """Rule for the j-th (1-based) weather column of an hour."""
    return (F.pmod(period_h * (j + 3), F.lit(97)) / 10.0).cast("double")


def weather_from_events(events: DataFrame) -> DataFrame:
    """Hourly weather over the event hour range, as the typed table
    ``(period_h, <23 weather columns>)``; sunlightHours follows its own rule."""
    spine = hour_spine_between(event_hour_bounds(events))
    h = F.col("period_h")
    cols = {k: weather_value(h, j) for j, k in enumerate(WEATHER_KEYS, start=1)}
    cols["sunlightHours"] = (cols["sunsetTime"] - cols["sunriseTime"]) / 3600.0
    return spine.select(h, *[cols[k].alias(k) for k in WEATHER_KEYS])


def weather_csv_rows_from_events(events: DataFrame) -> DataFrame:
    """The same weather as CSV-shaped strings with an ISO ``datetime`` (local offset)."""
    w = weather_from_events(events)
    ts = F.timestamp_add("HOUR", F.pmod(F.col("period_h"), F.lit(24)),
                         period_date(F.col("period_h")).cast("timestamp_ntz"))
    dt_text = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-0500"))
    return w.select(dt_text.alias("datetime"), *[F.col(k).cast("string").alias(k) for k in WEATHER_KEYS])


def weather_json_from_events(events: DataFrame) -> DataFrame:
    """Landed weather responses: ``dt`` text plus ``daily.data[0]`` holding the values
    and the two text fields the flattening drops."""
    rows = weather_csv_rows_from_events(events)
    entry = F.struct(
        F.lit("Clear").alias("summary"), F.lit("clear-day").alias("icon"),
        *[F.col(k).cast("double").alias(k) for k in WEATHER_KEYS if k != "sunlightHours"])
    return rows.select(F.col("datetime").alias("dt"),
                       F.struct(F.array(entry).alias("data")).alias("daily"))


def grid_cells(spark: SparkSession, grid: GridSpec) -> DataFrame:
    """Every cell of a grid; size fixed by the grid, not by data."""
    return spark.range(grid.n_cells).select(
        (F.col("id") / grid.n_cols).cast("int").alias("row"),
        (F.col("id") % grid.n_cols).cast("int").alias("col"))


def geo_cells_for_grid(spark: SparkSession, grid: GridSpec) -> DataFrame:
    """Long geo table ``(layer, row, col, value)`` with a value rule per layer."""
    cells = grid_cells(spark, grid)
    layers = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(name).alias("layer"))
                       for j, name in enumerate(GEO_LAYERS, start=1)])
    x = cells.select("row", "col", F.explode(layers).alias("l"))
    return x.select(
        F.col("l.layer").alias("layer"), "row", "col",
        (F.pmod(F.col("row") * 31 + F.col("col") * 17 + F.col("l.j") * 7, F.lit(100)) / 10.0).alias("value"))


def mask_cells_for_grid(spark: SparkSession, grid: GridSpec) -> DataFrame:
    """Mask raster as cells ``(row, col, value)``; value 1 marks the study area."""
    return grid_cells(spark, grid).select(
        "row", "col",
        F.when(F.pmod(F.col("row") * 31 + F.col("col") * 17, F.lit(3)) != 0, 1).otherwise(0).alias("value"))


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")


def damaged_trip_lines(events: DataFrame) -> DataFrame:
    """Trip lines of which some are bad, by event id (the first field): every 89th loses its last
    field; of the rest, every 83rd has the header's word for its pickup time, and of the rest
    every 79th hour 25."""
    lines = trip_lines_from_events(events)
    trip_id = F.substring_index(F.col("value"), ",", 1).cast("long")
    at = TRIP_COLUMNS.index("pickup_datetime")

    def with_time(text: Column) -> Column:
        parts = F.split("value", ",", -1)
        return F.array_join(F.concat(F.slice(parts, 1, at), F.array(text), F.slice(parts, at + 2, 14)), ",")

    time = F.split("value", ",", -1)[at]
    damaged = (
        F.when(trip_id % 89 == 0, F.regexp_replace("value", ",[^,]*$", ""))
        .when(trip_id % 83 == 0, with_time(F.lit("pickup_datetime")))
        .when(trip_id % 79 == 0, with_time(F.concat(F.substring(time, 1, 11), F.lit("25:00:00"))))
        .otherwise(F.col("value")))
    # inline() makes the line a value, as if read from a file: what parses it does not repeat the rules.
    return lines.select(F.inline(F.array(F.struct(F.col("value"))))).select(F.inline(F.array(F.struct(damaged.alias("value")))))
