"""Hourly weather: landed JSON responses -> flat rows -> CSV -> typed hourly table.

Weather has no spatial key; it joins on the hour period only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcast.functions.periods import hour_index_from_parts

# The 23 weather fields in CSV column order (after 'datetime').
# This is also the pinned feature order.
WEATHER_KEYS = [
    "apparentTemperatureMinTime", "cloudCover", "temperatureMin", "dewPoint",
    "apparentTemperatureMax", "temperatureMax", "sunlightHours", "temperatureMaxTime",
    "windBearing", "moonPhase", "visibility", "sunsetTime", "pressure",
    "precipProbability", "apparentTemperatureMin", "precipIntensityMax",
    "apparentTemperatureMaxTime", "humidity", "windSpeed", "time", "precipIntensity",
    "sunriseTime", "temperatureMinTime",
]
CSV_KEYS = ["datetime"] + WEATHER_KEYS

# 'YYYY-MM-DDTHH:MM:SS' with an optional offset; only the wall-clock parts are used.
_ISO = r"^\s*([0-9]+)-([0-9]+)-([0-9]+)T([0-9]+):"


def weather_period(text) -> F.Column:
    """Hour index of the local wall-clock time in an ISO text; the offset does not shift it."""
    def part(i):
        return F.regexp_extract(text, _ISO, i).cast("int")
    return F.when(text.rlike(_ISO), hour_index_from_parts(part(1), part(2), part(3), part(4))) \
        .otherwise(F.raise_error(F.concat(F.lit("bad weather datetime: "), F.coalesce(text, F.lit("NULL")))))


def flatten_weather_json(raw: DataFrame, dt_col: str = "dt") -> DataFrame:
    """Landed responses -> one flat row per request: element 0 of ``daily.data``,
    without summary/icon, plus ``datetime`` and ``sunlightHours``."""
    first = F.col("daily.data").getItem(0)
    present = set(raw.schema["daily"].dataType["data"].dataType.elementType.fieldNames())
    cols = []
    for k in WEATHER_KEYS:
        if k == "sunlightHours":
            cols.append(((first["sunsetTime"] - first["sunriseTime"]) / 3600.0).alias(k))
        elif k in present:
            cols.append(first[k].cast("double").alias(k))
        else:
            cols.append(F.lit(None).cast("double").alias(k))
    return raw.select(F.col(dt_col).alias("datetime"), *cols)


def read_weather_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def write_weather_csv(flat: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the fixed 24-column CSV; missing keys become empty fields, extra keys are ignored."""
    have = set(flat.columns)
    out = flat.select(*[(F.col(k).cast("string") if k in have else F.lit(None).cast("string")).alias(k)
                        for k in CSV_KEYS])
    out.write.mode(mode).option("header", True).csv(path)


def read_weather_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Header CSV -> raw string columns plus ``_ord``: file path, place in the file, line."""
    raw = spark.read.option("header", True).csv(path)
    meta = F.col("_metadata")
    return raw.withColumn("_ord", F.struct(meta["file_path"], meta["file_block_start"], F.monotonically_increasing_id()))


def weather_table(raw: DataFrame, order_col: str = "_ord") -> DataFrame:
    """Typed hourly table ``(period_h, <23 DOUBLE>)``.

    Values are parsed by column name; blank or non-numeric values become NULL
    (the feature step decides whether NULL fails). For a duplicated hour the
    last row in read order wins, chosen with ``max_by`` (no sort).
    """
    have = set(raw.columns)
    vals = [(F.col(k).try_cast("double") if k in have else F.lit(None).cast("double")).alias(k)
            for k in WEATHER_KEYS]
    typed = raw.select(weather_period(F.col("datetime")).alias("period_h"),
                       F.col(order_col).alias("_ord"), *vals)
    latest = typed.groupBy("period_h").agg(
        F.max_by(F.struct(*WEATHER_KEYS), F.col("_ord")).alias("w"))
    return latest.select("period_h", *[F.col(f"w.{k}").alias(k) for k in WEATHER_KEYS])
