"""Weather CSV: header by name, last row wins per hour, blanks become NULL, offsets ignored."""

from pyspark.sql import functions as F

from cellcast.functions.periods import period_text
from cellcast.session import scratch_dir
from cellcast.sources import weather as W


def test_weather_csv_rules(spark):
    path = scratch_dir(spark, "weather-unit")
    header = ",".join(reversed(W.CSV_KEYS))  # column order by name, not position
    rows = []
    for dt_text, v in [("2013-01-01T00:00:00-0500", "1.5"), ("2013-01-01T00:00:00-0500", "2.5"),
                       ("2013-01-01T01:00:00+0100", "")]:
        vals = {k: "0.1" for k in W.WEATHER_KEYS}
        vals["cloudCover"] = v
        vals["datetime"] = dt_text
        rows.append(",".join(vals[k] for k in reversed(W.CSV_KEYS)))
    spark.createDataFrame([(header,)] + [(r,) for r in rows], "value string").coalesce(1).write.text(path)
    typed = W.weather_table(W.read_weather_csv(spark, path))
    got = {r["t"]: r["cloudCover"] for r in typed.select(period_text(F.col("period_h")).alias("t"),
                                                          "cloudCover").collect()}
    assert got == {"2013010100": 2.5, "2013010101": None}


def test_flatten_drops_text_fields(spark):
    raw = spark.createDataFrame(
        [("2013-01-01T00:00:00-0500", {"data": [{"summary": "x", "icon": "y", "sunsetTime": 7200.0,
                                                 "sunriseTime": 0.0, "cloudCover": 0.5}]})],
        "dt string, daily struct<data: array<struct<summary: string, icon: string, sunsetTime: double, "
        "sunriseTime: double, cloudCover: double>>>")
    flat = W.flatten_weather_json(raw)
    assert "summary" not in flat.columns and "icon" not in flat.columns
    r = flat.first()
    assert r["sunlightHours"] == 2.0 and r["cloudCover"] == 0.5 and r["pressure"] is None
    assert flat.columns == W.CSV_KEYS
