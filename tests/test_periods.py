"""Hour periods: DST-free wall-clock hours, shifts across year ends, weekdays."""

import datetime as dt

from pyspark.sql import functions as F

from cellcast.functions import periods as P
from cellcast.sources.trips import pickup_period


def test_dst_hour_kept(spark):
    df = spark.createDataFrame([("2013-03-10 02:30:00",)], "t string")
    got = df.select(P.period_text(pickup_period(F.col("t")))).first()[0]
    assert got == "2013031002"


def test_year_shift(spark):
    df = spark.createDataFrame([("2013123123",)], "t string")
    got = df.select(P.period_text(P.shift_period(P.period_from_text(F.col("t")), 1))).first()[0]
    assert got == "2014010100"


def test_epoch_and_calendar_bounds(spark):
    df = spark.createDataFrame([("2012010100",), ("2015010123",)], "t string")
    got = [r[0] for r in df.select(P.period_from_text(F.col("t"))).collect()]
    assert got == [P.CALENDAR_FIRST_HOUR, P.CALENDAR_LAST_HOUR]


def test_weekday_onehot_monday_first(spark):
    df = spark.createDataFrame([(dt.date(2013, 1, 1),)], "d date")
    oh = P.weekday_onehot(F.col("d"))
    row = df.select(*[oh[k].alias(k) for k in P.WEEKDAY_COLUMNS]).first()
    assert list(row) == [0, 1, 0, 0, 0, 0, 0]


def test_parts_and_text_agree(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 2, 29, 23, 59, 59),)], "ts timestamp_ntz")
    h = P.hour_index(F.col("ts"))
    parts = P.period_parts(h)
    row = df.select(P.period_text(h), parts["month"], parts["day"], parts["hour"]).first()
    assert tuple(row) == ("2024022923", 2, 29, 23)


def test_weather_request_hours(spark):
    hrs = P.hours_from_year(spark, 2013, dt.datetime(2013, 1, 2, 0, 30))
    texts = [r[0] for r in hrs.select(P.period_text(F.col("period_h"))).orderBy("period_h").collect()]
    assert len(texts) == 25 and texts[0] == "2013010100" and texts[-1] == "2013010200"


def test_strict_calendar_fails_outside(spark):
    import pytest
    from cellcast.operators import lags as L
    c = spark.createDataFrame([(P.CALENDAR_LAST_HOUR, 0, 0, 1)], "period_h int, row int, col int, n bigint")
    assert L.trailing_sum(c, 1, 3, 1).count() == 2
    with pytest.raises(Exception):
        L.trailing_sum(c, 1, 3, 1, strict=True).collect()
