"""Trip line parsing: the 14-field rule and its three modes."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cellcast.functions.grid import TEST_1KM
from cellcast.sources.trips import project_trips, split_trip_lines

GOOD = "m,h,v,1,N,2013-01-01 10:15:00,2013-01-01 10:30:00,1,900,2.1,-73.9855,40.758,-73.9,40.7"


def test_good_line(spark):
    df = spark.createDataFrame([(GOOD,)], "value string")
    row = project_trips(split_trip_lines(df), TEST_1KM).first()
    assert row["period_h"] == (366 * 24) + 10  # 2013-01-01 10h, 2012 is a leap year


def test_short_line_fails(spark):
    df = spark.createDataFrame([(GOOD,), ("bad,line",)], "value string")
    with pytest.raises(Exception):
        split_trip_lines(df, on_bad="fail").collect()


def test_short_line_quarantine_and_drop(spark):
    df = spark.createDataFrame([(GOOD,), ("bad,line",)], "value string")
    good, bad = split_trip_lines(df, on_bad="quarantine")
    assert good.count() == 1
    assert [tuple(r) for r in bad.collect()] == [("bad,line", 2, "fields")]
    assert split_trip_lines(df, on_bad="drop").count() == 1


def test_bad_datetime_fails(spark):
    bad = GOOD.replace("2013-01-01 10:15:00", "2013-01-01T10:15")
    df = spark.createDataFrame([(bad,)], "value string")
    with pytest.raises(Exception):
        project_trips(split_trip_lines(df), TEST_1KM).collect()


HEADER = "medallion,hack,vendor,rate,flag,pickup_datetime,dropoff,n,secs,miles,lng,lat,lng2,lat2"


@pytest.mark.parametrize("time", ["pickup_datetime", "2013-01-01 25:00:00", "2013-01-01 24:00:00", "2013-02-30 10:00:00", "",
                                  "2013-01-01", "2013-01-01 99999999999:00:00"])
def test_bad_times_in_all_modes(spark, time):
    line = GOOD.replace("2013-01-01 10:15:00", time)
    df = spark.createDataFrame([(GOOD,), (line,), (HEADER,)], "value string")
    assert project_trips(split_trip_lines(df, on_bad="drop"), TEST_1KM).count() == 1
    good, bad = split_trip_lines(df, on_bad="quarantine")
    assert project_trips(good, TEST_1KM).count() == 1
    assert {r["reason"] for r in bad.collect()} == {"datetime"} and bad.count() == 2
    with pytest.raises(PySparkException):
        project_trips(split_trip_lines(df.filter(F.col("value") == line)), TEST_1KM).collect()


def test_unpadded_time_is_good(spark):
    df = spark.createDataFrame([(GOOD.replace("2013-01-01 10:15:00", " 2013-1-1  9:5:0 "),)], "value string")
    assert project_trips(split_trip_lines(df, on_bad="drop"), TEST_1KM).first()["period_h"] == 366 * 24 + 9
