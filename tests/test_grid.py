"""Projection, binning and parsing edges (the 50 m grid of the analysed job)."""

import pytest
from pyspark.sql import functions as F

from cellcast.functions.grid import NYC_50M, cell_of, in_extent, parse_number, with_cells_from_text


def cells(spark, pairs, grid=NYC_50M, zone=None):
    df = spark.createDataFrame(pairs, "lat string, lng string")
    out = with_cells_from_text(df, F.col("lat"), F.col("lng"), grid, zone=zone)
    return [(r["row"], r["col"]) for r in out.collect()]


@pytest.mark.parametrize("lat,lng,expected", [
    ("40.758", "-73.9855", (354, 456)),
    ("40.6413", "-73.7781", (608, 810)),
    ("40.758", "-79.9855", (354, 456)),   # zone 17 aliases onto zone 18
    ("40.758", "-67.9855", (354, 456)),   # zone 19 aliases onto zone 18
    ("bad", "", (90601, -7935)),          # both unparsable -> (0, 0) degrees, zone 31
    ("95", "-73.9", (90601, -11255)),     # out of range -> x = y = 0
    ("nan", "-73.9", (90601, -11255)),
])
def test_known_cells(spark, lat, lng, expected):
    assert cells(spark, [(lat, lng)]) == [expected]


def test_fixed_zone_removes_alias(spark):
    got = cells(spark, [("40.758", "-79.9855")], zone=18)
    assert got != [(354, 456)]
    assert cells(spark, [("40.758", "-73.9855")], zone=18) == [(354, 456)]


def test_suffix_number_is_unparsable(spark):
    df = spark.createDataFrame([("40.5d",), (" 40.5 ",), ("1e1",), (".5",), ("inf",), ("1_0",)], "t string")
    got = [r[0] for r in df.select(parse_number(F.col("t"))).collect()]
    assert got == [0.0, 40.5, 10.0, 0.5, float("inf"), 0.0]


def test_truncation_at_north_west_edge(spark):
    g = NYC_50M
    df = spark.createDataFrame([(g.x_min - 49, g.y_max + 49), (g.x_min - 51, g.y_max + 51)], "x double, y double")
    r, c = cell_of(F.col("x"), F.col("y"), g)
    assert [tuple(x) for x in df.select(r, c).collect()] == [(0, 0), (-1, -1)]


def test_extent_gate(spark):
    df = spark.createDataFrame([(948, 0), (949, 0), (0, 941), (0, 942)], "row int, col int")
    got = [r[0] for r in df.select(in_extent(F.col("row"), F.col("col"), NYC_50M)).collect()]
    assert got == [True, False, True, False]
