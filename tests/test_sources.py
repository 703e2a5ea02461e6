"""Broadcast guard, rasterize semantics and static layer pivot."""

from pyspark.sql import functions as F

from cellcast.functions.grid import TEST_1KM
from cellcast.operators.layers import rasterize
from cellcast.sources.geo import GEO_LAYERS, bounded_broadcast, geo_wide, mask_cells


def test_bounded_broadcast_falls_back_to_shuffle(spark):
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    prev_aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        big = spark.range(1000).withColumnRenamed("id", "k")
        small = spark.range(10).withColumnRenamed("id", "k")
        hinted = big.join(bounded_broadcast(small, max_rows=10, row_bytes=8), "k")
        unhinted = big.join(bounded_broadcast(small, max_rows=10 ** 12, row_bytes=8), "k")
        p1 = hinted._jdf.queryExecution().executedPlan().toString()
        p2 = unhinted._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in p1
        assert "BroadcastHashJoin" not in p2 and "SortMergeJoin" in p2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
        spark.conf.set("spark.sql.adaptive.enabled", prev_aqe)


def test_rasterize_adds_repeats_and_gates_extent(spark):
    df = spark.createDataFrame([(5, 1, 1, 2), (5, 1, 1, 3), (5, 47, 0, 9), (5, -1, 3, 4), (6, 47, 46, 1)],
                               "period_h int, row int, col int, n bigint")
    got = sorted(map(tuple, rasterize(df, TEST_1KM).collect()))
    assert got == [(5, 1, 1, 5.0), (5, 47, 0, 9.0), (6, 47, 46, 1.0)]


def test_geo_wide_missing_layer_reads_zero(spark):
    df = spark.createDataFrame([("roads", 0, 0, 1.5), ("airports", 0, 0, 2.0), ("roads", 1, 1, 3.0)],
                               "layer string, row int, col int, value double")
    rows = {(r["row"], r["col"]): r for r in geo_wide(df, TEST_1KM).collect()}
    assert rows[(0, 0)]["roads"] == 1.5 and rows[(0, 0)]["airports"] == 2.0
    assert rows[(0, 0)]["transport"] == 0.0 and rows[(1, 1)]["airports"] == 0.0
    assert geo_wide(df, TEST_1KM).columns == ["row", "col"] + GEO_LAYERS


def test_mask_repeats_and_cells_off_the_grid_are_dropped(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (2, 2, 0), (500, 500, 1), (-1, 3, 1), (47, 46, 1)],
                               "row int, col int, value int")
    assert sorted(map(tuple, mask_cells(df, TEST_1KM).collect())) == [(1, 1), (47, 46)]
    geo = spark.createDataFrame([("roads", 500, 500, 1.5), ("roads", 1, 1, 3.0)], "layer string, row int, col int, value double")
    assert [(r["row"], r["col"]) for r in geo_wide(geo, TEST_1KM).collect()] == [(1, 1)]
