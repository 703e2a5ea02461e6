"""Trailing sums: fan-out semantics, pyramids, the fused form and the window cross-check."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellcast.operators import lags as L


def counts(spark, rows):
    return spark.createDataFrame(rows, "period_h int, row int, col int, n bigint")


def as_dict(df, col="n"):
    return {r["period_h"]: r[col] for r in df.collect()}


def test_two_hour_fan_out(spark):
    c = counts(spark, [(10, 0, 0, 2), (11, 0, 0, 3), (20, 0, 0, 1)])
    assert as_dict(L.two_hour(c)) == {11: 2, 12: 5, 13: 3, 21: 1, 22: 1}


def test_empty_range_gives_no_rows(spark):
    c = counts(spark, [(10, 0, 0, 2)])
    assert L.trailing_sum(c, 3, 3, 1).count() == 0


def test_pyramid_equals_direct(spark):
    c = counts(spark, [(h, r, 0, (h * 7 + r) % 5 + 1) for h in range(0, 40, 3) for r in range(3)])
    key = ["period_h", "row", "col"]
    four_p = L.four_hour(L.two_hour(c))
    four_d = L.trailing_sum(c, 1, 5, 1)
    eight_p = L.eight_hour(four_p)
    eight_d = L.trailing_sum(c, 1, 9, 1)
    assert sorted(map(tuple, four_p.select(*key, "n").collect())) == sorted(map(tuple, four_d.select(*key, "n").collect()))
    assert sorted(map(tuple, eight_p.select(*key, "n").collect())) == sorted(map(tuple, eight_d.select(*key, "n").collect()))


def test_fused_layers_equal_separate(spark):
    c = counts(spark, [(h, r, 1, (h + r) % 4 + 1) for h in range(0, 400, 5) for r in range(2)])
    wide = L.lag_layers(c)
    key = ["period_h", "row", "col"]
    separate = {
        "observed": c, "two_hour": L.two_hour(c), "four_hour": L.trailing_sum(c, 1, 5, 1),
        "eight_hour": L.trailing_sum(c, 1, 9, 1), "previous_day": L.previous_day(c),
        "previous_week": L.previous_week(c),
    }
    for name, df in separate.items():
        want = sorted((r[0], r[1], r[2], float(r[3])) for r in df.select(*key, "n").collect())
        got = sorted(tuple(r) for r in wide.filter(F.col(name).isNotNull()).select(*key, name).collect())
        assert got == want, name


def test_fan_out_equals_densified_window(spark):
    c = counts(spark, [(10, 0, 0, 2), (11, 0, 0, 3), (20, 0, 0, 1)])
    dense = spark.range(0, 30).select(F.col("id").cast("int").alias("period_h"), F.lit(0).alias("row"),
                                      F.lit(0).alias("col"))
    d = dense.join(c, ["period_h", "row", "col"], "left").fillna(0, ["n"])
    w = Window.partitionBy("row", "col").orderBy("period_h").rangeBetween(-2, -1)
    win = d.select("period_h", F.sum("n").over(w).alias("n")).filter(F.col("n") > 0)
    assert as_dict(win) == as_dict(L.two_hour(c))


def test_range_frame_over_dense_cells_equals_fan_out(spark):
    c = counts(spark, [(h, r, 0, h % 4 + 1) for h in (3, 4, 9, 30, 31, 60) for r in range(2)] + [(5, 7, 7, 2)])
    for start, end in ((1, 9), (0, 3), (24, 25), (2, 2)):
        want = sorted(map(tuple, L.trailing_sum(c, start, end).collect()))
        assert sorted(map(tuple, L.trailing_window(c, start, end).collect())) == want
