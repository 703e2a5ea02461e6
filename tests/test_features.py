"""Feature table: order, density, zero fill and a pandas brute force at sf0.001."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from conftest import SF_SMALL
from cellcast.operators import features as FT
from cellcast.operators import layers as LY
from cellcast.plans import catalog as Q
from cellcast.sources.weather import WEATHER_KEYS


def test_feature_order():
    cols = FT.feature_columns(LY.MAIN_ORDERING, repeat_static=True)
    assert len(cols) == 5 + 7 + 23 + 11 * 7 == 112
    assert cols[:5] == ["row", "col", "month", "day", "hour"]
    assert cols[12:35] == WEATHER_KEYS
    assert cols[35:42] == ["two_hour", "roads", "roads_distance", "transport", "transport_distance",
                           "airports", "airports_distance"]
    assert len(FT.feature_columns(LY.MAIN_ORDERING)) == 5 + 7 + 23 + 11 + 6


def test_every_mask_cell_once_per_period(spark):
    ft = Q._features(spark, SF_SMALL)
    n_mask = Q.mask(spark).count()
    n_per = Q.eligible(spark, SF_SMALL).count()
    assert n_per == 190
    assert ft.count() == n_mask * n_per
    assert ft.select("period_h", "row", "col").distinct().count() == n_mask * n_per


def test_brute_force_layers(spark):
    """Label and base layer values of the feature table against pandas sums."""
    ft = Q._features(spark, SF_SMALL).select("period_h", "row", "col", "label", "two_hour", "four_hour",
                                           "eight_hour", "previous_day", "previous_week").toPandas()
    c = Q.counts(spark, SF_SMALL).toPandas()
    idx = {(r.period_h, r.row, r.col): r.n for r in c.itertuples()}

    def trailing(h, r, cc, lo, hi):
        return float(sum(idx.get((h - x, r, cc), 0) for x in range(lo, hi + 1)))

    sample = ft[(ft.label > 0) | (ft.two_hour > 0)].head(400)
    for r in sample.itertuples():
        assert r.label == float(idx.get((r.period_h, r.row, r.col), 0))
        assert r.two_hour == trailing(r.period_h, r.row, r.col, 1, 2)
        assert r.four_hour == trailing(r.period_h, r.row, r.col, 1, 4)
        assert r.eight_hour == trailing(r.period_h, r.row, r.col, 1, 8)
        assert r.previous_day == trailing(r.period_h, r.row, r.col, 24, 24)
        assert r.previous_week == trailing(r.period_h, r.row, r.col, 168, 168)
    # totals over the whole table
    total_label = ft.label.sum()
    in_mask = set(map(tuple, Q.mask(spark).toPandas()[["row", "col"]].values))
    periods = set(Q.eligible(spark, SF_SMALL).toPandas().period_h)
    want = sum(n for (h, r, cc), n in idx.items() if h in periods and (r, cc) in in_mask)
    assert total_label == want


def test_missing_weather_fails(spark):
    import pytest
    c = Q.counts(spark, SF_SMALL)
    el = Q.eligible(spark, SF_SMALL)
    wide = LY.wide_layers(c, Q.GRID, LY.MAIN_ORDERING)
    w = Q.weather(spark, SF_SMALL)
    first = el.agg(F.min("period_h")).first()[0]
    holed = w.filter(F.col("period_h") != first)
    ft = FT.feature_table(wide, el, Q.mask(spark), Q.geo(spark), holed, Q.GRID)
    with pytest.raises(Exception):
        ft.agg(F.sum("cloudCover")).collect()
    dropped = FT.feature_table(wide, el, Q.mask(spark), Q.geo(spark), holed, Q.GRID, on_missing_weather="drop")
    assert dropped.select("period_h").distinct().count() == el.count() - 1


def test_profile_sees_moved_cells(spark):
    """Swapping the values of two cells of a period changes its profile."""
    ft = Q._features(spark, SF_SMALL)
    h = ft.agg(F.min("period_h")).first()[0]
    one = ft.filter(F.col("period_h") == h)
    hot = one.filter("two_hour > 0").orderBy("row", "col").first()
    cold = one.filter("two_hour = 0").orderBy("row", "col").first()
    at = lambda r: (F.col("row") == r["row"]) & (F.col("col") == r["col"])
    moved = one.withColumn("two_hour", F.when(at(hot), cold["two_hour"]).when(at(cold), hot["two_hour"]).otherwise(F.col("two_hour")))
    a, b = Q._feature_profile(one).first().asDict(), Q._feature_profile(moved).first().asDict()
    assert {k for k in a if a[k] != b[k]} == {"placed_two_hour"}
