"""End-to-end jobs: the older job, and the store + report reproducing the in-memory stats."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from cellcast.operators import layers as LY
from cellcast.operators import model as M
from cellcast.plans import catalog as Q
from cellcast.plans import demand_model as DM
from cellcast.plans import legacy_model as LM
from cellcast.plans import report as R
from cellcast.session import delete_path, scratch_dir
from cellcast.sources import rasters as RS

SMALL_FOREST = M.ForestPreset(num_trees=5, max_depth=3, max_bins=16)


def test_legacy_job(spark):
    out = LM.run(spark, Q.counts(spark, SF_SMALL), Q.mask(spark), Q.geo(spark),
                 LM.LegacyConfig(grid=Q.GRID, forest=SMALL_FOREST))
    assert out["n_features"] == Q.mask(spark).count() * Q.eligible(spark, SF_SMALL, LY.OLDER_ORDERING).count()
    assert out["model"].numFeatures == 5 + 7 + 5 + 6
    day_total = out["by_day"].agg(F.sum("n")).first()[0]
    month_total = out["by_month"].agg(F.sum("n")).first()[0]
    assert day_total == month_total == spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
    tr, te = out["train"], out["test"]
    key = ["period_h", "row", "col"]
    assert tr.select(*key).intersect(te.select(*key)).count() == 0


@pytest.fixture(scope="module")
def job(spark):
    cfg = DM.DemandModelConfig(grid=Q.GRID, forest=SMALL_FOREST)
    res = DM.run(spark, Q.counts(spark, SF_SMALL), Q.mask(spark), Q.geo(spark), Q.weather(spark, SF_SMALL), cfg)
    path = scratch_dir(spark, "report-test")
    R.store_outputs(res, path, Q.GRID)
    yield res, path
    delete_path(spark, path)
    res.close()


def test_report_over_store_matches_stats(spark, job):
    res, path = job
    rep = R.concentration_report(spark, path, Q.mask(spark).count())
    cols = ["period_h", "layer", "one_percent", "five_percent", "ten_percent", "twenty_percent", "total"]

    def rounded(df):
        return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())

    assert rounded(rep) == rounded(res.stats)
    assert rep.count() > 0


def test_outputs_listing(spark, job):
    """Observed and two-hour rasters of all test periods that have the layer, predicted ones of
    the eligible test periods; their cells too."""
    res, path = job
    listed = {(r["grouping"], r["period_h"]) for r in RS.list_rasters(spark, path).collect()}
    test = {r["period_h"] for r in res.split.filter("split = 'test'").collect()}
    layers = {(r["layer"], r["period_h"]) for r in res.extras["manifest"].collect() if r["period_h"] in test}
    eligible = {r["period_h"] for r in res.extras["eligible"].collect()}
    want = {(g, h) for g, h in layers if g in ("observed", "two_hour")} | {("predicted", h) for h in test & eligible}
    assert listed == want
    both = {h for g, h in want if g == "observed"} & {h for g, h in want if g == "two_hour"} & test & eligible
    assert len([h for g, h in want if g == "observed"]) > len(both)
    stored = RS.read_layers(spark, path, "observed").select("period_h", "row", "col", "value")
    kept = LY.rasterize(Q.counts(spark, SF_SMALL), Q.GRID).filter(F.col("period_h").isin(*test))
    assert stored.exceptAll(kept).count() == kept.exceptAll(stored).count() == 0


def test_close_leaves_nothing(spark):
    import os
    counts = Q.counts(spark, SF_SMALL)
    old = LM.run(spark, counts, Q.mask(spark), Q.geo(spark), LM.LegacyConfig(grid=Q.GRID, forest=SMALL_FOREST))
    res = DM.run(spark, counts, Q.mask(spark), Q.geo(spark), Q.weather(spark, SF_SMALL),
                 DM.DemandModelConfig(grid=Q.GRID, forest=SMALL_FOREST))
    path = res.scratch[0].removeprefix("file://")
    assert os.path.isdir(path) and counts.is_cached
    base = os.path.dirname(path)
    before = {x for x in os.listdir(base) if "features" in x}
    res.close()
    old["close"]()
    assert len({x for x in os.listdir(base) if "features" in x}) == len(before) - 2
    assert not os.path.exists(path) and not counts.is_cached


def test_deep_forest_fits(spark):
    rows = Q.held_counts(spark, SF_SMALL).withColumn("label", F.col("n").cast("double")).filter("row between 0 and 47")
    model = M.fit_columns(rows, ["row", "col"], M.DEEP_FOREST)
    assert model.getNumTrees == 300 and max(t.depth for t in model.trees) <= 10
    assert M.predict_columns(model, rows, ["row", "col"]).filter("prediction is null").count() == 0


def test_ingest_from_text_files(spark):
    from cellcast.sources import testdata as T
    path = scratch_dir(spark, "trip-text")
    T.trip_lines_from_events(T.load_events(spark, SF_SMALL)).repartition(3).write.text(path)
    got = DM.ingest(spark, path, Q.GRID)
    want = Q.counts(spark, SF_SMALL)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    got.unpersist()
