"""Model job: split properties, prediction shape, and a sanity bound on the fit."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from cellcast.operators import model as M
from cellcast.plans import catalog as Q
from cellcast.plans import demand_model as DM


def test_period_split_disjoint_and_stable(spark):
    el = Q.eligible(spark, SF_SMALL)
    a = M.split_periods(el, 0.7, 7)
    b = M.split_periods(el, 0.7, 7)
    assert a.exceptAll(b).count() == 0
    tr = a.filter(F.col("split") == "train").select("period_h")
    te = a.filter(F.col("split") == "test").select("period_h")
    assert tr.intersect(te).count() == 0
    assert tr.count() + te.count() == el.count()


def test_model_run(spark):
    cfg = DM.DemandModelConfig(grid=Q.GRID, forest=M.ForestPreset(num_trees=8, max_depth=3, max_bins=16))
    res = DM.run(spark, Q.counts(spark, SF_SMALL), Q.mask(spark), Q.geo(spark), Q.weather(spark, SF_SMALL), cfg)
    test_periods = res.features.filter(F.col("split") == "test").select("period_h").distinct().count()
    n_mask = Q.mask(spark).count()
    assert res.predictions.count() == test_periods * n_mask
    assert res.predictions.filter(F.col("prediction") < 0).count() == 0
    # training RMSE no worse than predicting the mean label
    train = res.features.filter(F.col("split") == "train")
    scored = M.predict(res.model, train.drop("split")).join(train.select("period_h", "row", "col", "label"),
                                                            ["period_h", "row", "col"])
    mean = train.agg(F.avg("label")).first()[0]
    r = scored.agg(F.avg((F.col("prediction") - F.col("label")) ** 2).alias("m"),
                   F.avg((F.lit(mean) - F.col("label")) ** 2).alias("c")).first()
    assert r["m"] <= r["c"] + 1e-12
    stats = res.stats.toPandas()
    assert set(stats.layer) == {"obs", "pred", "two"}
    assert (stats.one_percent <= stats.five_percent + 1e-9).all()
    assert (stats.twenty_percent <= stats.total + 1e-9).all()


def test_reference_time_holdout(spark):
    from cellcast.functions.periods import period_from_text
    b = M.reference_time_bounds()
    texts = ["2013011000", "2013011001", "2013113023", "2013120100", "2013120101"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(period_from_text(F.col("t")).alias("period_h"))
    got = {r["period_h"]: r["split"] for r in M.time_holdout(df, **b).collect()}
    h = {t: r[0] for t, r in zip(texts, df.collect())}
    assert got == {h["2013011001"]: "train", h["2013113023"]: "train", h["2013120100"]: "test",
                   h["2013120101"]: "test"}
