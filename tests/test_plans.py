"""Physical plan checks: no Python evaluation, no cartesian products, broadcasts where bounded."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from cellcast.plans import catalog

BANNED = ["BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"]
# Their result is a plain read of what they have written.
SKIP = {"raster_listing", "stream_cell_counts"}


@pytest.fixture(autouse=True)
def nothing_cached(spark):
    spark.catalog.clearCache()


def executed(df) -> str:
    """The plan as it ran, after adaptive re-planning."""
    qe = df.groupBy().agg(F.count(F.lit(1)), *[F.max(F.col(f"`{c}`")) for c in df.columns])._jdf.queryExecution()
    qe.executedPlan().executeCollect()
    return qe.executedPlan().toString().partition("== Initial Plan ==")[0]


@contextmanager
def without_broadcasts(spark):
    """As at scale, where no table but the bounded ones is small enough to broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SKIP))
def test_no_python_no_cartesian(spark, name):
    plan = executed(catalog.QUERIES[name](spark, SF_SMALL))
    for word in BANNED:
        assert word not in plan, f"{name}: {word}"


def test_dense_side_is_not_exchanged(spark):
    """Above the expansion of the mask over the hours there is neither an exchange nor a sort,
    also when nothing is small enough to broadcast by itself."""
    from cellcast.operators import features as FT
    from cellcast.operators import layers as LY
    c = catalog.held_counts(spark, SF_SMALL)
    el = LY.eligible_periods(LY.period_manifest(c), LY.MAIN_ORDERING)
    with without_broadcasts(spark):
        ft = FT.feature_table(LY.wide_layers(c, catalog.GRID), el, catalog.mask(spark), catalog.geo(spark), None, catalog.GRID)
        df = ft.groupBy().agg(*[F.sum(k) for k in LY.MAIN_ORDERING])
        qe = df._jdf.queryExecution()
        qe.executedPlan().executeCollect()
        plan = qe.executedPlan().toString().partition("== Initial Plan ==")[0]
    above = plan[:plan.index("explode(")].split("ShuffledHashJoin", 1)[1]
    assert "Exchange" not in above and "Sort" not in above
    assert "SortMergeJoin" not in plan.split("explode(", 1)[0]


def test_lag_exchange_carries_uncopied_counts(spark):
    from cellcast.operators import lags as L
    plan = L.lag_layers(catalog.counts(spark, SF_SMALL))._jdf.queryExecution().executedPlan().toString()
    # The spread of the trips, the counts, and the counts by cell below the fan-out; none above it.
    assert plan.count("Exchange hashpartitioning") == 3
    assert "Exchange" not in plan[:plan.index("Generate explode")]


def test_wide_layers_shuffle_budget(spark):
    """At runtime: the spread, the counts, the counts by cell, the layers by period, and the
    global count of this test."""
    from cellcast.operators import layers as LY
    df = LY.wide_layers(catalog.counts(spark, SF_SMALL), catalog.GRID).groupBy().count()
    qe = df._jdf.queryExecution()
    qe.executedPlan().executeCollect()
    plan = qe.executedPlan().toString().partition("== Initial Plan ==")[0]
    assert plan.count("ShuffleQueryStage") - plan.count("ReusedExchange") == 5


@pytest.mark.parametrize("name, scans", [("combined_stats", 0), ("baseline_two_hour_avg", 0), ("feature_table", 1)])
def test_trips_are_parsed_once(spark, name, scans):
    """All uses of the counts read one persisted table. Weather alone scans the events again,
    for its first and last hour."""
    plan = catalog.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().withCachedData().collectLeaves()
    leaves = [plan.apply(i).getClass().getSimpleName() for i in range(plan.size())]
    assert "InMemoryRelation" in leaves
    assert leaves.count("LogicalRelation") == scans


def main_tree(df) -> str:
    """The tree of the plan as it ran, without its subqueries."""
    qe = df._jdf.queryExecution()
    qe.executedPlan().executeCollect()
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = qe.explainString(mode).partition("== Initial Plan ==")[0]
    return text.partition("===== Subqueries =====")[0]


def test_written_counts_need_no_exchange_by_cell(spark):
    """Lag layers of the written counts and their dense join: neither side is exchanged."""
    c, m = catalog.by_cell_tables(spark, SF_SMALL)
    with without_broadcasts(spark):
        tree = main_tree(catalog.materialized_lags(c, m).groupBy().agg(F.sum("two_hour"), F.count("row")))
    below = tree[tree.index("ShuffledHashJoin"):]
    assert "Exchange" not in below and "Sort " not in below and below.count("Scan parquet") == 2


def test_top_share_ranks_no_cells(spark):
    """Values are combined before the exchange by raster, above which the window runs."""
    tree = main_tree(catalog.QUERIES["top_share"](spark, SF_SMALL))
    below = tree[tree.index("Window"):]
    assert below.index("Exchange") < below.index("HashAggregate")
