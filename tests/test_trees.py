"""Forests as tables: split search against brute force, scoring against spark.ml, awkward tables."""

import random

import pytest
from pyspark.sql import functions as F

from cellcast.operators import model as M
from cellcast.operators import trees as TR

ROWS = "period_h int, row int, col int, label double, x array<double>"


def table(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        x = [float(rng.randint(0, 6)), rng.random() if k % 3 else 0.0, float(k % 2), 5.0]
        rows.append((k, k % 7, k % 11, float(int(3 * x[0] + 10 * (x[1] > 0.4) + rng.randint(0, 1))), x))
    return rows, spark.createDataFrame(rows, ROWS)


def best_by_hand(rows, cuts):
    """The split of one node with the greatest drop of the squared error, ties by feature and cut."""
    total, n = sum(r[3] for r in rows), len(rows)
    found = []
    for f, ends in enumerate(cuts):
        for b, cut in enumerate(ends):
            left = [r[3] for r in rows if r[4][f] <= cut]
            if 0 < len(left) < n:
                right = total - sum(left)
                found.append((-(sum(left) ** 2 / len(left) + right ** 2 / (n - len(left)) - total ** 2 / n), f, b))
    return min(found) if found else None


def tree_by_hand(rows, cuts, depth, node=1):
    out = {node: (None, None, len(rows), sum(r[3] for r in rows) / len(rows))}
    best = best_by_hand(rows, cuts) if depth else None
    if best and -best[0] > 1e-6:
        _, f, b = best
        out[node] = (f, cuts[f][b], *out[node][2:])
        out |= tree_by_hand([r for r in rows if r[4][f] <= cuts[f][b]], cuts, depth - 1, 2 * node)
        out |= tree_by_hand([r for r in rows if r[4][f] > cuts[f][b]], cuts, depth - 1, 2 * node + 1)
    return out


def test_one_tree_of_all_rows_equals_brute_force(spark, tmp_path):
    rows, df = table(spark)
    spec = TR.TableForest(num_trees=1, max_depth=3, max_bins=8, feature_subset="all", bootstrap=False)
    nodes = TR.fit_nodes(df, 4, str(tmp_path), spec).collect()
    cuts = TR.feature_cuts(df, 4, 8)
    want = tree_by_hand(rows, cuts, 3)
    assert {r.node: (r.feature, r.threshold, r.n) for r in nodes} == {k: v[:3] for k, v in want.items()}
    assert all(abs(r.prediction - want[r.node][3]) < 1e-9 for r in nodes)


def test_cuts_are_few_observed_and_leave_bins_to_the_tail(spark):
    rows = [(k, 0, 0, 0.0, [0.0 if k % 10 else float(k), float(k % 5), 1.0]) for k in range(2000)]
    cuts = TR.feature_cuts(spark.createDataFrame(rows, ROWS), 3, 32)
    assert cuts[1] == [0.0, 1.0, 2.0, 3.0] and cuts[2] == []
    assert cuts[0][0] == 0.0 and 25 <= len(cuts[0]) <= 31  # nine of ten rows are zero, yet the rest is resolved
    assert set(cuts[0]) <= {r[4][0] for r in rows} and cuts[0] == sorted(cuts[0])


def test_bootstrap_draws_about_poisson_counts(spark):
    rows, df = table(spark, 3000)
    each = df.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(9))))
    drawn = TR.with_bootstrap(each, ["period_h", "row", "col"], 11)
    share = drawn.count() / 30000
    mean = drawn.agg(F.sum("w")).first()[0] / 30000
    assert abs(share - 0.632) < 0.02 and abs(mean - 1.0) < 0.04
    per_tree = [r.n for r in drawn.groupBy("tree").agg(F.sum(F.col("w") * F.col("period_h")).alias("n")).collect()]
    assert len(set(per_tree)) == 10


def test_forest_is_the_same_for_any_partitioning_and_learns(spark, tmp_path):
    rows, df = table(spark)
    spec = TR.TableForest(num_trees=12, max_depth=4, max_bins=16)
    a = TR.fit_nodes(df.repartition(7), 4, str(tmp_path / "a"), spec)
    b = TR.fit_nodes(df.coalesce(1), 4, str(tmp_path / "b"), spec)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    scored = TR.score(a, df, spec).join(df.select("period_h", "label"), "period_h")
    err, spread = scored.agg(F.avg((F.col("label") - F.col("prediction")) ** 2), F.var_pop("label")).first()
    assert scored.count() == len(rows) and err < 0.4 * spread


@pytest.mark.parametrize("preset", [M.ForestPreset(4, 3, 16), M.ForestPreset(30, 10, 64)])
def test_nodes_of_a_fitted_model_score_like_the_model(spark, tmp_path, preset):
    rows, df = table(spark)
    wide = df.select("period_h", "row", "col", "label", *[F.get("x", F.lit(i)).alias(f"f{i}") for i in range(4)])
    columns = [f"f{i}" for i in range(4)]
    model = M.fit_columns(wide, columns, preset)
    want = {r.period_h: r.prediction for r in M.predict_columns(model, wide, columns).collect()}
    nodes = TR.model_nodes(model, str(tmp_path))
    spec = TR.TableForest(preset.num_trees, preset.max_depth)
    got = {r.period_h: r.prediction for r in TR.score(nodes, df, spec, root=0).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_tables_without_rows_or_without_a_split(spark, tmp_path):
    spec = TR.TableForest(num_trees=2, max_depth=2, bootstrap=False)
    none = spark.createDataFrame([], ROWS)
    assert TR.fit_nodes(none, 2, str(tmp_path / "a"), spec).count() == 0
    flat = spark.createDataFrame([(k, 0, 0, 3.0, [1.0, float(k)]) for k in range(5)], ROWS)
    nodes = TR.fit_nodes(flat, 2, str(tmp_path / "b"), spec).collect()
    assert sorted((r.tree, r.node, r.feature, r.n, r.prediction) for r in nodes) == [(0, 1, None, 5.0, 3.0), (1, 1, None, 5.0, 3.0)]
    scored = TR.score(spark.createDataFrame(nodes, TR.NODE_SCHEMA), flat, spec).collect()
    assert [r.prediction for r in scored] == [3.0] * 5
    assert TR.score(spark.createDataFrame(nodes, TR.NODE_SCHEMA), none, spec).count() == 0
