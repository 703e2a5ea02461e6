"""Regression forests as tables: split search by aggregation, nodes as rows, scoring by joins.

A forest is a table of nodes ``(tree, node, feature, threshold, left, right, n, prediction)``,
leaves with a null feature. :func:`fit_nodes` grows it level by level; one level is one
aggregation:

1. Every feature is cut into at most ``max_bins`` bins at observed values, so that a row is an
   array of small integers. The cuts come from counts over ``CELLS`` equal cells between the
   least and the greatest value, a fixed number per feature; a cell's weight is limited to
   one bin's share, so that a value on most rows (the zero of a sparse layer) leaves the
   other bins to the other values.
2. A row counts ``w`` times in a tree (a Poisson draw from a hash of its key and the tree) and
   is led to its node by one broadcast join per level with the splits found so far.
3. ``sum(w), sum(w y)`` are grouped by (tree, node, feature, bin), for the features that a
   hash draws for the node; sums over bins and the greatest drop in squared error give the
   split.

Everything is a hash or a sum, so the same rows give the same forest on any cluster, and SQL
can follow it. What is broadcast or collected is bounded by trees, levels, features and bins:
cuts and nodes, never rows. The rows are written once, in binned form, and read once a level.

:func:`model_nodes` gives the same table for a ``spark.ml`` forest; :func:`score` follows
either. An empty table has no nodes. Feature values must not be null.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellcast.sources.geo import bounded_broadcast

CELLS = 4096
# Modulus and factors of the row hash, and the steps of Poisson(1) in 1/10000.
PRIME = 2147483647
FACTORS = (73856093, 19349663, 83492791, 49979687)
POISSON = (3679, 7358, 9197, 9810, 9963, 9994)
NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, n double, prediction double"


@dataclass(frozen=True)
class TableForest:
    num_trees: int = 50
    max_depth: int = 3
    max_bins: int = 32
    #: Features tried at a node: 'onethird' or 'all'.
    feature_subset: str = "onethird"
    bootstrap: bool = True
    seed: int = 11
    #: Least drop of the squared error; below it a node stays a leaf.
    min_gain: float = 1e-6

    def subset(self, n_features: int) -> int:
        return n_features if self.feature_subset == "all" else max(1, math.ceil(n_features / 3))


def with_hash(df: DataFrame, name: str, keys: list[Column], seed: int) -> DataFrame:
    """Add a hash of integer keys in ``[0, PRIME)``, in integer arithmetic that any engine has.

    The one-element ``inline()`` makes each step a value; squaring would repeat the step before
    otherwise.
    """
    first = reduce(Column.__add__, [F.pmod(k.cast("long"), F.lit(PRIME)) * f for k, f in zip(keys, FACTORS, strict=False)])
    step = F.pmod(first + F.lit(seed).cast("long"), F.lit(PRIME))
    columns = df.columns
    for _ in range(3):
        df = df.select(*columns, F.inline(F.array(F.struct(step.alias(name)))))
        step = F.pmod(F.col(name) * F.col(name) + F.lit(FACTORS[0]), F.lit(PRIME))
    return df


def with_bootstrap(df: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Add ``w``, how often a row counts in its tree, and keep the rows that count."""
    u = F.pmod(F.col("w"), F.lit(10000))
    drawn = with_hash(df, "w", [F.col(k) for k in [*keys, "tree"]], seed).filter(u >= POISSON[0])
    return drawn.withColumn("w", reduce(Column.__add__, [(u >= p).cast("double") for p in POISSON]))


def feature_rows(rows: DataFrame, columns: list[str], keys=("period_h", "row", "col"), label: str | None = "label") -> DataFrame:
    """Keys, label and the features as one array ``x``, to six places: the last bits of a
    sum that another partitioning adds up in another order decide no split."""
    x = F.array(*[F.floor(F.col(c).cast("double") * 1e6 + 0.5) / 1e6 for c in columns]).alias("x")
    return rows.select(*keys, *([F.col(label).cast("double").alias("label")] if label else []), x)


def feature_cuts(rows: DataFrame, n_features: int, max_bins: int) -> list[list[float]]:
    """Per feature the values in ascending order at which bins end, the last bin left out: at most
    ``n_features * (max_bins - 1)`` numbers."""
    spark = rows.sparkSession
    ends = rows.agg(*[F.min(F.get("x", F.lit(i))).alias(f"lo{i}") for i in range(n_features)],
                    *[F.max(F.get("x", F.lit(i))).alias(f"hi{i}") for i in range(n_features)]).first()
    if ends["lo0"] is None:
        return [[] for _ in range(n_features)]
    span = spark.createDataFrame([(i, ends[f"lo{i}"], ends[f"hi{i}"]) for i in range(n_features)], "feature int, lo double, hi double")
    values = rows.select(F.posexplode("x").alias("feature", "v")).join(F.broadcast(span), "feature")
    cell = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(CELLS - 1), F.floor(
        (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * CELLS).cast("int"))).otherwise(0)
    counted = values.groupBy("feature", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    # At most CELLS rows a feature from here on.
    whole = Window.partitionBy("feature")
    limit = F.ceil(F.sum("n").over(whole) / max_bins)
    weighed = counted.select("feature", "cell", "top", F.least("n", limit).alias("w"))
    before = F.sum("w").over(whole.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    share = F.floor(F.coalesce(before, F.lit(0)) * max_bins / F.sum("w").over(whole))
    ranked = weighed.select("feature", "top", "cell", F.count(F.lit(1)).over(whole).alias("cells"),
                            (F.row_number().over(whole.orderBy("cell")) - 1).alias("nth"), share.alias("share"))
    named = ranked.withColumn("bin", F.when(F.col("cells") <= max_bins, F.col("nth")).otherwise(F.col("share")))
    tops = named.groupBy("feature", "bin").agg(F.max("top").alias("top"))
    cuts: list[list[float]] = [[] for _ in range(n_features)]
    for r in tops.orderBy("feature", "top").collect():
        cuts[r.feature].append(r.top)
    return [c[:-1] for c in cuts]


def binned(rows: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """``b``: per feature the number of cuts below the value."""
    ends = F.array(*[F.array(*map(F.lit, cut)) if cut else F.array().cast("array<double>") for cut in cuts])
    return rows.withColumn("b", F.transform("x", lambda v, i: F.size(F.filter(F.get(ends, i), lambda c: c < v))))


def _led(rows: DataFrame, splits: list[DataFrame]) -> DataFrame:
    """Leads each row of each tree from the root through the levels of splits found so far."""
    out = rows.withColumn("node", F.lit(1))
    for split in splits:
        at = F.broadcast(split.select("tree", F.col("node"), F.col("feature").alias("_f"), F.col("bin").alias("_b")))
        right = (F.get("b", F.col("_f")) > F.col("_b")).cast("int")
        # A row whose node was not split has come to rest in a leaf.
        out = out.join(at, ["tree", "node"]).select(*rows.columns, (F.col("node") * 2 + right).alias("node"))
    return out


def _best_splits(hist: DataFrame, spec: TableForest) -> DataFrame:
    """The best split of each (tree, node), from sums by bin: at most ``max_bins`` rows per feature."""
    of = Window.partitionBy("tree", "node", "feature")
    upto = of.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    side = hist.select("tree", "node", "feature", "bin", F.sum("w").over(of).alias("w"), F.sum("s").over(of).alias("s"),
                       F.sum("w").over(upto).alias("wl"), F.sum("s").over(upto).alias("sl"))
    side = side.filter(F.col("wl") < F.col("w")).withColumns({"wr": F.col("w") - F.col("wl"), "sr": F.col("s") - F.col("sl")})
    gain = F.col("sl") * F.col("sl") / F.col("wl") + F.col("sr") * F.col("sr") / F.col("wr") - F.col("s") * F.col("s") / F.col("w")
    first = F.row_number().over(Window.partitionBy("tree", "node").orderBy(F.desc("gain"), "feature", "bin"))
    return (side.withColumn("gain", gain).filter(F.col("gain") > spec.min_gain).withColumn("nth", first).filter("nth = 1")
            .select("tree", "node", "feature", "bin", "gain", "wl", "sl", "wr", "sr"))


def fit_nodes(train: DataFrame, n_features: int, folder: str, spec: TableForest = TableForest(),
              keys=("period_h", "row", "col")) -> DataFrame:
    """Fit a forest on ``(keys, label, x)`` rows; its nodes are written to ``folder`` and read back.

    Sums of integer labels are exact, so their order decides nothing.
    """
    spark = train.sparkSession
    cuts = feature_cuts(train, n_features, spec.max_bins)
    binned(train, cuts).select(*keys, "label", "b").write.mode("overwrite").parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    each = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(spec.num_trees - 1))))
    each = with_bootstrap(each, list(keys), spec.seed) if spec.bootstrap else each.withColumn("w", F.lit(1.0))
    each = each.select("tree", "label", "b", "w")

    tried = spec.subset(n_features)
    features = F.explode(F.sequence(F.lit(0), F.lit(n_features - 1))).alias("feature")
    draw = Window.partitionBy("tree", "node").orderBy("draw", "feature")
    frontier = spark.range(spec.num_trees).select(F.col("id").cast("int").alias("tree"), F.lit(1).alias("node"))
    splits: list[DataFrame] = []
    for level in range(spec.max_depth):
        drawn = (with_hash(frontier.select("tree", "node", features), "draw", [F.col("tree"), F.col("node"), F.col("feature")], spec.seed)
                 .withColumn("nth", F.row_number().over(draw)).filter(F.col("nth") <= tried).groupBy("tree", "node").agg(F.sort_array(F.collect_list("feature")).alias("features")))
        nodes_here = spec.num_trees << level
        at = _led(each, splits).join(bounded_broadcast(drawn, nodes_here, 32 + 4 * tried), ["tree", "node"])
        hist = (at.select("tree", "node", "label", "w", "b", F.explode("features").alias("feature"))
                .groupBy("tree", "node", "feature", F.get("b", F.col("feature")).alias("bin"))
                .agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("label")).alias("s")))
        path = f"{folder}/level-{level}"
        if level == 0:
            hist.write.mode("overwrite").parquet(f"{folder}/root")
            hist = spark.read.parquet(f"{folder}/root")
        _best_splits(hist, spec).write.mode("overwrite").parquet(path)
        splits.append(spark.read.parquet(path))
        frontier = splits[-1].select("tree", F.explode(F.array(F.col("node") * 2, F.col("node") * 2 + 1)).alias("node"))
    return _node_table(spark, folder, splits, cuts)


def _node_table(spark: SparkSession, folder: str, splits: list[DataFrame], cuts: list[list[float]]) -> DataFrame:
    root = spark.read.parquet(f"{folder}/root")
    one = root.groupBy("tree", "feature").agg(F.sum("w").alias("n"), F.sum("s").alias("s"))
    found = [one.groupBy("tree").agg(F.max("n").alias("n"), F.max("s").alias("s")).select("tree", F.lit(1).alias("node"), "n", "s")]
    for split in splits:
        found += [split.select("tree", (F.col("node") * 2).alias("node"), F.col("wl").alias("n"), F.col("sl").alias("s")),
                  split.select("tree", (F.col("node") * 2 + 1).alias("node"), F.col("wr").alias("n"), F.col("sr").alias("s"))]
    cut_rows = [(i, b, c) for i, cut in enumerate(cuts) for b, c in enumerate(cut)]
    cut = spark.createDataFrame(cut_rows, "feature int, bin int, threshold double")
    chosen = reduce(DataFrame.unionByName, [s.select("tree", "node", "feature", "bin") for s in splits]) if splits else (
        spark.createDataFrame([], "tree int, node int, feature int, bin int"))
    chosen = chosen.join(F.broadcast(cut), ["feature", "bin"])
    nodes = reduce(DataFrame.unionByName, found).join(chosen, ["tree", "node"], "left")
    inner = F.col("feature").isNotNull()
    nodes.select("tree", "node", "feature", "threshold", F.when(inner, F.col("node") * 2).alias("left"),
                 F.when(inner, F.col("node") * 2 + 1).alias("right"), "n", (F.col("s") / F.col("n")).alias("prediction")
                 ).write.mode("overwrite").parquet(f"{folder}/nodes")
    return spark.read.schema(NODE_SCHEMA).parquet(f"{folder}/nodes")


def model_nodes(model, folder: str) -> DataFrame:
    """The nodes of a fitted ``spark.ml`` regression forest, from the model's saved form."""
    from pyspark.sql import SparkSession

    model.write().overwrite().save(folder)
    saved = SparkSession.getActiveSession().read.parquet(f"{folder}/data")
    node = F.col("nodeData")
    inner = node["leftChild"] >= 0
    return saved.select(
        F.col("treeID").alias("tree"), node["id"].alias("node"), F.when(inner, node["split"]["featureIndex"]).alias("feature"),
        F.when(inner, F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        F.when(inner, node["leftChild"]).alias("left"), F.when(inner, node["rightChild"]).alias("right"),
        node["rawCount"].cast("double").alias("n"), node["prediction"].alias("prediction"))


def score(nodes: DataFrame, rows: DataFrame, spec, root: int = 1, keys=("period_h", "row", "col")) -> DataFrame:
    """``(keys, prediction)`` of ``(keys, x)`` rows: the mean of the leaves that the trees lead to.

    ``spec`` gives the numbers of trees and levels, which bound the broadcast; ``root`` is the
    number of the first node (0 for a ``spark.ml`` forest). Keys must be unique. A row's trees
    stay in one task until they are averaged, so one row per key crosses the network.
    """
    most = spec.num_trees << (spec.max_depth + 1)
    inner = nodes.filter(F.col("feature").isNotNull()).select("tree", "node", "feature", "threshold", "left", "right")
    at = rows.select(*keys, "x", F.explode(F.sequence(F.lit(0), F.lit(spec.num_trees - 1))).alias("tree"), F.lit(root).alias("node"))
    step = bounded_broadcast(inner, most, 32)
    for _ in range(spec.max_depth):
        go = F.when(F.get("x", F.col("feature")) <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        at = at.join(step, ["tree", "node"], "left").select(
            *keys, "x", "tree", F.when(F.col("feature").isNull(), F.col("node")).otherwise(go).alias("node"))
    leaf = bounded_broadcast(nodes.select("tree", "node", "prediction"), most, 16)
    return at.join(leaf, ["tree", "node"]).groupBy(*keys).agg(F.avg("prediction").alias("prediction"))
