"""Connected components of a table of links, in rounds of joins.

Each round first links every node's greater neighbours to its least one, then every
node's lesser neighbours, until only stars around the least node of each component are
left; the number of rounds grows with the logarithm of a component's diameter. Each step
is written to the shared folder and read again: that cuts the lineage, and joins between
read tables can be split by Spark where a node has very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _toward_least(pairs: DataFrame, folder: str) -> DataFrame:
    """Of pairs ``(a, b)``: each ``b``, and ``a`` itself, with the least of ``a`` and its ``b``."""
    least = stored(pairs.groupBy("a").agg(F.min("b").alias("m"))
                   .select("a", F.least("a", "m").alias("m")), f"{folder}/least")
    moved = pairs.join(least, "a").select(F.col("b").alias("hi"), F.col("m").alias("lo"))
    own = least.select(F.col("a").alias("hi"), F.col("m").alias("lo"))
    return moved.unionAll(own).filter(F.col("hi") > F.col("lo")).distinct()


def components(links: DataFrame, folder: str) -> DataFrame:
    """``(node, root)`` of every node that has a link; ``root`` is the least of its component.

    ``links`` has two integer columns, in any order; links of a node to itself and null
    ends count for nothing.
    """
    a, b = links.columns
    hi, lo = F.greatest(a, b), F.least(a, b)
    edges = (links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
             .select(hi.alias("hi"), lo.alias("lo")).distinct())
    edges = stored(edges, f"{folder}/0")
    sign = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")))
    before, round_ = edges.agg(sign).first()[0], 0
    while before[0]:
        round_ += 1
        at = f"{folder}/{round_}"
        both = edges.select(F.col("hi").alias("a"), F.col("lo").alias("b")).unionAll(
            edges.select(F.col("lo").alias("a"), F.col("hi").alias("b")))
        # Large star: keep of each node's links those to greater nodes, moved to the least.
        large = stored(_toward_least(both, f"{at}/large-least"), f"{at}/large")
        small = _toward_least(large.select(F.col("hi").alias("a"), F.col("lo").alias("b")), f"{at}/small-least")
        edges = stored(small, f"{at}/small")
        after = edges.agg(sign).first()[0]
        if after == before:
            break
        before = after
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(roots)
