"""Splits, random forest training and batch prediction (``spark.ml``).

Keys travel with the rows through ``transform``, so predictions are joined
back by column, never by position.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellcast.functions.periods import EPOCH
from cellcast.operators.features import assemble
from cellcast.operators.layers import MAIN_ORDERING


@dataclass(frozen=True)
class ForestPreset:
    num_trees: int
    max_depth: int
    max_bins: int
    feature_subset: str = "auto"
    impurity: str = "variance"
    # Statistics of one pass over the rows; a deep level of many trees needs more than the default 256.
    memory_mb: int = 256
    bootstrap: bool = True


# The two forest settings of the analysed jobs.
MAIN_FOREST = ForestPreset(num_trees=50, max_depth=3, max_bins=32)
DEEP_FOREST = ForestPreset(num_trees=300, max_depth=10, max_bins=64, memory_mb=2048)


def split_bucket(keys: list[Column], seed: int) -> Column:
    """Bucket 0..9999 from the first 32 bits of md5('<key>:...:<seed>'): recomputation gives the
    same split, and any engine can reproduce it."""
    digest = F.md5(F.concat_ws(":", *[k.cast("string") for k in keys], F.lit(str(int(seed)))))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(10000))


def split_periods(periods: DataFrame, train_fraction: float = 0.7, seed: int = 7) -> DataFrame:
    """``(period_h, split)``: whole periods go to 'train' or 'test'."""
    b = split_bucket([F.col("period_h")], seed)
    return periods.select("period_h", F.when(b < int(round(train_fraction * 10000)), "train")
                          .otherwise("test").alias("split"))


def split_rows(df: DataFrame, train_fraction: float = 0.7, seed: int = 7,
               keys=("period_h", "row", "col")) -> tuple[DataFrame, DataFrame]:
    """Row-level split (the older job): each (period, cell) goes to one side."""
    b = split_bucket([F.col(k) for k in keys], seed)
    cut = int(round(train_fraction * 10000))
    return df.filter(b < cut), df.filter(b >= cut)


def time_holdout(periods: DataFrame, test_from: int, train_after: int | None = None,
                 train_before: int | None = None) -> DataFrame:
    """``(period_h, split)`` by time: 'test' from ``test_from`` on (inclusive);
    'train' before ``train_before`` (default ``test_from``) and after
    ``train_after`` when given (both exclusive); other periods are left out."""
    h = F.col("period_h")
    train = h < (test_from if train_before is None else train_before)
    if train_after is not None:
        train = train & (h > train_after)
    return periods.select("period_h", F.when(h >= test_from, "test").when(train, "train").alias("split")) \
        .filter(F.col("split").isNotNull())


def reference_time_bounds() -> dict[str, int]:
    """The commented-out hold-out of the older job, as hour indexes. Its bounds
    compare period text as integers: train strictly between 2013011000 and
    2013120000, test strictly above 2013120000, which (day 00) falls between
    2013-11-30 23h and 2013-12-01 00h. So train is 2013-01-10 01h to 2013-11-30 23h
    and test starts at 2013-12-01 00h."""
    def hour(y, m, d, hh):
        return (dt.date(y, m, d) - EPOCH).days * 24 + hh
    return {"train_after": hour(2013, 1, 10, 0), "test_from": hour(2013, 12, 1, 0)}


def _forest(preset: ForestPreset, seed: int):
    from pyspark.ml.regression import RandomForestRegressor

    return RandomForestRegressor(
        featuresCol="features", labelCol="label", predictionCol="prediction",
        numTrees=preset.num_trees, maxDepth=preset.max_depth, maxBins=preset.max_bins,
        featureSubsetStrategy=preset.feature_subset, impurity=preset.impurity, seed=seed,
        maxMemoryInMB=preset.memory_mb, bootstrap=preset.bootstrap)


def _vectors(rows: DataFrame, columns: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="error").transform(rows)


def _keyed(scored: DataFrame) -> DataFrame:
    return scored.select("period_h", "row", "col", F.col("prediction").cast("double").alias("prediction"))


def fit_columns(train: DataFrame, columns: list[str], preset: ForestPreset = MAIN_FOREST, seed: int = 11):
    """Fit a regression forest on ``label`` over any columns."""
    return _forest(preset, seed).fit(_vectors(train, columns))


def predict_columns(model, rows: DataFrame, columns: list[str]) -> DataFrame:
    return _keyed(model.transform(_vectors(rows, columns)))


def fit_forest(train: DataFrame, preset: ForestPreset = MAIN_FOREST, ordering=MAIN_ORDERING,
               repeat_static: bool = False, weather: bool = True, seed: int = 11):
    """Assemble features and fit a regression forest on ``label``."""
    return _forest(preset, seed).fit(assemble(train, ordering, repeat_static, weather))


def predict(model, rows: DataFrame, ordering=MAIN_ORDERING, repeat_static: bool = False,
            weather: bool = True) -> DataFrame:
    """``(period_h, row, col, prediction)`` for every feature row."""
    return _keyed(model.transform(assemble(rows, ordering, repeat_static, weather)))
