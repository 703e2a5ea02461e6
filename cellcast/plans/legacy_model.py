"""The older job: five lag layers, no weather, no smoothing, a row-level split
and the deep forest preset. It ends at the fitted model, plus day and month
trip summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcast.functions.grid import NYC_50M, GridSpec
from cellcast.operators import features as FT
from cellcast.operators import layers as LY
from cellcast.operators import model as M
from cellcast.session import delete_path
from cellcast.plans.demand_model import _materialize, trip_summaries


@dataclass(frozen=True)
class LegacyConfig:
    grid: GridSpec = NYC_50M
    forest: M.ForestPreset = M.DEEP_FOREST
    train_fraction: float = 0.7
    split_seed: int = 7
    forest_seed: int = 11
    repeat_static: bool = False
    materialize: str = "table"


def run(spark: SparkSession, counts: DataFrame, mask: DataFrame, geo: DataFrame,
        cfg: LegacyConfig = LegacyConfig()) -> dict:
    ordering = list(LY.OLDER_ORDERING)
    by_day, by_month = trip_summaries(counts)
    manifest = LY.period_manifest(counts, [LY.OBSERVED] + ordering)
    eligible = LY.eligible_periods(manifest, ordering)
    wide = LY.wide_layers(counts, cfg.grid, ordering)
    feats = FT.feature_table(wide, eligible, mask, geo, None, cfg.grid, ordering)
    scratch: list[str] = []
    feats = _materialize(spark, feats, cfg.materialize, "legacy-features", scratch)
    train, test = M.split_rows(feats, cfg.train_fraction, cfg.split_seed)
    model = M.fit_forest(train, cfg.forest, ordering, cfg.repeat_static, weather=False, seed=cfg.forest_seed)

    def close() -> None:
        by_day.unpersist()
        for path in scratch:
            delete_path(spark, path)

    return {"close": close, "model": model, "by_day": by_day, "by_month": by_month, "train": train, "test": test,
            "n_features": feats.agg(F.count(F.lit(1))).first()[0]}
