"""The main job: trips -> counts -> layers -> features -> forest -> predictions -> stats.

Shuffle budget on the trip side: one for the cell-hour counts (partial
aggregation first), one of those counts by cell for all lag layers, one by
period for smoothing and pivot, one by cell for the dense join. The mask and the
static layers are broadcast behind a bound on the cells of the grid; for tables
by hour the choice is left to Spark, which sees their size.

The counts are persisted (a lost executor recomputes its blocks from the scan),
and the feature table is written once to the shared checkpoint folder and read
back, so training passes and scoring never re-run the layer stack. ``close()`` on
the result deletes the table and releases the counts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcast.functions.grid import NYC_50M, GridSpec
from cellcast.operators import counts as C
from cellcast.operators import evaluate as E
from cellcast.operators import features as FT
from cellcast.operators import lags as L
from cellcast.operators import layers as LY
from cellcast.operators import model as M
from cellcast.operators import trees as TR
from cellcast.session import delete_path, scratch_dir
from cellcast.sources import trip_store
from cellcast.sources.trips import trip_cells


@dataclass(frozen=True)
class DemandModelConfig:
    grid: GridSpec = NYC_50M
    ordering: tuple[str, ...] = tuple(LY.MAIN_ORDERING)
    forest: M.ForestPreset | TR.TableForest = M.MAIN_FOREST
    train_fraction: float = 0.7
    split_seed: int = 7
    forest_seed: int = 11
    repeat_static: bool = False
    with_weather: bool = True
    on_missing_weather: str = "fail"
    sigma: float = 1.0
    truncate: float = 4.0
    focal_size: int = 1
    area: int | None = None          # evaluation area; default = number of mask cells
    hours: int = FT.DEFAULT_SPAN_HOURS  # eligible hours that the expansion tasks are sized for
    materialize: str = "table"       # 'table' (parquet in the checkpoint folder), 'checkpoint' or 'none'


@dataclass
class DemandModelResult:
    """What the job leaves: ``rasters`` and ``raster_periods`` hold, by grouping, the predicted,
    observed and halved two-hour rasters of the test periods and the periods that have one."""
    model: object
    split: DataFrame
    features: DataFrame
    predictions: DataFrame
    stats: DataFrame
    rasters: dict[str, DataFrame]
    raster_periods: dict[str, DataFrame]
    extras: dict = field(default_factory=dict)
    scratch: list[str] = field(default_factory=list)
    held: list[DataFrame] = field(default_factory=list)

    def close(self) -> None:
        """Drop what the job kept for its result: scratch tables and persisted counts. The
        model stays usable, the tables do not."""
        spark = self.split.sparkSession
        for df in self.held:
            df.unpersist()
        for path in self.scratch:
            delete_path(spark, path)


def ingest(spark: SparkSession, trip_paths, grid: GridSpec = NYC_50M, on_bad: str = "fail",
           zone: int | None = None, partitions: int | None = None, store: str | None = None) -> DataFrame:
    """Trip text -> persisted cell-hour counts; unpersist them when done.

    With a ``store`` folder the files are counted once each, whatever the number of calls, and
    ``on_bad='quarantine'`` keeps their bad lines there (``trip_store.bad_lines``)."""
    if store is not None:
        trip_store.ingest_new(spark, trip_paths, store, grid, on_bad, zone, partitions)
        return C.persist_counts(trip_store.stored_counts(spark, store))
    if on_bad == "quarantine":
        raise ValueError("on_bad='quarantine' needs a store for the bad lines")
    return C.persist_counts(C.cell_hour_counts(trip_cells(spark, trip_paths, grid, on_bad, zone, partitions)))


def _materialize(spark: SparkSession, df: DataFrame, how: str, name: str, scratch: list[str],
                 partition_by: list[str] | None = None) -> DataFrame:
    """Cut the lineage; the folder of a written table is added to ``scratch``."""
    if how == "none":
        return df
    if how == "checkpoint":
        return df.checkpoint(eager=True)
    if how == "table":
        path = scratch_dir(spark, name)
        scratch.append(path)
        w = df.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)
        return spark.read.parquet(path)
    raise ValueError("materialize must be 'table', 'checkpoint' or 'none'")


def build_features(counts: DataFrame, mask: DataFrame, geo: DataFrame, weather: DataFrame | None,
                   cfg: DemandModelConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(manifest, eligible periods, feature table) for every eligible period."""
    ordering = list(cfg.ordering)
    manifest = LY.period_manifest(counts, [LY.OBSERVED] + ordering)
    eligible = LY.eligible_periods(manifest, ordering)
    wide = LY.wide_layers(counts, cfg.grid, ordering, cfg.sigma, cfg.truncate, cfg.focal_size)
    feats = FT.feature_table(wide, eligible, mask, geo, weather if cfg.with_weather else None,
                             cfg.grid, ordering, cfg.on_missing_weather, cfg.hours)
    return manifest, eligible, feats


def _fit_and_predict(spark: SparkSession, train: DataFrame, test: DataFrame, cfg: DemandModelConfig, scratch: list[str]):
    """The fitted forest (a model, or a table of nodes) and its predictions for the test rows."""
    ordering = list(cfg.ordering)
    if isinstance(cfg.forest, M.ForestPreset):
        model = M.fit_forest(train, cfg.forest, ordering, cfg.repeat_static, cfg.with_weather, cfg.forest_seed)
        return model, M.predict(model, test, ordering, cfg.repeat_static, cfg.with_weather)
    columns = FT.feature_columns(ordering, cfg.repeat_static, cfg.with_weather)
    scratch.append(scratch_dir(spark, "forest"))
    nodes = TR.fit_nodes(TR.feature_rows(train, columns), len(columns), scratch[-1], cfg.forest)
    return nodes, TR.score(nodes, TR.feature_rows(test, columns, label=None), cfg.forest)


def run(spark: SparkSession, counts: DataFrame, mask: DataFrame, geo: DataFrame,
        weather: DataFrame | None, cfg: DemandModelConfig = DemandModelConfig()) -> DemandModelResult:
    ordering = list(cfg.ordering)
    scratch: list[str] = []
    # Layers, manifest and both baselines read the counts; without this each would parse the trips anew.
    held = [] if counts.is_cached else [counts.persist(StorageLevel.MEMORY_AND_DISK)]
    manifest, eligible, feats = build_features(counts, mask, geo, weather, cfg)

    periods = manifest.select("period_h").distinct()
    split = M.split_periods(periods, cfg.train_fraction, cfg.split_seed)
    tagged = feats.join(split.join(eligible, "period_h", "left_semi"), "period_h")
    tagged = _materialize(spark, tagged, cfg.materialize, "features", scratch, ["split"])

    train = tagged.filter(F.col("split") == "train").drop("split")
    test = tagged.filter(F.col("split") == "test").drop("split")
    model, predictions = _fit_and_predict(spark, train, test, cfg, scratch)

    test_periods = split.filter(F.col("split") == "test").select("period_h")

    def test_layer(name: str) -> DataFrame:
        return (manifest.filter(F.col("layer") == name).select("period_h")
                .join(test_periods, "period_h", "left_semi"))

    obs = LY.rasterize(counts, cfg.grid, "n", unique_keys=True).join(test_periods, "period_h", "left_semi")
    two = (LY.rasterize(L.two_hour(counts), cfg.grid, "n", unique_keys=True).join(test_periods, "period_h", "left_semi")
           .select("period_h", "row", "col", (F.col("value") / 2).alias("value")))
    pred = predictions.select("period_h", "row", "col", F.col("prediction").alias("value"))
    area = cfg.area if cfg.area is not None else mask.agg(F.count(F.lit(1))).scalar()
    raster_periods = {"observed": test_layer(LY.OBSERVED), "two_hour": test_layer("two_hour"),
                      "predicted": test_periods.join(eligible, "period_h", "left_semi")}
    stats = E.combined_stats(
        {"obs": obs, "pred": pred, "two": two},
        {"pred": raster_periods["predicted"], "obs": raster_periods["observed"], "two": raster_periods["two_hour"]}, area)
    return DemandModelResult(model, split, tagged, predictions, stats,
                             {"observed": obs, "two_hour": two, "predicted": pred}, raster_periods,
                             {"eligible": eligible, "manifest": manifest}, scratch, held)


def trip_summaries(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per-day and per-month trip totals (the older job's summaries)."""
    by_day = C.trips_by_day(counts).persist(StorageLevel.MEMORY_AND_DISK)
    return by_day, C.trips_by_month(by_day)
