"""The query catalog: one Spark query per operator family, over the test tables.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame computed from the
tables in ``sf_dir`` (trips, weather and covariates are derived from
``events`` by ``cellcast.sources.testdata``). ``cellcast.plans.oracle`` holds
the matching DuckDB SQL under the same name.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcast.functions.grid import TEST_1KM, in_extent, utm_zone, with_utm
from cellcast.functions import periods as P
from cellcast.operators import evaluate as E
from cellcast.operators import features as FT
from cellcast.operators import layers as LY
from cellcast.operators import model as M
from cellcast.operators import smooth as S
from cellcast.operators import trees as TR
from cellcast.plans import demand_model as DM
from cellcast.plans import report as R
from cellcast.session import scratch_dir
from cellcast.sources import geo as GEO
from cellcast.sources import rasters as RS
from cellcast.sources import trip_store as TS
from cellcast.sources import weather as W
from cellcast.operators import counts as C
from cellcast.operators import lags as L
from cellcast.sources import testdata as T
from cellcast.sources.trips import project_trips, split_trip_lines, spread, trip_cells

GRID = TEST_1KM
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---- shared derived inputs ---------------------------------------------------------

def trip_fields(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The used fields of the trip lines, spread over the cluster's tasks."""
    lines = T.trip_lines_from_events(T.load_events(spark, sf_dir))
    return spread(split_trip_lines(lines), spark.sparkContext.defaultParallelism, keep)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_trips(trip_fields(spark, sf_dir), GRID)


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cell_hour_counts(cells(spark, sf_dir))


def held_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persisted counts, for queries that read them more than once (hours before the extent
    gate, cells after it): the trips are parsed once. ``spark.catalog.clearCache()`` frees them."""
    return C.persist_counts(counts(spark, sf_dir))


# ---- projection and counts ---------------------------------------------------------

@query
def project_cells(spark, sf_dir):
    """PRJ1-5: trip line -> (trip, hour, cell)."""
    return project_trips(trip_fields(spark, sf_dir, ("medallion",)), GRID,
                         keep=(F.col("medallion").cast("long").alias("trip_id"),))


@query
def bad_coords(spark, sf_dir):
    """PRJ2-4: trips whose cell falls outside the grid (sentinels, strays), counted per cell."""
    c = cells(spark, sf_dir)
    return (c.filter(~in_extent(F.col("row"), F.col("col"), GRID))
            .groupBy("row", "col").agg(F.count(F.lit(1)).alias("n")))


@query
def trips_cell_hour(spark, sf_dir):
    """AGG1."""
    return counts(spark, sf_dir)


@query
def trips_by_day(spark, sf_dir):
    """AGG2."""
    return C.trips_by_day(counts(spark, sf_dir))


@query
def trips_by_month(spark, sf_dir):
    """AGG3."""
    return C.trips_by_month(C.trips_by_day(counts(spark, sf_dir)))


# ---- trailing and lagged layers ------------------------------------------------------

@query
def trailing_2h(spark, sf_dir):
    """AGG4/AGG5: q-1, q-2."""
    return L.two_hour(counts(spark, sf_dir))


@query
def trailing_4h(spark, sf_dir):
    """AGG6: pyramid over the two-hour layer."""
    return L.four_hour(L.two_hour(counts(spark, sf_dir)))


@query
def trailing_8h(spark, sf_dir):
    """AGG7: pyramid over the four-hour layer."""
    return L.eight_hour(L.four_hour(L.two_hour(counts(spark, sf_dir))))


@query
def previous_day(spark, sf_dir):
    """AGG8."""
    return L.previous_day(counts(spark, sf_dir))


@query
def previous_week(spark, sf_dir):
    """AGG9."""
    return L.previous_week(counts(spark, sf_dir))


# ---- layers ---------------------------------------------------------------------------


# Hold-out bound of the test data (test from 2024-01-24 00h).
HOLDOUT_TEST_FROM = (_dt.date(2024, 1, 24) - P.EPOCH).days * 24


def _round(c, name):
    return F.round(F.col(c), 6).alias(name)


def mask(spark):
    return GEO.mask_cells(T.mask_cells_for_grid(spark, GRID), GRID)


def geo(spark):
    return GEO.geo_wide(T.geo_cells_for_grid(spark, GRID), GRID)


def weather(spark, sf_dir):
    rows = T.weather_csv_rows_from_events(T.load_events(spark, sf_dir))
    return W.weather_table(rows.withColumn("_ord", F.monotonically_increasing_id()))


def eligible(spark, sf_dir, ordering=LY.MAIN_ORDERING):
    return LY.eligible_periods(LY.period_manifest(counts(spark, sf_dir), [LY.OBSERVED] + ordering), ordering)


def area(spark):
    """Evaluation area of the test grid: the number of mask cells, as a scalar
    subquery of the calling plan (no separate driver action)."""
    return mask(spark).agg(F.count(F.lit(1))).scalar()


@query
def rasterize_extent(spark, sf_dir):
    """FLT1 + AGG10: in-extent cells summed per period."""
    return LY.rasterize(counts(spark, sf_dir), GRID, "n")


def _layer_stats(long):
    return long.groupBy("layer", "period_h").agg(
        F.count(F.lit(1)).alias("n_cells"), F.round(F.sum("value"), 6).alias("total"))


@query
def layer_union_stats(spark, sf_dir):
    """SET1 + PRJ12: the 12-layer union, cells and mass per (layer, period)."""
    return _layer_stats(LY.long_layers(counts(spark, sf_dir), GRID, LY.MAIN_ORDERING))


@query
def older_layer_union(spark, sf_dir):
    """SET2: the 6-layer union of the older job."""
    return _layer_stats(LY.long_layers(counts(spark, sf_dir), GRID, LY.OLDER_ORDERING))


@query
def layer_pivot(spark, sf_dir):
    """AGG11: layers side by side per (period, cell); NULL = zero cell."""
    names = [LY.OBSERVED] + LY.MAIN_ORDERING
    wide = LY.pivot_layers(LY.long_layers(counts(spark, sf_dir), GRID, LY.MAIN_ORDERING), names)
    return wide.select("period_h", "row", "col", *[_round(k, k) for k in names])


@query
def fused_layers(spark, sf_dir):
    """AGG4-11 fused: the wide layer table built with the fewest shuffles."""
    names = [LY.OBSERVED] + LY.MAIN_ORDERING
    wide = LY.wide_layers(counts(spark, sf_dir), GRID, LY.MAIN_ORDERING)
    return wide.select("period_h", "row", "col", *[_round(k, k) for k in names])


@query
def period_manifest(spark, sf_dir):
    """Which (layer, period) rasters exist, taken before the extent gate."""
    return LY.period_manifest(counts(spark, sf_dir))


@query
def eligible_periods(spark, sf_dir):
    """FLT3 + FLT4."""
    return eligible(spark, sf_dir)


# ---- smoothing ------------------------------------------------------------------------

def _two_hour_layer(spark, sf_dir):
    return LY.tag_layer(LY.rasterize(L.two_hour(counts(spark, sf_dir)), GRID, "n", unique_keys=True),
                        "two_hour")


@query
def kernel_density_2h(spark, sf_dir):
    """SPT1: Gaussian (sigma 1, radius 4, reflect) of the two-hour layer."""
    kd = S.kernel_density(_two_hour_layer(spark, sf_dir), GRID)
    return kd.select("period_h", "row", "col", _round("value", "value"))


@query
def focal_mean_2h(spark, sf_dir):
    """SPT2: focal mean of the two-hour layer, sizes 1 (identity) and 3."""
    src = _two_hour_layer(spark, sf_dir)
    parts = [S.focal_mean(src, GRID, size).select(F.lit(size).alias("size"), "period_h", "row", "col",
                                                   _round("value", "value"))
             for size in (1, 3)]
    return parts[0].unionByName(parts[1])


# ---- calendar and spines ----------------------------------------------------------------

def _orders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet")


@query
def period_parts(spark, sf_dir):
    """PRJ5-8 on order dates: hour index, text, parts and shifted periods."""
    o = _orders(spark, sf_dir).select("o_orderkey", P.hour_index(F.col("o_orderdate")).alias("period_h"))
    h = F.col("period_h")
    parts = P.period_parts(h)
    return o.select(
        "o_orderkey", "period_h", P.period_text(h).alias("period_text"),
        parts["month"].alias("month"), parts["day"].alias("day"), parts["hour"].alias("hour"),
        P.period_text(P.shift_period(h, 1)).alias("next_hour_text"),
        P.period_text(P.shift_period(h, -24)).alias("prev_day_text"),
        P.period_from_text(P.period_text(h)).alias("period_back"))


@query
def weekday_onehot(spark, sf_dir):
    """PRJ9: seven weekday indicators, Monday first."""
    o = _orders(spark, sf_dir)
    oh = P.weekday_onehot(F.to_date("o_orderdate"))
    return o.select("o_orderkey", *[oh[k].alias(k) for k in P.WEEKDAY_COLUMNS])


@query
def hour_spine(spark, sf_dir):
    """GEN1/GEN2: every hour between the first and last event hour."""
    spine = P.hour_spine_between(T.event_hour_bounds(T.load_events(spark, sf_dir)))
    return spine.select("period_h", P.period_text(F.col("period_h")).alias("period_text"))


@query
def day_spine(spark, sf_dir):
    """GEN3: every day between the first and last event day, with its weekday."""
    ev = T.load_events(spark, sf_dir)
    bounds = ev.agg(F.min(F.to_date("ts")).alias("lo"), F.max(F.to_date("ts")).alias("hi"))
    days = P.day_spine_between(bounds)
    return days.select((F.year("day") * 10000 + F.month("day") * 100 + F.dayofmonth("day")).cast("int")
                       .alias("day_key"), F.weekday("day").alias("weekday"))


# ---- weather and static inputs -----------------------------------------------------------

@query
def weather_features(spark, sf_dir):
    """SRC3 + PRJ10-11 + JN1: hourly weather joined to the hours with trips."""
    hours = LY.observed_periods(counts(spark, sf_dir))
    return hours.join(weather(spark, sf_dir), "period_h", "inner")


@query
def weather_flatten(spark, sf_dir):
    """SRC6: landed responses flattened to the 24 CSV fields."""
    flat = W.flatten_weather_json(T.weather_json_from_events(T.load_events(spark, sf_dir)))
    return flat.select("datetime", *[_round(k, k) for k in W.WEATHER_KEYS])


@query
def static_geo_join(spark, sf_dir):
    """SRC4 + JN4: static values of every in-extent cell with trips."""
    c = counts(spark, sf_dir).filter(in_extent(F.col("row"), F.col("col"), GRID)).select("row", "col").distinct()
    return c.join(GEO.bounded_broadcast(geo(spark), GRID.n_cells, 64), ["row", "col"], "left")


@query
def mask_expand(spark, sf_dir):
    """FLT2 + JN3: every mask cell at every eligible period."""
    return FT.dense_keys(eligible(spark, sf_dir), mask(spark), GRID)


def _features(spark, sf_dir, ordering=LY.MAIN_ORDERING, with_weather=True):
    c = held_counts(spark, sf_dir)
    el = LY.eligible_periods(LY.period_manifest(c, [LY.OBSERVED] + ordering), ordering)
    wide = LY.wide_layers(c, GRID, ordering)
    return FT.feature_table(wide, el, mask(spark), geo(spark),
                            weather(spark, sf_dir) if with_weather else None, GRID, ordering)


def _feature_profile(ft):
    """Per period: rows, the sum of every column, and its sum weighted by the cell's number on
    the grid, which changes when values move between the cells of a period."""
    cols = [c for c in ft.columns if c != "period_h"]
    place = (F.col("row") * GRID.n_cols + F.col("col") + 1).cast("double")
    sums = [F.round(F.sum(F.col(c).cast("double")), 6).alias(f"sum_{c}") for c in cols]
    placed = [F.round(F.sum(F.col(c).cast("double") * place), 3).alias(f"placed_{c}") for c in cols]
    return ft.groupBy("period_h").agg(F.count(F.lit(1)).alias("n_rows"), *sums, *placed)


@query
def feature_table(spark, sf_dir):
    """JN1-5 + O-FEAT columns: the full feature table, profiled per period by cell."""
    return _feature_profile(_features(spark, sf_dir))


@query
def older_feature_table(spark, sf_dir):
    """ML9: the older job's features (5 layers, no weather), profiled per period."""
    return _feature_profile(_features(spark, sf_dir, LY.OLDER_ORDERING, with_weather=False))


# ---- split, baseline, evaluation ---------------------------------------------------------

def _test_eligible(c):
    el = LY.eligible_periods(LY.period_manifest(c, [LY.OBSERVED] + LY.MAIN_ORDERING), LY.MAIN_ORDERING)
    split = M.time_holdout(el, HOLDOUT_TEST_FROM)
    return split.filter(F.col("split") == "test").select("period_h")


@query
def time_holdout(spark, sf_dir):
    """FLT6: train before the bound, test from it."""
    return M.time_holdout(eligible(spark, sf_dir), HOLDOUT_TEST_FROM)


@query
def hash_split(spark, sf_dir):
    """ML1: 70/30 split of whole periods by a seeded md5 bucket."""
    return M.split_periods(eligible(spark, sf_dir), 0.7, seed=7)


@query
def baseline_two_hour_avg(spark, sf_dir):
    """PRJ13 + ML8: two-hour layer halved, for test periods where it exists."""
    c = held_counts(spark, sf_dir)
    man = LY.period_manifest(c, ["two_hour"])
    test = M.time_holdout(man.select("period_h"), HOLDOUT_TEST_FROM).filter(F.col("split") == "test")
    two = LY.rasterize(L.two_hour(c), GRID, "n", unique_keys=True).join(test, "period_h", "left_semi")
    return two.select("period_h", "row", "col", (F.col("value") / 2).alias("value"))


@query
def top_share(spark, sf_dir):
    """WIN1-2 + AGG12: top 1/5/10/20 % sums of every observed raster."""
    obs = LY.tag_layer(LY.rasterize(counts(spark, sf_dir), GRID, "n", unique_keys=True), "observed")
    stats = E.top_share(obs, area(spark))
    return stats.select("period_h", "layer", *[_round(c, c) for c in E.STAT_COLUMNS])


def _obs_two(spark, sf_dir):
    c = held_counts(spark, sf_dir)
    obs = LY.rasterize(c, GRID, "n", unique_keys=True)
    two = LY.rasterize(L.two_hour(c), GRID, "n", unique_keys=True).select(
        "period_h", "row", "col", (F.col("value") / 2).alias("value"))
    man = LY.period_manifest(c, ["observed", "two_hour"])
    return c, obs, two, man


@query
def period_intersection(spark, sf_dir):
    """JN7 + SET3: test periods with a prediction, an observed and a two-hour raster."""
    c, obs, two, man = _obs_two(spark, sf_dir)
    pred_periods = _test_eligible(c)
    return E.common_periods(pred_periods, man.filter(F.col("layer") == "observed"),
                            man.filter(F.col("layer") == "two_hour"))


@query
def combined_stats(spark, sf_dir):
    """AGG13 + ML10 for the observed and baseline rasters of the predicted periods."""
    c, obs, two, man = _obs_two(spark, sf_dir)
    stats = E.combined_stats(
        {"obs": obs, "two": two},
        {"pred": _test_eligible(c),
         "obs": man.filter(F.col("layer") == "observed"),
         "two": man.filter(F.col("layer") == "two_hour")},
        area(spark))
    return stats.select("period_h", "layer", *[_round(c, c) for c in E.STAT_COLUMNS])


# ---- model, store, round trips -------------------------------------------------------


def _model_run(spark, sf_dir):
    cfg = DM.DemandModelConfig(grid=GRID)
    return DM.run(spark, counts(spark, sf_dir), mask(spark), geo(spark), weather(spark, sf_dir), cfg)


@query
def rf_predict(spark, sf_dir):
    """ML1 + ML3 + ML5-6: forest trained on hash-split train periods, predictions for
    every mask cell of every eligible test period (rows-only check)."""
    return _model_run(spark, sf_dir).predictions


@query
def model_concentration(spark, sf_dir):
    """ML10 with the model: top-share stats of predicted, observed and baseline rasters
    for the test periods present in all three (rows-only check)."""
    return _model_run(spark, sf_dir).stats


@query
def trips_rollup(spark, sf_dir):
    """AGG2 + AGG3 in one rollup; day_key NULL marks a month total."""
    return C.trips_rollup(counts(spark, sf_dir))


@query
def line_quarantine(spark, sf_dir):
    """SRC2, PRJ5: lines without 14 fields or without a good pickup time go to a side table;
    counts per outcome."""
    lines = T.damaged_trip_lines(T.load_events(spark, sf_dir))
    good, bad = split_trip_lines(lines, on_bad="quarantine")
    g = good.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit("good").alias("outcome"),
                                                                 F.lit(14).alias("n_fields"), "n")
    b = bad.groupBy("reason", "n_fields").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("reason").alias("outcome"), "n_fields", "n")
    return g.unionByName(b)


@query
def trips_text_gz(spark, sf_dir):
    """SRC1 + AGG1 over landed files: gzip text written, read back as a batch, counted."""
    path = scratch_dir(spark, "trip-text")
    T.trip_lines_from_events(T.load_events(spark, sf_dir)).repartition(3).write.option("compression", "gzip").text(path)
    return C.cell_hour_counts(trip_cells(spark, path, GRID, partitions=spark.sparkContext.defaultParallelism))


def _store_inputs(spark, sf_dir):
    c = held_counts(spark, sf_dir)
    man = LY.period_manifest(c, ["observed", "two_hour"])
    test = man.filter(F.col("period_h") >= HOLDOUT_TEST_FROM).select(
        F.col("layer").alias("grouping"), "period_h")
    obs = LY.rasterize(c, GRID, "n", unique_keys=True).select(F.lit("observed").alias("grouping"), "*")
    two = LY.rasterize(L.two_hour(c), GRID, "n", unique_keys=True).select(
        F.lit("two_hour").alias("grouping"), "period_h", "row", "col", (F.col("value") / 2).alias("value"))
    cells = obs.unionByName(two).join(test, ["grouping", "period_h"], "left_semi")
    return cells, test


@query
def raster_store_roundtrip(spark, sf_dir):
    """SNK2: observed and halved two-hour rasters of the test periods written to the
    partitioned store and read back with cell centres."""
    path = scratch_dir(spark, "layer-store")
    cells, test = _store_inputs(spark, sf_dir)
    RS.write_layers(cells, test, path, GRID)
    return RS.read_layers(spark, path)


@query
def raster_listing(spark, sf_dir):
    """SNK3: every stored (grouping, period), all-zero rasters included."""
    path = scratch_dir(spark, "layer-store")
    cells, test = _store_inputs(spark, sf_dir)
    RS.write_layers(cells, test, path, GRID)
    return RS.list_rasters(spark, path)


@query
def weather_csv_roundtrip(spark, sf_dir):
    """SRC6 -> SNK1 -> SRC3: flatten landed responses, write the 24-column CSV,
    read it back as the typed hourly table."""
    path = scratch_dir(spark, "weather-csv")
    W.write_weather_csv(W.flatten_weather_json(T.weather_json_from_events(T.load_events(spark, sf_dir))), path)
    typed = W.weather_table(W.read_weather_csv(spark, path))
    return typed.select("period_h", *[_round(k, k) for k in W.WEATHER_KEYS])


@query
def stream_cell_counts(spark, sf_dir):
    """SRC1 + AGG1 as a stream: trip lines landed as text files in several
    batches, counted per micro-batch and summed on read."""
    from cellcast.streaming import cell_counts as SC

    base = scratch_dir(spark, "stream")
    lines = T.trip_lines_from_events(T.load_events(spark, sf_dir))
    # Land the lines as several files, the way trip files arrive.
    lines.repartition(4).write.mode("overwrite").text(f"{base}/in")
    q = SC.start(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", GRID,
                 max_files_per_trigger=1, available_now=True)
    q.awaitTermination()
    return SC.read_counts(spark, f"{base}/out")


@query
def raster_store_rewrite(spark, sf_dir):
    """SNK2-3 on a second run: every fifth period of the observed rasters is rewritten with
    doubled values, every fifth after it as all-zero; cells and listing of the whole store."""
    path = scratch_dir(spark, "layer-store")
    stored, test = _store_inputs(spark, sf_dir)
    RS.write_layers(stored, test, path, GRID)
    fifth = F.col("period_h") % 5
    again = test.filter((F.col("grouping") == "observed") & fifth.isin(0, 1))
    doubled = stored.filter((F.col("grouping") == "observed") & (fifth == 0)).withColumn("value", F.col("value") * 2)
    RS.write_layers(doubled, again, path, GRID)
    listing = RS.list_rasters(spark, path).select(
        F.lit("listed").alias("kind"), "grouping", "period_h", *[F.lit(None).cast(t).alias(c) for c, t in
                                                                (("row", "int"), ("col", "int"), ("value", "double"))])
    found = RS.read_layers(spark, path).select(F.lit("cell").alias("kind"), "grouping", "period_h", "row", "col", "value")
    return found.unionByName(listing)


@query
def raster_store_snapshots(spark, sf_dir):
    """SNK2-3 through the commit log: an all-zero first write, a full one, one that rewrites two
    fifths of the observed rasters, and one that stops before its commit; cells and listing of
    the versions 1 to 3 and, after the clean-up, of the newest."""
    path = scratch_dir(spark, "layer-store")
    stored, test = _store_inputs(spark, sf_dir)
    fifth = F.col("period_h") % 5
    observed = F.col("grouping") == "observed"
    RS.write_layers(stored.filter(F.lit(False)), test.filter(observed), path, GRID)
    RS.write_layers(stored, test, path, GRID)
    doubled = stored.filter(observed & (fifth == 0)).withColumn("value", F.col("value") * 2)
    RS.write_layers(doubled, test.filter(observed & fifth.isin(0, 1)), path, GRID)
    RS.stage_layers(stored.withColumn("value", F.lit(-1.0)), test, path, GRID)

    def state(version, label):
        rasters = RS.list_rasters(spark, path, version)
        cells = RS.read_layers(spark, path, version=version).groupBy(*RS.RASTER).agg(
            F.count(F.lit(1)).alias("n_cells"), F.sum("value").alias("total"),
            F.sum(F.col("value") * (F.col("row") * GRID.n_cols + F.col("col") + 1)).alias("placed"))
        return rasters.join(cells, RS.RASTER, "left").select(
            F.lit(label).alias("version"), *RS.RASTER, F.coalesce("n_cells", F.lit(0)).cast("long").alias("n_cells"),
            *[F.round(F.coalesce(F.col(c), F.lit(0.0)), 6).alias(c) for c in ("total", "placed")])

    kept = f"{path}-versions"
    reduce(DataFrame.unionByName, [state(v, v) for v in (1, 2, 3)]).write.parquet(kept)
    RS.vacuum(spark, path, min_age_s=0.0)
    return spark.read.parquet(kept).unionByName(state(None, 0))


@query
def feature_vector(spark, sf_dir):
    """O-FEAT: the vectors of the full feature table in both forms (52 entries, or 112 with the
    static values after each layer), each entry summed per period with the cell's number as weight."""
    ft = _features(spark, sf_dir)
    place = (F.col("row") * GRID.n_cols + F.col("col") + 1).cast("double")
    parts = []
    for repeat in (False, True):
        n = len(FT.feature_columns(LY.MAIN_ORDERING, repeat))
        v = vector_to_array("features")
        rows = FT.assemble(ft, LY.MAIN_ORDERING, repeat).select("period_h", place.alias("place"), v.alias("v"))
        sums = [F.round(F.sum(F.col("v")[i] * F.col("place")), 3) if i < n else F.lit(None).cast("double") for i in range(112)]
        parts.append(rows.groupBy("period_h").agg(F.count(F.lit(1)).alias("n_rows"), *[
            x.alias(f"v{i}") for i, x in enumerate(sums) if i < n]).select(
            F.lit(n).alias("size"), "period_h", "n_rows", *[F.col(f"v{i}") if i < n else sums[i].alias(f"v{i}") for i in range(112)]))
    return parts[0].unionByName(parts[1])


@query
def row_split(spark, sf_dir):
    """ML2: 70/30 split of rows by a seeded md5 bucket; per side and period, rows and the sum of
    the cells' numbers."""
    keys = FT.dense_keys(eligible(spark, sf_dir), mask(spark), GRID)
    place = F.sum((F.col("row") * GRID.n_cols + F.col("col") + 1).cast("long"))
    train, test = M.split_rows(keys, 0.7, seed=7)
    sides = [df.select(F.lit(name).alias("split"), "*") for name, df in (("train", train), ("test", test))]
    return sides[0].unionByName(sides[1]).groupBy("split", "period_h").agg(
        F.count(F.lit(1)).alias("n_rows"), place.alias("cells"))


# One tree of one split over all rows, which SQL can follow.
SINGLE_SPLIT = M.ForestPreset(num_trees=1, max_depth=1, max_bins=32, feature_subset="all", bootstrap=False)


@query
def rf_single_tree(spark, sf_dir):
    """ML3, ML5, PRJ14, JN6: a forest of one split on the hour of the day, fitted on the trips per
    train hour, and its prediction for every test hour."""
    hours = held_counts(spark, sf_dir).groupBy("period_h").agg(F.sum("n").cast("double").alias("label"))
    rows = hours.join(M.split_periods(hours.select("period_h"), 0.7, seed=7), "period_h").withColumn(
        "hour", F.pmod(F.col("period_h"), F.lit(24)).cast("double"))
    # One order of the rows, so that the label sums are the same in every run.
    rows = rows.select("period_h", F.lit(0).alias("row"), F.lit(0).alias("col"), "label", "hour", "split")
    model = M.fit_columns(rows.filter("split = 'train'"), ["hour"], SINGLE_SPLIT)
    out = M.predict_columns(model, rows.filter("split = 'test'"), ["hour"])
    return out.select("period_h", _round("prediction", "prediction"))


@query
def weather_json_text(spark, sf_dir):
    """SRC6 from landed text: responses written as JSON lines, read with their schema, flattened."""
    path = scratch_dir(spark, "weather-json")
    raw = T.weather_json_from_events(T.load_events(spark, sf_dir))
    raw.write.json(path)
    flat = W.flatten_weather_json(W.read_weather_json(spark, path, raw.schema))
    return flat.select("datetime", *[_round(k, k) for k in W.WEATHER_KEYS])


@query
def weather_last_row(spark, sf_dir):
    """SRC3 over several files: an hour in two files takes its values from the later path."""
    path = scratch_dir(spark, "weather-csv")
    flat = W.flatten_weather_json(T.weather_json_from_events(T.load_events(spark, sf_dir)))
    W.write_weather_csv(flat, f"{path}/b")
    W.write_weather_csv(flat.select("datetime", *[(F.col(k) + 1).alias(k) for k in W.WEATHER_KEYS]), f"{path}/a")
    typed = W.weather_table(W.read_weather_csv(spark, [f"{path}/b", f"{path}/a"]))
    return typed.select("period_h", *[_round(k, k) for k in W.WEATHER_KEYS])


@query
def weather_request_hours(spark, sf_dir):
    """GEN2: request hours from 1 January up to the last event, which is left out."""
    last = T.load_events(spark, sf_dir).agg(F.max("ts")).first()[0]
    return P.hours_from_year(spark, last.year, last)


# ---- forests as tables of nodes ------------------------------------------------------

# A tree of all rows and features, and a small forest with draws of both.
TWO_LEVELS = TR.TableForest(num_trees=1, max_depth=2, feature_subset="all", bootstrap=False)
SMALL_FOREST = TR.TableForest(num_trees=5, max_depth=3)


def _table_forest(spark, sf_dir, spec):
    """The job with lag layers, calendar and static values as features and a forest by aggregation."""
    cfg = DM.DemandModelConfig(grid=GRID, ordering=tuple(LY.OLDER_ORDERING), with_weather=False, forest=spec)
    return DM.run(spark, counts(spark, sf_dir), mask(spark), geo(spark), None, cfg)


def _nodes(nodes):
    return nodes.select("tree", "node", "feature", _round("threshold", "threshold"), "left", "right", "n",
                        _round("prediction", "prediction"))


@query
def rf_two_levels(spark, sf_dir):
    """ML3-4: the split search by sums per node, feature and bin, over two levels and 23 features."""
    return _nodes(_table_forest(spark, sf_dir, TWO_LEVELS).model)


@query
def forest_nodes(spark, sf_dir):
    """ML3-4: the nodes of a forest with drawn rows and features."""
    return _nodes(_table_forest(spark, sf_dir, SMALL_FOREST).model)


@query
def forest_predict(spark, sf_dir):
    """ML5-6, PRJ14, JN6: every cell of every eligible test hour led through the nodes."""
    out = _table_forest(spark, sf_dir, SMALL_FOREST).predictions
    return out.select("period_h", "row", "col", _round("prediction", "prediction"))


@query
def forest_concentration(spark, sf_dir):
    """ML10: top-share stats of the predicted, observed and baseline rasters."""
    stats = _table_forest(spark, sf_dir, SMALL_FOREST).stats
    return stats.select("period_h", "layer", *[_round(c, c) for c in E.STAT_COLUMNS])


@query
def outputs_listing(spark, sf_dir):
    """ML7, FLT5, SNK2-3: predicted, observed and halved two-hour rasters of the test hours written to
    the store as the job leaves them, and the rasters that the store lists."""
    path = scratch_dir(spark, "outputs")
    R.store_outputs(_table_forest(spark, sf_dir, SMALL_FOREST), path, GRID)
    return RS.list_rasters(spark, path)


@query
def rf_deep(spark, sf_dir):
    """ML4: the deep preset (300 trees, depth 10, 64 bins) fitted on the trips per train hour, exported
    as nodes, and every test hour led through them (rows-only check)."""
    c = held_counts(spark, sf_dir)
    hours = c.groupBy("period_h").agg(F.sum("n").cast("double").alias("label"))
    lags = {f"lag_{k}": k for k in (1, 24, 168)}
    rows = hours.join(M.split_periods(hours.select("period_h"), 0.7, seed=7), "period_h")
    for name, k in lags.items():
        before = hours.select((F.col("period_h") + k).cast("int").alias("period_h"), F.col("label").alias(name))
        rows = rows.join(before, "period_h", "left").na.fill(0.0, [name])
    rows = rows.withColumns({"hour": F.pmod(F.col("period_h"), F.lit(24)).cast("double"),
                             "weekday": F.weekday(P.period_date(F.col("period_h"))).cast("double"),
                             "row": F.lit(0), "col": F.lit(0)})
    columns = ["hour", "weekday", *lags]
    model = M.fit_columns(rows.filter("split = 'train'"), columns, M.DEEP_FOREST)
    nodes = TR.model_nodes(model, scratch_dir(spark, "deep-forest"))
    x = F.array(*[F.col(k) for k in columns]).alias("x")
    test = rows.filter("split = 'test'").select("period_h", "row", "col", x)
    return TR.score(nodes, test, M.DEEP_FOREST, root=0).select("period_h", _round("prediction", "prediction"))


# ---- landed files --------------------------------------------------------------------

def _landed(lines, batch, path):
    """Lines landed as gzip files in a folder per batch (the trip's number modulo three)."""
    trip_id = F.substring_index("value", ",", 1).cast("long")
    (lines.select("value", (trip_id % 3).alias("batch")).filter(batch).write.mode("append")
     .partitionBy("batch").option("compression", "gzip").text(path))


@query
def quarantine_ingest(spark, sf_dir):
    """SRC2, AGG1 in one pass: cell-hour counts of the good lines, and every bad line kept, by file
    folder and reason with the sum of the trips' numbers."""
    base = scratch_dir(spark, "trip-store")
    _landed(T.damaged_trip_lines(T.load_events(spark, sf_dir)), F.lit(True), f"{base}/in")
    TS.ingest_new(spark, f"{base}/in", f"{base}/store", GRID, partitions=spark.sparkContext.defaultParallelism)
    trip_id = F.substring_index("line", ",", 1).cast("long")
    batch = F.regexp_extract("file", "batch=([0-9]+)", 1).cast("int")
    bad = TS.bad_lines(spark, f"{base}/store").groupBy(batch.alias("batch"), "reason").agg(
        F.sum("n").alias("n"), F.sum(trip_id * F.col("n")).alias("ids"))
    none = F.lit(None).cast("int")
    return TS.stored_counts(spark, f"{base}/store").select(
        none.alias("batch"), F.lit("good").alias("reason"), "period_h", "row", "col", "n", F.lit(None).cast("long").alias("ids")).unionByName(
        bad.select("batch", "reason", none.alias("period_h"), none.alias("row"), none.alias("col"), "n", "ids"))


@query
def trips_incremental(spark, sf_dir):
    """SRC1 with a ledger: a first landing, a second one beside it and a repeat; every file counts once."""
    base = scratch_dir(spark, "trip-store")
    lines = T.trip_lines_from_events(T.load_events(spark, sf_dir))
    tasks = spark.sparkContext.defaultParallelism
    for batch in (F.col("batch") == 0, F.col("batch") > 0, F.lit(False)):
        _landed(lines, batch, f"{base}/in")
        TS.ingest_new(spark, f"{base}/in", f"{base}/store", GRID, "fail", partitions=tasks)
    return TS.stored_counts(spark, f"{base}/store")


# ---- written counts, dense frames, wide windows, zones ---------------------------------

def by_cell_tables(spark, sf_dir, buckets=8):
    """Counts and mask written in buckets by cell, under names of their own."""
    base = scratch_dir(spark, "by-cell")
    name = base.rsplit("-", 1)[-1]
    return (C.write_by_cell(counts(spark, sf_dir), f"counts_{name}", f"{base}/counts", buckets),
            C.write_by_cell(mask(spark), f"mask_{name}", f"{base}/mask", buckets))


def materialized_lags(c, m):
    """Lag layers of written counts at every mask cell of every eligible hour: no exchange by cell."""
    el = LY.eligible_periods(LY.period_manifest(c, [LY.OBSERVED] + LY.OLDER_ORDERING), LY.OLDER_ORDERING)
    lags = L.lag_layers(c, by_cell=True)
    dense = FT.dense_keys(el, m, GRID, by_cell=True)
    return dense.join(lags.hint("shuffle_hash"), ["period_h", "row", "col"], "left")


@query
def counts_materialized(spark, sf_dir):
    """SNK4: counts written in buckets by cell; their lag layers, made dense, per period."""
    layers = [LY.OBSERVED, *LY.OLDER_ORDERING]
    place = (F.col("row") * GRID.n_cols + F.col("col") + 1).cast("double")
    dense = materialized_lags(*by_cell_tables(spark, sf_dir))
    return dense.groupBy("period_h").agg(F.count(F.lit(1)).alias("n_rows"), *[
        F.round(F.coalesce(F.sum(x), F.lit(0.0)), 3).alias(f"{kind}_{k}")
        for k in layers for kind, x in (("sum", F.col(k)), ("placed", F.col(k) * place))])


@query
def row_counts(spark, sf_dir):
    """AGG14: rows of the trips, the counts, the layers and the feature table of the older job."""
    c = held_counts(spark, sf_dir)
    el = LY.eligible_periods(LY.period_manifest(c, [LY.OBSERVED] + LY.OLDER_ORDERING), LY.OLDER_ORDERING)
    tables = {"trips": cells(spark, sf_dir), "counts": c, "layers": LY.long_layers(c, GRID, LY.OLDER_ORDERING),
              "features": FT.dense_keys(el, mask(spark), GRID)}
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("step"), "n") for k, df in tables.items()])


@query
def trailing_dense(spark, sf_dir):
    """WIN3: the eight-hour sum by a RANGE frame over cells made dense, as the fan-out gives it."""
    return L.trailing_window(counts(spark, sf_dir), 1, 9)


@query
def focal_mean_wide(spark, sf_dir):
    """SPT2: windows of 25 and 26 cells by running sums; per period cells, mass, mass by place and peak."""
    src = _two_hour_layer(spark, sf_dir)
    place = F.col("row") * GRID.n_cols + F.col("col") + 1
    parts = [S.wide_focal_mean(src, GRID, size).groupBy("period_h").agg(
        F.count(F.lit(1)).alias("n_cells"), F.round(F.sum("value"), 6).alias("total"),
        F.round(F.sum(F.col("value") * place), 4).alias("placed"), F.round(F.max("value"), 6).alias("peak")).select(
        F.lit(size).alias("size"), "*") for size in (25, 26)]
    return parts[0].unionByName(parts[1])


# Latitudes and longitudes on, below and above the borders of the irregular zones.
ZONE_LATITUDES = [-80.0, -33.0, 0.0, 55.999, 56.0, 60.0, 63.999, 64.0, 71.999, 72.0, 78.0, 83.999, 84.0]
ZONE_LONGITUDES = [-180.0, -0.001, 0.0, 2.999, 3.0, 5.999, 6.0, 8.999, 9.0, 11.999, 12.0, 20.999, 21.0, 32.999, 33.0, 41.999, 42.0, 179.999]


@query
def utm_zones(spark, sf_dir):
    """PRJ3: zone, easting and northing of points at the borders of all irregular zones, one per event."""
    def nth(values, i):
        return F.element_at(F.array(*map(F.lit, values)), (F.pmod(i, F.lit(len(values))) + 1).cast("int"))

    e = T.load_events(spark, sf_dir).select("event_id")
    points = e.select("event_id", nth(ZONE_LATITUDES, F.col("event_id")).alias("lat"), nth(
        ZONE_LONGITUDES, F.floor(F.col("event_id") / len(ZONE_LATITUDES))).alias("lng"))
    placed = with_utm(points, F.col("lat"), F.col("lng"))
    return placed.select("event_id", utm_zone(F.col("lat"), F.col("lng")).alias("zone"), F.round("x", 3).alias("x"), F.round("y", 2).alias("y"))
