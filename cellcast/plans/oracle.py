"""DuckDB SQL for each catalog query, written independently of the Spark code.

The SQL rebuilds the same derived inputs from the registered test tables
(``events``, ``orders``) by the rules of ``cellcast.sources.testdata`` and
then states each operator in plain relational form: range joins for trailing
sums, gather sums for smoothing, ``row_number`` for top-k. Integer outputs
are cast to INTEGER/BIGINT and doubles rounded where float sums may differ in
the last bits, on both sides.
"""

from __future__ import annotations

from typing import NamedTuple

from cellcast.sources.geo import GEO_LAYERS
from cellcast.sources.weather import WEATHER_KEYS


class Grid(NamedTuple):
    """The test grid, written out here so that the SQL shares no constant with the code it checks."""
    x_min: float = 562786.017
    y_max: float = 4530093.928
    cell_width: float = 1000.0
    cell_height: float = 1000.0
    n_rows: int = 48
    n_cols: int = 47


G = Grid()
# WGS84 from its axis and flattening; the meridian series follows from the eccentricity.
UTM_A, _FLATTENING, UTM_K0 = 6378137.0, 1 / 298.257223563, 0.9996
UTM_E2 = _FLATTENING * (2 - _FLATTENING)
UTM_EP2 = UTM_E2 / (1 - UTM_E2)
UTM_M1 = 1 - UTM_E2 / 4 - 3 * UTM_E2**2 / 64 - 5 * UTM_E2**3 / 256
UTM_M2 = 3 * UTM_E2 / 8 + 3 * UTM_E2**2 / 32 + 45 * UTM_E2**3 / 1024
UTM_M3 = 15 * UTM_E2**2 / 256 + 45 * UTM_E2**3 / 1024
UTM_M4 = 35 * UTM_E2**3 / 3072
EPOCH_SQL = "TIMESTAMP '2012-01-01 00:00:00'"


def _hour(ts: str) -> str:
    return f"CAST(date_diff('hour', {EPOCH_SQL}, date_trunc('hour', {ts})) AS INTEGER)"


def _utm_sql(lat: str, lng: str) -> tuple[str, str]:
    """UTM easting/northing as SQL over numeric lat/lng expressions (automatic zone)."""
    lam0 = f"radians((floor(({lng} + 180) / 6) + 1 - 1) * 6 - 180 + 3)"
    phi = f"radians({lat})"
    n = f"({UTM_A!r} / sqrt(1 - {UTM_E2!r} * sin({phi}) * sin({phi})))"
    t = f"(tan({phi}) * tan({phi}))"
    c = f"({UTM_EP2!r} * cos({phi}) * cos({phi}))"
    a = f"((radians({lng}) - {lam0}) * cos({phi}))"
    m = (f"({UTM_A!r} * ({UTM_M1!r} * {phi} - {UTM_M2!r} * sin(2 * {phi}) "
         f"+ {UTM_M3!r} * sin(4 * {phi}) - {UTM_M4!r} * sin(6 * {phi})))")
    x = (f"({UTM_K0!r} * {n} * ({a} + (1 - {t} + {c}) * pow({a}, 3) / 6 "
         f"+ (5 - 18 * {t} + {t} * {t} + 72 * {c} - 58 * {UTM_EP2!r}) * pow({a}, 5) / 120) + 500000.0)")
    y = (f"({UTM_K0!r} * ({m} + {n} * tan({phi}) * ({a} * {a} / 2 "
         f"+ (5 - {t} + 9 * {c} + 4 * {c} * {c}) * pow({a}, 4) / 24 "
         f"+ (61 - 58 * {t} + {t} * {t} + 600 * {c} - 330 * {UTM_EP2!r}) * pow({a}, 6) / 720)))")
    ok = f"({lat} BETWEEN -80 AND 84 AND {lng} BETWEEN -180 AND 180)"
    y = f"(CASE WHEN {lat} < 0 THEN {y} + 10000000.0 ELSE {y} END)"
    return f"(CASE WHEN {ok} THEN {x} ELSE 0.0 END)", f"(CASE WHEN {ok} THEN {y} ELSE 0.0 END)"


def _cells_cte(grid: Grid = G) -> str:
    """CTE ``cells(trip_id, period_h, row, col)``: one row per event."""
    lat = ("CASE WHEN event_id % 97 = 0 THEN 0.0 WHEN event_id % 101 = 0 THEN 95.0 "
           "WHEN event_id % 107 = 0 THEN 40.92 "
           "ELSE CAST(4060 + 6 * ((user_id % 25) // 5) AS DOUBLE) / 100.0 END")
    lng = ("CASE WHEN event_id % 97 = 0 THEN 0.0 "
           "WHEN event_id % 103 = 0 THEN CAST(-6820 + 9 * (user_id % 5) AS DOUBLE) / 100.0 "
           "WHEN event_id % 107 = 0 THEN -74.262 "
           "ELSE CAST(-7420 + 9 * (user_id % 5) AS DOUBLE) / 100.0 END")
    x, y = _utm_sql("lat", "lng")
    return f"""
    ll AS (
      SELECT event_id, ts, CAST({lat} AS DOUBLE) AS lat, CAST({lng} AS DOUBLE) AS lng FROM events
    ),
    xy AS (SELECT event_id, ts, {x} AS x, {y} AS y FROM ll),
    cells AS (
      SELECT event_id AS trip_id, {_hour('ts')} AS period_h,
             CAST(-trunc((y - {grid.y_max!r}) / {grid.cell_height!r}) AS INTEGER) AS row,
             CAST(trunc((x - {grid.x_min!r}) / {grid.cell_width!r}) AS INTEGER) AS col
      FROM xy
    ),
    counts AS (SELECT period_h, row, col, CAST(count(*) AS BIGINT) AS n FROM cells GROUP BY ALL)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes if c.strip())


def _trailing_cte(name: str, lo: int, hi: int) -> str:
    """``name(period_h,row,col,n)``: sum of counts over [q-hi, q-lo] at every reachable q."""
    return f"""
    {name} AS (
      SELECT t.period_h, t.row, t.col, CAST(sum(c.n) AS BIGINT) AS n
      FROM (SELECT DISTINCT CAST(period_h + x AS INTEGER) AS period_h, row, col
            FROM counts, range({lo}, {hi} + 1) r(x)) t
      JOIN counts c ON c.row = t.row AND c.col = t.col
                   AND c.period_h BETWEEN t.period_h - {hi} AND t.period_h - {lo}
      GROUP BY ALL
    )"""


def _in_extent(r: str = "row", c: str = "col", grid: Grid = G) -> str:
    return f"({r} BETWEEN 0 AND {grid.n_rows - 1} AND {c} BETWEEN 0 AND {grid.n_cols - 1})"


SQL: dict[str, str] = {}

SQL["project_cells"] = _with(_cells_cte()) + "\nSELECT trip_id, period_h, row, col FROM cells"

SQL["bad_coords"] = _with(_cells_cte()) + f"""
SELECT row, col, CAST(count(*) AS BIGINT) AS n FROM cells
WHERE NOT {_in_extent()} GROUP BY ALL"""

SQL["trips_cell_hour"] = _with(_cells_cte()) + "\nSELECT period_h, row, col, n FROM counts"

SQL["trips_by_day"] = _with(_cells_cte()) + f"""
SELECT CAST(strftime({EPOCH_SQL} + to_hours(period_h), '%Y%m%d') AS INTEGER) AS day_key,
       CAST(sum(n) AS BIGINT) AS n
FROM counts GROUP BY ALL"""

SQL["trips_by_month"] = _with(_cells_cte()) + f"""
SELECT CAST(strftime({EPOCH_SQL} + to_hours(period_h), '%Y%m') AS INTEGER) AS month_key,
       CAST(sum(n) AS BIGINT) AS n
FROM counts GROUP BY ALL"""

SQL["trailing_2h"] = _with(_cells_cte(), _trailing_cte("lay", 1, 2)) + "\nSELECT * FROM lay"
SQL["trailing_4h"] = _with(_cells_cte(), _trailing_cte("lay", 1, 4)) + "\nSELECT * FROM lay"
SQL["trailing_8h"] = _with(_cells_cte(), _trailing_cte("lay", 1, 8)) + "\nSELECT * FROM lay"
SQL["previous_day"] = _with(_cells_cte(), _trailing_cte("lay", 24, 24)) + "\nSELECT * FROM lay"
SQL["previous_week"] = _with(_cells_cte(), _trailing_cte("lay", 168, 168)) + "\nSELECT * FROM lay"


# ---- layers ---------------------------------------------------------------------------

HOLDOUT = "(SELECT CAST(date_diff('hour', TIMESTAMP '2012-01-01 00:00:00', TIMESTAMP '2024-01-24 00:00:00') AS INTEGER))"


def _layers_cte(names_kd=("two_hour", "four_hour", "eight_hour"), older: bool = False,
                grid: Grid = G) -> str:
    """CTE ``lay(layer, period_h, row, col, value)``: observed + lag layers in extent, plus
    Gaussian (gather over reflected index maps) and size-1 focal layers."""
    n_r, n_c = grid.n_rows, grid.n_cols
    lags = {"two_hour": (1, 2), "four_hour": (1, 4), "eight_hour": (1, 8),
            "previous_day": (24, 24), "previous_week": (168, 168)}
    ctes = [_trailing_cte(f"t_{k}", lo, hi) for k, (lo, hi) in lags.items()]
    base = [f"SELECT 'observed' AS layer, period_h, row, col, CAST(n AS DOUBLE) AS value FROM counts"]
    base += [f"SELECT '{k}' AS layer, period_h, row, col, CAST(n AS DOUBLE) AS value FROM t_{k}" for k in lags]
    ctes.append("base AS (SELECT * FROM (" + " UNION ALL ".join(base) + f") WHERE {_in_extent()})")
    ctes.append(_gauss_maps_cte(grid))
    if older:
        ctes.append("lay AS (SELECT * FROM base)")
    else:
        smoothed = [f"""SELECT b.layer || '_kd' AS layer, b.period_h, rm.i AS row, cm.i AS col,
                   sum(b.value * rm.w * cm.w) AS value
            FROM base b JOIN gr rm ON b.row = rm.ri JOIN gc cm ON b.col = cm.ri
            WHERE b.layer IN ({", ".join(f"'{k}'" for k in names_kd)}) GROUP BY ALL"""]
        smoothed.append(f"""SELECT layer || '_neighbor_avg' AS layer, period_h, row, col, value FROM base
            WHERE layer IN ({", ".join(f"'{k}'" for k in names_kd)})""")
        ctes.append("lay AS (SELECT * FROM base UNION ALL " + " UNION ALL ".join(smoothed) + ")")
    return ",\n".join(ctes)


def _reflect(v: str, n: int) -> str:
    return f"(CASE WHEN {v} < 0 THEN -({v}) - 1 WHEN {v} >= {n} THEN 2 * {n} - 1 - ({v}) ELSE {v} END)"


def _map_cte(name: str, n: int, taps: str) -> str:
    """``name(i, ri, w)``: target index i reads source index ri with total weight w."""
    return f"""{name} AS (
      SELECT i, ri, sum(w) AS w FROM (
        SELECT CAST(t.i AS INTEGER) AS i, CAST({_reflect('t.i + k.k', n)} AS INTEGER) AS ri, k.w
        FROM range(0, {n}) t(i), {taps} k
      ) GROUP BY ALL
    )"""


def _gauss_maps_cte(grid: Grid = G) -> str:
    kw = """kw AS (
      SELECT k, exp(-0.5 * k * k) / (SELECT sum(exp(-0.5 * j * j)) FROM range(-4, 5) s(j)) AS w
      FROM range(-4, 5) s(k)
    )"""
    return ",\n".join([kw, _map_cte("gr", grid.n_rows, "kw"), _map_cte("gc", grid.n_cols, "kw")])


MAIN_NAMES = ["observed", "two_hour", "two_hour_kd", "two_hour_neighbor_avg",
              "four_hour", "four_hour_kd", "four_hour_neighbor_avg",
              "eight_hour", "eight_hour_kd", "eight_hour_neighbor_avg",
              "previous_day", "previous_week"]
OLDER_NAMES = ["two_hour", "four_hour", "eight_hour", "previous_day", "previous_week"]

SQL["rasterize_extent"] = _with(_cells_cte()) + f"""
SELECT period_h, row, col, CAST(sum(n) AS DOUBLE) AS value FROM counts WHERE {_in_extent()} GROUP BY ALL"""

SQL["layer_union_stats"] = _with(_cells_cte(), _layers_cte()) + """
SELECT layer, period_h, CAST(count(*) AS BIGINT) AS n_cells, round(sum(value), 6) AS total FROM lay GROUP BY ALL"""

SQL["older_layer_union"] = _with(_cells_cte(), _layers_cte(older=True)) + """
SELECT layer, period_h, CAST(count(*) AS BIGINT) AS n_cells, round(sum(value), 6) AS total FROM lay GROUP BY ALL"""

_PIVOT = ",\n       ".join(f"round(max(CASE WHEN layer = '{k}' THEN value END), 6) AS {k}" for k in MAIN_NAMES)
SQL["layer_pivot"] = _with(_cells_cte(), _layers_cte()) + f"""
SELECT period_h, row, col,
       {_PIVOT}
FROM lay GROUP BY period_h, row, col"""
SQL["fused_layers"] = SQL["layer_pivot"]


def _hours_cte() -> str:
    return "hrs AS (SELECT DISTINCT period_h FROM counts)"


def _manifest_cte() -> str:
    rows = ["SELECT 'observed' AS layer, period_h FROM hrs"]
    spans = {"two_hour": (1, 2), "four_hour": (1, 4), "eight_hour": (1, 8),
             "previous_day": (24, 24), "previous_week": (168, 168)}
    for k, (lo, hi) in spans.items():
        names = [k, f"{k}_kd", f"{k}_neighbor_avg"] if k in ("two_hour", "four_hour", "eight_hour") else [k]
        for nm in names:
            rows.append(f"SELECT '{nm}' AS layer, period_h + x AS period_h FROM hrs, range({lo}, {hi} + 1) r(x)")
    return "man AS (SELECT DISTINCT layer, CAST(period_h AS INTEGER) AS period_h FROM (" + \
        " UNION ALL ".join(rows) + "))"


def _eligible_cte() -> str:
    """Eligible = observed at q, q-24, q-168 and at q-1 or q-2 (direct formula)."""
    return """elig AS (
      SELECT q.period_h FROM hrs q
      WHERE EXISTS (SELECT 1 FROM hrs h WHERE h.period_h IN (q.period_h - 1, q.period_h - 2))
        AND EXISTS (SELECT 1 FROM hrs h WHERE h.period_h = q.period_h - 24)
        AND EXISTS (SELECT 1 FROM hrs h WHERE h.period_h = q.period_h - 168)
    )"""


SQL["period_manifest"] = _with(_cells_cte(), _hours_cte(), _manifest_cte()) + "\nSELECT layer, period_h FROM man"
SQL["eligible_periods"] = _with(_cells_cte(), _hours_cte(), _eligible_cte()) + "\nSELECT period_h FROM elig"


# ---- smoothing ------------------------------------------------------------------------

SQL["kernel_density_2h"] = _with(_cells_cte(), _trailing_cte("two", 1, 2), _gauss_maps_cte()) + f"""
SELECT t.period_h, rm.i AS row, cm.i AS col, round(sum(t.n * rm.w * cm.w), 6) AS value
FROM (SELECT * FROM two WHERE {_in_extent()}) t JOIN gr rm ON t.row = rm.ri JOIN gc cm ON t.col = cm.ri
GROUP BY ALL"""

_U3 = "u3 AS (SELECT k, 1.0 / 3 AS w FROM range(-1, 2) s(k))"
SQL["focal_mean_2h"] = _with(_cells_cte(), _trailing_cte("two", 1, 2), _U3, _map_cte("ur", G.n_rows, "u3"),
                             _map_cte("uc", G.n_cols, "u3")) + f"""
SELECT 1 AS size, period_h, row, col, round(CAST(n AS DOUBLE), 6) AS value FROM two WHERE {_in_extent()}
UNION ALL
SELECT 3 AS size, t.period_h, rm.i AS row, cm.i AS col, round(sum(t.n * rm.w * cm.w), 6) AS value
FROM (SELECT * FROM two WHERE {_in_extent()}) t JOIN ur rm ON t.row = rm.ri JOIN uc cm ON t.col = cm.ri
GROUP BY ALL"""


# ---- calendar and spines ----------------------------------------------------------------

SQL["period_parts"] = f"""
WITH o AS (SELECT o_orderkey, date_trunc('hour', o_orderdate) AS hts FROM orders)
SELECT o_orderkey, {_hour('hts')} AS period_h, strftime(hts, '%Y%m%d%H') AS period_text,
       CAST(month(hts) AS INTEGER) AS month, CAST(day(hts) AS INTEGER) AS day, CAST(hour(hts) AS INTEGER) AS hour,
       strftime(hts + INTERVAL 1 HOUR, '%Y%m%d%H') AS next_hour_text,
       strftime(hts - INTERVAL 24 HOUR, '%Y%m%d%H') AS prev_day_text,
       {_hour('hts')} AS period_back
FROM o"""

SQL["weekday_onehot"] = "SELECT o_orderkey, " + ", ".join(
    f"CAST(isodow(o_orderdate) = {i + 1} AS INTEGER) AS {k}" for i, k in enumerate(
        ["wd_mon", "wd_tue", "wd_wed", "wd_thu", "wd_fri", "wd_sat", "wd_sun"])) + " FROM orders"

SQL["hour_spine"] = f"""
WITH b AS (SELECT min(date_trunc('hour', ts)) AS lo, max(date_trunc('hour', ts)) AS hi FROM events)
SELECT {_hour('t.ts')} AS period_h, strftime(t.ts, '%Y%m%d%H') AS period_text
FROM b, generate_series(b.lo, b.hi, INTERVAL 1 HOUR) t(ts)"""

SQL["day_spine"] = """
WITH b AS (SELECT min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) AS hi FROM events)
SELECT CAST(strftime(t.d, '%Y%m%d') AS INTEGER) AS day_key, CAST(isodow(t.d) - 1 AS INTEGER) AS weekday
FROM b, generate_series(CAST(b.lo AS TIMESTAMP), CAST(b.hi AS TIMESTAMP), INTERVAL 1 DAY) t(d)"""


# ---- weather and static inputs -----------------------------------------------------------

def _weather_cols(h: str = "period_h") -> list[str]:
    def v(j):
        return f"(CAST(({h} * ({j} + 3)) % 97 AS DOUBLE) / 10.0)"
    cols = []
    for j, k in enumerate(WEATHER_KEYS, start=1):
        if k == "sunlightHours":
            cols.append(f"(({v(12)} - {v(22)}) / 3600.0) AS {k}")
        else:
            cols.append(f"{v(j)} AS {k}")
    return cols


def _weather_cte() -> str:
    return f"""wspine AS (
      SELECT {_hour('t.ts')} AS period_h, t.ts FROM
        (SELECT min(date_trunc('hour', ts)) AS lo, max(date_trunc('hour', ts)) AS hi FROM events) b,
        generate_series(b.lo, b.hi, INTERVAL 1 HOUR) t(ts)
    ),
    wx AS (SELECT period_h, ts, {", ".join(_weather_cols())} FROM wspine)"""


SQL["weather_features"] = _with(_cells_cte(), _hours_cte(), _weather_cte()) + f"""
SELECT w.period_h, {", ".join(f"w.{k}" for k in WEATHER_KEYS)} FROM wx w JOIN hrs h ON h.period_h = w.period_h"""

SQL["weather_flatten"] = _with(_weather_cte()) + f"""
SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') || '-0500' AS datetime,
       {", ".join(f"round({k}, 6) AS {k}" for k in WEATHER_KEYS)} FROM wx"""


def _geo_cols(r: str = "row", c: str = "col") -> list[str]:
    return [f"CAST(({r} * 31 + {c} * 17 + {j} * 7) % 100 AS DOUBLE) / 10.0 AS {k}"
            for j, k in enumerate(GEO_LAYERS, start=1)]


def _grid_cte(grid: Grid = G) -> str:
    return f"""gridc AS (
      SELECT CAST(r.r AS INTEGER) AS row, CAST(c.c AS INTEGER) AS col
      FROM range(0, {grid.n_rows}) r(r), range(0, {grid.n_cols}) c(c)
    ),
    maskc AS (SELECT row, col FROM gridc WHERE (row * 31 + col * 17) % 3 <> 0),
    geoc AS (SELECT row, col, {", ".join(_geo_cols())} FROM gridc)"""


SQL["static_geo_join"] = _with(_cells_cte(), _grid_cte()) + f"""
SELECT g.* FROM (SELECT DISTINCT row, col FROM counts WHERE {_in_extent()}) c
JOIN geoc g ON g.row = c.row AND g.col = c.col"""

SQL["mask_expand"] = _with(_cells_cte(), _hours_cte(), _eligible_cte(), _grid_cte()) + """
SELECT e.period_h, m.row, m.col FROM elig e, maskc m"""


def _features_sql(older: bool, profile=None) -> str:
    names = OLDER_NAMES if older else MAIN_NAMES[1:]
    pivot = ",\n       ".join(f"max(CASE WHEN layer = '{k}' THEN value END) AS {k}" for k in ["observed"] + names)
    ctes = [_cells_cte(), _hours_cte(), _eligible_cte(), _grid_cte(), _layers_cte(older=older),
            f"wide AS (SELECT period_h, row, col, {pivot} FROM lay GROUP BY period_h, row, col)"]
    if not older:
        ctes.append(_weather_cte())
    wd = ["wd_mon", "wd_tue", "wd_wed", "wd_thu", "wd_fri", "wd_sat", "wd_sun"]
    ts = f"({EPOCH_SQL} + to_hours(e.period_h))"
    cal = [f"CAST(month({ts}) AS DOUBLE) AS month", f"CAST(day({ts}) AS DOUBLE) AS day",
           f"CAST(hour({ts}) AS DOUBLE) AS hour"]
    cal += [f"CAST(isodow({ts}) = {i + 1} AS DOUBLE) AS {k}" for i, k in enumerate(wd)]
    feat = ["CAST(m.row AS DOUBLE) AS row", "CAST(m.col AS DOUBLE) AS col",
            "coalesce(w.observed, 0.0) AS label"] + cal
    if not older:
        feat += [f"x.{k}" for k in WEATHER_KEYS]
    feat += [f"coalesce(w.{k}, 0.0) AS {k}" for k in names]
    feat += [f"g.{k}" for k in GEO_LAYERS]
    joins = "LEFT JOIN wide w ON w.period_h = e.period_h AND w.row = m.row AND w.col = m.col " \
            "JOIN geoc g ON g.row = m.row AND g.col = m.col "
    if not older:
        joins += "JOIN wx x ON x.period_h = e.period_h "
    cols = ["row", "col", "label", "month", "day", "hour"] + wd + ([] if older else WEATHER_KEYS) + names + GEO_LAYERS
    sums = ", ".join([f"round(sum({k}), 6) AS sum_{k}" for k in cols]
                     + [f"round(sum({k} * (row * {G.n_cols} + col + 1)), 3) AS placed_{k}" for k in cols])
    rows = f"(SELECT e.period_h, {', '.join(feat)} FROM elig e, maskc m {joins})"
    if profile:
        return _with(*ctes, f"ft AS {rows}") + profile
    return _with(*ctes) + f"""
SELECT period_h, CAST(count(*) AS BIGINT) AS n_rows, {sums}
FROM {rows}
GROUP BY period_h"""


SQL["feature_table"] = _features_sql(older=False)
SQL["older_feature_table"] = _features_sql(older=True)


# ---- split, baseline, evaluation ---------------------------------------------------------

SQL["time_holdout"] = _with(_cells_cte(), _hours_cte(), _eligible_cte()) + f"""
SELECT period_h, CASE WHEN period_h >= {HOLDOUT} THEN 'test' ELSE 'train' END AS split FROM elig"""

SQL["baseline_two_hour_avg"] = _with(_cells_cte(), _trailing_cte("two", 1, 2)) + f"""
SELECT period_h, row, col, CAST(n AS DOUBLE) / 2 AS value FROM two
WHERE {_in_extent()} AND period_h >= {HOLDOUT}"""


def _area() -> str:
    return f"(SELECT count(*) FROM range(0, {G.n_rows}) r(r), range(0, {G.n_cols}) c(c) WHERE (r * 31 + c * 17) % 3 <> 0)"


def _stats_sql(src: str) -> str:
    """Top-share stats over ``src(period_h, layer, row, col, value)``."""
    ks = {"one_percent": 0.01, "five_percent": 0.05, "ten_percent": 0.10, "twenty_percent": 0.20}
    sums = ", ".join(
        f"round(coalesce(sum(CASE WHEN rn <= CAST(floor({_area()} * {f}) AS BIGINT) THEN value END), 0.0), 6) AS {k}"
        for k, f in ks.items())
    return f"""
    SELECT period_h, layer, {sums}, round(sum(value), 6) AS total FROM (
      SELECT period_h, layer, value,
             row_number() OVER (PARTITION BY period_h, layer ORDER BY value DESC, row, col) AS rn
      FROM {src}) GROUP BY ALL"""


SQL["top_share"] = _with(_cells_cte()) + _stats_sql(
    f"(SELECT period_h, 'observed' AS layer, row, col, CAST(n AS DOUBLE) AS value FROM counts WHERE {_in_extent()})")

_PRED_PERIODS = f"""pp AS (
      SELECT period_h FROM elig WHERE period_h >= {HOLDOUT}
        AND period_h IN (SELECT period_h FROM hrs)
        AND period_h IN (SELECT period_h + x FROM hrs, range(1, 3) r(x))
    )"""

SQL["period_intersection"] = _with(_cells_cte(), _hours_cte(), _eligible_cte(), _PRED_PERIODS) + \
    "\nSELECT period_h FROM pp"

SQL["combined_stats"] = _with(
    _cells_cte(), _hours_cte(), _eligible_cte(), _PRED_PERIODS, _trailing_cte("two", 1, 2),
    f"""src AS (
      SELECT period_h, 'obs' AS layer, row, col, CAST(n AS DOUBLE) AS value FROM counts
      WHERE {_in_extent()} AND period_h IN (SELECT period_h FROM pp)
      UNION ALL
      SELECT period_h, 'two' AS layer, row, col, CAST(n AS DOUBLE) / 2 AS value FROM two
      WHERE {_in_extent()} AND period_h IN (SELECT period_h FROM pp)
    )""", "st AS (" + _stats_sql("src") + ")") + """
SELECT f.period_h, f.layer, coalesce(st.one_percent, 0.0) AS one_percent, coalesce(st.five_percent, 0.0) AS five_percent,
       coalesce(st.ten_percent, 0.0) AS ten_percent, coalesce(st.twenty_percent, 0.0) AS twenty_percent,
       coalesce(st.total, 0.0) AS total
FROM (SELECT period_h, l.layer FROM pp, (VALUES ('obs'), ('two')) l(layer)) f
LEFT JOIN st ON st.period_h = f.period_h AND st.layer = f.layer"""


# ---- round trips and summaries -------------------------------------------------------------

SQL["trips_rollup"] = _with(_cells_cte()) + f"""
, d AS (SELECT CAST(strftime({EPOCH_SQL} + to_hours(period_h), '%Y%m%d') AS INTEGER) AS day_key, n FROM counts)
SELECT CAST(day_key // 100 AS INTEGER) AS month_key, day_key, CAST(sum(n) AS BIGINT) AS n FROM d GROUP BY ALL
UNION ALL
SELECT CAST(day_key // 100 AS INTEGER) AS month_key, CAST(NULL AS INTEGER) AS day_key, CAST(sum(n) AS BIGINT) AS n
FROM d GROUP BY 1"""

SQL["line_quarantine"] = """
SELECT CASE WHEN event_id % 89 = 0 THEN 'fields' WHEN event_id % 83 = 0 OR event_id % 79 = 0 THEN 'datetime' ELSE 'good' END AS outcome,
       CASE WHEN event_id % 89 = 0 THEN 13 ELSE 14 END AS n_fields, CAST(count(*) AS BIGINT) AS n
FROM events GROUP BY ALL"""

SQL["trips_text_gz"] = SQL["trips_cell_hour"]

_STORE = _with(_cells_cte(), _hours_cte(), _manifest_cte(), _trailing_cte("two", 1, 2)) + f"""
, test AS (SELECT layer AS grouping, period_h FROM man
           WHERE layer IN ('observed', 'two_hour') AND period_h >= {HOLDOUT})
"""

SQL["raster_store_roundtrip"] = _STORE + f"""
SELECT s.grouping, CAST(s.period_h AS INTEGER) AS period_h, s.row, s.col, s.value,
       CAST({G.x_min!r} AS DOUBLE) + (s.col + 0.5) * {G.cell_width!r} AS x,
       CAST({G.y_max!r} AS DOUBLE) - (s.row + 0.5) * {G.cell_height!r} AS y
FROM (
  SELECT 'observed' AS grouping, period_h, row, col, CAST(n AS DOUBLE) AS value FROM counts WHERE {_in_extent()}
  UNION ALL
  SELECT 'two_hour' AS grouping, period_h, row, col, CAST(n AS DOUBLE) / 2 AS value FROM two WHERE {_in_extent()}
) s JOIN test t ON t.grouping = s.grouping AND t.period_h = s.period_h"""

SQL["raster_listing"] = _STORE + "\nSELECT grouping, period_h FROM test"

SQL["weather_csv_roundtrip"] = _with(_weather_cte()) + f"""
SELECT period_h, {", ".join(f"round({k}, 6) AS {k}" for k in WEATHER_KEYS)} FROM wx"""

SQL["stream_cell_counts"] = SQL["trips_cell_hour"]

SQL["hash_split"] = _with(_cells_cte(), _hours_cte(), _eligible_cte()) + """
SELECT period_h,
       CASE WHEN CAST(('0x' || substr(md5(CAST(period_h AS VARCHAR) || ':7'), 1, 8)) AS BIGINT) % 10000 < 7000
            THEN 'train' ELSE 'test' END AS split
FROM elig"""


SQL["raster_store_rewrite"] = _STORE + f"""
, first AS (
  SELECT 'observed' AS grouping, period_h, row, col, CAST(n AS DOUBLE) AS value FROM counts WHERE {_in_extent()}
  UNION ALL
  SELECT 'two_hour' AS grouping, period_h, row, col, CAST(n AS DOUBLE) / 2 AS value FROM two WHERE {_in_extent()})
SELECT 'cell' AS kind, s.grouping, CAST(s.period_h AS INTEGER) AS period_h, s.row, s.col,
       CASE WHEN s.grouping = 'observed' AND s.period_h % 5 = 0 THEN 2 * s.value ELSE s.value END AS value
FROM first s JOIN test t ON t.grouping = s.grouping AND t.period_h = s.period_h
WHERE NOT (s.grouping = 'observed' AND s.period_h % 5 = 1)
UNION ALL
SELECT 'listed', grouping, CAST(period_h AS INTEGER), CAST(NULL AS INTEGER), CAST(NULL AS INTEGER), CAST(NULL AS DOUBLE) FROM test"""


def _vector_sql() -> str:
    head = ["row", "col", "month", "day", "hour", "wd_mon", "wd_tue", "wd_wed", "wd_thu", "wd_fri", "wd_sat", "wd_sun",
            *WEATHER_KEYS]
    layers = MAIN_NAMES[1:]
    forms = [head + layers + GEO_LAYERS, head + [x for k in layers for x in [k, *GEO_LAYERS]]]
    parts = []
    for names in forms:
        sums = [f"round(sum({k} * (row * {G.n_cols} + col + 1)), 3) AS v{i}" for i, k in enumerate(names)]
        sums += [f"CAST(NULL AS DOUBLE) AS v{i}" for i in range(len(names), 112)]
        parts.append(f"SELECT {len(names)} AS size, period_h, CAST(count(*) AS BIGINT) AS n_rows, {', '.join(sums)} FROM ft GROUP BY period_h")
    return _features_sql(False, "\n" + "\nUNION ALL\n".join(parts))


SQL["feature_vector"] = _vector_sql()

SQL["row_split"] = _with(_cells_cte(), _hours_cte(), _eligible_cte(), _grid_cte()) + f"""
SELECT CASE WHEN CAST(('0x' || substr(md5(e.period_h || ':' || m.row || ':' || m.col || ':7'), 1, 8)) AS BIGINT) % 10000 < 7000
            THEN 'train' ELSE 'test' END AS split, e.period_h, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(sum(m.row * {G.n_cols} + m.col + 1) AS BIGINT) AS cells
FROM elig e, maskc m GROUP BY ALL"""

SQL["rf_single_tree"] = _with(_cells_cte()) + """
, h AS (SELECT period_h, period_h % 24 AS hour, CAST(sum(n) AS DOUBLE) AS label,
               CAST(('0x' || substr(md5(period_h || ':7'), 1, 8)) AS BIGINT) % 10000 < 7000 AS train
        FROM counts GROUP BY period_h),
t AS (SELECT hour, label FROM h WHERE train),
cuts AS (SELECT DISTINCT hour AS cut FROM t WHERE hour < (SELECT max(hour) FROM t)),
gain AS (
  SELECT cut, sum(label) FILTER (hour <= cut) / count(*) FILTER (hour <= cut) AS low,
         sum(label) FILTER (hour > cut) / count(*) FILTER (hour > cut) AS high,
         pow(sum(label) FILTER (hour <= cut), 2) / count(*) FILTER (hour <= cut)
         + pow(sum(label) FILTER (hour > cut), 2) / count(*) FILTER (hour > cut) AS explained
  FROM cuts, t GROUP BY cut),
best AS (SELECT * FROM gain ORDER BY explained DESC, cut LIMIT 1)
SELECT period_h, round(CASE WHEN hour <= cut THEN low ELSE high END, 6) AS prediction FROM h, best WHERE NOT train"""

SQL["weather_json_text"] = SQL["weather_flatten"]
SQL["weather_last_row"] = SQL["weather_csv_roundtrip"]

SQL["weather_request_hours"] = f"""
SELECT CAST(x AS INTEGER) AS period_h FROM (
  SELECT unnest(range({_hour("date_trunc('year', m)")}, {_hour('m')} + CASE WHEN m > date_trunc('hour', m) THEN 1 ELSE 0 END)) AS x
  FROM (SELECT max(ts) AS m FROM events))"""


_WRITTEN = f"""
, first AS (
  SELECT 'observed' AS grouping, period_h, row, col, CAST(n AS DOUBLE) AS value FROM counts WHERE {_in_extent()}
  UNION ALL
  SELECT 'two_hour' AS grouping, period_h, row, col, CAST(n AS DOUBLE) / 2 AS value FROM two WHERE {_in_extent()}),
versions AS (
  SELECT 1 AS version, t.*, 0.0 AS factor FROM test t WHERE grouping = 'observed'
  UNION ALL SELECT 2, t.*, 1.0 FROM test t
  UNION ALL SELECT v, t.*, CASE WHEN grouping = 'two_hour' THEN 1.0 WHEN period_h % 5 = 0 THEN 2.0 WHEN period_h % 5 = 1 THEN 0.0 ELSE 1.0 END
  FROM test t, (VALUES (3), (0)) x(v))"""
SQL["raster_store_snapshots"] = _STORE + _WRITTEN + f"""
SELECT CAST(version AS INTEGER) AS version, v.grouping, CAST(v.period_h AS INTEGER) AS period_h,
       CAST(CASE WHEN factor > 0 THEN count(value) ELSE 0 END AS BIGINT) AS n_cells,
       round(coalesce(sum(value * factor), 0.0), 6) AS total,
       round(coalesce(sum(value * factor * (row * {G.n_cols} + col + 1)), 0.0), 6) AS placed
FROM versions v LEFT JOIN first f ON f.grouping = v.grouping AND f.period_h = v.period_h
GROUP BY version, v.grouping, v.period_h, factor"""


# ---- forests as tables of nodes ------------------------------------------------------------

PRIME, FACTORS, POISSON = 2147483647, (73856093, 19349663, 83492791, 49979687), (3679, 7358, 9197, 9810, 9963, 9994)


def _hash(keys: list[str], seed: int = 11) -> str:
    """Three rounds of the integer hash, each a subquery-free expression of the one before."""
    h = "(" + " + ".join(f"CAST({k} AS BIGINT) * {f}" for k, f in zip(keys, FACTORS, strict=False)) + f" + {seed}) % {PRIME}"
    return f"list_reduce([{h}, 0, 0], lambda h, z: (h * h + {FACTORS[0]}) % {PRIME})"


def _forest_sql(trees: int, depth: int, bins: int, everything: bool, tail: str) -> str:
    """The split search over the older job's features, level by level, and what follows."""
    names = ["row", "col", "month", "day", "hour", "wd_mon", "wd_tue", "wd_wed", "wd_thu", "wd_fri", "wd_sat", "wd_sun",
             *OLDER_NAMES, *GEO_LAYERS]
    n = len(names)
    tried = n if everything else -(-n // 3)
    x = ", ".join(f"floor(CAST({k} AS DOUBLE) * 1e6 + 0.5) / 1e6" for k in names)
    u = _hash(["period_h", "row", "col", "tree"]) + " % 10000"
    weight = "CAST(1 AS DOUBLE)" if everything else "(" + " + ".join(f"(u >= {p})::int" for p in POISSON) + ")::double"
    parts = [f"""
, xs AS MATERIALIZED (
  SELECT period_h, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, label, [{x}] AS x,
         CAST(('0x' || substr(md5(period_h || ':7'), 1, 8)) AS BIGINT) % 10000 < 7000 AS train FROM ft),
long AS (SELECT unnest(range(0, {n})) AS feature, unnest(x) AS v FROM xs WHERE train),
span AS MATERIALIZED (SELECT feature, min(v) AS lo, max(v) AS hi FROM long GROUP BY feature),
counted AS (
  SELECT feature, CASE WHEN hi > lo THEN least(4095, CAST(floor((v - lo) / (hi - lo) * 4096) AS INTEGER)) ELSE 0 END AS cell,
         count(*) AS n, max(v) AS top FROM long JOIN span USING (feature) GROUP BY ALL),
weighed AS (SELECT *, least(n, ceil(sum(n) OVER (PARTITION BY feature) / {bins})) AS w FROM counted),
named AS (
  SELECT feature, cell, top, CASE WHEN count(*) OVER (PARTITION BY feature) <= {bins}
         THEN row_number() OVER (PARTITION BY feature ORDER BY cell) - 1
         ELSE floor(coalesce(sum(w) OVER (PARTITION BY feature ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                    * {bins} / sum(w) OVER (PARTITION BY feature)) END AS part FROM weighed),
placed AS MATERIALIZED (
  SELECT feature, cell, dense_rank() OVER (PARTITION BY feature ORDER BY part) - 1 AS bin,
         max(top) OVER (PARTITION BY feature, part) AS cut FROM named),
cuts AS (SELECT DISTINCT feature, bin, cut AS threshold FROM placed),
drawn_rows AS (
  SELECT period_h, row, col, label, x, tree, {'0' if everything else u} AS u FROM xs, range(0, {trees}) t(tree) WHERE train),
rows0 AS MATERIALIZED (SELECT tree, 1 AS node, label, x, {weight} AS w FROM drawn_rows WHERE {'true' if everything else f'u >= {POISSON[0]}'}),
front0 AS (SELECT tree, 1 AS node FROM range(0, {trees}) t(tree))"""]
    for d in range(depth):
        parts.append(f"""
features{d} AS (
  SELECT tree, node, feature FROM front{d}, range(0, {n}) f(feature)
  QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY {_hash(["tree", "node", "feature"])}, feature) <= {tried}),
hist{d} AS MATERIALIZED (
  SELECT tree, node, feature, bin, sum(w) AS w, sum(w * label) AS s
  FROM (SELECT tree, node, feature, label, w,
               CASE WHEN hi > lo THEN least(4095, CAST(floor((x[feature + 1] - lo) / (hi - lo) * 4096) AS INTEGER)) ELSE 0 END AS cell
        FROM rows{d} JOIN features{d} USING (tree, node) JOIN span USING (feature))
  JOIN placed USING (feature, cell) GROUP BY ALL),
sides{d} AS (
  SELECT tree, node, feature, bin, sum(w) OVER f AS w, sum(s) OVER f AS s, sum(w) OVER g AS wl, sum(s) OVER g AS sl FROM hist{d}
  WINDOW f AS (PARTITION BY tree, node, feature), g AS (PARTITION BY tree, node, feature ORDER BY bin)),
split{d} AS MATERIALIZED (
  SELECT tree, node, feature, bin, threshold, wl, sl, w - wl AS wr, s - sl AS sr,
         sl * sl / wl + (s - sl) * (s - sl) / (w - wl) - s * s / w AS gain
  FROM sides{d} JOIN cuts USING (feature, bin) WHERE wl < w AND gain > 1e-6
  QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY gain DESC, feature, bin) = 1),
front{d + 1} AS (SELECT tree, node * 2 + unnest([0, 1]) AS node FROM split{d}),
rows{d + 1} AS MATERIALIZED (
  SELECT tree, r.node * 2 + (x[feature + 1] > threshold)::int AS node, label, x, w FROM rows{d} r JOIN split{d} s USING (tree, node))""")
    found = ["SELECT tree, 1 AS node, max(n) AS n, max(s) AS s FROM (SELECT tree, feature, sum(w) AS n, sum(s) AS s FROM hist0 GROUP BY ALL) GROUP BY tree"]
    for d in range(depth):
        found += [f"SELECT tree, node * 2, wl, sl FROM split{d}", f"SELECT tree, node * 2 + 1, wr, sr FROM split{d}"]
    inner = " UNION ALL ".join(f"SELECT tree, node, feature, threshold FROM split{d}" for d in range(depth))
    parts.append(f"""
inner_nodes AS MATERIALIZED ({inner}),
nodes AS MATERIALIZED (
  SELECT CAST(tree AS INTEGER) AS tree, CAST(node AS INTEGER) AS node, CAST(feature AS INTEGER) AS feature, threshold,
         CASE WHEN feature IS NOT NULL THEN CAST(node * 2 AS INTEGER) END AS left,
         CASE WHEN feature IS NOT NULL THEN CAST(node * 2 + 1 AS INTEGER) END AS right, n, s / n AS prediction
  FROM ({" UNION ALL ".join(found)}) LEFT JOIN inner_nodes USING (tree, node))""")
    at = f"(SELECT period_h, row, col, x, tree, 1 AS node FROM xs, range(0, {trees}) t(tree) WHERE NOT train)"
    for _ in range(depth):
        at = (f"(SELECT period_h, row, col, x, tree, CASE WHEN feature IS NULL THEN node WHEN x[feature + 1] <= threshold THEN node * 2 "
              f"ELSE node * 2 + 1 END AS node FROM {at} LEFT JOIN inner_nodes USING (tree, node))")
    parts.append(f"""
predicted AS (SELECT period_h, row, col, avg(prediction) AS prediction FROM {at} JOIN nodes USING (tree, node) GROUP BY ALL)""")
    return _features_sql(True, ",".join(parts) + tail)


_NODES = """
SELECT tree, node, feature, round(threshold, 6) AS threshold, "left", "right", n, round(prediction, 6) AS prediction FROM nodes"""
SQL["rf_two_levels"] = _forest_sql(1, 2, 32, True, _NODES)
SQL["forest_nodes"] = _forest_sql(5, 3, 32, False, _NODES)
SQL["forest_predict"] = _forest_sql(5, 3, 32, False, """
SELECT period_h, row, col, round(prediction, 6) AS prediction FROM predicted""")
SQL["forest_concentration"] = _forest_sql(5, 3, 32, False, f""",
held AS (SELECT DISTINCT period_h FROM xs WHERE NOT train), {_trailing_cte("two", 1, 2).strip()},
src AS (
  SELECT period_h, 'pred' AS layer, row, col, prediction AS value FROM predicted
  UNION ALL SELECT period_h, 'obs', row, col, CAST(n AS DOUBLE) FROM counts WHERE {_in_extent()} AND period_h IN (SELECT period_h FROM held)
  UNION ALL SELECT period_h, 'two', row, col, CAST(n AS DOUBLE) / 2 FROM two WHERE {_in_extent()} AND period_h IN (SELECT period_h FROM held)),
st AS ({_stats_sql("src")})
SELECT CAST(h.period_h AS INTEGER) AS period_h, l.layer, coalesce(one_percent, 0.0) AS one_percent, coalesce(five_percent, 0.0) AS five_percent,
       coalesce(ten_percent, 0.0) AS ten_percent, coalesce(twenty_percent, 0.0) AS twenty_percent, coalesce(total, 0.0) AS total
FROM held h CROSS JOIN (VALUES ('pred'), ('obs'), ('two')) l(layer) LEFT JOIN st ON st.period_h = h.period_h AND st.layer = l.layer""")


# ---- landed files, written counts, dense frames, wide windows, zones -----------------------

_BAD = "event_id % 89 = 0 OR event_id % 83 = 0 OR event_id % 79 = 0"
SQL["quarantine_ingest"] = _with(_cells_cte()) + f"""
SELECT CAST(NULL AS INTEGER) AS batch, 'good' AS reason, period_h, row, col, CAST(count(*) AS BIGINT) AS n, CAST(NULL AS BIGINT) AS ids
FROM cells WHERE NOT ({_BAD.replace("event_id", "trip_id")}) GROUP BY period_h, row, col
UNION ALL
SELECT CAST(event_id % 3 AS INTEGER), CASE WHEN event_id % 89 = 0 THEN 'fields' ELSE 'datetime' END, CAST(NULL AS INTEGER),
       CAST(NULL AS INTEGER), CAST(NULL AS INTEGER), CAST(count(*) AS BIGINT), CAST(sum(event_id) AS BIGINT)
FROM events WHERE {_BAD} GROUP BY 1, 2"""

SQL["trips_incremental"] = SQL["trips_cell_hour"]

_PER_PERIOD = ", ".join(f"round(sum({x}), 3) AS {kind}_{k}" for k in ["observed", *OLDER_NAMES] for kind, x in (
    ("sum", "label" if k == "observed" else k), ("placed", f"{'label' if k == 'observed' else k} * (row * {G.n_cols} + col + 1)")))
SQL["counts_materialized"] = _features_sql(True, f"""
SELECT period_h, CAST(count(*) AS BIGINT) AS n_rows, {_PER_PERIOD} FROM ft GROUP BY period_h""")

SQL["row_counts"] = _with(_cells_cte(), _hours_cte(), _eligible_cte(), _grid_cte(), _layers_cte(older=True)) + """
SELECT 'trips' AS step, CAST(count(*) AS BIGINT) AS n FROM cells
UNION ALL SELECT 'counts', count(*) FROM counts
UNION ALL SELECT 'layers', count(*) FROM lay
UNION ALL SELECT 'features', (SELECT count(*) FROM elig) * (SELECT count(*) FROM maskc)"""

SQL["trailing_dense"] = SQL["trailing_8h"]


def _uniform(size: int) -> str:
    return f"u{size} AS (SELECT k, 1.0::DOUBLE AS w FROM range(-{size // 2}, {size - size // 2}) s(k))"


SQL["focal_mean_wide"] = _with(_cells_cte(), _trailing_cte("two", 1, 2), *[
    x for size in (25, 26) for x in (_uniform(size), _map_cte(f"ur{size}", G.n_rows, f"u{size}"), _map_cte(f"uc{size}", G.n_cols, f"u{size}"))
]) + "\nUNION ALL\n".join(f"""
SELECT CAST({size} AS INTEGER) AS size, period_h, CAST(count(*) AS BIGINT) AS n_cells, round(sum(value), 6) AS total,
       round(sum(value * (row * {G.n_cols} + col + 1)), 4) AS placed, round(max(value), 6) AS peak
FROM (SELECT t.period_h, rm.i AS row, cm.i AS col, sum(t.n * rm.w * cm.w) / {size * size}.0 AS value
      FROM (SELECT * FROM two WHERE {_in_extent()}) t JOIN ur{size} rm ON t.row = rm.ri JOIN uc{size} cm ON t.col = cm.ri GROUP BY ALL)
GROUP BY period_h""" for size in (25, 26))


def _zones_sql() -> str:
    lats = [-80.0, -33.0, 0.0, 55.999, 56.0, 60.0, 63.999, 64.0, 71.999, 72.0, 78.0, 83.999, 84.0]
    lngs = [-180.0, -0.001, 0.0, 2.999, 3.0, 5.999, 6.0, 8.999, 9.0, 11.999, 12.0, 20.999, 21.0, 32.999, 33.0, 41.999, 42.0, 179.999]
    x, y = _utm_sql("lat", "lng")
    # The series with its own zone in place of the regular one.
    regular = "floor((lng + 180) / 6) + 1"
    x, y = x.replace(regular, "zone"), y.replace(regular, "zone")
    return f"""
WITH p AS (
  SELECT event_id, ([{', '.join(map(repr, lats))}])[(event_id % {len(lats)} + 1)::int]::DOUBLE AS lat,
         ([{', '.join(map(repr, lngs))}])[((event_id // {len(lats)}) % {len(lngs)} + 1)::int]::DOUBLE AS lng FROM events),
zones(lat_from, lat_to, lng_from, lng_to, number) AS (
  VALUES (56.0, 63.9999999, 3.0, 12.0, 32), (72.0, 84.0, 0.0, 9.0, 31), (72.0, 84.0, 9.0, 21.0, 33), (72.0, 84.0, 21.0, 33.0, 35),
         (72.0, 84.0, 33.0, 42.0, 37)),
z AS (SELECT p.*, coalesce(number, floor((lng + 180) / 6) + 1)::int AS zone
      FROM p LEFT JOIN zones ON lat >= lat_from AND lat <= lat_to AND lng >= lng_from AND lng < lng_to)
SELECT event_id, zone, round({x}, 3) AS x, round({y}, 2) AS y FROM z"""


SQL["utm_zones"] = _zones_sql()

SQL["outputs_listing"] = _with(_cells_cte(), _hours_cte(), _manifest_cte(), _eligible_cte()) + """
SELECT grouping, CAST(period_h AS INTEGER) AS period_h FROM (
  SELECT layer AS grouping, period_h FROM man WHERE layer IN ('observed', 'two_hour')
  UNION ALL SELECT 'predicted', period_h FROM elig)
WHERE CAST(('0x' || substr(md5(CAST(period_h AS VARCHAR) || ':7'), 1, 8)) AS BIGINT) % 10000 >= 7000"""
