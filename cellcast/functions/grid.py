"""Grid definition, coordinate parsing, UTM projection and cell binning.

Projection and binning are built-in expressions (in stacked projections), so they run
inside whole-stage codegen next to the scan; no Python per row.

Grid conventions (row 0 is the north edge, ``int()``-style truncation toward
zero, the index gate applied only at rasterization) follow the analysed job.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GridSpec:
    """A north-up regular grid. Valid cells are ``0 <= row < n_rows``, ``0 <= col < n_cols``."""

    x_min: float
    y_min: float
    x_max: float
    y_max: float
    cell_width: float
    cell_height: float
    n_rows: int
    n_cols: int

    @property
    def n_cells(self) -> int:
        return self.n_rows * self.n_cols

    def with_cell(self, size: float, n_rows: int, n_cols: int) -> "GridSpec":
        return replace(self, cell_width=size, cell_height=size, n_rows=n_rows, n_cols=n_cols)


# The analysed job's grid (UTM zone 18N metres, 50 m cells).
# Its array is 949 rows (north to south) by 942 columns, although the extent
# divided by the cell size is 942 x 940; the index gate is what counts.
NYC_50M = GridSpec(
    x_min=562786.017, y_min=4482993.928, x_max=609786.017, y_max=4530093.928,
    cell_width=50.0, cell_height=50.0, n_rows=949, n_cols=942,
)

# The test grid, same extent with 1 km cells.
TEST_1KM = NYC_50M.with_cell(1000.0, n_rows=48, n_cols=47)


# Text accepted as a number by Python's float(): optional sign, decimal or
# exponent form, nan/inf/infinity, surrounding whitespace. Spark's cast also
# takes suffixes such as '40.5d', which must count as unparsable.
_PY_FLOAT = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:nan|inf|infinity))\s*$"


def parse_number(text: Column, default: float = 0.0) -> Column:
    """String -> DOUBLE with the 'unparsable becomes ``default``' rule."""
    return F.coalesce(F.regexp_extract(text, _PY_FLOAT, 0).try_cast("double"), F.lit(default))


# WGS84 / UTM constants of the transverse Mercator forward series
# (Snyder, USGS Professional Paper 1395), as used by the analysed job.
UTM_A = 6378137.0
UTM_E2 = 0.0066943799901413165
UTM_EP2 = 0.006739496742276435
UTM_K0 = 0.9996
UTM_M1 = 0.9983242984503243
UTM_M2 = 0.002514607064228144
UTM_M3 = 2.639046602129982e-6
UTM_M4 = 3.4180461367750593e-9
UTM_FALSE_EASTING = 500000.0
UTM_FALSE_NORTHING_SOUTH = 10000000.0


# The irregular zones around Norway and Svalbard, as latitude from and below (or up to
# and with the last degree of the projection), longitude from and below, zone.
IRREGULAR_ZONES = [
    (56.0, 64.0, 3.0, 12.0, 32),
    (72.0, 84.0, 0.0, 9.0, 31),
    (72.0, 84.0, 9.0, 21.0, 33),
    (72.0, 84.0, 21.0, 33.0, 35),
    (72.0, 84.0, 33.0, 42.0, 37),
]
LAST_LATITUDE = 84.0


def utm_zone(lat: Column, lng: Column, irregular=tuple(IRREGULAR_ZONES)) -> Column:
    """Automatic UTM zone number: the interval of the irregular zones that holds the point, or
    else the zone of its six degrees. The table is short and its intervals are disjoint, so the
    lookup is an expression; a join would cost a row's worth of work for five rows."""
    zone = (F.floor((lng + 180.0) / 6.0) + 1).cast("int")
    for lat_from, lat_to, lng_from, lng_to, number in irregular:
        below = (lat <= lat_to) if lat_to == LAST_LATITUDE else (lat < lat_to)
        zone = F.when((lat >= lat_from) & below & (lng >= lng_from) & (lng < lng_to), F.lit(number)).otherwise(zone)
    return zone


def with_utm(df: DataFrame, lat: Column, lng: Column, zone: int | None = None,
             x: str = "x", y: str = "y") -> DataFrame:
    """Add UTM easting ``x`` and northing ``y`` (metres) for numeric ``lat``/``lng``.

    ``zone=None`` picks the zone per point and then, like the analysed job,
    discards it, so points of other zones alias onto the grid. Passing a fixed
    ``zone`` projects every point into that zone instead. Points outside
    latitude [-80, 84] or longitude [-180, 180] (NaN included) map to (0, 0).

    The series reuses its terms many times, so it is built in stacked
    projections: Catalyst keeps a projection separate when collapsing it would
    repeat a non-trivial expression, and all of them still run in one codegen
    stage.
    """
    keep = [F.col(c) for c in df.columns]
    z = utm_zone(F.col("_lat"), F.col("_lng")) if zone is None else F.lit(int(zone))
    # A one-element inline() ends predicate pushdown here: a later filter on
    # row/col cannot be rewritten through the series down to the scan, which
    # would copy the whole series into the filter once per reference.
    s1 = df.select(*keep, F.inline(F.array(F.struct(lat.cast("double").alias("_lat"),
                                                    lng.cast("double").alias("_lng")))))
    s2 = s1.select(*keep, "_lat", "_lng", F.radians("_lat").alias("_phi"),
                   (F.radians("_lng") - F.radians((z - 1) * 6 - 180 + 3)).alias("_dlam"))
    phi = F.col("_phi")
    s3 = s2.select(*keep, "_lat", "_lng", "_phi", "_dlam",
                   F.sin(phi).alias("_sin"), F.cos(phi).alias("_cos"), F.tan(phi).alias("_tan"))
    sin_phi, cos_phi, tan_phi = F.col("_sin"), F.col("_cos"), F.col("_tan")
    s4 = s3.select(
        *keep, "_lat", "_lng", "_tan",
        (F.lit(UTM_A) / F.sqrt(1.0 - UTM_E2 * sin_phi * sin_phi)).alias("_n"),
        (tan_phi * tan_phi).alias("_t"),
        (UTM_EP2 * cos_phi * cos_phi).alias("_c"),
        (F.col("_dlam") * cos_phi).alias("_a"),
        (UTM_A * (UTM_M1 * phi - UTM_M2 * F.sin(2 * phi) + UTM_M3 * F.sin(4 * phi)
                  - UTM_M4 * F.sin(6 * phi))).alias("_m"))
    n, t, c, a, m = (F.col(k) for k in ("_n", "_t", "_c", "_a", "_m"))
    xv = UTM_K0 * n * (
        a + (1 - t + c) * F.pow(a, 3) / 6
        + (5 - 18 * t + t * t + 72 * c - 58 * UTM_EP2) * F.pow(a, 5) / 120
    ) + UTM_FALSE_EASTING
    yv = UTM_K0 * (m + n * F.col("_tan") * (
        a * a / 2
        + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24
        + (61 - 58 * t + t * t + 600 * c - 330 * UTM_EP2) * F.pow(a, 6) / 720
    ))
    la, lo = F.col("_lat"), F.col("_lng")
    yv = yv + F.when(la < 0, F.lit(UTM_FALSE_NORTHING_SOUTH)).otherwise(F.lit(0.0))
    ok = la.between(-80.0, 84.0) & lo.between(-180.0, 180.0)
    return s4.select(*keep, F.when(ok, xv).otherwise(F.lit(0.0)).alias(x),
                     F.when(ok, yv).otherwise(F.lit(0.0)).alias(y))


def cell_of(x: Column, y: Column, grid: GridSpec) -> tuple[Column, Column]:
    """(row, col) of a projected point; truncation toward zero like ``int()``."""
    col = ((x - grid.x_min) / grid.cell_width).cast("int")
    row = -(((y - grid.y_max) / grid.cell_height).cast("int"))
    return row, col


def in_extent(row: Column, col: Column, grid: GridSpec) -> Column:
    """The index gate applied at rasterization."""
    return row.between(0, grid.n_rows - 1) & col.between(0, grid.n_cols - 1)


def cell_center(row: Column, col: Column, grid: GridSpec) -> tuple[Column, Column]:
    """Map coordinates of a cell centre (the corrected georeference)."""
    return (grid.x_min + (col + 0.5) * grid.cell_width,
            grid.y_max - (row + 0.5) * grid.cell_height)


def with_cells_from_text(df: DataFrame, lat_text: Column, lng_text: Column, grid: GridSpec,
                         zone: int | None = None) -> DataFrame:
    """Add ``row``/``col`` for latitude/longitude text (unparsable text reads as 0.0)."""
    keep = [F.col(c) for c in df.columns]
    pts = with_utm(df, parse_number(lat_text), parse_number(lng_text), zone=zone, x="_x", y="_y")
    row, col = cell_of(F.col("_x"), F.col("_y"), grid)
    # Same barrier on the way out: filters on row/col (the extent gate) apply
    # to the computed cells instead of re-evaluating the series below them.
    return pts.select(*keep, F.inline(F.array(F.struct(row.alias("row"), col.alias("col")))))
