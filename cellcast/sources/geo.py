"""Static per-cell inputs: geographic layers and the study-area mask.

Rasters are stored as cell tables ``(layer, row, col, value)``; a reader for
image formats is out of scope. Both tables are bounded by the grid size, not
by the trip volume, which is what makes broadcasting them safe; the check is
explicit in :func:`bounded_broadcast`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellcast.functions.grid import GridSpec, in_extent

# The six static layers, in feature order.
GEO_LAYERS = ["roads", "roads_distance", "transport", "transport_distance",
              "airports", "airports_distance"]

# Largest table we hint for broadcast; above it the join falls back to a shuffle.
MAX_BROADCAST_BYTES = 256 * 1024 * 1024


def bounded_broadcast(df: DataFrame, max_rows: int, row_bytes: int,
                      limit: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast-hint ``df`` only if its proven row bound fits ``limit``.

    ``max_rows`` must be a bound that holds by construction (e.g. the number of
    grid cells), never an estimate of the data.
    """
    if max_rows * row_bytes <= limit:
        return F.broadcast(df)
    return df


def geo_wide(geo_long: DataFrame, grid: GridSpec, layers=GEO_LAYERS) -> DataFrame:
    """``(layer, row, col, value)`` -> ``(row, col, <one column per layer>)``, cells of the grid.
    A cell missing from a layer reads as 0, like a dense raster."""
    wide = geo_long.filter(in_extent(F.col("row"), F.col("col"), grid)).groupBy("row", "col").pivot("layer", list(layers)).agg(F.first("value"))
    return wide.select("row", "col", *[F.coalesce(F.col(k), F.lit(0.0)).cast("double").alias(k)
                                       for k in layers])


def mask_cells(mask_raster: DataFrame, grid: GridSpec) -> DataFrame:
    """Cells of the study area: mask value equal to 1, on the grid, each once. So the mask
    has at most ``grid.n_cells`` rows, whatever the raster holds."""
    return (mask_raster.filter((F.col("value") == 1) & in_extent(F.col("row"), F.col("col"), grid))
            .select("row", "col").distinct())
