"""Cloud-masked composites from a long pixel table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenogrid.schema import BANDS, REFLECTANCE_SCALE

# Band names of the two sensors in the order of the common names.
LANDSAT_BANDS = ["B2", "B3", "B4", "B5", "B6", "B7"]
SENTINEL_BANDS = ["B2", "B3", "B4", "B8A", "B11", "B12"]
CLOUD_BITS = 0b1110
TILE = ["mws_id", "tile_year", "period"]


def harmonise(scenes: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Sensor frames with their own band names to one frame with the common names."""
    parts = [df.withColumnsRenamed(dict(zip(names, BANDS))) for df, names in scenes]
    return reduce(lambda a, b: a.unionByName(b), parts)


def composite(pixels: DataFrame) -> DataFrame:
    """Median of the clear scenes per pixel, scaled to int16; a pixel never seen clear is 0.

    The group is one pixel of one tile and quarter, i.e. at most the scenes of a quarter.
    """
    clear = F.col("fmask").bitwiseAND(CLOUD_BITS) == 0
    return pixels.groupBy(*TILE, "row", "col").agg(*[
        F.coalesce(F.round(F.median(F.when(clear, F.col(b))) * REFLECTANCE_SCALE), F.lit(0)).cast("smallint").alias(b)
        for b in BANDS])


def tile_coverage(composites: DataFrame) -> DataFrame:
    return composites.groupBy(*TILE).agg(F.avg((F.col("nir") > 0).cast("double")).alias("coverage"))


def fit_band_stats(composites: DataFrame) -> DataFrame:
    """One row of mean and spread per band over pixels with data."""
    return composites.agg(*[f(F.when(F.col(b) != 0, F.col(b))).alias(f"{b}_{n}") for b in BANDS
                            for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def normalise(composites: DataFrame, stats: DataFrame) -> DataFrame:
    out = composites.crossJoin(F.broadcast(stats))
    return out.withColumns({b: F.when(F.col(b) == 0, 0.0).otherwise(
        F.try_divide(F.col(b) - F.col(f"{b}_mean"), F.col(f"{b}_std"))) for b in BANDS}).drop(*stats.columns)
