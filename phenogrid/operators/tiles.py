"""Tile registry and the lookup of a sample's image tile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenogrid.functions.columns import seeded_hash
from phenogrid.functions.dates import period_label
from phenogrid.functions.ranking import global_rank
from phenogrid.schema import TILE_MIN_COVERAGE, TILE_MIN_YEAR

# Fixed value: file name pattern of a composite.
NAME = r"^composite_(.+)_(\d{4})(?:_(H[12]|Q[1-4]))?\.tif$"


def parse_names(names: DataFrame, col: str = "name") -> DataFrame:
    """File names with their key; ``mws_id`` is NULL where the name does not match."""
    part = lambda i: F.when(F.col(col).rlike(NAME), F.regexp_extract(col, NAME, i))
    return names.select(
        col, part(1).alias("mws_id"), part(2).cast("int").alias("tile_year"),
        F.when(part(3) == "", "ANNUAL").otherwise(part(3)).alias("period"))


def registry_from_names(names: DataFrame, col: str = "name") -> DataFrame:
    keys = parse_names(names, col).where("mws_id is not null")
    return keys.groupBy("mws_id", "tile_year", "period").agg(F.min(col).alias(col))


def registry_report(names: DataFrame, col: str = "name") -> DataFrame:
    """Files, names that do not match and files beyond the first of their key."""
    per = parse_names(names, col).groupBy("mws_id", "tile_year", "period").agg(F.count("*").alias("n"))
    bad = F.col("mws_id").isNull()
    return per.agg(F.sum("n").alias("n_files"), F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("n_bad"),
                   F.coalesce(F.sum(F.when(~bad, F.col("n") - 1)), F.lit(0)).alias("n_dup"))


def lookup_exact(samples: DataFrame, tiles: DataFrame, date: str = "target_date", lag: int = 1) -> DataFrame:
    """Annual tile of ``lag`` years before the target; a missing one stays NULL."""
    asked = samples.withColumn("tile_year", (F.year(date) - lag).cast("int")).withColumn("period", F.lit("ANNUAL"))
    have = tiles.select("mws_id", "tile_year", "period", F.lit(True).alias("tile_found"))
    return asked.join(have, ["mws_id", "tile_year", "period"], "left").withColumn(
        "tile_found", F.coalesce("tile_found", F.lit(False)))


def lookup_walkback(samples: DataFrame, tiles: DataFrame, date: str = "target_date", mode: str = "quarterly",
                    lag: int = 1, min_coverage: float | None = None, min_year: int | None = None) -> DataFrame:
    """Same season of the latest earlier year that has a tile.

    Samples are reduced to their distinct (location, season, latest allowed year) before they
    meet the tiles, and the best tile is an aggregate, so the size of the sample set only
    matters in the final equality join.
    """
    ok = F.lit(True)
    if min_coverage is not None:
        ok = ok & (F.col("coverage") >= min_coverage)
    if min_year is not None:
        ok = ok & (F.col("tile_year") >= min_year)
    have = tiles.where(ok).select("mws_id", "period", "tile_year")
    asked = samples.withColumn("period", period_label(date, mode)).withColumn("_latest", F.year(date) - lag)
    keys = asked.select("mws_id", "period", "_latest").distinct()
    best = keys.join(have, ["mws_id", "period"]).where(F.col("tile_year") <= F.col("_latest")) \
        .groupBy("mws_id", "period", "_latest").agg(F.max("tile_year").alias("tile_year"))
    return asked.join(best, ["mws_id", "period", "_latest"], "left").drop("_latest").withColumn(
        "tile_found", F.col("tile_year").isNotNull())


def lookup_covered(samples: DataFrame, tiles: DataFrame, date: str = "target_date", lag: int = 1,
                   min_coverage: float = TILE_MIN_COVERAGE, min_year: int = TILE_MIN_YEAR) -> DataFrame:
    """Walk-back over sufficiently covered tiles; none is an error status, not a lost row."""
    out = lookup_walkback(samples, tiles, date, "quarterly", lag, min_coverage, min_year)
    return out.withColumn("tile_status", F.when(F.col("tile_found"), "OK").otherwise("ERROR: no quarterly tile"))


def missing_report(resolved: DataFrame) -> DataFrame:
    key = F.when(F.col("tile_found"), F.struct("mws_id", "tile_year", "period"))
    return resolved.groupBy("split").agg(
        F.count("*").alias("n_samples"), F.count_if(~F.col("tile_found")).alias("n_missing"),
        (F.avg((~F.col("tile_found")).cast("double")) * 100).alias("pct_missing"), F.count_distinct(key).alias("n_tiles"))


def registry_parity(left: DataFrame, right: DataFrame, keys=("mws_id", "target_date")) -> DataFrame:
    """Samples of two lookups side by side: how many differ in their tile or exist on one side only."""
    tile = F.struct("tile_year", "period", "tile_found")
    a = left.select(*keys, tile.alias("_a"), F.lit(1).alias("_in_a"))
    b = right.select(*keys, tile.alias("_b"), F.lit(1).alias("_in_b"))
    return a.join(b, list(keys), "full").agg(
        F.count("*").alias("n_samples"),
        F.count_if(F.col("_in_a").isNull() | F.col("_in_b").isNull() | ~F.col("_a").eqNullSafe(F.col("_b"))).alias("n_different"))


def tile_grouped_batches(resolved: DataFrame, tiles_per_batch: int, per_tile: int, seed: int = 42) -> DataFrame:
    """At most ``per_tile`` seeded samples of each tile, tiles in seeded order cut into batches."""
    tile = ["mws_id", "tile_year", "period"]
    pick = Window.partitionBy(*tile).orderBy(seeded_hash(seed, *tile, "target_date"), "target_date")
    chosen = resolved.where("tile_found").withColumn("_k", F.row_number().over(pick)).where(F.col("_k") <= per_tile)
    order = global_rank(resolved.where("tile_found").select(*tile).distinct()
                        .withColumn("_h", seeded_hash(seed, *tile)), ["_h", *tile], "_pos")
    order = order.select(*tile, F.floor(F.col("_pos") / tiles_per_batch).cast("int").alias("batch"))
    return chosen.join(order, tile).select("batch", *tile, "target_date", F.col("_k").alias("slot"))
