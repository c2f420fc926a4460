"""Up to twelve reference points around each plot, in two tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenogrid.functions.columns import ladder
from phenogrid.functions.geo import distance_km, in_rings
from phenogrid.operators.ordered import first_of_each
from phenogrid.operators.spatial import GRID, containing_polygon, first_within, in_grid, listed_polygons, nearest_k
from phenogrid.schema import (
    BUFFER_KM, CELL_FRACTION, MIN_POINTS, PROXY_KM, PROXY_TILE_KM, VEGETATED_CLASSES,
    VEGETATION_KM, VEGETATION_PENALTY_KM,
)
from phenogrid.session import materialise

SITE = ["lat", "lon", "tile"]


def eligible_cells(cells: DataFrame) -> DataFrame:
    return cells.where(F.coalesce("fraction", F.lit(0.0)) >= CELL_FRACTION).select("cell_id", "tile", "clat", "clon", "fraction")


def sites_of(plots: DataFrame, villages: DataFrame) -> DataFrame:
    """Distinct plot positions with their village."""
    return containing_polygon(plots.select(*SITE).distinct(), villages, "village_no", ["village_no", "village"])


def best_of_villages(sites: DataFrame, own: DataFrame, villages: DataFrame, k: int) -> DataFrame:
    """The ``k`` cells of largest crop fraction of each village and tile that holds a site."""
    asked = sites.where(F.col("village_no").isNotNull()).select("village_no", "tile").distinct()
    regions = listed_polygons(asked.join(villages.select("village_no", "rings"), "village_no"))
    cells = in_grid(own, "clon", "clat").withColumns({"_known": ~F.isnan("fraction"), "_less": -F.col("fraction")})
    return first_of_each(regions, ["village_no", "tile"], cells, ["tile", *GRID], ["_known", "_less", "cell_id"], k,
                         in_rings("clon", "clat", "rings"), block=2 * k)


def tier_one(sites: DataFrame, cells: DataFrame, villages: DataFrame, k: int = MIN_POINTS) -> DataFrame:
    """Cells of the plot's own tile: in its village by crop fraction, then the nearest within 5 km.

    The k best cells of a village do not depend on the plot, so they are ranked once per
    village and tile; the fill comes from the bucketed nearest search.
    """
    own = eligible_cells(cells)
    best = best_of_villages(sites, own, villages, k)
    in_village = sites.join(best, ["village_no", "tile"]).select(
        *SITE, "cell_id", "clat", "clon", F.lit(0).alias("_tier"), F.col("rank").cast("double").alias("_order"),
        distance_km("lat", "lon", "clat", "clon").alias("km"))
    near = nearest_k(sites.select(*SITE), SITE, own.withColumnRenamed("tile", "cell_tile"), "cell_id", k, max_km=BUFFER_KM,
                     start_km=BUFFER_KM / 4, group=["cell_tile"], eligible=F.col("cell_tile") == F.col("tile"))
    near = near.select(*SITE, "cell_id", "clat", "clon", F.lit(1).alias("_tier"), F.col("km").alias("_order"), "km")
    # a cell that is both counts once, as a village cell
    both = in_village.unionByName(near).groupBy(*SITE, "cell_id").agg(
        F.min(F.struct("_tier", "_order", "clat", "clon", "km")).alias("_c")).select(*SITE, "cell_id", "_c.*")
    pick = Window.partitionBy(*SITE).orderBy("_tier", "_order", "cell_id")
    return both.withColumn("ord", F.row_number().over(pick)).where(F.col("ord") <= k).select(
        *SITE, "ord", F.lit("cropland").alias("kind"), F.col("cell_id").alias("ref_id"), "clat", "clon", "km",
        F.lit(None).cast("string").alias("ref_tile"))


def vegetated(cover: DataFrame) -> DataFrame:
    return cover.where(F.col("cover_class").isin(VEGETATED_CLASSES))


def sampled_vegetation(sites: DataFrame, cover: DataFrame, cap: int, seed: int = 1) -> DataFrame:
    """Seeded sample of at most ``cap`` vegetated points around each site (the sampling operator)."""
    drawn = vegetated(cover).withColumn("_draw", F.xxhash64("veg_id", F.lit(seed)))
    return first_within(sites.select(*SITE), SITE, drawn, ["_draw", "veg_id"], cap, VEGETATION_KM, target_at=("vlat", "vlon")).select(
        *SITE, "veg_id", "vlat", "vlon", "km")


def tier_two(sites: DataFrame, cells: DataFrame, catalogue: DataFrame, cover: DataFrame, k: int = MIN_POINTS) -> DataFrame:
    """Nearest stand-ins: cropland of other tiles within 50 km, vegetation within 10 km at +20 km.

    The k nearest of each pool hold the k nearest of both.
    """
    far = eligible_cells(cells).join(catalogue, "tile").withColumnRenamed("tile", "cell_tile")
    centre = distance_km("lat", "lon", "tile_lat", "tile_lon")
    crop = nearest_k(sites.select(*SITE), SITE, far, "cell_id", k, max_km=PROXY_KM, start_km=PROXY_KM / 16,
                     group=["cell_tile", "tile_lat", "tile_lon"],
                     eligible=(F.col("cell_tile") != F.col("tile")) & (centre <= PROXY_TILE_KM))
    crop = crop.select(*SITE, F.lit("cropland").alias("kind"), F.col("cell_id").alias("ref_id"), "clat", "clon", "km",
                       F.col("cell_tile").alias("ref_tile"), F.col("km").alias("_eff"))
    veg = nearest_k(sites.select(*SITE), SITE, vegetated(cover), "veg_id", k, target_at=("vlat", "vlon"),
                    max_km=VEGETATION_KM, start_km=VEGETATION_KM / 4)
    veg = veg.select(*SITE, F.lit("vegetation").alias("kind"), F.col("veg_id").alias("ref_id"), F.col("vlat").alias("clat"),
                     F.col("vlon").alias("clon"), "km", F.lit(None).cast("string").alias("ref_tile"),
                     (F.col("km") + VEGETATION_PENALTY_KM).alias("_eff"))
    pick = Window.partitionBy(*SITE).orderBy("_eff", "kind", "ref_id")
    return crop.unionByName(veg).withColumn("ord", F.row_number().over(pick)).where(F.col("ord") <= k).drop("_eff")


def sample_points(plots: DataFrame, cells: DataFrame, villages: DataFrame, catalogue: DataFrame, cover: DataFrame,
                  k: int = MIN_POINTS) -> tuple[DataFrame, DataFrame]:
    """(points, summary): the chosen points per plot position and one summary row per plot.

    Positions and chosen points are read several times below, so they are stored once.
    """
    sites = materialise(sites_of(plots, villages), "sites")
    one = materialise(tier_one(sites, cells, villages, k), "tier-one")
    rest = sites.join(one.select(*SITE).distinct(), SITE, "left_anti")
    two = tier_two(rest, cells, catalogue, cover, k)
    points = materialise(one.withColumn("tier", F.lit(1)).unionByName(two.withColumn("tier", F.lit(2))), "points")
    return points, sampling_summary(plots, sites, points, catalogue, k)


def sampling_summary(plots: DataFrame, sites: DataFrame, points: DataFrame, catalogue: DataFrame, k: int = MIN_POINTS) -> DataFrame:
    first = F.min_by(F.struct("ref_tile", "km"), "ord")
    per = points.groupBy(*SITE, "tier").agg(
        F.count("*").alias("n_points"), F.bool_or(F.col("kind") == "vegetation").alias("_veg"), F.max("km").alias("_far"), first.alias("_first"))
    none = sites.join(per.select(*SITE), SITE, "left_anti")
    nearest = nearest_k(none.select(*SITE), SITE, catalogue.withColumnRenamed("tile", "cat_tile"), "cat_tile", 1,
                        target_at=("tile_lat", "tile_lon"), start_km=20.0).select(*SITE, F.bround("km", 1).alias("nearest_km"))
    out = plots.join(sites, SITE).join(per, SITE, "left").join(nearest, SITE, "left")
    two = F.col("tier") == 2
    veg = two & F.col("_veg")
    proxy = two & ~F.col("_veg")
    return out.withColumns({
        "n_points": F.coalesce("n_points", F.lit(0)),
        "village": F.when(F.col("tier") == 1, F.col("village")),
        "small_sample": F.coalesce("n_points", F.lit(0)) < k,
        "proxy": F.coalesce(proxy, F.lit(False)), "veg_fallback": F.coalesce(veg, F.lit(False)),
        "proxy_tile": F.when(proxy, F.col("_first.ref_tile")), "proxy_km": F.when(proxy, F.bround("_first.km", 1)),
        "veg_km": F.when(veg, F.bround("_far", 1)),
        "coverage": ladder([(F.col("tier") == 1, "own tile"), (proxy, "proxy"), (veg, "vegetation")], "out of coverage"),
    }).drop("_veg", "_far", "_first", "tier", "village_no")


def work_table(plots: DataFrame, points: DataFrame, known: DataFrame, key: str = "mws_id") -> DataFrame:
    """Plot (ord 0) and its points as forecast tasks, without those that have no history.

    ``plots`` and ``points`` carry the location each was assigned to; a plot without history
    drops out with its points.
    """
    alive = known.select(key).distinct()
    head = plots.select("plot_id", F.lit(0).alias("ord"), F.col("lat").alias("plat"), F.col("lon").alias("plon"), key).join(alive, key, "left_semi")
    tail = plots.select("plot_id", *SITE).join(points.select(*SITE, "ord", F.col("clat").alias("plat"), F.col("clon").alias("plon"), key), SITE) \
        .select("plot_id", "ord", "plat", "plon", key).join(alive, key, "left_semi")
    return head.unionByName(tail.join(head.select("plot_id"), "plot_id", "left_semi"))
