"""Named queries: distances, nearest profile, polygons and sampling around plots."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenogrid.functions import geo
from phenogrid.functions.columns import round_cols, rounded
from phenogrid.operators import sampling, spatial
from phenogrid.plans.registry import query
from phenogrid.schema import VEGETATION_CAP
from phenogrid.sources import tables as t


def study_locations(spark, d):
    """Profile positions inside the study area of the plots."""
    return t.locations(spark, d).withColumns({
        "latitude": F.expr("19.0D + ((loc_no*37) % 1000)*0.0028D"), "longitude": F.expr("76.0D + ((loc_no*91) % 1000)*0.0029D")})


@query("f01_great_circle_distance")
def f01(spark, d):
    p = t.plots(spark, d)
    return p.select("plot_id", rounded(geo.distance_km("lat", "lon", F.lit(20.17), F.lit(78.32))).alias("km"))


@query("f02_nearest_profile")
def f02(spark, d):
    out = spatial.nearest_profile(t.plots(spark, d), study_locations(spark, d), ["mws_id", "district"])
    return round_cols(out.select("plot_id", "mws_id", "district", "profile_km"), ["profile_km"], 4)


@query("f06_village_of_point")
def f06(spark, d):
    out = spatial.containing_polygon(t.plots(spark, d), t.villages(spark, d), "village_no", ["village"])
    return out.select("plot_id", "village")


@query("f07_cell_centre")
def f07(spark, d):
    lon, lat = geo.ring_centre("ring")
    return round_cols(t.crop_cells(spark, d).select("cell_id", lon.alias("lon"), lat.alias("lat")), ["lon", "lat"])


@query("f08_admin_names")
def f08(spark, d):
    names = t.table(spark, d, "nation").join(t.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("string").alias("district"), F.lower("n_name").alias("dname"), F.concat(F.lit("  "), F.col("r_name")).alias("sname"))
    loc = t.locations(spark, d)
    admin = loc.where("loc_no % 6 <> 5").join(names, "district").select(
        geo.location_key("latitude", "longitude").alias("loc_key"), F.col("sname").alias("state"),
        F.concat("dname", F.lit(" east")).alias("district"), F.concat(F.lit("block "), F.col("tehsil")).alias("tehsil"))
    pts = loc.select("mws_id", (F.col("latitude") + 0.00001).alias("lat"), F.col("longitude").alias("lon"))
    return spatial.admin_names(pts, admin).select("mws_id", "state", "district", "tehsil", "tile_key")


def _inputs(spark, d):
    cells = t.crop_cells(spark, d)
    return t.plots(spark, d), cells, t.villages(spark, d), t.tile_catalogue(cells), t.land_cover(spark, d)


@query("f09_sampling_own_tile")
def f09(spark, d):
    plots, cells, villages, _, _ = _inputs(spark, d)
    out = sampling.tier_one(sampling.sites_of(plots, villages), cells, villages)
    return plots.select("plot_id", *sampling.SITE).join(out, sampling.SITE).select("plot_id", "ord", "ref_id", rounded("km", 4).alias("km"))


@query("f10_sampling_stand_ins")
def f10(spark, d):
    plots, *rest = _inputs(spark, d)
    points, _ = sampling.sample_points(plots, *rest)
    two = points.where("tier = 2")
    return plots.select("plot_id", *sampling.SITE).join(two, sampling.SITE).select(
        "plot_id", "ord", "kind", "ref_id", rounded("km", 4).alias("km"), "ref_tile")


@query("f11_sampling_summary")
def f11(spark, d):
    _, summary = sampling.sample_points(*_inputs(spark, d))
    return summary.select("plot_id", "coverage", "n_points", "village", "small_sample", "proxy_tile", "proxy_km", "veg_km", "nearest_km")


@query("f12_vegetation_sample")
def f12(spark, d):
    plots, _, villages, _, cover = _inputs(spark, d)
    out = sampling.sampled_vegetation(sampling.sites_of(plots, villages), cover, cap=VEGETATION_CAP)
    return plots.select("plot_id", *sampling.SITE).join(out, sampling.SITE).select("plot_id", "veg_id", rounded("km", 4).alias("km"))


def forecast_tasks(spark, d):
    """Work table of all plots: the plot and its points with the location each is read from, if it has any reading."""
    plots, *rest = _inputs(spark, d)
    points, summary = sampling.sample_points(plots, *rest)
    loc = study_locations(spark, d)
    homes = spatial.nearest_profile(plots, loc, ["mws_id"])
    placed = spatial.nearest_profile(points, loc, ["mws_id"], at=("clat", "clon"))
    known = t.observations(spark, d).where("NDVI_raw is not null").select("mws_id").distinct()
    return sampling.work_table(homes, placed, known), summary


@query("f13_forecast_work_table")
def f13(spark, d):
    tasks, _ = forecast_tasks(spark, d)
    return tasks.select("plot_id", "ord", "mws_id")
