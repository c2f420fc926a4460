"""Views of the driver tables in the shapes the engine works on.

Location = supplier, district = nation, state = region, observation = line item by ship date.
Every function reads only the columns it needs, so the scan is pruned to them.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phenogrid.functions.columns import W
from phenogrid.schema import RADIATION, STEP_DAYS, WIND
from phenogrid.session import operators_alone, shuffles_for

#: Origin of the 14-day grid; the steps and years that are used come from the observations.
EPOCH = "1995-01-02"
SENSORS = [
    "NDVI_raw", "total_precipitation_m", "runoff_m", "evaporation_m", "temperature_2m",
    "dewpoint_temperature_2m", *WIND, *RADIATION, "sm_surface", "sm_rootzone", "SummaryQA",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    operators_alone(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(spark, sf_dir):
    """Shuffles in proportion to the observations (counted from the files' footers) while a panel is stored."""
    return shuffles_for(spark, table(spark, sf_dir, "lineitem").count())


def locations(spark, sf_dir) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return sup.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr(
        "cast(s_suppkey as string) mws_id",
        "s_suppkey loc_no",
        "8.0D + ((s_suppkey*37) % 1000)*0.028D latitude",
        "68.0D + ((s_suppkey*91) % 1000)*0.029D longitude",
        "cast(n_regionkey as string) state",
        "cast(s_nationkey as string) district",
        "concat(cast(s_nationkey as string), '-', cast(s_suppkey % 3 as string)) tehsil",
        "(s_suppkey % 17) / 17.0D sensitivity_spei3",
    )


def observations(spark, sf_dir) -> DataFrame:
    """One row per raw observation: daily state, flux, soil and reflectance-index readings."""
    return (
        table(spark, sf_dir, "lineitem")
        .selectExpr(
            "cast(l_suppkey as string) mws_id",
            "cast(l_shipdate as date) obs_date",
            f"datediff(cast(l_shipdate as date), date'{EPOCH}') dd",
            "cast(round(l_discount * 100000) as int) NDVI_raw",
            "l_quantity * 0.001D total_precipitation_m",
            "l_quantity * l_tax * 0.001D runoff_m",
            "-(l_quantity * l_discount) * 0.001D evaporation_m",
            "280.0D + l_tax * 250.0D temperature_2m",
            "270.0D + l_tax * 200.0D + l_discount * 10.0D dewpoint_temperature_2m",
            f"l_linenumber - 3.5D {WIND[0]}",
            f"l_quantity / 10.0D - 2.5D {WIND[1]}",
            f"l_extendedprice {RADIATION[0]}",
            f"l_tax - l_extendedprice / 10.0D {RADIATION[1]}",
            "0.05D + l_tax sm_surface",
            "0.1D + l_discount sm_rootzone",
            "(l_linenumber - 1) % 4 SummaryQA",
        )
        .withColumn("step", F.floor(F.col("dd") / F.lit(14.0)).cast("int"))
        .withColumn("day_in_step", (F.col("dd") % 14).cast("int"))
        .drop("dd")
    )


def _span(spark, sf_dir):
    """First and last observation date; one pass over one column."""
    day = F.col("l_shipdate").cast("date")
    return table(spark, sf_dir, "lineitem").agg(F.min(day).alias("first"), F.max(day).alias("last")).first()


def calendar(spark, sf_dir) -> Column:
    """The grid's steps from the first observation to the last, as an array; none without observations."""
    span = _span(spark, sf_dir)
    if span["first"] is None:
        return F.array().cast("array<int>")
    low, high = ((day - date.fromisoformat(EPOCH)).days // STEP_DAYS for day in (span["first"], span["last"]))
    return F.sequence(F.lit(low), F.lit(high))


def tile_years(spark, sf_dir) -> list[int]:
    """Years with composites: from the first year after the one of the first observation to that of the last."""
    span = _span(spark, sf_dir)
    return [] if span["first"] is None else list(range(span["first"].year + 1, span["last"].year + 1))


def grid(spark, sf_dir) -> DataFrame:
    """Every location on every step of the calendar (no shuffle: an explode per location)."""
    return locations(spark, sf_dir).select("mws_id", F.explode(calendar(spark, sf_dir)).alias("step")) \
        .withColumn("date", F.expr(f"date_add(date'{EPOCH}', step * 14)"))


def source_panel(spark, sf_dir, whole: bool = True) -> DataFrame:
    """The panel as it is read from storage: source column names, sentinels and gaps.

    Without ``whole`` steps that have no observation at all are left out, for callers that drop them anyway.
    """
    obs = observations(spark, sf_dir)
    sums = obs.groupBy("mws_id", "step").agg(
        F.count("*").alias("n_obs"),
        F.sum(F.col("total_precipitation_m") * 1000).alias("total_precipitation_sum"),
        F.sum(F.col("runoff_m") * 1000).alias("runoff_sum"),
        F.when(F.count("*") == 1, -9999.0).otherwise(F.sum(F.col("evaporation_m") * -1000))
        .alias("total_evaporation_sum"),
        *[F.avg(c).alias(c) for c in (
            "temperature_2m", "dewpoint_temperature_2m", *WIND, *RADIATION, "sm_surface", "sm_rootzone")])
    medians = obs.groupBy("mws_id", "step").agg(
        (F.median("NDVI_raw") * 0.0001).alias("NDVI"), F.median("SummaryQA").alias("SummaryQA"))
    agg = sums.join(medians, ["mws_id", "step"])
    loc = locations(spark, sf_dir)
    # a tenth of the locations, one district and one state have no surface-soil series at all
    no_soil = (F.col("loc_no") % 10 == 0) | (F.col("district") == "3") | (F.col("state") == "4")
    if whole:
        cells = loc.withColumn("step", F.explode(calendar(spark, sf_dir))).join(agg, ["mws_id", "step"], "left")
    else:
        cells = loc.join(agg, "mws_id").select("mws_id", "step", *loc.columns[1:], *agg.columns[2:])
    # in time order, as the windows that follow need it: one sort serves all
    every = W().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dated = cells.withColumn("sm_surface", F.when(~no_soil, F.col("sm_surface"))) \
        .withColumn("date", F.expr(f"date_add(date'{EPOCH}', step * 14)"))
    return dated.select(*[c for c in dated.columns if c not in ("loc_no", "date")], F.avg("NDVI").over(every).alias("baseline_ndvi_mean"),
                        F.stddev_samp("NDVI").over(every).alias("baseline_ndvi_std"), "date")


def tiles(spark, sf_dir) -> DataFrame:
    """Registry of quarterly composites; about a fifth are absent and many are cloudy."""
    return (
        locations(spark, sf_dir).select("mws_id", "loc_no")
        .withColumn("tile_year", F.explode(F.array(*[F.lit(y) for y in tile_years(spark, sf_dir)]).cast("array<int>")))
        .withColumn("q", F.explode(F.sequence(F.lit(1), F.lit(4))))
        .where((F.col("loc_no") + F.col("tile_year") + F.col("q")) % 5 != 0)
        .select(
            "mws_id", "tile_year", F.concat(F.lit("Q"), F.col("q")).alias("period"),
            (((F.col("loc_no") * 7 + F.col("tile_year") * 13 + F.col("q") * 29) % 100) / 100.0).alias("coverage"))
    )


def pixels(spark, sf_dir) -> DataFrame:
    """Long pixel table: scene observations of a 4 x 4 patch per (location, year, quarter).

    Two sensors with their own band names; ``fmask`` is a bit field as on the real product.
    """
    return table(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_suppkey as string) mws_id", "year(l_shipdate) tile_year",
        "concat('Q', cast(quarter(l_shipdate) as string)) period",
        "cast(l_partkey % 4 as int) row", "cast(l_linenumber % 4 as int) col",
        "cast(l_orderkey % 2 as int) sensor", "cast((l_orderkey + l_linenumber) % 16 as int) fmask",
        "l_discount * 2.0D b1", "l_discount * 3.0D b2", "l_tax * 2.0D b3",
        "case when l_quantity < 5 then 0.0D else l_quantity * 0.01D end b4",
        "l_tax * 4.0D b5", "l_tax * 3.0D + l_discount b6")


def embeddings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def daily_weather(spark, sf_dir) -> DataFrame:
    """100 forecast days per location; every seventh location is short and every ninth has a gap."""
    return (
        locations(spark, sf_dir).select("mws_id", "loc_no")
        .withColumn("n_days", F.when(F.col("loc_no") % 7 == 0, 90).otherwise(100))
        .withColumn("day_no", F.explode(F.expr("sequence(0, n_days - 1)")))
        .select(
            "mws_id", F.expr("date_add(date'2001-08-01', day_no)").alias("day"),
            F.when((F.col("loc_no") % 9 == 0) & (F.col("day_no") == 50), None)
            .otherwise(((F.col("day_no") * 7 + F.col("loc_no")) % 20).cast("double")).alias("rain_sum"),
            F.when(F.col("loc_no") % 11 == 0, 99.0)
            .otherwise((F.col("day_no") % 15 + 15).cast("double")).alias("temperature_2m_mean"))
    )


def plots(spark, sf_dir) -> DataFrame:
    """Advisory requests: one plot per customer, in a 2.8 x 2.9 degree study area (a few far off it)."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey plot_id",
        "19.0D + ((c_custkey * 7919) % 2800) * 0.001D + case when c_custkey % 50 = 7 then 5.0D else 0.0D end lat",
        "76.0D + ((c_custkey * 104729) % 2900) * 0.001D lon",
        "case c_custkey % 3 when 0 then 'rain-fed' when 1 then 'irrigated' end regime",
    ).withColumn("tile", tile_of("lat", "lon"))


def tile_of(lat, lon):
    """Cropland tile a position falls in: half-degree blocks named like ``d38_t152``."""
    return F.concat(F.lit("d"), F.floor(F.col(lat) * 2).cast("string"),
                    F.lit("_t"), F.floor(F.col(lon) * 2).cast("string"))


def crop_cells(spark, sf_dir) -> DataFrame:
    """Cropland squares: centre on a 0.001 degree raster, ring of five corners, crop fraction.

    A third of the tiles has no cells at all, so that plots there need a stand-in.
    """
    h = 0.0004
    return (
        table(spark, sf_dir, "orders").selectExpr(
            "o_orderkey cell_id",
            "19.0D + ((o_orderkey * 7927) % 2800) * 0.001D clat", "76.0D + ((o_orderkey * 6841) % 2900) * 0.001D clon",
            "(o_orderkey % 100) / 100.0D fraction")
        .where((F.floor(F.col("clat") * 2) + F.floor(F.col("clon") * 2)) % 3 != 0)
        .withColumn("tile", tile_of("clat", "clon"))
        .withColumn("ring", F.expr(
            f"array(named_struct('lon', clon-{h}D, 'lat', clat-{h}D), named_struct('lon', clon+{h}D, 'lat', clat-{h}D),"
            f"named_struct('lon', clon+{h}D, 'lat', clat+{h}D), named_struct('lon', clon-{h}D, 'lat', clat+{h}D),"
            f"named_struct('lon', clon-{h}D, 'lat', clat-{h}D))"))
    )


def tile_catalogue(cells: DataFrame) -> DataFrame:
    """Tiles with the centre of the box around their cells."""
    return cells.groupBy("tile").agg(
        ((F.min("clat") + F.max("clat")) / 2).alias("tile_lat"), ((F.min("clon") + F.max("clon")) / 2).alias("tile_lon"))


def land_cover(spark, sf_dir) -> DataFrame:
    """Classified land-cover points (class codes of a global 10 m product)."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey veg_id", "19.0D + ((p_partkey * 3571) % 2800) * 0.001D vlat",
        "76.0D + ((p_partkey * 5101) % 2900) * 0.001D vlon", "cast((p_partkey % 10 + 1) * 10 as int) cover_class")


def villages(spark, sf_dir) -> DataFrame:
    """Village boundaries, one or two closed rings each (overlaps allowed: lowest number wins)."""
    box = ("array(named_struct('lon', x, 'lat', y), named_struct('lon', x+{w}, 'lat', y), "
           "named_struct('lon', x+{w}+0.02D, 'lat', y+{h}), named_struct('lon', x, 'lat', y+{h}), "
           "named_struct('lon', x, 'lat', y))")
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey village_no", "concat('village ', cast(s_suppkey as string)) village",
        "19.0D + ((s_suppkey * 137) % 2800) * 0.001D y", "76.0D + ((s_suppkey * 211) % 2900) * 0.001D x",
    ).withColumn("rings", F.expr(
        "case when village_no % 4 = 0 then array(" + box.format(w="0.15D", h="0.12D") + ", "
        + box.format(w="0.05D", h="0.04D") + ") else array(" + box.format(w="0.15D", h="0.12D") + ") end")
    ).select("village_no", "village", "rings")


def fetch_log(spark, sf_dir) -> DataFrame:
    """Fetch attempts from the event stream: sweep number, outcome message, seconds, attempts."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "cast(ts as timestamp) ts", "cast(user_id as string) mws_id", "cast(ts as date) target",
        "cast(event_id % 3 as int) + 1 sweep_no", "cast(event_id % 4 as int) + 1 attempts",
        "value query_time_s",
        "case when event_type = 'error' then case "
        "when value < 5 then 'ERROR: HTTP 429 Too Many Requests' "
        "when value < 10 then 'ERROR: fetch returned no data (no satellite coverage)' "
        "when value < 20 then 'ERROR: no actual NDVI at target' "
        "when value < 30 then 'ERROR: HTTPSConnectionPool: Read timed out' "
        "when value < 40 then 'ERROR: HTTP Error 404: Not Found' "
        "when value < 50 then 'ERROR: no quarterly tile >= 0.75 coverage' "
        "when value < 60 then 'ERROR: date 2035-06-15 is in the future; it must be today or earlier' "
        "when value < 70 then 'ERROR: HTTP Error 401: Unauthorized' "
        "when value < 80 then 'ERROR: RESOURCE_EXHAUSTED: quota exceeded' "
        "when value < 90 then 'ERROR: plot forecast unavailable (no usable data at the plot)' "
        "else 'ERROR: boom' end else 'OK' end status")
