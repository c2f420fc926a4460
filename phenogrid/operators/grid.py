"""Raw observations onto the 14-day grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenogrid.functions.columns import ladder
from phenogrid.schema import COMPOSITE_DAYS, CRITICAL_COLUMNS, RADIATION, SENTINEL, SOIL_DAYS, STEP_DAYS, WIND

STATE = ["temperature_2m", "dewpoint_temperature_2m", *WIND, *RADIATION]
FLUX = {"precipitation": ("total_precipitation_m", 1000.0), "runoff": ("runoff_m", 1000.0),
        "et": ("evaporation_m", -1000.0)}
SOIL = ["sm_surface", "sm_rootzone"]
NDVI_SCALE = 0.0001
REQUIRED = ["date", "NDVI", "precipitation", "temperature_2m", "dewpoint_temperature_2m", "et", "runoff",
            *SOIL[::-1], *WIND, *RADIATION, "coverage_fraction"]


def step_grid(points: DataFrame, cutoff: str, steps: int) -> DataFrame:
    """``steps`` dates per point, the last one at the point's ``cutoff`` date."""
    first = F.date_sub(F.col(cutoff), STEP_DAYS * (steps - 1))
    return points.select("*", F.posexplode(F.sequence(first, F.col(cutoff), F.expr(f"interval {STEP_DAYS} days")))
                         .alias("step", "date"))


def reduce_readings(obs: DataFrame) -> DataFrame:
    """States, fluxes and soil moisture of each (location, step) with observations.

    States are means and fluxes unit-converted sums over the step, soil moisture is the mean of
    its first three days; they aggregate in hash tables, combined map-side.
    """
    soil = F.col("day_in_step") < SOIL_DAYS
    return obs.groupBy("mws_id", "step").agg(
        *[F.avg(c).alias(c) for c in STATE],
        *[F.sum(F.col(src) * k).alias(name) for name, (src, k) in FLUX.items()],
        *[F.avg(F.when(soil, F.col(c))).alias(c) for c in SOIL],
        (F.count(F.when(soil, F.col("sm_surface"))) > 0).cast("int").alias("is_real_smap"),
        (F.count("temperature_2m") > 0).cast("int").alias("is_real_era5"),
        (F.count("total_precipitation_m") > 0).cast("int").alias("is_real_chirps"))


def reduce_index(obs: DataFrame) -> DataFrame:
    """The index and its quality flag per (location, step): medians over 16 days.

    The first two days of a step also count for the step before; exact medians need another kind of
    aggregate, which gets only its two columns. Readings are 16-bit integers, which bounds the value
    table a median keeps.
    """
    overlap = COMPOSITE_DAYS - STEP_DAYS
    both = obs.select("mws_id", "NDVI_raw", "SummaryQA", F.explode(F.expr(
        f"case when day_in_step < {overlap} and step > 0 then array(step, step - 1) else array(step) end")).alias("step"))
    # readings are whole numbers: counted per value first, map-side, so a busy step stays small
    counted = both.groupBy("mws_id", "step", "NDVI_raw", "SummaryQA").agg(F.count("*").alias("_n"))
    return counted.groupBy("mws_id", "step").agg(
        (F.percentile("NDVI_raw", 0.5, F.col("_n")) * NDVI_SCALE).alias("NDVI"), F.percentile("SummaryQA", 0.5, F.col("_n")).alias("SummaryQA"),
        (F.count("NDVI_raw") > 0).cast("int").alias("is_real_ndvi"))


def reduce_observations(obs: DataFrame) -> DataFrame:
    """One row per (location, step) with every per-step statistic.

    Both sides end up hashed on (location, step), so joining them moves nothing.
    """
    return reduce_index(obs).join(reduce_readings(obs), ["mws_id", "step"], "full")


def add_coverage(df: DataFrame) -> DataFrame:
    flags = ["is_real_ndvi", "is_real_smap", "is_real_era5", "is_real_chirps"]
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in flags})
    return df.withColumn("coverage_fraction", F.col("is_real_ndvi") * 0.4 + F.col("is_real_chirps") * 0.2
                         + F.col("is_real_smap") * 0.2 + F.col("is_real_era5") * 0.2)


def fill_constants(df: DataFrame) -> DataFrame:
    """Constants in place of missing statistics (compatibility switch; the default keeps NULL)."""
    fills = {c: SENTINEL for c in (*STATE, *FLUX)} | {c: 0.2 for c in SOIL} | {"NDVI": 0.4 * NDVI_SCALE}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})


def fortnight_panel(grid: DataFrame, obs: DataFrame, compat: bool = False) -> DataFrame:
    """The wide panel on the given (mws_id, step, date) grid; an absent quality flag is 3.

    Its cells are the grid's, so each side is joined to them; a side whose columns nobody reads is then left out by the optimizer.
    """
    cells = ["mws_id", "step"]
    wide = add_coverage(grid.join(reduce_index(obs), cells, "left").join(reduce_readings(obs), cells, "left"))
    wide = wide.withColumn("SummaryQA", F.coalesce(F.col("SummaryQA"), F.lit(3.0)))
    return fill_constants(wide) if compat else wide


def require_columns(df: DataFrame, cols=REQUIRED) -> DataFrame:
    """Add the columns a partial fetch left out, as NULL."""
    have = {c.lower() for c in df.columns}
    return df.withColumns({c: F.lit(None).cast("date" if c == "date" else "double")
                           for c in cols if c.lower() not in have})


def reassemble(grid: DataFrame, batches: list[DataFrame]) -> DataFrame:
    """Batches of steps back into one panel; steps no batch delivered stay as rows without date."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)
    return require_columns(grid.select("mws_id", "step").join(union, ["mws_id", "step"], "left"))


def input_status(points: DataFrame, history: DataFrame) -> DataFrame:
    """Per location: is the delivered history usable at all?"""
    counts = history.groupBy("mws_id").agg(
        F.count("*").alias("n_rows"), F.count("date").alias("n_dates"),
        F.count("coverage_fraction").alias("n_coverage"),
        sum((F.count(c) for c in CRITICAL_COLUMNS[1:]), F.count(CRITICAL_COLUMNS[0])).alias("n_critical"))
    c = F.col
    out = points.select("mws_id").join(counts, "mws_id", "left").fillna(0)
    return out.withColumn("input_status", ladder(
        [(c("n_rows") == 0, "EMPTY"), (c("n_dates") == 0, "NO_DATE"), (c("n_coverage") == 0, "NO_COVERAGE"),
         (c("n_critical") == 0, "ALL_MISSING")], "OK"))


def actual_ndvi(requests: DataFrame, obs: DataFrame, date: str, epoch: str) -> DataFrame:
    """Observed index at a date: median over [date, date + 16 days), NULL at or below -0.999.

    Requests go to the two or three steps their window touches and meet the observations on
    (location, step); observations are first counted per value, so a busy step stays small.
    """
    counted = obs.groupBy("mws_id", "step", "obs_date", "NDVI_raw").agg(F.count("*").alias("_n"))
    first = F.floor(F.datediff(F.col(date), F.lit(epoch).cast("date")) / F.lit(float(STEP_DAYS)))
    last = F.floor((F.datediff(F.col(date), F.lit(epoch).cast("date")) + COMPOSITE_DAYS - 1) / F.lit(float(STEP_DAYS)))
    asked = requests.select("mws_id", date).distinct()
    spread = asked.withColumn("step", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    hits = spread.join(counted, ["mws_id", "step"]).where(
        (F.col("obs_date") >= F.col(date)) & (F.col("obs_date") < F.date_add(F.col(date), COMPOSITE_DAYS)))
    value = F.percentile("NDVI_raw", 0.5, F.col("_n")) * NDVI_SCALE
    found = hits.groupBy("mws_id", date).agg(value.alias("actual_ndvi")).withColumn(
        "actual_ndvi", F.when(F.col("actual_ndvi") > -0.999, F.col("actual_ndvi")))
    return requests.join(found, ["mws_id", date], "left")
