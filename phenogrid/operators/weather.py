"""Weather over the lead window: forecast buckets, climatology and sanity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenogrid.functions.asof import asof_join
from phenogrid.functions.columns import W, flags
from phenogrid.schema import FORECAST_HORIZON, STEP_DAYS

MIN_DAYS = FORECAST_HORIZON * STEP_DAYS


def _steps(value: str, bucket: str):
    return F.transform(F.array_sort(F.collect_list(F.struct(bucket, value))), lambda s: s[value])


def forecast_steps(daily: DataFrame) -> DataFrame:
    """Daily forecast to seven 14-day rain sums and temperature means (kelvin) per location.

    A series shorter than the lead window or with a gap gives NULL and a reason.
    """
    w = Window.partitionBy("mws_id")
    d = daily.withColumn("_b", F.floor((F.row_number().over(w.orderBy("day")) - 1) / STEP_DAYS))
    d = d.withColumns({
        "_days": F.count("*").over(w), "_rain_n": F.count("rain_sum").over(w),
        "_temp_n": F.count("temperature_2m_mean").over(w), "_rain": F.sum("rain_sum").over(w),
        "_temp": F.avg(F.col("temperature_2m_mean") + 273.15).over(w)})
    per = d.where(F.col("_b") < FORECAST_HORIZON).groupBy("mws_id", "_b", "_days", "_rain_n", "_temp_n", "_rain", "_temp").agg(
        F.sum("rain_sum").alias("_p"), F.avg(F.col("temperature_2m_mean") + 273.15).alias("_t"))
    out = per.groupBy("mws_id", "_days", "_rain_n", "_temp_n", "_rain", "_temp").agg(
        _steps("_p", "_b").alias("_ps"), _steps("_t", "_b").alias("_ts"))
    long = F.col("_days") >= MIN_DAYS
    rain_ok = long & (F.col("_rain_n") == F.col("_days"))
    temp_full = long & (F.col("_temp_n") == F.col("_days"))
    temp_ok = temp_full & (F.col("_temp") > 250.0) & (F.col("_temp") < 330.0)
    return out.select(
        "mws_id", F.when(rain_ok, F.col("_rain")).alias("api_precip_sum"), F.when(temp_ok, F.col("_temp")).alias("api_temp_mean"),
        F.when(rain_ok, F.col("_ps")).alias("api_precip_steps"), F.when(temp_ok, F.col("_ts")).alias("api_temp_steps"),
        flags((~rain_ok, F.lit("PRECIP_INCOMPLETE")), (temp_full & ~temp_ok, F.lit("TEMP_IMPLAUSIBLE")),
              (~temp_full, F.lit("TEMP_INCOMPLETE"))).alias("reasons"))


def climatology_historical(requests: DataFrame, history: DataFrame, target: str = "target") -> DataFrame:
    """The seven rows up to the target; none when the history ends more than 30 days earlier."""
    last7 = W().rowsBetween(-(FORECAST_HORIZON - 1), 0)
    wins = history.select(
        "mws_id", "date", F.collect_list(F.struct("date", "precipitation", "temperature_2m")).over(last7).alias("_win"),
        F.max("date").over(Window.partitionBy("mws_id")).alias("_end"))
    out = asof_join(requests, wins, ["mws_id"], target, "date", ["_win", "_end"])
    ok = (F.size("_win") == FORECAST_HORIZON) & (F.datediff(F.col(target), F.col("_end")) <= 30)
    return _take(out, ok)


def climatology_future(requests: DataFrame, history: DataFrame, target: str = "target", cutoff: str | None = None) -> DataFrame:
    """Same season of an earlier year: the row nearest in day-of-year and the six before it.

    With ``cutoff``, a date column of the requests, rows after it aren't known yet.

    A year of history is one row with its (at most 27) fortnights in order, so a request meets
    one row per year and picks inside the array.
    """
    years = history.groupBy("mws_id", F.year("date").alias("_y")).agg(
        F.array_sort(F.collect_list(F.struct("date", "precipitation", "temperature_2m"))).alias("_rows"))
    asks = ["mws_id", target, *([cutoff] if cutoff else [])]
    asked = requests.select(*asks).distinct()
    doy = F.dayofyear(F.col(target))
    met = asked.join(years, "mws_id").where(F.col("_y") < F.year(F.col(target)))
    if cutoff:
        met = met.withColumn("_rows", F.filter("_rows", lambda x: x["date"] <= F.col(cutoff))).where(F.size("_rows") > 0)
    apart = F.transform("_rows", lambda x: F.least(F.abs(F.dayofyear(x["date"]) - doy), 365 - F.abs(F.dayofyear(x["date"]) - doy)))
    met = met.withColumn("_apart", apart).withColumn("_gap", F.array_min("_apart"))
    met = met.withColumn("_pos", F.array_position("_apart", F.col("_gap"))).where(F.col("_pos") >= FORECAST_HORIZON)
    best = met.groupBy(*asks).agg(F.min_by(
        F.struct("_rows", "_pos"), F.struct("_gap", "_y")).alias("_b"))
    best = best.select(*asks, F.slice("_b._rows", F.col("_b._pos").cast("int") - FORECAST_HORIZON + 1, FORECAST_HORIZON).alias("_win"))
    return _take(requests.join(best, asks, "left"), F.col("_win").isNotNull())


def _take(df, ok):
    part = lambda c: F.when(ok, F.transform("_win", lambda x: x[c]))
    return df.withColumns({"clim_precip_steps": part("precipitation"), "clim_temp_steps": part("temperature_2m")}) \
        .drop("_win", "_end")


def _valid(steps):
    return F.filter(F.coalesce(steps, F.array().cast("array<double>")), lambda x: x.isNotNull())


def safe_sum(steps, default: float = 0.0):
    v = _valid(steps)
    return F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x)).otherwise(F.lit(default))


def safe_mean(steps, default: float = 298.0):
    v = _valid(steps)
    return F.when(F.size(v) > 0, F.try_divide(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), F.size(v))).otherwise(F.lit(default))


def choose_source(df: DataFrame) -> DataFrame:
    """Forecast where it is usable, climatology per variable elsewhere, with a source label."""
    p_api, t_api = F.col("api_precip_sum").isNotNull(), F.col("api_temp_mean").isNotNull()
    src = lambda ok: F.when(ok, "API").otherwise("CLIMATOLOGY")
    label = F.concat(F.lit("P:"), src(p_api), F.lit("|T:"), src(t_api),
                     F.when(F.size("reasons") > 0, F.concat(F.lit("|REASONS:"), F.concat_ws(",", "reasons"))).otherwise(""))
    return df.withColumns({
        "precip_steps": F.when(p_api, F.col("api_precip_steps")).otherwise(F.col("clim_precip_steps")),
        "temp_steps": F.when(t_api, F.col("api_temp_steps")).otherwise(F.col("clim_temp_steps")),
        "precip_sum": F.when(p_api, F.col("api_precip_sum")).otherwise(safe_sum(F.col("clim_precip_steps"))),
        "temp_mean": F.when(t_api, F.col("api_temp_mean")).otherwise(safe_mean(F.col("clim_temp_steps"))),
        "forecast_source": label})


def sanity(df: DataFrame) -> DataFrame:
    """Implausible temperature becomes 298 K; cool values and replacements are flagged."""
    t = F.col("temp_mean")
    bad = t.isNotNull() & ~t.between(240.0, 330.0)
    fixed = F.when(t.isNull() | bad, 298.0).otherwise(t)
    return df.withColumns({
        "forecast_issues": flags(
            (t.isNull(), F.lit("FORECAST_TEMP_NAN_FALLBACK")),
            (bad, F.concat(F.lit("FORECAST_TEMP_IMPLAUSIBLE:"), F.bround(t, 2).cast("string"), F.lit("K"))),
            (fixed < 294.0, F.lit("FORECAST_TEMP_FALLBACK_APPLIED"))),
        "temp_mean": fixed, "precip_sum": F.coalesce(F.col("precip_sum"), F.lit(0.0))})
