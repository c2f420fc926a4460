"""Seasonal baselines and standardised anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenogrid.functions.arrays import array_mean, array_median, array_std_pop
from phenogrid.functions.asof import asof_join
from phenogrid.functions.columns import W, ladder
from phenogrid.schema import MAD_TO_STD, MIN_BASELINE, QUARTER_MEANS, QUARTER_STDS, SPREAD_FLOOR, TREND_DELTA


def seasonal_baseline(requests: DataFrame, history: DataFrame, target: str = "target", month_window: int = 0,
                      years: int | None = None, cutoff: str | None = None, robust: bool = True,
                      min_samples: int = MIN_BASELINE) -> DataFrame:
    """Centre and spread of the location's own values around the target's time of year.

    Only values before the cutoff count (default: 1 January of the target year). Requests are
    reduced to their distinct (location, month, cutoff). History is one short array per
    (location, month), so a request meets 2 * month_window + 1 rows, and the robust statistics
    run inside the array without a second pass.
    """
    cut = F.col(cutoff) if cutoff else F.trunc(F.col(target), "year")
    asked = requests.select("mws_id", F.month(target).alias("_m"), cut.alias("_cut")).distinct()
    months = F.array_distinct(F.transform(
        F.sequence(F.lit(-month_window), F.lit(month_window)), lambda k: F.pmod(F.col("_m") - 1 + k, F.lit(12)) + 1))
    by_month = history.where(F.col("NDVI").isNotNull()).groupBy("mws_id", F.month("date").alias("_hm")).agg(
        F.collect_list(F.struct("date", "NDVI")).alias("_vals"))
    met = asked.withColumn("_hm", F.explode(months)).join(by_month, ["mws_id", "_hm"])
    if month_window:
        met = met.groupBy("mws_id", "_m", "_cut").agg(F.flatten(F.collect_list("_vals")).alias("_vals"))
    met = met.withColumn("_vals", F.filter("_vals", lambda v: v["date"] < F.col("_cut")))
    if years:
        present = F.array_sort(F.array_distinct(F.transform("_vals", lambda v: F.year(v["date"]))))
        met = met.withColumn("_first", F.get(present, F.greatest(F.size(present) - years, F.lit(0))))
        met = met.withColumn("_vals", F.filter("_vals", lambda v: F.year(v["date"]) >= F.col("_first")))
    met = met.withColumn("_x", F.transform("_vals", lambda v: v["NDVI"])).withColumn("baseline_n", F.size("_x"))
    enough = F.col("baseline_n") >= min_samples
    centre = array_median(F.col("_x")) if robust else array_mean(F.col("_x"))
    met = met.withColumn("baseline_mean", F.when(enough, centre))
    spread = MAD_TO_STD * array_median(F.transform("_x", lambda x: F.abs(x - F.col("baseline_mean")))) if robust else array_std_pop(F.col("_x"))
    found = met.select("mws_id", "_m", "_cut", "baseline_mean", F.when(enough, spread).alias("baseline_std"), "baseline_n")
    out = requests.withColumn("_m", F.month(target)).withColumn("_cut", cut)
    return out.join(found, ["mws_id", "_m", "_cut"], "left").drop("_m", "_cut").fillna({"baseline_n": 0})


def profile_fallback(df: DataFrame, profiles: DataFrame, target: str = "target") -> DataFrame:
    """Quarter mean and spread of the profile where the own history is too short."""
    q = F.quarter(target)
    pick = lambda cols: F.element_at(F.array(*[F.col(c) for c in cols]), q)
    out = df.join(profiles.select("mws_id", *QUARTER_MEANS, *QUARTER_STDS), "mws_id", "left")
    out = out.withColumns({"_qm": pick(QUARTER_MEANS), "_qs": pick(QUARTER_STDS)})
    own = F.col("baseline_mean").isNotNull() & F.col("baseline_std").isNotNull()
    quarter = F.col("_qm").isNotNull() & F.col("_qs").isNotNull()
    return out.withColumns({
        "baseline_source": F.when(own, "point-history").when(quarter, "quarter-climatology").otherwise("unavailable"),
        "baseline_mean": F.when(own, F.col("baseline_mean")).when(quarter, F.col("_qm")),
        "baseline_std": F.when(own, F.col("baseline_std")).when(quarter, F.col("_qs")),
    }).drop("_qm", "_qs", *QUARTER_MEANS, *QUARTER_STDS)


def condition(z):
    return F.when(z.isNull() | F.isnan(z), "Unknown").when(z < -1.0, "Below normal").when(z < 1.0, "Near normal").otherwise("Above normal")


def indicators(df: DataFrame, forecast: str = "forecast", bias: float = 0.0, floor: float = SPREAD_FLOOR) -> DataFrame:
    """Anomaly, z-score, percentage and label of a forecast against its baseline.

    Labels use the unrounded z; the reported spread is the one the z was divided by.
    """
    mean = F.col("baseline_mean")
    anomaly = F.col(forecast) - bias - mean
    spread = F.when(mean.isNotNull(), F.greatest(F.coalesce("baseline_std", F.lit(floor)), F.lit(floor)))
    z = anomaly / spread
    return df.withColumns({
        "ndvi_anomaly": F.bround(anomaly, 3), "z_exact": z,
        "ndvi_anomaly_pct": F.when(F.abs(mean) > 1e-6, F.bround(F.try_divide(anomaly, mean) * 100, 1)),
        "z": F.bround(z, 2), "condition": condition(z), "seasonal_std_ndvi": F.bround(spread, 3),
        "seasonal_mean_ndvi": F.bround(mean, 3), "forecast_ndvi": F.bround(forecast, 3)})


def row_anomalies(history: DataFrame) -> DataFrame:
    """Every observed row minus the baseline at its own date (NULL without a baseline)."""
    seen = history.where(F.col("NDVI").isNotNull()).select("mws_id", "date", "NDVI")
    return seasonal_baseline(seen, seen, target="date").withColumn("anomaly", F.col("NDVI") - F.col("baseline_mean"))


def recent_anomalies(requests: DataFrame, history: DataFrame, cutoff: str, n: int = 6) -> DataFrame:
    """Anomalies of the last n observed rows up to the cutoff, oldest first."""
    runs = row_anomalies(history).select(
        "mws_id", "date", F.collect_list("anomaly").over(W().rowsBetween(-(n - 1), 0)).alias("recent"))
    return asof_join(requests, runs, ["mws_id"], cutoff, "date", ["recent"])


def trend(recent):
    """Direction of the recent anomalies; fewer than four say nothing."""
    n = F.size(recent)
    delta = (F.element_at(recent, -1) + F.element_at(recent, -2)) / 2 - (F.element_at(recent, 1) + F.element_at(recent, 2)) / 2
    short = recent.isNull() | (n < 4)
    return F.when(short, "unknown").otherwise(ladder(
        [(delta > TREND_DELTA, "recovering"), (delta < -TREND_DELTA, "declining")], "holding"))


def result_record(df: DataFrame, verbose: bool = False) -> DataFrame:
    """The canonical result as one struct column."""
    anomaly = {"z": "z", "baseline_mean": "seasonal_mean_ndvi", "baseline_std": "seasonal_std_ndvi"}
    if verbose:
        anomaly |= {"baseline_source": "baseline_source", "baseline_n": "baseline_n", "ndvi": "ndvi_anomaly", "pct": "ndvi_anomaly_pct"}
    date = lambda c: F.date_format(c, "yyyy-MM-dd")
    fields = [
        F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).alias("location"),
        F.struct("state", "district", "tehsil").alias("admin"), date("target").alias("target_date"), F.col("forecast_ndvi"),
        F.col("condition").alias("relative_vegetation_condition"),
        F.struct(*[F.col(v).alias(k) for k, v in anomaly.items()]).alias("anomaly")]
    if verbose:
        stale = F.col("stale_fortnights")
        note = F.when((stale >= 1) & F.col("last_obs").isNotNull(), F.concat(
            F.lit("Anchored on NDVI from "), date("last_obs"), F.lit(", ~"), stale.cast("string"), F.lit(" fortnight(s) before the "),
            date("anchor"), F.lit(" anchor -- more recent imagery was unavailable (cloud/latency), so the last observation was carried forward.")))
        fields += [date("as_of").alias("as_of"), date("anchor").alias("anchor_date"), stale.alias("anchor_stale_fortnights"),
                   date("last_obs").alias("last_observation"), note.alias("note")]
    return df.withColumn("result", F.struct(*fields))
