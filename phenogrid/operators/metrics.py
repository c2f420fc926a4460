"""Scores of forecasts against observed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenogrid.functions.columns import r2
from phenogrid.functions.quantiles import exact_median, exact_quantiles
from phenogrid.session import cut_lineage


def global_metrics(df: DataFrame) -> DataFrame:
    """n, R2, RMSE, MAE, bias, correlation and the R2 of the bias-corrected forecast, in one pass.

    Removing the bias b takes n*b^2 off the squared error, so no second pass is needed.
    """
    a, f = F.col("actual"), F.col("forecast")
    n, bias, sse = F.count("*"), F.avg(f - a), F.sum((f - a) * (f - a))
    sst = F.var_pop(a) * F.count("*")
    return df.agg(
        n.alias("n_samples"), r2("actual", "forecast").alias("global_r2"),
        F.sqrt(F.avg((f - a) * (f - a))).alias("rmse"), F.avg(F.abs(f - a)).alias("mae"), bias.alias("bias"),
        F.corr("actual", "forecast").alias("corr"),
        F.when(n >= 2, F.when(sst > 0, 1 - (sse - n * bias * bias) / sst).when(
            F.abs(sse - n * bias * bias) <= 1e-12 * F.greatest(sse, F.lit(1e-300)), 1.0).otherwise(0.0)).alias("debiased_r2"))


def reference_metrics(df: DataFrame) -> DataFrame:
    """Skill against the seasonal normal, on the change from now, and of plain persistence."""
    d = df.withColumns({
        "_at": F.col("actual") - F.col("clim"), "_ap": F.col("forecast") - F.col("clim"),
        "_dt": F.col("actual") - F.col("current"), "_dp": F.col("forecast") - F.col("current")})
    return d.agg(r2("_at", "_ap").alias("global_anomaly_r2"), r2("_dt", "_dp").alias("delta_r2"),
                 r2("actual", "current").alias("persistence_global_r2"))


def location_r2(df: DataFrame) -> DataFrame:
    d = df.withColumns({
        "_at": F.col("actual") - F.col("clim"), "_ap": F.col("forecast") - F.col("clim"),
        "_dt": F.col("actual") - F.col("current"), "_dp": F.col("forecast") - F.col("current")})
    return d.groupBy("mws_id").agg(
        F.count("*").alias("n"), F.stddev_pop("actual").alias("spread"), r2("actual", "forecast").alias("r2"),
        r2("_at", "_ap").alias("anomaly_r2"), r2("actual", "current").alias("persistence_r2"), r2("_dt", "_dp").alias("delta_r2"))


def median_location_metrics(df: DataFrame) -> DataFrame:
    """Median over locations of their R2 (locations with at least two rows)."""
    per = cut_lineage(location_r2(df).where("n >= 2"))  # one row per location, read by every median
    out = per.agg(F.count("*").alias("n_basins"))
    for c, name in (("r2", "median_basin_r2"), ("anomaly_r2", "median_basin_anomaly_r2"),
                    ("persistence_r2", "median_basin_persistence_r2"), ("delta_r2", "median_basin_delta_r2")):
        out = out.crossJoin(F.broadcast(exact_median(per, [], c, name)))
    return out


def test_metrics(df: DataFrame) -> DataFrame:
    """Scores of the test split: forecast, persistence, change, and share of right directions."""
    test = df.where("split = 'test'")
    up = lambda x: (F.col(x) - F.col("current")) > 0
    err = lambda x: F.col("actual") - F.col(x)
    d = test.withColumns({"_dt": F.col("actual") - F.col("current"), "_dp": F.col("forecast") - F.col("current")})
    whole = d.agg(
        r2("actual", "forecast").alias("test_r2"), F.sqrt(F.avg(err("forecast") * err("forecast"))).alias("test_rmse"),
        (F.avg((up("forecast") == up("actual")).cast("double")) * 100).alias("direction_accuracy"),
        r2("actual", "current").alias("persistence_r2"), F.sqrt(F.avg(err("current") * err("current"))).alias("persistence_rmse"),
        r2("_dt", "_dp").alias("delta_r2"))
    return whole.crossJoin(F.broadcast(median_location_metrics(test)))


def fit_month_climatology(train: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mean target per (location, month), per location and overall, from one scan of the train rows."""
    month = train.groupBy("mws_id", F.month("target_date").alias("_m")).agg(F.sum("actual").alias("_s"), F.count("actual").alias("_n"))
    loc = month.groupBy("mws_id").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    mean = lambda name: F.try_divide("_s", "_n").alias(name)
    overall = loc.agg(F.try_divide(F.sum("_s"), F.sum("_n")).alias("_overall"))
    return month.select("mws_id", "_m", mean("_month_mean")), loc.select("mws_id", mean("_loc_mean")), overall


def deseasonalised_metrics(df: DataFrame) -> DataFrame:
    month, loc, overall = fit_month_climatology(df.where("split = 'train'"))
    test = df.where("split = 'test'").withColumn("_m", F.month("target_date"))
    t = test.join(month, ["mws_id", "_m"], "left").join(loc, "mws_id", "left").crossJoin(F.broadcast(overall))
    normal = F.coalesce("_month_mean", "_loc_mean", "_overall")
    t = t.withColumns({"_at": F.col("actual") - normal, "_ap": F.col("forecast") - normal})
    per = cut_lineage(t.groupBy("mws_id").agg(F.count("*").alias("n"), r2("_at", "_ap").alias("r2")).where("n >= 2"))
    return t.agg(r2("_at", "_ap").alias("anomaly_r2")).crossJoin(
        F.broadcast(exact_median(per, [], "r2", "median_basin_anomaly_r2")))


def best_and_worst(df: DataFrame, n: int, min_rows: int = 11) -> DataFrame:
    """The n best and n worst locations by R2; nothing if fewer than 2n qualify."""
    per = location_r2(df).where((F.col("n") >= min_rows) & (F.col("spread") > 0)).select("mws_id", "n", "r2")
    enough = per.agg((F.count("*") >= 2 * n).alias("_enough"))
    parts = []
    for label, order in (("best", [F.col("r2").desc(), "mws_id"]), ("worst", [F.col("r2").asc(), "mws_id"])):
        top = per.orderBy(*order).limit(n)  # n rows: the report itself
        parts.append(top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(label)).orderBy(*order)))
                     .withColumn("label", F.lit(label)))
    return parts[0].unionByName(parts[1]).crossJoin(F.broadcast(enough)).where("_enough").drop("_enough")


def chosen_series(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """Actual and predicted series of the chosen locations, in date order, with the split starts."""
    some = df.join(chosen.select("mws_id").distinct(), "mws_id", "left_semi")
    point = F.struct("target_date", "actual", "forecast")
    start = lambda s: F.min(F.when(F.col("split") == s, F.col("target_date"))).alias(f"{s}_start")
    return some.groupBy("mws_id").agg(F.array_sort(F.collect_list(point)).alias("series"), start("train"), start("val"), start("test"))


def latency_report(log: DataFrame) -> DataFrame:
    """Latency of successful fetches, retries and throughput over the log's time span."""
    ok = log.where("status = 'OK'")
    qs = exact_quantiles(ok, [], "query_time_s", {"median_s": 0.5, "p90_s": 0.9})
    minutes = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / F.lit(60e6)
    total = log.agg(
        F.count("*").alias("n_total"), F.count_if(F.col("status") == "OK").alias("n_ok"),
        F.avg(F.when(F.col("status") == "OK", F.col("query_time_s"))).alias("mean_s"), F.avg("query_time_s").alias("mean_all_s"),
        F.count_if(F.col("attempts") > 1).alias("n_retried"), F.try_divide(F.count("*"), minutes).alias("per_minute"))
    return total.crossJoin(F.broadcast(qs))


def parity(left: DataFrame, right: DataFrame, keys: list[str], numbers: list[str], labels: list[str], tol: float = 1e-6) -> DataFrame:
    """Two computations of the same rows: largest difference per number, label and row mismatches."""
    a = left.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in numbers + labels], F.lit(1).alias("_in_a"))
    b = right.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in numbers + labels], F.lit(1).alias("_in_b"))
    diff = {c: F.max(F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}"))) for c in numbers}
    one_null = lambda c: F.col(f"_a_{c}").isNull() != F.col(f"_b_{c}").isNull()
    out = a.join(b, keys, "full").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("_in_a").isNull() | F.col("_in_b").isNull()).alias("n_unpaired"),
        *[F.coalesce(d, F.lit(0.0)).alias(f"max_diff_{c}") for c, d in diff.items()],
        *[F.count_if(one_null(c)).alias(f"null_mismatch_{c}") for c in numbers],
        *[F.count_if(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))).alias(f"mismatch_{c}") for c in labels])
    bad = (F.col("n_unpaired") > 0)
    for c in numbers:
        bad = bad | (F.col(f"max_diff_{c}") > tol) | (F.col(f"null_mismatch_{c}") > 0)
    for c in labels:
        bad = bad | (F.col(f"mismatch_{c}") > 0)
    return out.withColumn("parity_ok", ~bad)
