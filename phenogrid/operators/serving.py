"""Forecasts at request time: what was fitted is a stored, versioned bundle, and requests are answered from it.

A bundle is a folder of small tables, the model and, written last, a manifest. A version without a manifest
was not finished and isn't seen by a reader, so training may be killed and repeated at any time.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phenogrid.functions.dates import calendar_features, cyclic_features
from phenogrid.operators import anomaly, features, forecast, impute, quality, scaling, spatial
from phenogrid.schema import (
    CATEGORICAL, DYNAMIC, FORECAST_HORIZON, PROFILE, SCALED, STEP_DAYS, WEATHER, WIND, WINDOW,
)
from phenogrid.session import cut_lineage

TABLES = ("scaler", "codes", "caps", "profiles")
MODELS = {"linear": LinearRegressionModel, "gbt": GBTRegressionModel}
MANIFEST = "version string, settings string"
#: Ten years of steps and the lead: what a request reads of its location's history.
HISTORY_STEPS = 10 * 26 + FORECAST_HORIZON
#: Profile columns that a request takes over from its nearest profile.
TAKEN = [c for c in PROFILE if c not in ("mws_id", "latitude", "longitude")]


@dataclass(frozen=True)
class Bundle:
    version: str
    settings: dict
    scaler: DataFrame
    codes: DataFrame
    caps: DataFrame
    profiles: DataFrame
    model: object


def versions(spark: SparkSession, path: str) -> list[str]:
    """Finished versions below ``path`` in ascending order; none where the folder is absent."""
    try:
        return sorted(r["version"] for r in spark.read.schema(MANIFEST).parquet(f"{path}/*/manifest").collect())
    except AnalysisException as gone:
        if gone.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def save_bundle(path: str, version: str, model, tables: dict[str, DataFrame], kind: str = "linear",
                dynamic=tuple(DYNAMIC), static=(), window: int = WINDOW) -> str:
    """Write one version. What an unfinished attempt left is replaced; a finished version is never changed."""
    spark = tables["scaler"].sparkSession
    if version in versions(spark, path):
        raise ValueError(f"version {version} exists")
    if kind not in MODELS or set(tables) != set(TABLES):
        raise ValueError(f"a bundle needs a model of {', '.join(MODELS)} and the tables {', '.join(TABLES)}")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{version}/{name}")
    model.write().overwrite().save(f"{path}/{version}/model")
    settings = json.dumps({"kind": kind, "dynamic": list(dynamic), "static": list(static), "window": window})
    spark.createDataFrame([(version, settings)], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/{version}/manifest")
    return version


def load_bundle(spark: SparkSession, path: str, version: str | None = None) -> Bundle:
    """The named version, or the greatest finished one."""
    known = versions(spark, path)
    version = version or (known[-1] if known else None)
    if version not in known:
        raise ValueError(f"no finished version {version} below {path}")
    root = f"{path}/{version}"
    settings = json.loads(spark.read.schema(MANIFEST).parquet(f"{root}/manifest").first()["settings"])
    return Bundle(version, settings, *[spark.read.parquet(f"{root}/{name}") for name in TABLES],
                  MODELS[settings["kind"]].load(f"{root}/model"))


def placed_profiles(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row per requested location with the values of the profile nearest to it."""
    points = requests.groupBy("mws_id").agg(F.min(F.struct("latitude", "longitude")).alias("_at")).select(
        "mws_id", F.col("_at.latitude").alias("lat"), F.col("_at.longitude").alias("lon"))
    near = spatial.nearest_profile(points.select("lat", "lon").distinct(), profiles, ["mws_id", *TAKEN])
    return points.join(near.withColumnRenamed("mws_id", "profile_id"), ["lat", "lon"]) \
        .withColumnsRenamed({"lat": "latitude", "lon": "longitude"})


def serving_features(requests: DataFrame, history: DataFrame, bundle: Bundle, placed: DataFrame, clip: bool = False,
                     steps: int = HISTORY_STEPS) -> DataFrame:
    """The scaled last rows of every distinct (location, anchor), made from its own history alone.

    A request sees the ``steps`` grid steps up to its anchor. Weather gaps take the median of those rows, the index
    its neighbour, and no later row has any influence. Anchors lie on the grid, so a location is asked for at most
    once per step however many requests it gets, and a group holds at most ``steps`` rows. ``clip`` applies the
    bundle's radiation caps, which the published serving path leaves out.
    """
    admin = [c for c in CATEGORICAL if c != "mws_id"]
    asked = requests.groupBy("mws_id", "anchor").agg(F.min(F.struct(*admin)).alias("_admin")).select("mws_id", "anchor", "_admin.*")
    raw = ["date", *WEATHER, *WIND]
    rows = asked.join(history.select("mws_id", *raw), "mws_id").where(
        (F.col("date") <= F.col("anchor")) & (F.col("date") > F.date_sub("anchor", steps * STEP_DAYS)))
    rows = rows.join(placed, "mws_id")
    # one group per location and anchor: the panel's windows then end at the anchor
    rows = rows.withColumn("_place", F.col("mws_id")).withColumn("mws_id", F.concat_ws("|", "mws_id", F.col("anchor").cast("string")))
    whole = Window.partitionBy("mws_id")
    gaps = [c for c in (*WEATHER, *WIND) if c != "NDVI"]
    rows = rows.withColumns({f"_m_{c}": F.median(c).over(whole) for c in gaps})
    rows = rows.withColumns({c: F.coalesce(c, f"_m_{c}") for c in gaps}).drop(*[f"_m_{c}" for c in gaps])
    rows = cyclic_features(calendar_features(impute.fill_neighbours(rows, ["NDVI"])))
    rows = features.rolling_features(features.ratio_features(features.lag_features(features.water_balance(rows))))
    if clip:
        rows = features.clip_radiation(rows, bundle.caps)
    rows = features.quarter_deviation(rows.withColumn("months_from_peak", F.col("month") - F.col("peak_month")))
    rows = impute.fill_neighbours(rows, DYNAMIC)
    newest = whole.orderBy(F.col("date").desc())
    rows = rows.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= bundle.settings["window"]).drop("_back")
    rows = scaling.apply_scaler(rows, bundle.scaler, SCALED, serve=True)
    return features.apply_label_codes(rows.withColumn("mws_id", F.col("_place")).drop("_place"), bundle.codes)


def serving_samples(rows: DataFrame, bundle: Bundle) -> DataFrame:
    """One row per (location, anchor): the window as an array of rows, and the last row's statics and codes."""
    dynamic, static = bundle.settings["dynamic"], bundle.settings["static"]
    codes = [f"{c}_encoded" for c in CATEGORICAL]
    steps = F.array_sort(F.collect_list(F.struct("date", F.array(*[F.col(c).cast("double") for c in dynamic]).alias("row"))))
    last = F.max_by(F.struct(F.col("NDVI").alias("current_ndvi"), *static, *codes), "date")
    return rows.groupBy("mws_id", "anchor").agg(steps.alias("_w"), last.alias("_last")).select(
        "mws_id", "anchor", F.size("_w").alias("n_rows"), F.transform("_w", lambda s: s["row"]).alias("history"),
        F.element_at("_w", 1)["date"].alias("window_start"), F.element_at("_w", -1)["date"].alias("window_end"), "_last.*")


def forecasts(requests: DataFrame, history: DataFrame, weather: DataFrame, bundle: Bundle, placed: DataFrame) -> DataFrame:
    """(location, anchor, n_rows, window dates, forecast) of what the bundle can answer.

    ``weather`` has ``precip_steps`` and ``temp_steps`` of the lead by location and anchor; without it they are empty.
    """
    samples = serving_samples(serving_features(requests, history, bundle, placed), bundle)
    samples = samples.join(weather.select("mws_id", "anchor", "precip_steps", "temp_steps"), ["mws_id", "anchor"], "left")
    samples = scaling.scaled_aggregates(samples, bundle.scaler, "precip_steps", "temp_steps")
    full = samples.where(F.col("n_rows") == bundle.settings["window"])
    out = bundle.model.transform(forecast.with_vector(full, bundle.settings["static"])).crossJoin(
        F.broadcast(bundle.scaler.select("NDVI_mu", "NDVI_sd")))
    value = scaling.inverse_ndvi(F.col("current_ndvi") + F.col("delta_hat"))
    done = out.select("mws_id", "anchor", value.alias("forecast"))
    return samples.select("mws_id", "anchor", "n_rows", "window_start", "window_end").join(done, ["mws_id", "anchor"], "left")


def serve(requests: DataFrame, history: DataFrame, weather: DataFrame, bundle: Bundle, **baseline) -> DataFrame:
    """Every request with its forecast, baseline, anomaly, staleness, result record and a ``status``.

    ``requests`` has the location, its position and names, ``anchor`` (on the grid), ``target`` and ``as_of``.
    ``history`` is the panel on the grid with gaps as NULL. ``baseline`` goes to the seasonal baseline. A request that can't be
    answered keeps its row: NO_HISTORY, INSUFFICIENT_HISTORY (fewer rows than the window), NO_PROFILE (no position or
    no profile) or NO_VALUE (no index reading at all), with NULLs in place of the numbers.
    """
    placed = cut_lineage(placed_profiles(requests.where("latitude is not null and longitude is not null"), bundle.profiles))
    found = forecasts(requests, history, weather, bundle, placed)
    seen = history.join(requests.select("mws_id", "anchor").distinct(), "mws_id").where(F.col("date") <= F.col("anchor")) \
        .groupBy("mws_id", "anchor").agg(F.count("*").alias("_rows"), F.count("NDVI").alias("_values"))
    out = requests.join(placed.select("mws_id", "profile_id", "profile_km"), "mws_id", "left") \
        .join(seen, ["mws_id", "anchor"], "left").join(found, ["mws_id", "anchor"], "left")
    status = F.when(F.coalesce("_rows", F.lit(0)) == 0, "NO_HISTORY").when(F.col("profile_id").isNull(), "NO_PROFILE") \
        .when(F.col("n_rows") < bundle.settings["window"], "INSUFFICIENT_HISTORY").when(F.col("_values") == 0, "NO_VALUE").otherwise("OK")
    out = out.withColumn("status", status).withColumn("forecast", F.when(F.col("status") == "OK", F.col("forecast"))) \
        .fillna({"n_rows": 0}).drop("_rows", "_values")
    known = history.where("NDVI is not null")
    out = anomaly.profile_fallback(anomaly.seasonal_baseline(out, known, **baseline), placed)
    out = quality.anchor_staleness(anomaly.indicators(out), known)
    return anomaly.result_record(out.withColumn("bundle_version", F.lit(bundle.version)), verbose=True)
