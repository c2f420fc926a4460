"""Training a bundle on the panel and answering requests from it, and the named query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenogrid.functions.columns import round_cols
from phenogrid.operators import clean, features, forecast, scaling, serving, weather, windows
from phenogrid.plans import features as fplan
from phenogrid.plans import outlook
from phenogrid.plans.registry import query
from phenogrid.schema import CATEGORICAL, PROFILE
from phenogrid.session import cut_lineage, materialise, scratch_path
from phenogrid.sources import tables as t

SERVED = ["NDVI", "ndvi_q_deviation", "month_sin", "month_cos", "precipitation"]
STATIC_USED = ["latitude", "longitude", "historical_max_ndvi", "peak_month"]


def train_bundle(spark, d, path: str, version: str, kind: str = "linear", history: DataFrame | None = None) -> str:
    """Fit scaler, codes, caps, profiles and model on the train rows and store them as one version.

    With a stored serving ``history`` the observations are not reduced to a panel again.
    """
    panel = fplan.stored_panel(spark, d, history)
    df = fplan.stored_features(spark, d, panel)
    scaler = cut_lineage(scaling.fit_scaler(df.where("split = 'train'")))
    samples = materialise(windows.split_samples(scaling.apply_scaler(df, scaler), dynamic=SERVED, static=STATIC_USED), "samples")
    model = forecast.residual_model(samples, STATIC_USED, kind, iterations=10, depth=3)
    tables = {"scaler": scaler, "codes": features.fit_label_codes(panel), "profiles": features.static_profiles(df, PROFILE),
              "caps": features.fit_radiation_clip(panel.where("split = 'train'"))}
    return serving.save_bundle(path, version, model, tables, kind, SERVED, STATIC_USED)


def serving_history(spark, d) -> DataFrame:
    """The whole grid with sentinels and gaps as NULL: serving fills what training drops."""
    with t.sized(spark, d):
        return materialise(clean.null_sentinels(clean.rename_source(t.source_panel(spark, d))), "serving", bucket="mws_id")


def serving_requests(spark, d) -> DataFrame:
    return outlook.requests(spark, d).select("mws_id", "latitude", "longitude", *CATEGORICAL[:3], "anchor", "target") \
        .withColumn("as_of", F.date_add("anchor", 3))


def served(spark, d) -> DataFrame:
    path = scratch_path(spark, "bundle")
    history, req = serving_history(spark, d), serving_requests(spark, d)
    train_bundle(spark, d, path, "1", history=history)
    lead = weather.climatology_future(req.select("mws_id", "anchor", "target").distinct(), history, cutoff="anchor").withColumnsRenamed(
        {"clim_precip_steps": "precip_steps", "clim_temp_steps": "temp_steps"})
    return serving.serve(req, history, lead, serving.load_bundle(spark, path))


@query("f04_served_forecast")
def f04_served(spark, d):
    """Every location at three anchors, answered from a stored bundle, with a status for each."""
    out = served(spark, d).select(
        "mws_id", "anchor", "target", "status", "n_rows", "window_start", "window_end", "profile_id", "forecast", "baseline_source",
        "baseline_n", "z", "condition", "stale_fortnights", F.col("result.note").alias("note"))
    return round_cols(out, ["forecast"])
