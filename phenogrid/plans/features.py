"""The feature pipeline end to end, and named queries for its steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenogrid.functions.columns import round_cols, rounded
from phenogrid.functions.dates import add_time_features
from phenogrid.operators import clean, features, impute, scaling
from phenogrid.plans import panel as panel_plan
from phenogrid.plans.registry import query
from phenogrid.schema import DYNAMIC, RADIATION, SCALED, STATIC, WEATHER, WIND
from phenogrid.session import materialise
from phenogrid.sources import tables as t


def split_panel(spark, d) -> DataFrame:
    return clean.assign_split(clean.rename_and_clean(clean.parse_dates(t.source_panel(spark, d, False))))


def build_features(panel: DataFrame) -> DataFrame:
    """Imputed, engineered and complete rows. ``panel`` is scanned several times: store it first.

    Baselines, phenology and radiation caps are fitted on the train rows as they were before
    imputation.
    """
    train = panel.where(F.col("split") == "train")
    caps = features.fit_radiation_clip(train)
    df = impute.apply_imputation(panel, impute.fit_imputation(panel))
    df = features.add_engineered(add_time_features(df), caps)
    df = features.apply_label_codes(df, features.fit_label_codes(panel))
    df = features.merge_static(df, features.fit_quarterly(train), features.fit_phenology(train))
    return features.drop_critical_nulls(features.quarter_deviation(df))


def stored_panel(spark, d, cleaned: DataFrame | None = None) -> DataFrame:
    """The panel with its split, from the observations or from a stored panel that is ``cleaned`` but for unobserved rows.

    No feature is made of the number of observations or their quality flag, so these are neither shuffled nor stored.
    """
    with t.sized(spark, d):
        panel = split_panel(spark, d) if cleaned is None else clean.assign_split(clean.drop_unobserved(cleaned))
        return materialise(panel.drop("n_obs", "SummaryQA"), "panel", bucket="mws_id")


def stored_features(spark, d, panel: DataFrame | None = None) -> DataFrame:
    with t.sized(spark, d):
        return materialise(build_features(stored_panel(spark, d) if panel is None else panel), "features", bucket="mws_id")


def scaled_features(spark, d) -> DataFrame:
    df = stored_features(spark, d)
    return scaling.apply_scaler(df, scaling.fit_scaler(df.where("split = 'train'")))


def imputed(spark, d) -> DataFrame:
    panel = stored_panel(spark, d)
    return impute.apply_imputation(panel, impute.fit_imputation(panel))


KEY = ["mws_id", "date"]


@query("d01_hierarchical_imputation")
def d01(spark, d):
    return round_cols(imputed(spark, d).select(*KEY, *WEATHER), WEATHER)


@query("d02_location_imputation")
def d02(spark, d):
    cols = [*WEATHER[1:], *WIND]
    h = panel_plan.stored_history(spark, d, cols)
    fits = impute.fit_imputation(h, cols, ladder=("mws_id",))
    return round_cols(impute.apply_imputation(h, fits).select("mws_id", "step", *cols), cols)


@query("d03_ndvi_neighbour_fill")
def d03(spark, d):
    return round_cols(impute.fill_neighbours(panel_plan.patchy(spark, d), ["NDVI"]).select("mws_id", "step", "NDVI"), ["NDVI"])


@query("d04_radiation_caps")
def d04(spark, d):
    caps = features.fit_radiation_clip(split_panel(spark, d).where("split = 'train'"))
    return round_cols(caps, caps.columns)


@query("d05_radiation_clip")
def d05(spark, d):
    panel = stored_panel(spark, d)
    caps = features.fit_radiation_clip(panel.where("split = 'train'"))
    return round_cols(features.clip_radiation(panel, caps).select(*KEY, *RADIATION), RADIATION)


def _engineered(spark, d, fn, cols):
    return round_cols(fn(imputed(spark, d)).select(*KEY, *cols), cols)


@query("d06_precip_minus_runoff")
def d06(spark, d):
    return _engineered(spark, d, features.water_balance, ["precip_runoff_diff"])


@query("d07_lags")
def d07(spark, d):
    return _engineered(spark, d, features.lag_features,
                       ["precipitation_prev", "et_prev", "NDVI_prev", "NDVI_prev2", "NDVI_change_prev"])


@query("d08_ratios")
def d08(spark, d):
    return _engineered(spark, d, features.ratio_features, ["precip_et_ratio", "temp_precip_idx", "evap_stress"])


@query("d09_rolling_ndvi")
def d09(spark, d):
    return _engineered(spark, d, features.rolling_features, ["NDVI_rolling_mean", "NDVI_rolling_std"])


@query("d10_precip_cum_3")
def d10(spark, d):
    return _engineered(spark, d, features.rolling_features, ["precip_cum_3"])


@query("d11_fit_label_codes")
def d11(spark, d):
    return features.fit_label_codes(split_panel(spark, d))


@query("d12_apply_label_codes")
def d12(spark, d):
    # codes fitted on the later half of the locations, so that unseen values occur
    loc = t.locations(spark, d)
    codes = features.fit_label_codes(loc.where("loc_no % 2 = 1"))
    return features.apply_label_codes(loc, codes).select("mws_id", "state_encoded", "district_encoded", "tehsil_encoded", "mws_id_encoded")


def _train(spark, d):
    return split_panel(spark, d).where("split = 'train'")


@query("d13_quarterly_baselines")
def d13(spark, d):
    out = features.fit_quarterly(_train(spark, d))
    return round_cols(out, out.columns[1:])


@query("d14_phenology")
def d14(spark, d):
    return round_cols(features.fit_phenology(_train(spark, d)), ["historical_max_ndvi"])


@query("d15_static_baselines_joined")
def d15(spark, d):
    panel = stored_panel(spark, d)
    train = panel.where("split = 'train'")
    out = features.merge_static(add_time_features(panel), features.fit_quarterly(train), features.fit_phenology(train))
    return round_cols(out.select(*KEY, "q1_mean_ndvi", "q4_std_ndvi", "historical_max_ndvi", "months_from_peak"),
                      ["q1_mean_ndvi", "q4_std_ndvi", "historical_max_ndvi"])


@query("d16_quarter_deviation")
def d16(spark, d):
    return round_cols(stored_features(spark, d).select(*KEY, "ndvi_q_deviation"), ["ndvi_q_deviation"])


@query("d17_critical_nulls_dropped")
def d17(spark, d):
    cols = list(dict.fromkeys([*DYNAMIC, *STATIC]))
    # without imputation, so that there is something to drop
    panel = stored_panel(spark, d)
    train = panel.where("split = 'train'")
    df = features.add_engineered(add_time_features(panel), features.fit_radiation_clip(train))
    df = features.quarter_deviation(features.merge_static(df, features.fit_quarterly(train), features.fit_phenology(train)))
    return round_cols(features.drop_critical_nulls(df).select(*KEY, "split", *cols), cols)


@query("d18_fit_scaler")
def d18(spark, d):
    out = scaling.fit_scaler(stored_features(spark, d).where("split = 'train'"))
    return round_cols(out, out.columns)


@query("d19_apply_scaler")
def d19(spark, d):
    return round_cols(scaled_features(spark, d).select(*KEY, *SCALED), SCALED)


@query("d20_inverse_ndvi")
def d20(spark, d):
    df = stored_features(spark, d)
    scaler = scaling.fit_scaler(df.where("split = 'train'"))
    out = scaling.apply_scaler(df.select(*KEY, "NDVI"), scaler, ["NDVI"]).crossJoin(F.broadcast(scaler))
    shifted = out.select(*KEY, scaling.inverse_ndvi(F.col("NDVI") * 1.5).alias("stretched_ndvi"), scaling.inverse_ndvi(F.col("NDVI")).alias("NDVI"))
    return round_cols(shifted, ["stretched_ndvi", "NDVI"])


@query("d21_scaled_forecast_aggregates")
def d21(spark, d):
    df = stored_features(spark, d)
    scaler = scaling.fit_scaler(df.where("split = 'train'"), ["precipitation", "temperature_2m"])
    out = scaling.scaled_aggregates(panel_plan._weather(spark, d), scaler, "precip_steps", "temp_steps")
    return round_cols(out.select("mws_id", "forecast_precip_sum", "forecast_temp_mean"), ["forecast_precip_sum", "forecast_temp_mean"])


@query("d22_split_summary")
def d22(spark, d):
    return features.split_summary(split_panel(spark, d))


@query("d23_embedding_standardised")
def d23(spark, d):
    emb = t.embeddings(spark, d).withColumn("embedding", F.when(F.col("vec_id") % 50 != 49, F.col("embedding")))
    stats = scaling.fit_embedding_scaler(emb.where("vec_id % 10 < 7 and embedding is not null"))
    out = scaling.standardise_embeddings(emb, stats)
    return out.select("vec_id", F.posexplode("embedding").alias("pos", "z")).withColumn("z", rounded("z", 5))
