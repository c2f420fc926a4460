"""Forecasters: persistence, quarter climatology and a fitted residual model."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenogrid.functions.asof import asof_join
from phenogrid.operators.scaling import inverse_ndvi
from phenogrid.schema import QUARTER_MEANS


def persistence(requests: DataFrame, history: DataFrame, cutoff: str) -> DataFrame:
    """Last valid index value at or before the cutoff."""
    seen = history.where(F.col("NDVI").isNotNull()).select("mws_id", "date", F.col("NDVI").alias("current"))
    return asof_join(requests, seen, ["mws_id"], cutoff, "date", ["current"])


def quarter_climatology(df: DataFrame, quarterly: DataFrame, date: str) -> DataFrame:
    """The location's train mean of the quarter of ``date``."""
    normal = F.element_at(F.array(*[F.col(c) for c in QUARTER_MEANS]), F.quarter(date))
    return df.join(quarterly.select("mws_id", *QUARTER_MEANS), "mws_id", "left").withColumn("clim", normal).drop(*QUARTER_MEANS)


def damped(df: DataFrame, weight: float = 0.4) -> DataFrame:
    """Current value pulled towards the seasonal normal: a forecast in residual form without a fit."""
    return df.withColumn("forecast", F.col("current") + weight * (F.coalesce("clim", "current") - F.col("current")))


def residual_model(samples: DataFrame, static, kind: str = "gbt", emb: str | None = None, seed: int = 42,
                   iterations: int = 20, depth: int = 4) -> PipelineModel:
    """Fit ``target - current`` on the train samples from flattened history, statics and tile vector.

    For trees the validation split decides when boosting stops.
    """
    train = with_vector(samples.where("split in ('train', 'val')"), static, emb).withColumn(
        "delta", F.col("target") - F.col("current_ndvi")).withColumn("is_val", F.col("split") == "val")
    if kind == "gbt":
        est = GBTRegressor(featuresCol="features", labelCol="delta", predictionCol="delta_hat", maxIter=iterations,
                           maxDepth=depth, seed=seed, validationIndicatorCol="is_val", validationTol=0.001)
    else:
        est = LinearRegression(featuresCol="features", labelCol="delta", predictionCol="delta_hat", regParam=0.01)
        train = train.where("not is_val")
    return est.fit(train.select("features", "delta", "is_val"))


def with_vector(samples: DataFrame, static, emb: str | None = None) -> DataFrame:
    """``features``: the flattened history, the statics, the lead's aggregates and the tile vector, in this order."""
    scalars = F.array(*[F.col(c).cast("double") for c in (*static, "forecast_precip_sum", "forecast_temp_mean")])
    parts = [F.flatten("history"), scalars, *([F.col(emb)] if emb else [])]
    return samples.withColumn("features", array_to_vector(F.concat(*parts)))


def predict(model, samples: DataFrame, static, scaler: DataFrame, emb: str | None = None) -> DataFrame:
    """Scaled and original-unit forecasts of every sample."""
    out = model.transform(with_vector(samples, static, emb)).withColumn("scaled_forecast", F.col("current_ndvi") + F.col("delta_hat"))
    out = out.crossJoin(F.broadcast(scaler.select("NDVI_mu", "NDVI_sd")))
    return out.withColumns({
        "forecast": inverse_ndvi(F.col("scaled_forecast")), "actual": inverse_ndvi(F.col("target")),
        "current": inverse_ndvi(F.col("current_ndvi"))}).select(
        "mws_id", "target_date", "split", "actual", "current", "forecast", "scaled_forecast")
