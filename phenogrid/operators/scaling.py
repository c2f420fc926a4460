"""Standard scaling with population spread, and embedding standardisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenogrid.functions.columns import clip
from phenogrid.schema import SCALED

#: A column takes seven fields of an aggregate, and Spark compiles no aggregate of over 100.
COLUMNS_AT_ONCE = 12


def fit_scaler(train: DataFrame, cols=tuple(SCALED)) -> DataFrame:
    """One row of ``<col>_mu`` and ``<col>_sd``; a zero spread acts as 1.

    A column is constant if its extremes are equal: the spread summed up over several tasks may be a little over zero.
    Rows are scanned once per COLUMNS_AT_ONCE columns, each scan reading only its own: store them first.
    """
    sd = lambda c: F.when((F.min(c) < F.max(c)) & (F.stddev_pop(c) > 0), F.stddev_pop(c)).otherwise(1.0)
    parts = [cols[i:i + COLUMNS_AT_ONCE] for i in range(0, len(cols), COLUMNS_AT_ONCE)]
    out = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), [
        train.agg(*[F.avg(c).alias(f"{c}_mu") for c in some], *[sd(c).alias(f"{c}_sd") for c in some]) for some in parts])
    return out.select(*[f"{c}_mu" for c in cols], *[f"{c}_sd" for c in cols])


def scale(c: str, value=None):
    return ((F.col(c) if value is None else value) - F.col(f"{c}_mu")) / F.col(f"{c}_sd")


def inverse_ndvi(value):
    """Scaled index back to [0, 1]."""
    return clip(value * F.col("NDVI_sd") + F.col("NDVI_mu"), 0.0, 1.0)


def apply_scaler(df: DataFrame, scaler: DataFrame, cols=tuple(SCALED), serve: bool = False) -> DataFrame:
    """Standardise; the serving path treats a missing value as 0 before scaling."""
    # two arrays, not two columns for each one scaled: rows of over 100 columns are not compiled
    packed = scaler.select(F.array(*[f"{c}_mu" for c in cols]).alias("_mu"), F.array(*[f"{c}_sd" for c in cols]).alias("_sd"))
    val = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if serve else F.col(c)
    scaled = {c: (val(c) - F.col("_mu")[i]) / F.col("_sd")[i] for i, c in enumerate(cols)}
    return df.crossJoin(F.broadcast(packed)).withColumns(scaled).drop("_mu", "_sd")


def scaled_aggregates(df: DataFrame, scaler: DataFrame, precip: str, temp: str) -> DataFrame:
    """Sum of scaled step rain and mean of scaled step temperature; empty lists give 0."""
    out = df.crossJoin(F.broadcast(scaler.select("precipitation_mu", "precipitation_sd", "temperature_2m_mu", "temperature_2m_sd")))
    p = F.transform(F.coalesce(F.col(precip), F.array().cast("array<double>")), lambda x: scale("precipitation", x))
    t = F.transform(F.coalesce(F.col(temp), F.array().cast("array<double>")), lambda x: scale("temperature_2m", x))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    return out.withColumns({
        "forecast_precip_sum": total(p),
        "forecast_temp_mean": F.when(F.size(t) == 0, 0.0).otherwise(F.try_divide(total(t), F.size(t)))}) \
        .drop("precipitation_mu", "precipitation_sd", "temperature_2m_mu", "temperature_2m_sd")


def fit_embedding_scaler(emb: DataFrame, vec: str = "embedding", eps: float = 1e-6) -> DataFrame:
    """One row of arrays ``mu`` and ``sd`` over the given (distinct) train rows."""
    per = emb.select(F.posexplode(vec).alias("pos", "x")).groupBy("pos").agg(
        F.avg(F.col("x").cast("double")).alias("m"), (F.stddev_pop(F.col("x").cast("double")) + eps).alias("s"))
    rows = F.array_sort(F.collect_list(F.struct("pos", "m", "s")))
    return per.agg(rows.alias("r")).select(F.transform("r", lambda x: x["m"]).alias("mu"), F.transform("r", lambda x: x["s"]).alias("sd"))


def standardise_embeddings(emb: DataFrame, stats: DataFrame, vec: str = "embedding") -> DataFrame:
    """Per-dimension z-score; a row without vector keeps the neutral zero vector."""
    out = emb.crossJoin(F.broadcast(stats))
    z = F.transform(F.arrays_zip(F.col(vec).alias("x"), F.col("mu").alias("m"), F.col("sd").alias("s")),
                    lambda e: (e["x"].cast("double") - e["m"]) / e["s"])
    zero = F.transform("mu", lambda m: F.lit(0.0))
    return out.withColumn(vec, F.when(F.col(vec).isNull(), zero).otherwise(z)).drop("mu", "sd")
