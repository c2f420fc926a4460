"""Missing values of a history: flags, provenance, freshness, limited fill, reliability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenogrid.functions.columns import W, clip
from phenogrid.schema import FLATLINE_COLUMNS, FRESHNESS_COLUMNS, GAP_COLUMNS

_SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def missing_flags(df: DataFrame, cols=GAP_COLUMNS) -> DataFrame:
    return df.withColumns({f"{c}_is_missing": F.col(c).isNull().cast("int") for c in cols})


def steps_since(df: DataFrame, named: dict[str, object]) -> DataFrame:
    """Rows since a condition last held (0 where it holds; rows so far if it never did)."""
    df = df.withColumn("_rn", F.row_number().over(W()))
    return df.withColumns({
        name: (F.col("_rn") - F.coalesce(F.max(F.when(cond, F.col("_rn"))).over(W().rowsBetween(*_SO_FAR)), F.lit(0))).cast("int")
        for name, cond in named.items()}).drop("_rn")


def freshness(df: DataFrame, cols=FRESHNESS_COLUMNS) -> DataFrame:
    named = {f"{c}_steps_since_observed": F.col(c).isNotNull() for c in cols}
    return steps_since(df, named | {"ndvi_gap_length": F.col("NDVI").isNotNull()})


def days_since_previous(df: DataFrame) -> DataFrame:
    return df.withColumn("days_since_last_obs",
                         F.coalesce(F.datediff("date", F.lag("date").over(W())), F.lit(0)))


def flatlines(df: DataFrame, cols=FLATLINE_COLUMNS) -> DataFrame:
    last6 = W().rowsBetween(-5, 0)
    return df.withColumns({
        f"{c}_is_flatlined": F.coalesce(
            F.when(F.count(c).over(last6) >= 4, F.stddev_samp(c).over(last6)) < 1e-5, F.lit(False)).cast("int")
        for c in cols})


def limited_fill(df: DataFrame, cols=tuple(GAP_COLUMNS[1:]), forward: int = 2) -> DataFrame:
    """Carry a value forward up to two rows, then back by one row (the index is never filled)."""
    df = df.withColumns({c: F.last(c, ignorenulls=True).over(W().rowsBetween(-forward, 0)) for c in cols})
    return df.withColumns({c: F.coalesce(F.col(c), F.lead(c, 1).over(W())) for c in cols})


def provenance(df: DataFrame, cols=GAP_COLUMNS) -> DataFrame:
    return df.withColumns({
        f"{c}_source": F.when(F.col(f"{c}_is_missing") == 0, "observed")
        .when(F.col(c).isNotNull(), "forward_fill").otherwise("missing") for c in cols})


def reliability(df: DataFrame) -> DataFrame:
    cost = (F.when(F.col("NDVI_is_missing") == 1, 0.3).otherwise(0.0),
            F.when(F.col("ndvi_gap_length") > 2, 0.3).otherwise(0.0),
            F.when(F.col("NDVI_steps_since_observed") > 3, 0.2).otherwise(0.0))
    return df.withColumn("sensor_reliability", clip(F.lit(1.0) - cost[0] - cost[1] - cost[2], 0.0, 1.0))


def enrich(df: DataFrame) -> DataFrame:
    """All gap columns; flatlines and freshness look at the values before the fill."""
    df = freshness(missing_flags(df))
    df = limited_fill(flatlines(days_since_previous(df)))
    return reliability(provenance(df))
