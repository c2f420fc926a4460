"""Cleaning of the source panel and the chronological split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenogrid.functions.columns import W, missing_to_null
from phenogrid.schema import RENAMES, SPLIT_TRAIN, SPLIT_VAL, WEATHER


def rename_source(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(RENAMES)


def null_sentinels(df: DataFrame, cols=WEATHER) -> DataFrame:
    return df.withColumns({c: missing_to_null(c) for c in cols if c in df.columns})


def drop_unobserved(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["NDVI", "temperature_2m"])


def rename_and_clean(df: DataFrame) -> DataFrame:
    return drop_unobserved(null_sentinels(rename_source(df)))


def parse_dates(df: DataFrame, d: str = "date") -> DataFrame:
    """Dates as DATE. Order is a property of the windows that need it, not of the frame."""
    return df.withColumn(d, F.to_date(d))


def assign_split(df: DataFrame, train: float = SPLIT_TRAIN, val: float = SPLIT_VAL) -> DataFrame:
    """Earliest rows of each location train, then val, then test."""
    n = F.count("*").over(W().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (
        df.withColumns({"_rn": F.row_number().over(W()), "_n": n})
        .withColumn("split", F.when(F.col("_rn") <= F.floor(F.col("_n") * F.lit(train)), "train")
                    .when(F.col("_rn") <= F.floor(F.col("_n") * F.lit(train + val)), "val").otherwise("test"))
        .drop("_rn", "_n"))
