"""Engineered columns, train-only statistics and label codes (fit -> apply)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenogrid.functions.columns import W, clip
from phenogrid.functions.quantiles import exact_quantiles, if_few
from phenogrid.functions.ranking import global_rank
from phenogrid.schema import CATEGORICAL, DYNAMIC, QUARTER_MEANS, RADIATION, STATIC
from phenogrid.session import cut_lineage


def fit_radiation_clip(train: DataFrame) -> DataFrame:
    """One row: the 99th percentile of each radiation column."""
    stacked = train.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("value")) for c in RADIATION])).alias("x")).select("x.col", "x.value")
    caps = exact_quantiles(stacked, ["col"], "value", {"cap": 0.99})
    return cut_lineage(caps.agg(*[F.max(F.when(F.col("col") == c, F.col("cap"))).alias(f"{c}_cap") for c in RADIATION]))


def clip_radiation(df: DataFrame, caps: DataFrame) -> DataFrame:
    out = df.crossJoin(F.broadcast(caps))
    return out.withColumns({c: clip(c, high=F.col(f"{c}_cap")) for c in RADIATION}).drop(*caps.columns)


def _ratio(top, bottom, high):
    """top / (bottom + 0.01) in [0, high]; a zero denominator acts as an infinite ratio."""
    den = F.col(bottom) + 0.01
    return F.when(den == 0, F.when(F.col(top) > 0, F.lit(float(high))).when(F.col(top) < 0, 0.0)) \
        .otherwise(clip(F.try_divide(F.col(top), den), 0.0, float(high)))


def water_balance(df: DataFrame) -> DataFrame:
    return df.withColumn("precip_runoff_diff", F.col("precipitation") - F.col("runoff"))


def lag_features(df: DataFrame) -> DataFrame:
    df = df.withColumns({
        "precipitation_prev": F.lag("precipitation", 1).over(W()), "et_prev": F.lag("et", 1).over(W()),
        "NDVI_prev": F.lag("NDVI", 1).over(W()), "NDVI_prev2": F.lag("NDVI", 2).over(W())})
    return df.withColumn("NDVI_change_prev", F.col("NDVI_prev") - F.col("NDVI_prev2"))


def ratio_features(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "precip_et_ratio": _ratio("precipitation", "et", 50),
        "temp_precip_idx": F.col("temperature_2m") * F.col("precipitation"),
        "evap_stress": _ratio("temperature_2m", "sm_rootzone", 1000)})


def rolling_features(df: DataFrame) -> DataFrame:
    prev3 = W().rowsBetween(-3, -1)
    last3 = W().rowsBetween(-2, 0)
    return df.withColumns({
        "NDVI_rolling_mean": F.avg("NDVI").over(prev3),
        "NDVI_rolling_std": F.coalesce(F.when(F.count("NDVI").over(prev3) > 1, F.stddev_samp("NDVI").over(prev3)), F.lit(0.0)),
        "precip_cum_3": F.when(F.count("precipitation").over(last3) == 3, F.sum("precipitation").over(last3)).otherwise(0.0)})


def add_engineered(df: DataFrame, caps: DataFrame) -> DataFrame:
    return rolling_features(clip_radiation(ratio_features(lag_features(water_balance(df))), caps))


def fit_label_codes(df: DataFrame, cols=tuple(CATEGORICAL)) -> DataFrame:
    """(column, value, code): codes in the sort order of the distinct values of each column."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]))
    values = df.select(*cols).distinct().select(cells.alias("s")).select("s.*").where("value is not null").distinct()
    ranked = global_rank(values, ["column", "value"], "_pos")
    first = ranked.groupBy("column").agg(F.min("_pos").alias("_first"))
    return ranked.join(F.broadcast(first), "column").select("column", "value", (F.col("_pos") - F.col("_first")).cast("int").alias("code"))


def apply_label_codes(df: DataFrame, codes: DataFrame, cols=tuple(CATEGORICAL)) -> DataFrame:
    """``<column>_encoded``; unseen and missing values become 0.

    The codes of a column with few values are sent to the rows, which else would be shuffled by each column in turn.
    """
    codes = cut_lineage(codes)
    for c in cols:
        one = codes.where(F.col("column") == c).select(F.col("value").alias(c), F.col("code").alias("_code"))
        df = df.join(one if c == "mws_id" else if_few(one), c, "left").withColumn(f"{c}_encoded", F.coalesce(F.col("_code"), F.lit(0))).drop("_code")
    return df


def fit_quarterly(train: DataFrame) -> DataFrame:
    """Mean and sample spread of the index per location and quarter, one pass, one wide row."""
    q = lambda k: F.when(F.quarter("date") == k, F.col("NDVI"))
    return train.groupBy("mws_id").agg(
        *[F.avg(q(k)).alias(f"q{k}_mean_ndvi") for k in (1, 2, 3, 4)],
        *[F.stddev_samp(q(k)).alias(f"q{k}_std_ndvi") for k in (1, 2, 3, 4)])


def fit_phenology(train: DataFrame) -> DataFrame:
    """Highest index value per location and the month that reached it first."""
    return train.groupBy("mws_id").agg(
        F.max("NDVI").alias("historical_max_ndvi"),
        F.min_by(F.month("date"), F.struct(-F.col("NDVI"), F.col("date"))).alias("peak_month"))


def merge_static(df: DataFrame, quarterly: DataFrame, phenology: DataFrame) -> DataFrame:
    out = df.join(quarterly, "mws_id", "left").join(phenology, "mws_id", "left")
    return out.withColumn("months_from_peak", F.col("month") - F.col("peak_month"))


def quarter_deviation(df: DataFrame) -> DataFrame:
    normal = F.element_at(F.array(*[F.col(c) for c in QUARTER_MEANS]), F.col("quarter"))
    return df.withColumn("ndvi_q_deviation", F.coalesce(F.col("NDVI") - normal, F.lit(0.0)))


def drop_critical_nulls(df: DataFrame) -> DataFrame:
    return df.dropna(subset=list(dict.fromkeys([*DYNAMIC, *STATIC, "date", "mws_id", "split"])))


def static_profiles(df: DataFrame, cols) -> DataFrame:
    """First row of each location, reduced to the profile columns."""
    first = F.row_number().over(Window.partitionBy("mws_id").orderBy("date"))
    return df.withColumn("_rn", first).where("_rn = 1").select(*cols)


def split_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(
        F.count("*").alias("n_rows"), F.count_distinct("mws_id").alias("n_locations"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"))
