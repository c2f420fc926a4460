"""Split-safe samples and serving windows over the scaled panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenogrid.functions.asof import asof_join
from phenogrid.functions.columns import W, seeded_share
from phenogrid.schema import DYNAMIC, LEAD, STATIC, WINDOW


def split_samples(df: DataFrame, window: int = WINDOW, lead: int = LEAD, dynamic=tuple(DYNAMIC),
                  static=tuple(STATIC), arrays: bool = True) -> DataFrame:
    """One sample per target row whose lead rows all lie in one split.

    History rows are the ``window`` rows before the lead rows and may reach into earlier splits.
    Counted in rows, not days: a dropped row moves the window, it does not break it. All frames
    share the panel's window, so a sample costs one sort of the location and no join. With
    ``arrays=False`` only the scalars are produced.
    """
    lead_rows = W().rowsBetween(-(lead - 1), 0)
    hist_rows = W().rowsBetween(-(lead + window - 1), -lead)
    whole = W().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    have, stat = list(dynamic), list(static)
    missing = [c for c in (*have, *stat) if c not in df.columns]
    if missing:
        raise ValueError(f"the panel lacks {', '.join(missing)}")
    complete = F.forall(F.array(*[F.col(c).isNotNull() for c in have]), lambda ok: ok)
    cols = {
        "_rn": F.row_number().over(W()), "_lo": F.min("split").over(lead_rows), "_hi": F.max("split").over(lead_rows),
        "_full": F.count_if(complete).over(hist_rows), 
        "current_ndvi": F.lag("NDVI", lead).over(W()), "history_start": F.lag("date", lead + window - 1).over(W()),
        "history_end": F.lag("date", lead).over(W()),
        "forecast_precip_sum": F.sum("precipitation").over(lead_rows),
        "forecast_temp_mean": F.avg("temperature_2m").over(lead_rows),
        **{f"_s_{c}": F.first(c).over(whole) for c in stat}}
    if arrays:
        cols["history"] = F.collect_list(F.array(*[F.col(c).cast("double") for c in have])).over(hist_rows)
        cols["history_dates"] = F.collect_list("date").over(hist_rows)
    out = df.withColumns(cols).where(
        (F.col("_rn") >= window + lead) & (F.col("_lo") == F.col("_hi")) & (F.col("_full") == window)
        & F.col("NDVI").isNotNull())
    # NULLs among the lead rows are skipped; only a sum or mean of nothing, or a NULL static value, rejects
    out = out.dropna(subset=["forecast_precip_sum", "forecast_temp_mean", *[f"_s_{c}" for c in stat]])
    keep = ["mws_id", F.col("date").alias("target_date"), "split", F.col("NDVI").alias("target"), "current_ndvi",
            "history_start", "history_end", "forecast_precip_sum", "forecast_temp_mean",
            *[F.col(f"_s_{c}").alias(c) for c in stat]]
    keep += [c for c in df.columns if c.endswith("_encoded")]
    return out.select(*keep, *(["history", "history_dates"] if arrays else []))


def serving_windows(requests: DataFrame, history: DataFrame, cutoff: str, cols, window: int = WINDOW) -> DataFrame:
    """The last ``window`` rows up to the cutoff of each request, or a status."""
    last = W().rowsBetween(-(window - 1), 0)
    wins = history.select("mws_id", "date", F.collect_list(F.struct("date", *cols)).over(last).alias("window"))
    out = asof_join(requests, wins, ["mws_id"], cutoff, "date", ["window"])
    n = F.coalesce(F.size("window"), F.lit(0))
    return out.withColumn("n_rows", n).withColumn(
        "status", F.when(n < window, "INSUFFICIENT_HISTORY").otherwise("OK"))


def debug_records(samples: DataFrame) -> DataFrame:
    """Samples as JSON lines with their static values, codes and arrays, for inspection."""
    series = lambda c: F.transform("history", lambda row: row[DYNAMIC.index(c)])
    return samples.select("mws_id", "target_date", F.to_json(F.struct(
        "mws_id", "target_date", "split", "target", "current_ndvi", "forecast_precip_sum", "forecast_temp_mean",
        *[c for c in STATIC if c in samples.columns], *[c for c in samples.columns if c.endswith("_encoded")],
        "history_dates", "history",
        *[series(c).alias(f"{c}_history") for c in ("precipitation", "temperature_2m")],
    )).alias("record"))


def mask_history(samples: DataFrame, p: float = 0.15, seed: int = 42, feature: int = 0) -> DataFrame:
    """Augmentation: with probability p, zero one feature of the history except in its last row.

    The choice is a hash of the sample and the seed, so it doesn't depend on how rows are dealt out.
    """
    n = F.size("history")
    masked = F.transform("history", lambda row, i: F.when(i == n - 1, row).otherwise(
        F.transform(row, lambda v, j: F.when(j == feature, 0.0).otherwise(v))))
    return samples.withColumn("masked", seeded_share(seed, "mws_id", "target_date") < p).withColumn(
        "history", F.when(F.col("masked"), masked).otherwise(F.col("history")))
