"""History audit, staleness and clear-view share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenogrid.functions.asof import asof_join
from phenogrid.functions.columns import W, flags
from phenogrid.operators.gaps import steps_since
from phenogrid.schema import CLEAR_PRIOR, CLEAR_PRIOR_DEFAULT, CLEAR_STALE_COST, COMPLETENESS_COLUMNS, STEP_DAYS, WINDOW


def audit(history: DataFrame, today: str) -> DataFrame:
    """Completeness, coverage, longest gap and quality flags per location, on rows up to today."""
    real = history.where(F.col("date") <= F.lit(today).cast("date"))
    real = steps_since(real, {"_gap": F.col("coverage_fraction") >= 0.5})
    newest = Window.partitionBy("mws_id").orderBy(F.col("date").desc())
    real = real.withColumn("_back", F.row_number().over(newest))
    empty = (F.col("_back") <= 18) & (F.col("NDVI").isNull() | (F.col("NDVI") == 0))
    per = real.groupBy("mws_id").agg(
        *[(F.avg(F.col(c).isNotNull().cast("double")) * 100).alias(f"_pct_{c}") for c in COMPLETENESS_COLUMNS],
        F.bround(F.avg("coverage_fraction") * 100, 1).alias("coverage_pct"),
        F.count_if(F.col("coverage_fraction") >= 0.5).alias("valid_steps"),
        F.max("_gap").alias("max_gap"), F.count_if(empty).alias("_recent_empty"), F.avg("NDVI").alias("_mean_ndvi"))
    per = per.withColumns({f"{c}_completeness": F.bround(F.col(f"_pct_{c}"), 1) for c in COMPLETENESS_COLUMNS})
    cov = F.col("coverage_pct")
    too_low = cov < 20
    pairs = [(F.col(f"_pct_{c}") < 70, F.concat(F.lit(f"LOW_{c.upper()}_COMPLETENESS:"),
                                               F.col(f"{c}_completeness").cast("string"), F.lit("%")))
             for c in COMPLETENESS_COLUMNS]
    pairs += [
        (cov < 40, "CRITICAL: Historical coverage extremely low (<40%)."),
        (F.col("_recent_empty") > 9, "WARNING: >50% of recent LSTM window missing."),
        (F.col("_mean_ndvi") < 0.12, "NOTICE: Low biomass — may be water, urban, or fallow."),
        (too_low, F.concat(F.lit("ERROR: Only "), cov.cast("string"), F.lit("% coverage. Minimum 20% required."))),
        (~too_low & (F.col("max_gap") >= 8),
         F.concat(F.lit("CRITICAL: Long temporal gap detected ("), F.col("max_gap").cast("string"), F.lit(" windows)"))),
    ]
    return per.withColumn("quality_issues", flags(*[(c, v if not isinstance(v, str) else F.lit(v)) for c, v in pairs])) \
        .drop(*[f"_pct_{c}" for c in COMPLETENESS_COLUMNS], "_recent_empty", "_mean_ndvi")


def anchor_staleness(requests: DataFrame, history: DataFrame, anchor: str = "anchor") -> DataFrame:
    """Steps between the anchor and the last observed index value at or before it."""
    seen = history.where(F.col("NDVI").isNotNull()).select("mws_id", "date", F.col("date").alias("last_obs"))
    out = asof_join(requests, seen, ["mws_id"], anchor, "date", ["last_obs"])
    steps = F.bround(F.datediff(F.col(anchor), F.col("last_obs")) / F.lit(float(STEP_DAYS)))
    return out.withColumn("stale_fortnights", F.when(F.col("last_obs").isNotNull(), F.greatest(steps, F.lit(0.0)).cast("int")))


def clear_view(requests: DataFrame, history: DataFrame, cutoff: str, coverage_pct: str | None = None,
               window: int = WINDOW) -> DataFrame:
    """Share of clear views in the last rows up to the cutoff.

    Quality flags decide when any is present in those rows, else the availability flag, else the
    audit's coverage. The shares run over the history once and are looked up as of the cutoff.
    """
    last = W().rowsBetween(-(window - 1), 0)
    clear = F.coalesce(F.col("SummaryQA") <= 1, F.lit(False)).cast("double")
    shares = history.select("mws_id", "date", F.when(
        F.count("SummaryQA").over(last) > 0, F.avg(clear).over(last)).otherwise(
        F.avg(F.col("is_real_ndvi").cast("double")).over(last)).alias("_share"))
    out = asof_join(requests, shares, ["mws_id"], cutoff, "date", ["_share"])
    share = F.col("_share") if coverage_pct is None else F.coalesce(F.col("_share"), F.col(coverage_pct) / 100.0)
    return out.withColumn("clear_view", F.bround(share, 3)).drop("_share")


def estimate_clear_view(month, stale):
    """Season prior less a fixed cost per stale step, when no per-view quality is known."""
    table = F.create_map(*[F.lit(x) for kv in CLEAR_PRIOR.items() for x in kv])
    prior = F.coalesce(table[month], F.lit(CLEAR_PRIOR_DEFAULT))
    return F.when(stale.isNull(), prior).otherwise(F.bround(F.greatest(prior - CLEAR_STALE_COST * stale, F.lit(0.0)), 3))
