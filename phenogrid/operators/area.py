"""Area labels from point z-scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenogrid import schema as S
from phenogrid.functions.columns import ladder
from phenogrid.functions.quantiles import exact_median


def severity(m):
    return ladder([(m <= S.SEVERITY_WELL_BELOW, "well_below"), (m <= S.SEVERITY_BELOW, "below"), (m < S.SEVERITY_ABOVE, "normal")], "above")


def agreement(sd):
    return ladder([(sd < S.SD_HIGH, "high"), (sd < S.SD_LOW, "medium")], "low")


def attribution(plot_z, pct_below, median_z):
    low = plot_z <= S.ATTRIBUTION_Z
    wide = (pct_below >= S.ATTRIBUTION_PCT) & (median_z <= S.ATTRIBUTION_Z)
    return ladder([(low & wide, "regional"), (low, "local")], "none")


def data_quality(clear_view):
    return ladder([(clear_view.isNull(), "unknown"), (clear_view >= S.CLEAR_GOOD, "good"), (clear_view >= S.CLEAR_FAIR, "fair")], "poor")


def rank_of(label):
    return ladder([(label == c, i) for i, c in enumerate(S.CONFIDENCE)], F.lit(None).cast("int"))


def label_of(rank):
    return F.element_at(F.array(*[F.lit(c) for c in S.CONFIDENCE]), rank + 1)


def overall_confidence(point_agreement, quality):
    """The worse of point agreement and data quality; an unknown quality does not count."""
    as_conf = ladder([(quality == k, v) for k, v in S.QUALITY_TO_CONFIDENCE.items()], F.lit(None).cast("string"))
    return label_of(F.least(rank_of(point_agreement), rank_of(as_conf)))


def effective_confidence(overall, quality, cap):
    """Poor data forces low; a cap may lower it further. Returns (confidence, capped)."""
    base = F.when(quality == "poor", "low").otherwise(overall)
    over = F.coalesce(rank_of(base) > rank_of(cap), F.lit(False))
    return F.when(over, cap).otherwise(base), over


def summarise(points: DataFrame, keys: list[str], z: str = "z", bounded: bool = True) -> DataFrame:
    """Counts, median, spread and share below normal per area.

    ``bounded`` areas are the twelve points of a plot; for larger areas (a district, a state)
    the median comes from the bracketed quantile and only the sums are grouped.
    """
    valid = points.where(F.col(z).isNotNull())
    aggs = [F.count("*").alias("n"), F.coalesce(F.stddev_pop(z), F.lit(0.0)).alias("sd_exact"), F.count_if(F.col(z) <= S.POINT_BELOW_Z).alias("_below")]
    if bounded:
        per = valid.groupBy(*keys).agg(F.median(z).alias("median_exact"), *aggs)
    else:
        per = valid.groupBy(*keys).agg(*aggs).join(exact_median(valid, keys, z, "median_exact"), keys)
    return per.withColumns({
        "median_z": F.bround("median_exact", 3), "sd": F.bround("sd_exact", 3),
        "pct_below": F.bround(100 * F.col("_below") / F.col("n")).cast("int"), "severity": severity(F.col("median_exact")),
        "spatial_confidence": agreement(F.col("sd_exact")), "small_sample": F.col("n") < S.MIN_POINTS}).drop("_below")
