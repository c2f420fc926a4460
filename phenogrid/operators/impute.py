"""Median imputation up the ladder location -> district -> state -> everything."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenogrid.functions.columns import W
from phenogrid.functions.quantiles import exact_median, if_few
from phenogrid.schema import WEATHER
from phenogrid.session import cut_lineage

LADDER = ("mws_id", "district", "state", None)


@dataclass
class LevelMedians:
    """Medians of one level: a small frame keyed by ``level`` (or one row).

    Those of a level above the location are sent to the rows if they are few: by a shuffle, all rows of a
    state would meet in one task, and rows stored by location would leave their buckets.
    """

    level: str | None
    cols: list[str]
    stats: DataFrame


def fill_level(df: DataFrame, fit: LevelMedians) -> DataFrame:
    named = {c: f"_median_{c}" for c in fit.cols}
    stats = fit.stats.withColumnsRenamed(named)
    joined = df.join(stats, fit.level, "left") if fit.level else df.crossJoin(F.broadcast(stats))
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(m)) for c, m in named.items()}).drop(*named.values())


def fit_level(df: DataFrame, level: str | None, cols: list[str]) -> LevelMedians:
    """Medians per value of ``level``.

    A location has at most one row per step, so plain ``median`` is safe there; the groups
    above it grow with the data and use the bracketed quantile.
    """
    if level == "mws_id":
        stats = df.groupBy("mws_id").agg(*[F.median(c).alias(c) for c in cols])
    else:
        # the column's name is a key of its own: one pipeline for all columns of the level
        keys = [level] if level else []
        stacked = df.select(*keys, F.explode(F.array(*[
            F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("value")) for c in cols])).alias("_x")).select(
            *keys, F.col("_x.col").alias("_col"), F.col("_x.value").alias("_value"))
        medians = exact_median(stacked, [*keys, "_col"], "_value", "_median")
        stats = medians.groupBy(*keys).agg(*[F.max(F.when(F.col("_col") == c, F.col("_median"))).alias(c) for c in cols])
    stats = cut_lineage(stats)
    return LevelMedians(level, cols, stats if level in ("mws_id", None) else if_few(stats))


def columns_with_gaps(df: DataFrame, cols: list[str]) -> list[str]:
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    return [c for c in cols if counts[c]]


def fit_imputation(df: DataFrame, cols=tuple(WEATHER), ladder=LADDER, fit_on: str | None = None) -> list[LevelMedians]:
    """Medians per level, each taken from the frame the levels before have already filled.

    Levels are fitted only for columns that still have gaps. ``fit_on="train"`` restricts the
    medians to that split; the default uses every row.
    """
    fits: list[LevelMedians] = []
    left = list(cols)
    for level in ladder:
        left = columns_with_gaps(df, left)
        if not left:
            break
        base = df.where(F.col("split") == fit_on) if fit_on else df
        fits.append(fit_level(base, level, left))
        df = fill_level(df, fits[-1])
    return fits


def apply_imputation(df: DataFrame, fits: list[LevelMedians]) -> DataFrame:
    for fit in fits:
        df = fill_level(df, fit)
    return df


def fill_neighbours(df: DataFrame, cols) -> DataFrame:
    """Previous value, then next value, over any distance within the location."""
    before = W().rowsBetween(Window.unboundedPreceding, 0)
    after = W().rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumns({c: F.last(c, ignorenulls=True).over(before) for c in cols})
    return df.withColumns({c: F.coalesce(F.col(c), F.first(c, ignorenulls=True).over(after)) for c in cols})
