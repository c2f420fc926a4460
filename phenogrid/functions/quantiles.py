"""Exact quantiles of groups of any size.

Spark's ``median``/``percentile`` keep every distinct value of a group in one hash map, which
is fine for a location (bounded by the calendar) or for a plot (12 points) but not for a
district, a state or the whole panel. Here a bounded sketch first brackets the wanted ranks
and only the values inside the bracket are ordered, so no task ever sees a whole group:

1. ``percentile_approx`` per group (bounded memory, merged map-side) gives a value range that
   contains the wanted rank for certain, since its rank error is below n / ACCURACY; the ranges
   are stored, counted, and broadcast only if they are few, so the values need no shuffle;
2. where a range may still hold too many distinct values to order in one task, it is narrowed
   by sketching inside it, as often as needed;
3. one more pass counts, map-side, the values under the range and the distinct values in it;
4. a running sum over those few distinct values finds the exact ranks; a range that doesn't
   hold them would be an error, not a wrong value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phenogrid.session import cut_lineage

ACCURACY = 10000
# brackets are a few numbers per group: up to this many groups (some 20 MB) they are broadcast
BROADCAST_GROUPS = 200_000
# distinct values of a group that may be ordered in one task
ORDERED_VALUES = 1_000_000
_MARGIN = 3.0 / ACCURACY
_GRID = 200


def if_few(groups: DataFrame) -> DataFrame:
    """``groups`` marked for a broadcast if it has at most BROADCAST_GROUPS rows; stored rows tell the optimizer no size."""
    return F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                    ordered_values: int = ORDERED_VALUES) -> DataFrame:
    """One row per group with a linearly interpolated quantile per entry of ``probs``.

    Groups without any value give no row (for ``keys=[]``: one row of NULLs).
    """
    vals = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    names = list(probs)
    points = [p for n in names for p in (max(probs[n] - _MARGIN, 0.0), min(probs[n] + _MARGIN, 1.0))]
    sketch = cut_lineage(vals.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", [float(p) for p in points], ACCURACY).alias("_q")))
    size = sketch.agg(F.count("*").alias("groups"), F.max("_n").alias("largest")).first()
    few = not keys or size["groups"] <= BROADCAST_GROUPS
    # up to ACCURACY values a group is ordered as it is; above, the margin covers at least two ranks
    small = F.col("_n") <= ACCURACY
    inside = max((size["largest"] or 0) * (2 * _MARGIN + 2 / ACCURACY), min(size["largest"] or 0, ACCURACY))
    out = None
    for i, name in enumerate(names):
        bracket = sketch.select(
            *keys, "_n", F.when(small, F.col("_min")).otherwise(F.col("_q")[2 * i]).alias("_lo"),
            F.when(small, F.col("_max")).otherwise(F.col("_q")[2 * i + 1]).alias("_hi"))
        if inside > ordered_values:
            bracket = _narrow(vals, bracket, keys, probs[name], few, ordered_values)
        part = _rank_inside(vals, bracket, keys, name, probs[name], few)
        out = part if out is None else (out.join(part, keys) if keys else out.crossJoin(F.broadcast(part)))
    return out


def exact_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    return exact_quantiles(df, keys, value, {name: 0.5})


def _position(prob: float) -> Column:
    return F.lit(float(prob)) * (F.col("_n") - 1)


def _with_bracket(vals: DataFrame, bracket: DataFrame, keys: list[str], few: bool) -> DataFrame:
    b = F.broadcast(bracket) if few else bracket
    return vals.join(b, keys) if keys else vals.crossJoin(b)


def _narrow(vals, bracket, keys, prob, few, ordered_values):
    """Shrink each range to about two hundredths until its distinct values can be ordered.

    The range keeps a whole grid step on both sides of the wanted ranks, far more than the
    rank error of the sketch inside it. A range that is a single value needs no narrowing.
    """
    grid = [i / _GRID for i in range(_GRID + 1)]
    v = F.col("_v")
    inside = (v >= F.col("_lo")) & (v <= F.col("_hi"))
    while True:
        joined = _with_bracket(vals, bracket, keys, few).where(v <= F.col("_hi"))
        state = cut_lineage(joined.groupBy(*keys, "_n", "_lo", "_hi").agg(
            F.count_if(v < F.col("_lo")).alias("_below"), F.count_if(inside).alias("_m"),
            F.approx_count_distinct(F.when(inside, v)).alias("_distinct"),
            F.percentile_approx(F.when(inside, v), grid, ACCURACY).alias("_g")))
        wide = (F.col("_distinct") > ordered_values) & (F.col("_lo") < F.col("_hi"))
        step = lambda rank: (rank - F.col("_below")) * _GRID / F.greatest(F.col("_m") - 1, F.lit(1))
        low = F.greatest(F.floor(step(F.floor(_position(prob)))) - 1, F.lit(0)).cast("int")
        high = F.least(F.ceil(step(F.ceil(_position(prob)))) + 1, F.lit(_GRID)).cast("int")
        shrunk = cut_lineage(state.select(
            *keys, "_n", F.when(wide, F.col("_g")[low]).otherwise(F.col("_lo")).alias("_lo"),
            F.when(wide, F.col("_g")[high]).otherwise(F.col("_hi")).alias("_hi"),
            (wide & ((F.col("_g")[low] > F.col("_lo")) | (F.col("_g")[high] < F.col("_hi")))).alias("_moved")))
        bracket = shrunk.drop("_moved")
        if shrunk.where("_moved").isEmpty():
            return bracket


def _rank_inside(vals, bracket, keys, name, prob, few):
    joined = _with_bracket(vals, bracket, keys, few)
    counted = (
        joined.where(F.col("_v") <= F.col("_hi"))
        .select(*keys, "_n", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v"))
        .groupBy(*keys, "_n", "_v").agg(F.count("*").alias("_c")))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    pos = _position(prob)
    ranked = counted.withColumn(
        "_cum", F.sum("_c").over(w.orderBy(F.col("_v").asc_nulls_first())
                                 .rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    hit = lambda idx: F.min(F.when(F.col("_v").isNotNull() & (F.col("_cum") > idx), F.col("_v")))
    agg = ranked.groupBy(*keys).agg(
        hit(F.floor(pos)).alias("_a"), hit(F.ceil(pos)).alias("_b"), F.max(F.floor(pos)).alias("_at"),
        F.max(pos - F.floor(pos)).alias("_f"),
        F.coalesce(F.max(F.when(F.col("_v").isNull(), F.col("_c"))), F.lit(0)).alias("_under"))
    missed = F.col("_at").isNotNull() & (F.col("_b").isNull() | (F.col("_under") > F.col("_at")))
    found = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")
    return agg.select(*keys, F.when(missed, F.raise_error(F.lit(f"the range of {name} misses its rank")).cast("double")).otherwise(
        found).alias(name))
