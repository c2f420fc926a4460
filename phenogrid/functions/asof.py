"""As-of join: for every (key, date) the latest row at or before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str,
              payload: list[str]) -> DataFrame:
    """``left`` plus the ``payload`` of the latest ``right`` row with ``right_on <= left_on``.

    Both sides go into one sorted window instead of a range join, so no pairs are formed. The
    left side is reduced to its distinct (key, date) first: a location that is asked for very
    often costs one window row per date, and the answer is joined back by equality.
    """
    asked = left.select(*keys, F.col(left_on).alias("_on")).distinct()
    known = right.where(F.col(right_on).isNotNull()).select(
        *keys, F.col(right_on).alias("_on"), F.struct(*payload).alias("_p"))
    both = asked.withColumn("_ask", F.lit(1)).unionByName(known.withColumn("_ask", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_on", "_ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    answers = both.withColumn("_p", F.last("_p", ignorenulls=True).over(w)).where("_ask = 1") \
        .select(*keys, F.col("_on").alias(left_on), "_p")
    return left.join(answers, [*keys, left_on], "left").select(
        *[left[c] for c in left.columns], *[F.col("_p")[c].alias(c) for c in payload])
