"""Evaluation in sweeps: what failed for a passing reason is tried again until nothing is left to try.

Each sweep appends one folder of attempts; the latest attempt of a pair counts. A sweep's folder is complete or
absent for its readers, so a run that was killed and is repeated goes on where the finished sweeps ended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phenogrid.operators.fetchlog import is_terminal

KEY = ["mws_id", "target_date"]
NOT_EVALUATED = "ERROR: not evaluated"
DONE = "sweep int, n long"


def finished_sweeps(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the sweeps whose marker was written, in order."""
    try:
        return sorted(r["sweep"] for r in spark.read.schema(DONE).parquet(f"{path}/done/*").collect())
    except AnalysisException as gone:
        if gone.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def attempts(spark: SparkSession, path: str) -> DataFrame | None:
    """All attempts of the finished sweeps; None before the first."""
    done = finished_sweeps(spark, path)
    return spark.read.parquet(*[f"{path}/attempts/{n}" for n in done]) if done else None


def latest(tries: DataFrame) -> DataFrame:
    """The last attempt of each pair and how often it was tried; one map-side combined aggregate, no sort."""
    values = [c for c in tries.columns if c not in (*KEY, "sweep")]
    return tries.groupBy(*KEY).agg(F.max_by(F.struct(*values), "sweep").alias("_v"), F.count("*").alias("attempts")).select(*KEY, "_v.*", "attempts")


def is_settled(status: Column) -> Column:
    """A result, or a failure that another sweep can't change."""
    return F.coalesce((status == "OK") | is_terminal(status), F.lit(False))


def pending(pairs: DataFrame, tries: DataFrame | None) -> DataFrame:
    """Pairs that were never tried or whose last attempt may still succeed."""
    if tries is None:
        return pairs
    settled = latest(tries).where(is_settled(F.col("status"))).select(*KEY)
    return pairs.join(settled, KEY, "left_anti")


def sweep_until_settled(pairs: DataFrame, evaluate: Callable[[DataFrame, int], DataFrame], path: str, sweeps: int = 3) -> DataFrame:
    """The latest attempt of every pair after at most ``sweeps`` sweeps.

    ``evaluate(pairs, sweep)`` gives one row per pair, with a ``status``; a pair without a row stays pending. Repeated
    pairs count once. Sweeps stop early when nothing is pending. A pair that never got a row has the status
    'ERROR: not evaluated' and no attempts.
    """
    spark = pairs.sparkSession
    pairs = pairs.dropDuplicates(KEY)
    done = finished_sweeps(spark, path)
    for n in range(max(done, default=0) + 1, sweeps + 1):
        left = pending(pairs, attempts(spark, path))
        if left.isEmpty():
            break
        target = f"{path}/attempts/{n}"
        # an unfinished folder of an earlier run is replaced; the marker comes last
        evaluate(left, n).withColumn("sweep", F.lit(n)).write.mode("overwrite").parquet(target)
        count = spark.read.parquet(target).count()
        spark.createDataFrame([(n, count)], DONE).coalesce(1).write.mode("overwrite").parquet(f"{path}/done/{n}")
    tries = attempts(spark, path)
    if tries is None:
        return pairs.withColumns({"status": F.lit(NOT_EVALUATED), "attempts": F.lit(0).cast("long")})
    out = pairs.join(latest(tries), KEY, "left")
    return out.withColumns({"status": F.coalesce("status", F.lit(NOT_EVALUATED)), "attempts": F.coalesce("attempts", F.lit(0).cast("long"))})


def error_modes(settled: DataFrame) -> DataFrame:
    """How often each outcome occurred, and how many of those pairs took more than one attempt."""
    return settled.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("attempts") > 1).alias("n_retried"))
