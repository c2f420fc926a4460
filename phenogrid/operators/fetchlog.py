"""Jobs over the log of fetch attempts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Markers searched in lower-cased error texts.
RATE_LIMIT_MARKERS = [
    "429", "too many requests", "rate limit", "user rate limit", "quota", "resource exhausted",
    "rate_limit_exceeded",
]
TRANSIENT_MARKERS = [
    "coverage_fraction", "missing columns", "permission", "quota", "rate limit", "ratelimit",
    "429", "500", "502", "503", "504", "timed out", "timeout", "deadline", "temporarily",
    "unavailable", "connection", "reset by peer", "eof occurred", "all-nan", "returned no data",
    "returned zero rows", "partial fetch", "access was denied", "denied mid-batch",
    "access denied", "no satellite coverage",
]
TERMINAL_MARKERS = ["no actual NDVI at target", "no quarterly tile"]


def has_any(text: Column, markers) -> Column:
    """Plain substring search: much cheaper than one alternation pattern over long texts."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in markers])


def is_rate_limit(message: Column) -> Column:
    return has_any(F.lower(message), RATE_LIMIT_MARKERS)


def is_transient(message: Column) -> Column:
    return has_any(F.lower(message), TRANSIENT_MARKERS)


def is_terminal(status: Column) -> Column:
    return has_any(status, TERMINAL_MARKERS)


def failure_class(status: Column) -> Column:
    return (F.when(status == "OK", "ok").when(is_terminal(status), "terminal")
            .when(is_rate_limit(status), "rate_limit").when(is_transient(status), "transient").otherwise("other"))


def failure_counts(log: DataFrame) -> DataFrame:
    return log.groupBy(failure_class(F.col("status")).alias("failure_class")).agg(
        F.count("*").alias("n"), F.count_if(F.col("attempts") > 1).alias("n_retried"))


def latest_attempt(log: DataFrame) -> DataFrame:
    """Last sweep per (location, target); combined map-side, whatever the number of attempts."""
    best = F.max_by(F.struct("sweep_no", "status", "attempts", "query_time_s"), F.struct("sweep_no", "event_id"))
    return log.groupBy("mws_id", "target").agg(best.alias("_b")).select("mws_id", "target", "_b.*")


def requeue(log: DataFrame) -> DataFrame:
    return latest_attempt(log).where((F.col("status") != "OK") & ~is_terminal(F.col("status")))


def throttle_report(log: DataFrame, workers: int = 13) -> DataFrame:
    """Throttles, dropped points and the suggested concurrency per request."""
    suggested = max(2, workers // 2)
    per = log.groupBy("mws_id", "target").agg(
        F.count("*").alias("n_points"), F.count_if(is_rate_limit(F.col("status"))).alias("throttles"),
        F.count_if(F.col("status") != "OK").alias("dropped"))
    n = lambda c: F.col(c).cast("string")
    text = F.concat(n("throttles"), F.lit(" of "), n("n_points"), F.lit(" fetches were throttled and "), n("dropped"),
                    F.lit(f" gave no point; {suggested} workers instead of {workers} may avoid this."))
    return per.where("throttles > 0").withColumns({"suggested_workers": F.lit(suggested), "warning": text})
