"""Writers of results and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, sep: str = ",") -> str:
    df.write.option("header", True).option("sep", sep).csv(path)
    return path


def write_panel(df: DataFrame, path: str, by_year: bool = True) -> str:
    """Panel as Parquet, one folder per year so that date filters prune files.

    Rows of one location are kept together inside a year: range-partitioned, so a location with
    many rows spreads over files instead of filling one.
    """
    out = df.withColumn("year", F.year("date"))
    writer = out.repartitionByRange("year", "mws_id", "date").write
    (writer.partitionBy("year") if by_year else writer).parquet(path)
    return path


def first_predictions(scored: DataFrame, locations: DataFrame, n: int = 200) -> DataFrame:
    """The first n test predictions with their position, paired by location key."""
    test = scored.where("split = 'test'").select("mws_id", "target_date", "actual", "forecast")
    return test.join(locations.select("mws_id", "latitude", "longitude"), "mws_id").orderBy("mws_id", "target_date").limit(n)


def evaluation_rows(pairs: DataFrame, scored: DataFrame) -> DataFrame:
    """One row per wanted (location, target): scored, or with the reason why not."""
    have = scored.select("mws_id", "target_date", "actual", "forecast", "current", "clim")
    out = pairs.join(have, ["mws_id", "target_date"], "left")
    return out.withColumns({
        "abs_error": F.abs(F.col("forecast") - F.col("actual")),
        "status": F.when(F.col("actual").isNull(), "ERROR: no actual NDVI at target").otherwise("OK")})


def summary_text(metrics: DataFrame) -> DataFrame:
    """Metrics row as the one-line report."""
    f4 = lambda c: F.format_string("%.4f", c)
    return metrics.withColumn("summary", F.concat(
        F.lit("paired n="), F.col("n_samples").cast("string"), F.lit(" | R2 "), f4("global_r2"), F.lit(" | MAE "), f4("mae"),
        F.lit(" | RMSE "), f4("rmse"), F.lit(" | bias "), F.format_string("%+.4f", "bias"), F.lit(" | corr "), F.format_string("%.3f", "corr")))


def tile_jobs(manifest: DataFrame, years: list[int], quarters: list[str]) -> DataFrame:
    """Download jobs: every location x year x quarter (a plain explode, no join)."""
    return manifest.withColumn("tile_year", F.explode(F.array(*[F.lit(y) for y in years]))) \
        .withColumn("period", F.explode(F.array(*[F.lit(q) for q in quarters])))


def job_outcomes(jobs: DataFrame, tiles: DataFrame, min_coverage: float = 0.75) -> DataFrame:
    """ok / low coverage / failed counts; an existing tile without measured coverage is ok."""
    have = tiles.select("mws_id", "tile_year", "period", "coverage", F.lit(True).alias("_have"))
    done = jobs.join(have, ["mws_id", "tile_year", "period"], "left")
    outcome = F.when(F.col("_have").isNull(), "failed").when(F.col("coverage") < min_coverage, "low_coverage").otherwise("ok")
    return done.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))
