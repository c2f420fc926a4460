"""Named queries: evaluation of forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenogrid.functions.columns import round_cols
from phenogrid.functions.dates import snap_to_grid
from phenogrid.operators import features, forecast, metrics, sweeps, tiles
from phenogrid.plans import features as fplan
from phenogrid.plans import windows as wplan
from phenogrid.plans.registry import query
from phenogrid.session import materialise, scratch_path
from phenogrid.sources import tables as t


def scored(spark, d):
    """Every sample with its forecast, persistence value and seasonal normal.

    Scores read it several times, and it reads the panel twice: the panel's few columns are stored once.
    """
    with t.sized(spark, d):
        panel = materialise(fplan.split_panel(spark, d).select(
            "mws_id", "date", "split", "NDVI", "precipitation", "temperature_2m"), "panel", bucket="mws_id")
    s = wplan.plain_samples(spark, d, panel).select("mws_id", "target_date", "split", F.col("target").alias("actual"), F.col("current_ndvi").alias("current"))
    quarterly = features.fit_quarterly(panel.where("split = 'train'"))
    return forecast.damped(forecast.quarter_climatology(s, quarterly, "target_date"))


def _rounded(df):
    return round_cols(df, [c for c, ty in df.dtypes if ty == "double"])


@query("g01_global_metrics")
def g01(spark, d):
    return _rounded(metrics.global_metrics(scored(spark, d)).drop("debiased_r2"))


@query("g02_debiased_r2")
def g02(spark, d):
    biased = scored(spark, d).withColumn("forecast", F.col("forecast") + 0.05)
    return _rounded(metrics.global_metrics(biased).select("n_samples", "bias", "debiased_r2"))


@query("g03_reference_skill")
def g03(spark, d):
    return _rounded(metrics.reference_metrics(scored(spark, d)))


@query("g04_median_location_r2")
def g04(spark, d):
    return _rounded(metrics.median_location_metrics(scored(spark, d)))


@query("g05_test_metrics")
def g05(spark, d):
    return _rounded(metrics.test_metrics(scored(spark, d)))


@query("g06_deseasonalised_r2")
def g06(spark, d):
    return _rounded(metrics.deseasonalised_metrics(scored(spark, d)))


@query("g07_best_and_worst")
def g07(spark, d):
    return _rounded(metrics.best_and_worst(scored(spark, d), 5))


@query("g08_chosen_series")
def g08(spark, d):
    s = scored(spark, d)
    out = metrics.chosen_series(s, metrics.best_and_worst(s, 5))
    return round_cols(out.select("mws_id", "train_start", "val_start", "test_start", F.posexplode("series").alias("pos", "p"))
                      .select("mws_id", "train_start", "val_start", "test_start", "pos", "p.*"), ["actual", "forecast"])


@query("g09_latency_report")
def g09(spark, d):
    return _rounded(metrics.latency_report(t.fetch_log(spark, d)))


@query("g10_two_path_parity")
def g10(spark, d):
    """Current value from the sample window against the as-of lookup at the window's end."""
    s = wplan.plain_samples(spark, d)
    by_window = s.select("mws_id", "target_date", F.col("current_ndvi").alias("current"), (F.col("current_ndvi") > 0.5).alias("green"))
    looked = forecast.persistence(s.select("mws_id", "target_date", "history_end"), fplan.split_panel(spark, d), "history_end")
    by_lookup = looked.select("mws_id", "target_date", "current", (F.col("current") > 0.5).alias("green"))
    return metrics.parity(by_window, by_lookup, ["mws_id", "target_date"], ["current"], ["green"])


def evaluator(spark, d):
    """Evaluation of pairs in one sweep: the sweep's fetch outcome of the location, then tile and actual value."""
    values = materialise(scored(spark, d).select("mws_id", "target_date", "actual", "forecast", "current", "clim"), "scored")
    log = materialise(t.fetch_log(spark, d).groupBy("mws_id", "sweep_no").agg(F.max_by("status", "event_id").alias("fetched")), "fetched")
    registry = t.tiles(spark, d)

    def evaluate(pairs, sweep):
        out = pairs.join(log.where(F.col("sweep_no") == sweep).drop("sweep_no"), "mws_id", "left")
        out = tiles.lookup_covered(out, registry, min_year=1997).join(values, sweeps.KEY, "left")
        status = F.when(F.col("fetched") != "OK", F.col("fetched")).when(~F.col("tile_found"), F.col("tile_status")) \
            .when(F.col("actual").isNull(), "ERROR: no actual NDVI at target").otherwise("OK")
        ok = F.col("status") == "OK"
        return out.withColumn("status", status).select(
            *sweeps.KEY, *[F.when(ok, F.col(c)).alias(c) for c in ("period", "tile_year", "actual", "forecast", "current", "clim")], "status")

    return evaluate


def settled(spark, d):
    """Every seeded pair on the grid, after up to three sweeps."""
    pairs = wplan.evaluation_pairs(t.locations(spark, d), 50, 10, "1998-01-01", 1000).select(
        "mws_id", snap_to_grid("target", t.EPOCH).alias("target_date"))
    return sweeps.sweep_until_settled(pairs, evaluator(spark, d), scratch_path(spark, "sweeps"), 3)


@query("a09_evaluation_sweeps")
def a09_sweeps(spark, d):
    """The seeded evaluation set with the latest attempt of each pair."""
    out = settled(spark, d).withColumn("abs_error", F.abs(F.col("forecast") - F.col("actual")))
    return _rounded(out.select("mws_id", "target_date", "period", "tile_year", "actual", "forecast", "current", "clim", "abs_error", "status", "attempts"))


@query("a09_sweep_outcomes")
def a09_outcomes(spark, d):
    return sweeps.error_modes(settled(spark, d))
