"""Named queries: readers and writers, each on files written from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenogrid.functions.columns import round_cols
from phenogrid.operators import features, metrics, tiles
from phenogrid.plans import evaluation as eplan
from phenogrid.plans import features as fplan
from phenogrid.plans import windows as wplan
from phenogrid.plans.registry import query
from phenogrid.schema import PANEL_SCHEMA, PROFILE
from phenogrid.session import scratch_path
from phenogrid.sources import readers, sinks
from phenogrid.sources import tables as t


def _doubles(df, digits=6):
    return round_cols(df, [c for c, ty in df.dtypes if ty == "double"], digits)


@query("a01_panel_from_csv")
def a01(spark, d):
    src = t.source_panel(spark, d)
    # file order differs from the contract's, and the file has columns the contract does not know
    cols = [f.name for f in PANEL_SCHEMA][::-1]
    path = sinks.write_csv(src.select("step", *cols), scratch_path(spark, "panel-csv"))
    return _doubles(readers.read_panel(spark, path))


def profiles(spark, d):
    panel = fplan.stored_panel(spark, d)
    train = panel.where("split = 'train'")
    df = panel.join(features.fit_quarterly(train), "mws_id").join(features.fit_phenology(train), "mws_id")
    return features.static_profiles(df, PROFILE)


@query("a02_static_lookup_from_tsv")
def a02(spark, d):
    path = sinks.write_csv(profiles(spark, d), scratch_path(spark, "lookup-tsv"), sep="\t")
    return _doubles(readers.read_static_lookup(spark, path))


@query("a03_manifest")
def a03(spark, d):
    loc = t.locations(spark, d).select(F.col("longitude").alias("lon"), "mws_id", F.col("latitude").alias("lat"))
    path = sinks.write_csv(loc, scratch_path(spark, "manifest"))
    return _doubles(readers.read_manifest(spark, path, limit=40))


@query("a04_embeddings_from_wide")
def a04(spark, d):
    emb = t.embeddings(spark, d)
    low, n = emb.select(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if low != n:
        raise ValueError(f"vectors of {low} to {n} entries")
    wide = emb.select(F.col("vec_id").alias("mws_id"), (F.lit(2000) + F.col("label")).alias("year"),
                      F.when(F.col("vec_id") % 3 == 0, "H1").alias("half"), *[F.col("embedding")[i].alias(f"e{i}") for i in reversed(range(n))])
    path = scratch_path(spark, "embeddings")
    wide.write.parquet(path)
    out = readers.read_embeddings(spark, path)
    return out.select("mws_id", "year", "half", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.round(F.col("x").cast("double") + 1e-9, 5))


@query("a05_tile_registry_from_names")
def a05(spark, d):
    names = wplan.tile_names(spark, d)
    report = tiles.registry_report(names)
    return tiles.registry_from_names(names).select("mws_id", "tile_year", "period").crossJoin(F.broadcast(report))


@query("a07_static_profiles")
def a07(spark, d):
    return _doubles(features.static_profiles(fplan.scaled_features(spark, d), PROFILE), 5)


@query("a08_first_test_predictions")
def a08(spark, d):
    return _doubles(sinks.first_predictions(eplan.scored(spark, d), t.locations(spark, d)))


@query("a09_evaluation_rows")
def a09(spark, d):
    """Every location and step of the grid: scored, or with the reason why not."""
    pairs = t.grid(spark, d).select("mws_id", F.col("date").alias("target_date"))
    return _doubles(sinks.evaluation_rows(pairs, eplan.scored(spark, d)))


@query("a09_evaluation_summary")
def a09b(spark, d):
    return sinks.summary_text(metrics.global_metrics(eplan.scored(spark, d))).select("n_samples", "summary")


@query("a10_tile_jobs")
def a10(spark, d):
    return sinks.tile_jobs(t.locations(spark, d).select("mws_id"), t.tile_years(spark, d), ["Q1", "Q2", "Q3", "Q4"])


@query("a11_job_outcomes")
def a11(spark, d):
    jobs = sinks.tile_jobs(t.locations(spark, d).select("mws_id"), t.tile_years(spark, d), ["Q1", "Q2", "Q3", "Q4"])
    cached = t.tiles(spark, d).withColumn("coverage", F.when(F.col("coverage") >= 0.05, F.col("coverage")))
    return sinks.job_outcomes(jobs, cached)


@query("a12_request_list")
def a12(spark, d):
    req = t.plots(spark, d).select("lat", "lon", F.when(F.col("plot_id") % 2 == 0, "2001-06-01").alias("date"))
    return _doubles(readers.read_requests(spark, sinks.write_csv(req, scratch_path(spark, "requests"))))
