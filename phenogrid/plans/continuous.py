"""Named queries: the streaming jobs, run to the end of their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenogrid.functions.columns import round_cols
from phenogrid.functions.dates import snap_to_grid
from phenogrid.operators import anomaly, intervals, spatial
from phenogrid.plans import outlook
from phenogrid.plans import panel as pplan
from phenogrid.plans.registry import query
from phenogrid.plans.spatial import study_locations
from phenogrid.session import cut_lineage, materialise, scratch_path
from phenogrid.sources import tables as t
from phenogrid.streaming import jobs

EVENT_EPOCH = "2024-01-01"


def _files(spark) -> int:
    """Files per delivery: as many as there are shuffle partitions, so no task writes it alone."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)


@query("k01_streaming_fortnights")
def k01(spark, d):
    src, out, ckpt = (scratch_path(spark, n) for n in ("k01-in", "k01-out", "k01-ckpt"))
    events = t.table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("mws_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    n = _files(spark)
    events.repartitionByRange(n, "ts").sortWithinPartitions("ts").write.parquet(src)
    stream = jobs.file_stream(spark, src, events.schema, files_per_batch=n // 2)
    jobs.run_available(jobs.fortnight_stream(stream, "mws_id", "ts", "value", EVENT_EPOCH), out, ckpt, mode="update")
    return round_cols(jobs.latest_per_key(spark, out, ["mws_id", "step_start"]), ["mean_value", "sum_value"])


def arriving_requests(spark, d):
    """Every plot asks once, with one of three as-of dates; every fifth request is sent twice."""
    req = t.plots(spark, d).select(
        F.col("plot_id").alias("request_id"), "lat", "lon",
        F.expr("date_add(date'2000-01-10', cast(plot_id % 3 as int) * 100)").alias("as_of"),
        F.expr("timestamp_seconds(946684800 + plot_id)").alias("received"))
    return req.unionByName(req.where("request_id % 5 = 0"))


@query("k02_streaming_requests")
def k02(spark, d):
    src, out, ckpt = (scratch_path(spark, n) for n in ("k02-in", "k02-out", "k02-ckpt"))
    arrived = arriving_requests(spark, d)
    n = _files(spark)
    arrived.repartition(n, "received").write.parquet(src)
    known = scratch_path(spark, "k02-answers")
    intervals.write_answers(outlook.panel(spark, d).select("mws_id", "date", "NDVI"), known)
    where = study_locations(spark, d).select("mws_id", "latitude", "longitude")

    def answer(batch):
        placed = cut_lineage(spatial.nearest_profile(batch, where, ["mws_id"]))
        dated = placed.withColumn("anchor", snap_to_grid("as_of", t.EPOCH)).withColumn("target", F.date_add("anchor", 98))
        found = intervals.look_up(dated, intervals.read_answers(spark, known, placed))
        return anomaly.indicators(found, "current").select(
            "request_id", "mws_id", "anchor", "target", "forecast_ndvi", "z", "condition")

    jobs.answer_requests(jobs.file_stream(spark, src, arrived.schema, files_per_batch=n // 2), answer, out, ckpt)
    return spark.read.parquet(out).drop("batch_id")


@query("k03_streaming_reliability")
def k03(spark, d):
    """Steps come in three deliveries, each with a share of later and earlier ones mixed in, and a closing cell."""
    src, out, ckpt = (scratch_path(spark, n) for n in ("k03-in", "k03-out", "k03-ckpt"))
    cells = materialise(pplan.history(spark, d).select("mws_id", "step", "date", F.col("NDVI").isNull().alias("missing")), "cells")
    last = cells.agg(F.max("date"), F.max("step")).first()
    delivery = F.floor((F.col("step") + F.pmod(F.xxhash64("mws_id", "step"), F.lit(2))) * 3 / (last[1] + 2)).cast("int")
    shape = cells.schema
    for i in range(3):
        cells.where(delivery == i).repartition(_files(spark), "mws_id").write.mode("append").parquet(src)
    jobs.closing_cell(spark, last[0]).write.mode("append").parquet(src)
    stream = jobs.file_stream(spark, src, shape, files_per_batch=_files(spark))
    with jobs.map_state_store(spark):
        jobs.run_available(jobs.gap_stream(stream), out, ckpt)
    return round_cols(spark.read.schema(jobs.GAP_OUTPUT).parquet(f"{out}/batch_id=*"), ["sensor_reliability"])


@query("k01_late_observations")
def k01b(spark, d):
    """Observations delivered regardless of their time: far behind the newest one, many come late, and none is lost."""
    src, out, ckpt = (scratch_path(spark, n) for n in ("k01b-in", "k01b-out", "k01b-ckpt"))
    events = t.table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("mws_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    n = _files(spark)
    events.repartition(n, "mws_id", "value").write.parquet(src)
    stream = jobs.file_stream(spark, src, events.schema, files_per_batch=max(n // 4, 1))
    jobs.run_available(stream, out, ckpt, writer=jobs.partial_writer(out, ["mws_id"], "ts", "value", EVENT_EPOCH, delay_days=7))
    return round_cols(jobs.merged_partials(spark, out, ["mws_id"]).drop("n_late"), ["mean_value", "sum_value"])
