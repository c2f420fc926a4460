"""Streams: late and shuffled deliveries, restarts, and answers stored as intervals."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from phenogrid.operators import anomaly, forecast, intervals
from phenogrid.session import scratch_path
from phenogrid.streaming import jobs

DAY = date(2020, 1, 6)
CELLS = "mws_id string, step int, date date, missing boolean"


def deliver(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def plain_gaps(cells):
    out, gap = [], {}
    for mws, step, _, missing in sorted(cells):
        gap[mws] = gap.get(mws, 0) + 1 if missing else 0
        out.append((mws, step, gap[mws]))
    return out


def rows_of(spark, out):
    return sorted((r["mws_id"], r["step"], r["ndvi_gap_length"]) for r in spark.read.schema(jobs.GAP_OUTPUT).parquet(f"{out}/batch_id=*").collect())


def test_shuffled_steps_and_a_restart(spark):
    """Steps up to a step apart swap places, come twice, and the job stops after every delivery."""
    rnd = random.Random(4)
    cells = [(m, s, DAY + timedelta(days=14 * s), rnd.random() < 0.4) for m in ("a", "b", "c") for s in range(30) if rnd.random() < 0.9]
    src, out, ckpt = (scratch_path(spark, n) for n in ("gap-in", "gap-out", "gap-ckpt"))
    order = sorted(cells, key=lambda c: c[1] + rnd.choice([0, 1.5]))
    for at in range(0, len(order), 20):
        deliver(spark, order[at:at + 20] + order[max(0, at - 3):at], CELLS, src)
        with jobs.map_state_store(spark):
            jobs.run_available(jobs.gap_stream(jobs.file_stream(spark, src, spark.createDataFrame([], CELLS).schema)), out, ckpt)
    before = rows_of(spark, out)
    assert 0 < len(before) < len(cells) and set(before) < set(plain_gaps(cells))
    # a step far behind the watermark gives no row; the closing cell brings the rest
    deliver(spark, [("a", 0, DAY, False)], CELLS, src)
    jobs.closing_cell(spark, max(c[2] for c in cells)).write.mode("append").parquet(src)
    with jobs.map_state_store(spark):
        jobs.run_available(jobs.gap_stream(jobs.file_stream(spark, src, spark.createDataFrame([], CELLS).schema)), out, ckpt)
    assert rows_of(spark, out) == plain_gaps(cells)


class Store(dict):
    """State of one location in memory, counting what it holds."""

    def getMapState(self, name, key, value):
        held = self.setdefault(name, {})
        return type("M", (), {
            "updateValue": lambda _, k, v: held.__setitem__(k, v), "iterator": lambda _: iter(list(held.items())),
            "removeKey": lambda _, k: held.pop(k), "clear": lambda _: held.clear()})()

    def getValueState(self, name, schema):
        return type("V", (), {
            "exists": lambda _: name in self, "get": lambda _: self[name], "update": lambda _, v: self.__setitem__(name, v),
            "clear": lambda _: self.pop(name)})()

    def registerTimer(self, at):
        self["timer"] = at


def test_gap_state_stays_bounded_and_expires():
    import pandas as pd

    store, tracker = Store(), jobs.GapTracker(expire_days=100)
    tracker.init(store)
    got = []
    for s in range(200):
        due = pd.Timestamp(DAY) + pd.Timedelta(days=14 * s)
        list(tracker.handleInputRows(("m",), iter([pd.DataFrame({"step": [s], "missing": [s % 3 != 0], "due": [due]})]), None))
        now = type("T", (), {"getCurrentWatermarkInMs": lambda _: int((due - pd.Timedelta(days=30)).timestamp() * 1000)})()
        for frame in tracker.handleExpiredTimer(("m",), now, None):
            got += frame["step"].tolist()
        assert len(store["held"]) <= 4
    assert got == list(range(197))
    far = type("T", (), {"getCurrentWatermarkInMs": lambda _: int((due + pd.Timedelta(days=200)).timestamp() * 1000)})()
    for _ in range(2):
        for frame in tracker.handleExpiredTimer(("m",), far, None):
            got += frame["step"].tolist()
    assert got == list(range(200)) and not store["held"] and "known" not in store


def test_late_rows_are_counted_and_merged(spark):
    """Rows 60 days behind the newest one change the final table as if they had come in time; a repeated batch changes nothing."""
    start = datetime(2024, 1, 1)
    early = [("a", start + timedelta(days=i), float(i)) for i in range(100)]
    late = [("a", start + timedelta(days=30), 5.0), ("b", start + timedelta(days=33), None), ("b", None, 1.0)]
    src, out, ckpt = (scratch_path(spark, n) for n in ("late-in", "late-out", "late-ckpt"))
    schema = "mws_id string, ts timestamp, value double"
    writer = jobs.partial_writer(out, ["mws_id"], "ts", "value", "2024-01-01", delay_days=30)
    stream = lambda: jobs.file_stream(spark, src, spark.createDataFrame([], schema).schema)
    for rows in (early, late):
        deliver(spark, rows, schema, src)
        jobs.run_available(stream(), out, ckpt, writer=writer)
    writer(spark.createDataFrame(late, schema), 1)
    got = {(r["mws_id"], r["step_start"]): r for r in jobs.merged_partials(spark, out, ["mws_id"]).collect()}
    steps = {}
    for mws, ts, v in early + late[:2]:
        steps.setdefault((mws, date(2024, 1, 1) + timedelta(days=(ts - start).days // 14 * 14)), []).append(v)
    assert {k: r["n"] for k, r in got.items()} == {k: len(v) for k, v in steps.items()}
    assert sum(r["n_late"] for r in got.values()) == 2 and got["b", date(2024, 1, 29)]["mean_value"] is None
    assert got["a", date(2024, 1, 29)]["sum_value"] == pytest.approx(1000 * sum(steps["a", date(2024, 1, 29)]))


@pytest.fixture(scope="module")
def readings(spark):
    rnd = random.Random(8)
    rows = [(f"m{m}", DAY + timedelta(days=14 * s), rnd.random() if rnd.random() < 0.8 else None) for m in range(12) for s in range(260)]
    return spark.createDataFrame(rows, "mws_id string, date date, NDVI double")


def requests(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, f"m{rnd.randrange(14)}", DAY + timedelta(days=rnd.randrange(-400, 4200))) for i in range(300)] + [(900, None, DAY), (901, "m1", None)]
    return spark.createDataFrame(rows, "request_id int, mws_id string, anchor date").withColumn("target", F.date_add("anchor", 98))


def test_intervals_answer_like_the_history(spark, readings):
    asked = requests(spark, 1)
    path = scratch_path(spark, "answers")
    intervals.write_answers(readings, path, folders=5)
    got = intervals.look_up(asked, intervals.read_answers(spark, path, asked, folders=5), folders=5)
    plain = anomaly.seasonal_baseline(forecast.persistence(asked, readings, "anchor"), readings)
    cols = ["request_id", "current", "baseline_mean", "baseline_std", "baseline_n"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, plain.select(cols).collect()))
    assert got.where("baseline_mean is not null and current is not null").count() > 100


def test_a_batch_reads_only_its_folders_and_aggregates_nothing(spark, readings):
    path = scratch_path(spark, "answers")
    intervals.write_answers(readings, path, folders=50)
    one = requests(spark, 2).where("mws_id = 'm3'")
    stored = intervals.read_answers(spark, path, one, folders=50)
    found = intervals.look_up(one, stored, folders=50)
    scan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan and stored.select("folder").distinct().count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Window" not in plan


def test_refreshing_some_locations(spark, readings):
    path = scratch_path(spark, "answers")
    intervals.write_answers(readings, path, folders=7)
    more = readings.unionByName(spark.createDataFrame([("m2", DAY + timedelta(days=14 * 300), 0.9)], readings.schema))
    intervals.refresh_answers(more, path, more.where("mws_id = 'm2'"), folders=7)
    asked = requests(spark, 3)
    got = intervals.look_up(asked, intervals.read_answers(spark, path, folders=7), folders=7)
    plain = forecast.persistence(asked, more, "anchor")
    assert sorted(map(tuple, got.select("request_id", "current").collect())) == sorted(map(tuple, plain.select("request_id", "current").collect()))
    assert spark.read.parquet(path).count() == 12
