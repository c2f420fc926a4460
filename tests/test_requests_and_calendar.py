"""Requests without data keep their row; the calendar follows the observations."""

from datetime import date, datetime

from pyspark.sql import functions as F

from phenogrid.operators import area, message, rules
from phenogrid.plans import outlook
from phenogrid.session import scratch_path
from phenogrid.sources import tables as t


def test_every_request_has_a_row_and_a_status(spark):
    day = date(2000, 1, 3)
    rows = [(f"m{i}", day, date(2000, 4, 10), i, "d1" if i < 4 else "d2", "t", 10.0 + i, 77.0, z)
            for i, z in enumerate([-1.4, -0.2, 0.3, None, None])]
    pts = spark.createDataFrame(rows, "mws_id string, anchor date, target date, loc_no long, district string, tehsil string, latitude double, longitude double, z double")
    areas = area.summarise(pts, ["district", "anchor"])
    views = spark.createDataFrame([("m0", day, 0.9), ("m1", day, 0.2)], "mws_id string, anchor date, clear_view double")
    trends = spark.createDataFrame([("m0", day, "declining")], "mws_id string, anchor date, trend string")
    facts = outlook.assemble(pts, areas, views, trends)
    got = {r["mws_id"]: r for r in outlook.answered(facts, lambda f: rules.decide(f, rules.default_rules(spark))).collect()}
    assert {m: r["status"] for m, r in got.items()} == {**dict.fromkeys(("m0", "m1", "m2"), "ok"), **dict.fromkeys(("m3", "m4"), "no data at the plot")}
    assert got["m0"]["matched"] is not None and got["m0"]["trend"] == "declining" and got["m1"]["trend"] == "unknown"
    for m in ("m3", "m4"):
        assert got[m]["matched"] is None and got[m]["attribution"] is None and got[m]["effective_confidence"] is None and got[m]["lens"] is None
    assert got["m3"]["n"] == 3 and got["m4"]["n"] is None
    told = message.render(outlook.answered(facts, lambda f: rules.decide(f, rules.default_rules(spark)))).select("mws_id", "status", "message").collect()
    assert len(told) == 5 and all(r["message"] for r in told if r["status"] == "ok")


def test_every_state_is_listed_once(spark):
    states = outlook.j12(spark, "/root/testdata/sf0.001").collect()
    assert len(states) == 72 == len({(r["attribution"], r["regime"], r["severity"], r["effective_confidence"]) for r in states})
    assert sum(r["n_rows"] for r in states) > 0 and all(r["n_rules"] <= 1 for r in states)


def written(spark, days):
    path = scratch_path(spark, "calendar")
    spark.createDataFrame([(d,) for d in days], "l_shipdate timestamp").write.parquet(f"{path}/lineitem.parquet")
    return path


def test_calendar_reaches_the_last_observation(spark):
    path = written(spark, [datetime(1994, 12, 20), datetime(1996, 5, 1), None, datetime(2030, 1, 1)])
    steps = spark.range(1).select(t.calendar(spark, path).alias("s")).first()["s"]
    first, last = ((d - date.fromisoformat(t.EPOCH)).days // 14 for d in (date(1994, 12, 20), date(2030, 1, 1)))
    assert (steps[0], steps[-1], len(steps)) == (first, last, last - first + 1) and first == -1
    assert t.tile_years(spark, path) == list(range(1995, 2031))
    empty = written(spark, [])
    assert spark.range(1).select(F.explode(t.calendar(spark, empty))).collect() == [] and t.tile_years(spark, empty) == []
