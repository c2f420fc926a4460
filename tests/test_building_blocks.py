"""Helpers against brute force, with skewed groups."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenogrid.functions import dates, geo, quantiles
from phenogrid.functions.asof import asof_join
from phenogrid.functions.quantiles import exact_quantiles
from phenogrid.functions.ranking import global_rank
from phenogrid.operators import impute, spatial
from phenogrid.sources import readers, sinks
from phenogrid.session import scratch_path


def test_exact_quantiles_with_a_hot_group(spark):
    """One group holds most rows (more than the sketch keeps exactly), one is tiny, one is constant."""
    df = spark.range(60000).select(
        F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") < 30, "tiny").when(F.col("id") % 10 == 8, "flat").otherwise("other").alias("g"),
        F.when(F.col("id") % 10 == 8, 1.5).otherwise(F.pmod(F.col("id") * 7919, F.lit(50021)) / 7.0).alias("v"))
    got = {r.g: (r.m, r.p) for r in exact_quantiles(df, ["g"], "v", {"m": 0.5, "p": 0.99}).collect()}
    pdf = df.toPandas()
    for g, sub in pdf.groupby("g"):
        assert got[g] == pytest.approx((sub.v.quantile(0.5), sub.v.quantile(0.99)), abs=1e-9), g
    whole = exact_quantiles(df, [], "v", {"m": 0.5}).first().m
    assert whole == pytest.approx(pdf.v.quantile(0.5), abs=1e-9)


@pytest.mark.parametrize("limit", [5, 200])
def test_quantile_ranges_are_narrowed(spark, limit):
    """Ranges with more distinct values than may be ordered shrink without losing the rank."""
    df = spark.range(40000).select(
        F.when(F.col("id") % 4 == 0, "ties").when(F.col("id") % 4 == 1, "small_steps").otherwise("hot").alias("g"),
        F.when(F.col("id") % 8 == 0, 2.0).otherwise(F.pmod(F.col("id") * 7919, F.lit(39989)) / 13.0).alias("v"))
    got = {r.g: (r.m, r.p, r.z) for r in exact_quantiles(df, ["g"], "v", {"m": 0.5, "p": 0.9, "z": 0.0}, ordered_values=limit).collect()}
    for g, sub in df.toPandas().groupby("g"):
        assert got[g] == pytest.approx(tuple(sub.v.quantile([0.5, 0.9, 0.0])), abs=1e-9), g


@pytest.mark.parametrize("low, high", [(0.0, 30.0), (70.0, 99.0)])
def test_a_range_that_misses_its_rank_is_an_error(spark, low, high):
    vals = spark.range(100).selectExpr("'a' AS g", "CAST(id AS double) AS _v")
    at = lambda lo, hi: spark.createDataFrame([("a", 100, lo, hi)], "g string, _n long, _lo double, _hi double")
    assert quantiles._rank_inside(vals, at(40.0, 60.0), ["g"], "m", 0.5, True).first().m == 49.5
    with pytest.raises(Exception, match="misses its rank"):
        quantiles._rank_inside(vals, at(low, high), ["g"], "m", 0.5, True).collect()


def test_exact_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert exact_quantiles(empty, ["g"], "v", {"m": 0.5}).count() == 0
    assert exact_quantiles(empty, [], "v", {"m": 0.5}).collect()[0].m is None


def test_global_rank_is_a_permutation_in_order(spark):
    df = spark.range(1000).select((F.pmod(F.col("id") * 37, F.lit(1000))).alias("k"))
    rows = global_rank(df, ["k"], "pos").collect()
    assert sorted((r.k, r.pos) for r in rows) == [(i, i) for i in range(1000)]


def brute(sites, targets, k, max_km):
    out = set()
    for s, (la, lo) in sites.items():
        d = []
        for t, (a, o) in targets.items():
            p1, p2 = math.radians(la), math.radians(a)
            h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(o - lo) / 2) ** 2
            d.append((2 * 6371.0 * math.asin(math.sqrt(h)), t))
        out |= {(s, t, i) for i, (km, t) in enumerate(sorted(d)[:k], 1) if max_km is None or km <= max_km}
    return out


@pytest.mark.parametrize("k, max_km, start", [(1, None, 1.0), (5, None, 1.0), (12, 80.0, 5.0), (3, 5.0, 5.0)])
def test_nearest_k_against_brute_force(spark, k, max_km, start):
    """A dense cluster with most targets, scattered ones, the date line and a pole."""
    rng = np.random.default_rng(1)
    cluster = rng.normal([20, 77], 0.05, (300, 2))
    wide = np.column_stack([rng.uniform(-80, 80, 60), rng.uniform(-180, 180, 60)])
    edge = np.array([[0.0, 179.99], [0.01, -179.98], [89.9, 10.0], [89.9, -170.0]])
    targets = {i: tuple(map(float, p)) for i, p in enumerate(np.vstack([cluster, wide, edge]))}
    sites = {i: p for i, p in enumerate([(20.0, 77.0), (20.3, 77.4), (-33.0, 151.0), (0.0, -179.99), (89.95, 100.0), (20.05, 77.01)])}
    s = spark.createDataFrame([(i, *p) for i, p in sites.items()], "sid int, lat double, lon double")
    t = spark.createDataFrame([(i, *p) for i, p in targets.items()], "tid int, clat double, clon double")
    got = {(r.sid, r.tid, r["rank"]) for r in spatial.nearest_k(s, ["sid"], t, "tid", k, max_km=max_km, start_km=start).collect()}
    assert got == brute(sites, targets, k, max_km)


def test_polygon_with_hole_like_second_ring(spark):
    ring = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]
    polys = spark.createDataFrame([(1, [ring(0.0, 0.0, 1.0), ring(0.4, 0.4, 0.2)]), (2, [ring(0.3, 0.3, 2.0)])],
                                  "no int, rings array<array<struct<lon:double,lat:double>>>")
    pts = spark.createDataFrame([(0.1, 0.1), (0.5, 0.5), (0.7, 0.7), (3.0, 3.0)], "lon double, lat double")
    got = {(r.lon, r.lat): r.no for r in spatial.containing_polygon(pts, polys, "no", ["no"]).collect()}
    assert got == {(0.1, 0.1): 1, (0.5, 0.5): 2, (0.7, 0.7): 1, (3.0, 3.0): None}


def test_ring_centre(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (2.0, 0.0), (2.0, 4.0), (0.0, 4.0), (0.0, 0.0)],)], "ring array<struct<lon:double,lat:double>>")
    assert tuple(df.select(*geo.ring_centre("ring")).first()) == (1.0, 2.0)


def test_asof_join_keeps_every_request(spark):
    d = dt.date
    left = spark.createDataFrame([("a", d(2020, 1, 5), i) for i in range(50)] + [("a", d(2019, 1, 1), 99), ("b", d(2020, 1, 1), 100)], "k string, on date, i int")
    right = spark.createDataFrame([("a", d(2020, 1, 1), 1.0), ("a", d(2020, 1, 5), 2.0), ("a", d(2020, 1, 6), 3.0)], "k string, day date, v double")
    got = {r.i: r.v for r in asof_join(left, right, ["k"], "on", "day", ["v"]).collect()}
    assert len(got) == 52 and got[0] == 2.0 and got[99] is None and got[100] is None


def test_dates(spark):
    df = spark.createDataFrame([("2017-07-01",), ("2017-07-14",), ("2017-06-30",), ("2024-02-30",), ("2031-01-01",), ("nonsense",), (None,)], "t string")
    rows = dates.resolve_forecast_dates(df, "t", "2025-01-01").collect()
    assert [r.date_status for r in rows] == ["OK", "OK", "OK", "INVALID_DATE", "FUTURE_DATE", "INVALID_DATE", "OK"]
    assert [str(r.anchor) for r in rows[:3]] == ["2017-07-01", "2017-07-01", "2017-06-17"]
    assert (rows[0].target - rows[0].anchor).days == 98


def test_imputation_is_sequential(spark):
    """State medians see the district fill: a rollup over the raw rows would give another number."""
    rows = [("a", "d1", "s1", 1.0), ("b", "d1", "s1", None), ("b", "d1", "s1", None), ("b", "d1", "s1", None), ("c", "d2", "s1", 9.0), ("c", "d2", "s1", 9.0),
            ("e", "d3", "s1", None), ("f", "d4", "s2", None)]
    df = spark.createDataFrame(rows, "mws_id string, district string, state string, et double")
    fits = impute.fit_imputation(df, ["et"])
    assert [f.level for f in fits] == ["mws_id", "district", "state", None]
    got = {r.mws_id: r.et for r in impute.apply_imputation(df, fits).select("mws_id", "et").distinct().collect()}
    assert got == {"a": 1.0, "b": 1.0, "c": 9.0, "e": 1.0, "f": 1.0}


def test_readers_by_name(spark):
    df = spark.createDataFrame([(78.3, "m1", 20.1, "x")], "lon double, mws_id string, lat double, extra string")
    path = sinks.write_csv(df, scratch_path(spark, "t-manifest"))
    assert tuple(readers.read_manifest(spark, path).first()) == ("m1", 20.1, 78.3)
    bad = sinks.write_csv(df.drop("lat"), scratch_path(spark, "t-manifest"))
    with pytest.raises(ValueError, match="lat"):
        readers.read_manifest(spark, bad)
    assert readers.detect_separator(spark, sinks.write_csv(df, scratch_path(spark, "t-tsv"), sep="\t")) == "\t"
