"""Answers from a stored bundle: versions, statuses, no look ahead, and a plain recomputation."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenogrid.operators import forecast, serving
from phenogrid.schema import CATEGORICAL, DYNAMIC, PROFILE, QUARTER_MEANS, RADIATION, SCALED, WEATHER, WIND, WINDOW
from phenogrid.session import scratch_path

DAY = date(1995, 1, 2)
SERVED, STATIC = ["NDVI", "temp_precip_idx", "months_from_peak"], ["latitude", "peak_month"]
COLUMNS = [*WEATHER, *WIND]


def at(step):
    return DAY + timedelta(days=14 * step)


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(3)
    rows = []
    for place, n in (("a", 60), ("b", 40), ("c", 10), ("dry", 40)):
        for k in range(n):
            values = [None if rnd.random() < 0.15 else rnd.uniform(0.1, 0.9) for _ in COLUMNS]
            if place == "dry":
                values[0] = None
            rows.append((place, at(k), *values))
    history = spark.createDataFrame(rows, "mws_id string, date date, " + ", ".join(f"{c} double" for c in COLUMNS))
    scaler = spark.createDataFrame([tuple(x for i in range(len(SCALED)) for x in (0.01 * i, 1.0 + 0.1 * i))],
                                   ", ".join(f"{c}_mu double, {c}_sd double" for c in SCALED))
    profile = lambda key, lat: (key, lat, 77.0, *[0.1 * i for i in range(len(PROFILE) - 3)])
    profiles = spark.createDataFrame([profile("p", 10.0), profile("q", 40.0)], "mws_id string, " + ", ".join(f"{c} double" for c in PROFILE[1:]))
    codes = spark.createDataFrame([("state", "s", 3), ("mws_id", "b", 1)], "column string, value string, code int")
    caps = spark.createDataFrame([(1.0, 1.0)], ", ".join(f"{c}_cap double" for c in RADIATION))
    size = WINDOW * len(SERVED)
    samples = spark.createDataFrame([
        ("train", [[rnd.random() for _ in SERVED] for _ in range(WINDOW)], rnd.random(), rnd.random(), rnd.random(), rnd.random(), rnd.random(), rnd.random())
        for _ in range(size + 40)], "split string, history array<array<double>>, target double, current_ndvi double, latitude double, "
        "peak_month double, forecast_precip_sum double, forecast_temp_mean double")
    model = forecast.residual_model(samples, STATIC, "linear")
    requests = spark.createDataFrame(
        [(m, lat, 77.0, "s", "d", "t", at(k), at(k + 7), at(k) + timedelta(days=3)) for m, lat, k in (
            ("a", 11.0, 30), ("a", 11.0, 45), ("a", 11.0, 10), ("b", 39.0, 39), ("c", 12.0, 9), ("dry", 12.0, 39), ("none", 12.0, 30), ("b", None, 20))]
        + [("a", 11.0, 77.0, "s", "d", "t", at(30), at(37), at(30))],
        "mws_id string, latitude double, longitude double, state string, district string, tehsil string, anchor date, target date, as_of date")
    weather = spark.createDataFrame([("a", at(30), [0.1, 0.2], [280.0, 290.0]), ("b", at(39), [], None)],
                                    "mws_id string, anchor date, precip_steps array<double>, temp_steps array<double>")
    return {"history": history, "requests": requests, "weather": weather, "model": model,
            "tables": {"scaler": scaler, "codes": codes, "caps": caps, "profiles": profiles}}


@pytest.fixture(scope="module")
def path(spark, tables):
    root = scratch_path(spark, "bundles")
    serving.save_bundle(root, "1", tables["model"], tables["tables"], "linear", SERVED, STATIC)
    return root


@pytest.fixture(scope="module")
def first(spark, tables, path):
    return answers(spark, tables, path)


def answers(spark, tables, path, history=None):
    out = serving.serve(tables["requests"], tables["history"] if history is None else history, tables["weather"], serving.load_bundle(spark, path))
    return sorted(((r["mws_id"], r["anchor"], r["status"], r["n_rows"], r["forecast"], r["profile_id"], r["as_of"]) for r in out.collect()), key=str)


def test_versions(spark, tables, path):
    assert serving.versions(spark, path) == ["1"] and serving.versions(spark, path + "-none") == []
    tables["tables"]["scaler"].write.parquet(f"{path}/2/scaler")  # training was killed here
    assert serving.load_bundle(spark, path).version == "1"
    with pytest.raises(ValueError):
        serving.load_bundle(spark, path, "2")
    with pytest.raises(ValueError):
        serving.save_bundle(path, "1", tables["model"], tables["tables"], "linear", SERVED, STATIC)
    serving.save_bundle(path, "2", tables["model"], tables["tables"], "linear", SERVED, STATIC)
    assert serving.load_bundle(spark, path).version == "2" and serving.load_bundle(spark, path, "1").version == "1"


def test_every_request_has_a_status(first):
    got = first
    assert len(got) == 9
    status = {(m, a): s for m, a, s, *_ in got}
    assert status == {("a", at(30)): "OK", ("a", at(45)): "OK", ("a", at(10)): "INSUFFICIENT_HISTORY", ("b", at(39)): "OK", ("c", at(9)): "INSUFFICIENT_HISTORY",
                      ("dry", at(39)): "NO_VALUE", ("none", at(30)): "NO_HISTORY", ("b", at(20)): "INSUFFICIENT_HISTORY"}
    assert all((f is not None) == (s == "OK") and (f is None or 0 <= f <= 1) for _, _, s, _, f, *_ in got)
    assert {m: p for m, _, _, _, _, p, _ in got if p} == {"a": "p", "b": "q", "c": "p", "dry": "p", "none": "p"}


def test_a_fresh_session_gives_the_same_numbers(spark, tables, path, first):
    other = spark.newSession()
    bundle = serving.load_bundle(other, path, "1")
    moved = {k: other.createDataFrame(tables[k].collect(), tables[k].schema) for k in ("requests", "history", "weather")}
    again = serving.serve(moved["requests"], moved["history"], moved["weather"], bundle).select("mws_id", "anchor", "as_of", "forecast").collect()
    assert {(r["mws_id"], r["anchor"], r["as_of"]): r["forecast"] for r in again} == {(m, a, z): f for m, a, _, _, f, _, z in first}


def test_later_rows_have_no_influence(spark, tables, path, first):
    late = F.col("date") > F.lit(at(30))
    changed = tables["history"].withColumns({c: F.when(late, F.lit(77.0)).otherwise(F.col(c)) for c in COLUMNS})
    old, new = first, answers(spark, tables, path, changed)
    pick = lambda rows: [x for x in rows if x[1] <= at(30)]
    assert pick(old) == pick(new) and old != new


def test_forecast_equals_a_plain_recomputation(tables, first):
    """The window, the statics and the linear model for one request, by hand."""
    rows = [r for r in sorted(tables["history"].where("mws_id = 'a'").collect(), key=lambda r: r["date"]) if r["date"] <= at(30)]
    def filled(c):
        xs = [r[c] for r in rows]
        if c == "NDVI":
            for i in range(1, len(xs)):
                xs[i] = xs[i - 1] if xs[i] is None else xs[i]
            first = next(x for x in xs if x is not None)
            return [first if x is None else x for x in xs]
        mid = float(np.median([x for x in xs if x is not None]))
        return [mid if x is None else x for x in xs]
    place = {c: i for i, c in enumerate(SCALED)}
    scaled = lambda c, x: (x - 0.01 * place[c]) / (1.0 + 0.1 * place[c])
    prof = dict(zip(PROFILE[3:], [0.1 * i for i in range(len(PROFILE) - 3)]))
    ndvi, rain, heat = filled("NDVI"), filled("precipitation"), filled("temperature_2m")
    window = []
    for i, r in enumerate(rows):
        window.append([scaled("NDVI", ndvi[i]), scaled("temp_precip_idx", rain[i] * heat[i]), scaled("months_from_peak", r["date"].month - prof["peak_month"])])
    window = window[-WINDOW:]
    sums = sum(scaled("precipitation", x) for x in (0.1, 0.2)), np.mean([scaled("temperature_2m", x) for x in (280.0, 290.0)])
    x = [v for row in window for v in row] + [scaled("latitude", 11.0), scaled("peak_month", prof["peak_month"]), *sums]
    model = tables["model"]
    want = window[-1][0] + float(np.dot(model.coefficients.toArray(), x)) + model.intercept
    want = min(max(want * 1.0 + 0.0, 0.0), 1.0)
    got = {(m, a): f for m, a, _, _, f, *_ in first}[("a", at(30))]
    assert math.isclose(got, want, abs_tol=1e-9)


def test_codes_and_caps(spark, tables, path):
    bundle = serving.load_bundle(spark, path, "1")
    req = tables["requests"].where("latitude is not null")
    placed = serving.placed_profiles(req, bundle.profiles)
    rows = serving.serving_features(req, tables["history"], bundle, placed, clip=True)
    assert set(DYNAMIC) <= set(rows.columns) and set(QUARTER_MEANS) <= set(rows.columns)
    got = rows.groupBy("mws_id", "anchor").agg(F.count("*").alias("n"), *[F.max(f"{c}_encoded").alias(c) for c in CATEGORICAL if c != "mws_id"],
                                               F.max("mws_id_encoded").alias("code")).collect()
    assert {(r["mws_id"], r["n"], r["state"], r["district"], r["code"]) for r in got} == {
        ("a", 24, 3, 0, 0), ("a", 11, 3, 0, 0), ("b", 24, 3, 0, 1), ("b", 21, 3, 0, 1), ("c", 10, 3, 0, 0), ("dry", 24, 3, 0, 0)} - {("b", 21, 3, 0, 1)}


def test_empty_tables(spark, tables, path):
    bundle = serving.load_bundle(spark, path, "1")
    none = serving.serve(tables["requests"].limit(0), tables["history"], tables["weather"], bundle)
    assert none.collect() == []
    bare = serving.serve(tables["requests"], tables["history"].limit(0), tables["weather"].limit(0), bundle).collect()
    assert len(bare) == 9 and {r["status"] for r in bare} == {"NO_HISTORY"} and all(r["forecast"] is None for r in bare)
