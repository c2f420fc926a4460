"""Cases with known answers: area labels, rule rows, lens, audit, error classes."""

import itertools

import pytest
from pyspark.sql import functions as F

from phenogrid.operators import area, fetchlog, message, rules

POINTS = [-1.4, -2.1, -2.4, -2.6, -3.0, -3.1] * 2


def facts(spark, zs=POINTS, plot_z=-2.87, clear=0.6, regime="rain-fed", month=9, lat=20.17, lon=78.32, cap=None, trend="recovering",
          fallow=False):
    pts = spark.createDataFrame([(1, float(z)) for z in zs], "plot_id int, z double")
    row = spark.createDataFrame(
        [(1, plot_z, clear, regime, month, lat, lon, cap, trend, fallow, "MURLI")],
        "plot_id int, plot_z double, clear_view double, regime string, target_month int, lat double, lon double, conf_cap string, "
        "trend string, fallow boolean, village string")
    return row.join(area.summarise(pts, ["plot_id"]), "plot_id")


def decided(spark, **kw):
    return rules.decide(facts(spark, **kw), rules.default_rules(spark))


def one(spark, **kw):
    return decided(spark, **kw).first()


def values(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_severity_and_agreement_bins(spark):
    zs = [(-2.5,), (-2.0,), (-1.5,), (-1.0,), (0.0,), (1.0,), (1.2,)]
    assert values(spark, area.severity(F.col("z")), zs, "z double") == [
        "well_below", "well_below", "below", "below", "normal", "above", "above"]
    assert values(spark, area.agreement(F.col("s")), [(0.3,), (0.5,), (0.7,), (1.2,)], "s double") == ["high", "medium", "medium", "low"]


def test_attribution(spark):
    rows = [(-2.0, 100, -2.0), (-2.0, 10, -0.1), (0.3, 0, 0.2)]
    got = values(spark, area.attribution(F.col("p"), F.col("b"), F.col("m")), rows, "p double, b int, m double")
    assert got == ["regional", "local", "none"]


def test_area_summary_and_rule_row(spark):
    r = one(spark)
    assert (r.severity, r.spatial_confidence, r.attribution, r.pct_below, r.n) == ("well_below", "medium", "regional", 100, 12)
    assert (r.effective_confidence, r.matched.risk_level, r.matched.action_tier) == ("medium", "below-usual", "low_regret+prepare")
    assert not r.small_sample


def test_poor_data_forces_watch(spark):
    out = message.render(decided(spark, clear=0.3)).first()
    assert (out.data_quality, out.data_poor_gate, out.effective_confidence, out.matched.risk_level) == ("poor", True, "low", "watch")
    assert "limited clear satellite views" in out.message


def test_cap_comes_before_the_match(spark):
    kw = dict(zs=[-2.5] * 12, plot_z=-2.5, clear=0.9, trend="unknown")
    free, capped = one(spark, **kw), one(spark, cap="medium", **kw)
    assert (free.effective_confidence, free.conf_capped) == ("high", False)
    assert (capped.effective_confidence, capped.conf_capped) == ("medium", True)
    assert free.matched.active_advisory != capped.matched.active_advisory


def test_season_flips_with_the_place(spark):
    dry, wet = one(spark, month=11), one(spark, month=11, lat=10.85, lon=79.10)
    assert (dry.season, wet.season) == ("dry", "wet")
    assert dry.lens.driver.startswith("D2") and wet.lens.driver.startswith("D1")
    assert one(spark, month=9).season == "wet"
    assert one(spark, fallow=True).lens.season == "dry_fallow"


def test_worse_of_two(spark):
    rows = [("high", "fair"), ("medium", "good"), ("high", "poor"), ("high", "unknown")]
    got = values(spark, area.overall_confidence(F.col("a"), F.col("q")), rows, "a string, q string")
    assert got == ["medium", "medium", "low", "high"]


def test_unspecified_regime_merges_or_splits(spark):
    split = one(spark, regime=None)
    assert split.regime_split and split.matched.regime == "rain-fed" and split.matched_irrigated.regime == "irrigated"
    text = message.render(decided(spark, regime=None)).first().message
    assert "RAIN-FED" in text and "IRRIGATED" in text
    assert not one(spark, zs=[0.1] * 12, plot_z=0.0, regime=None).regime_split


def verdict(spark, text=None, **kw):
    df = message.render(decided(spark, **kw))
    if text is not None:
        df = df.withColumn("message", F.lit(text))
    return message.audit(df).first().failed_rule


@pytest.mark.parametrize("text, failed", [
    (None, None), ("expect a 45% yield loss", "invented_number"), ("a drought is coming", "forbidden_word"),
    ("may run well below usual; one opinion", None), ("may run well below usual; a second opinion", "second_opinion"),
    ("may run well below usual; a 2nd opinion", "second_opinion"), ("may run a little below usual; one opinion", "understated"),
    ("well below usual and the rains are weak", "watch_drift"),
])
def test_message_audit(spark, text, failed):
    assert verdict(spark, text) == failed


def test_gated_message_may_be_soft(spark):
    assert verdict(spark, "please watch closely; a low-confidence read", clear=0.3) is None


def test_rendered_messages_pass_their_own_audit(spark):
    cases = [dict(), dict(clear=0.9), dict(clear=None), dict(zs=[0.0] * 12, plot_z=0.0), dict(zs=[1.5] * 5, plot_z=1.5),
             dict(zs=[-1.4] * 12, plot_z=-1.5), dict(regime="irrigated"), dict(regime=None)]
    df = None
    for kw in cases:
        part = message.render(decided(spark, **kw))
        df = part if df is None else df.unionByName(part)
    assert [r.failed_rule for r in message.audit(df).collect()] == [None] * len(cases)


def test_every_state_matches_exactly_one_rule(spark):
    """All states an aggregate can produce; below/well_below with local cannot occur."""
    states = [s for s in itertools.product(["regional", "local", "none"], ["rain-fed", "irrigated"],
                                           ["well_below", "below", "normal", "above"], ["low", "medium", "high"])
              if not (s[0] == "regional" and s[2] in ("normal", "above"))]
    df = rules.with_rules(spark.createDataFrame(states, "a string, r string, s string, c string"), rules.default_rules(spark))
    n = F.size(rules.matches(F.col("a"), F.col("r"), F.col("s"), F.col("c")))
    assert df.where(n != 1).count() == 0


def test_no_rule_gives_the_neutral_row(spark):
    df = rules.with_rules(spark.createDataFrame([("regional", "rain-fed", "above", "low")], "a string, r string, s string, c string"),
                          rules.default_rules(spark))
    row = df.select(rules.match(F.col("a"), F.col("r"), F.col("s"), F.col("c")).alias("m")).first().m
    assert (row.rule_order, row.risk_level, row.action_tier) == (0, "watch", "monitor")


def test_error_classes(spark):
    texts = [("NameResolutionError: Failed to resolve host",), ("date '2035-06-15' is in the future; it must be today or earlier.",),
             ("HTTP Error 404: Not Found",), ("plot forecast unavailable (no usable data at the plot)",), ("HTTP Error 401: Unauthorized",), ("boom",)]
    assert values(spark, message.error_status(F.col("t")), texts, "t string") == [503, 422, 422, 422, 502, 502]


def test_rate_limit_texts(spark):
    texts = [("HTTP 429 Too Many Requests",), ("User rate limit exceeded",), ("RESOURCE_EXHAUSTED: quota exceeded",),
             ("HTTP 404 not found",), ("connection reset",)]
    assert values(spark, fetchlog.is_rate_limit(F.col("t")), texts, "t string") == [True, True, True, False, False]


def test_text_requests(spark):
    rows = [("outlook for 20.17, 78.32 on 2018-06-15 irrigated",), ("rain fed plot at 10.85 79.10",), ("hello 3",), (None,)]
    got = message.parse_request(spark.createDataFrame(rows, "t string"), "t").collect()
    assert (got[0].lat, got[0].lon, got[0].date, got[0].regime) == (20.17, 78.32, "2018-06-15", "irrigated")
    assert (got[1].lat, got[1].date, got[1].regime) == (10.85, None, "rain-fed")
    assert not got[2].is_request and not got[3].is_request
