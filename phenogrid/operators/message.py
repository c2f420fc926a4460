"""The outlook message, its audit, and the small text jobs around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenogrid.functions.columns import ladder
from phenogrid.operators.area import rank_of
from phenogrid.operators.fetchlog import has_any

# Words and patterns of the message contract.
FORBIDDEN = ["drought", "famine", "disaster", "crop failure"]
SECOND_OPINION = ["second opinion", "2nd opinion"]
BULLET = "• "
SUB_BULLET = "    – "
NUMBER = r"(-?\d+\.?\d*)"
BASE_NUMBERS = ["3", "12"]
WATCH_DRIFT = (
    r"\b(rains?|monsoon)\b[^.]{0,30}\b(is|are|has been|have been|was|were)\b[^.]{0,15}"
    r"(underperform|fail|weak|poor|insufficient)"
    r"|\b(water source|borewell|canal|water table)\b[^.]{0,30}\b(is|are|has been|have been)\b"
    r"[^.]{0,15}(low|running low|depleted|declin|drying)")
FORWARD_DECLINE = (
    r"\b(may|might|could|will|expect\w*|likely|going to|set to)\b[^.]{0,25}"
    r"\b(decline|declining|drop|dropping|fall|falling|worsen|deteriorat\w*|get worse|go below|run below)\b")
WELL_BELOW_WORDS = ["well below", "well-below", "notably below", "noticeably below", "significantly below"]
SMALL_SAMPLE_WORDS = ["few", "small sample", "limited sample", "handful"]
QUALITY_WORDS = ["fair", "cloud", "limited", "quality", "could not be assessed", "low-confidence", "low confidence"]
CONFIDENCE_WORDS = {"high": ["high confidence"], "medium": ["medium confidence"], "low": ["low confidence", "low-confidence"]}
RAINFED_WORDS = ["rain-fed", "rain fed", "rainfed"]
RAINFED_BRANCH = ["if your field is rain-fed", "if rain-fed", "if rain fed", "if rainfed"]
IRRIGATED_BRANCH = ["if your field is irrigated", "if irrigated"]
QUALITY_NOTES = {
    "poor": "Note: limited clear satellite views this window — treat this as a low-confidence read.",
    "fair": "Note: a fair-quality read — some cloud limited the clear satellite views.",
    "unknown": "Note: clear satellite-view quality for this window could not be assessed — read this greenness outlook "
               "with extra caution.",
}
SMALL_NOTE = "Note: only a few fields could be sampled here (a small sample) — read this with extra caution."
TREND_PHRASES = {"recovering": "recovering toward normal", "declining": "declining lately"}
OUTLOOK_PHRASES = {"well_below": "still leans well below", "below": "still leans below", "normal": "is about normal", "above": "is favourable"}


def levers_shown() -> Column:
    return F.col("severity").isin("below", "well_below") & (F.col("attribution") == "regional")


def _bullet(text) -> Column:
    return F.concat(F.lit(BULLET), text if isinstance(text, Column) else F.lit(text))


def _lookup(table: dict, key: str) -> Column:
    return ladder([(F.col(key) == k, v) for k, v in table.items()], F.lit(None).cast("string"))


def _levers(lens: str) -> Column:
    steps = F.transform(F.col(lens)["levers"], lambda x: F.concat(F.lit(SUB_BULLET), x))
    return F.concat(F.array(_bullet("Low-regret steps to consider:")), steps,
                    F.array(F.concat(F.lit(BULLET + "Watch: "), F.col(lens)["escalate_if"], F.lit("."))))


def _trend_line() -> Column:
    t, sev = F.col("trend"), F.col("severity")
    opposes = ((t == "recovering") & sev.isin("below", "well_below")) | ((t == "declining") & sev.isin("normal", "above"))
    start = F.concat(F.lit("Recent trend (context): the area has been "), _lookup(TREND_PHRASES, "trend"))
    against = F.concat(start, F.lit(" recently, even though the ~3-month outlook "), _lookup(OUTLOOK_PHRASES, "severity"), F.lit(" — weigh both."))
    return F.when(t.isin(*TREND_PHRASES), _bullet(F.when(opposes, against).otherwise(F.concat(start, F.lit(" — weigh that in.")))))


def render(decided: DataFrame) -> DataFrame:
    """Title and bullet lines of a decided row (``village`` and ``trend`` included) as ``message``."""
    none = F.array().cast("array<string>")
    show, split = levers_shown(), F.col("regime_split")
    levers = lambda lens: F.when(show, _levers(lens)).otherwise(none)
    own = F.array(F.when(split, _bullet(F.concat(F.lit("If your field is RAIN-FED: "), F.col("matched.active_advisory"))))
                  .otherwise(_bullet(F.col("matched.active_advisory"))))
    other = F.when(split, F.concat(F.array(_bullet(F.concat(
        F.lit("If your field is IRRIGATED: "), F.col("matched_irrigated.active_advisory")))), levers("lens_irrigated"))).otherwise(none)
    notes = F.array(
        F.when(F.col("data_quality").isin(*QUALITY_NOTES), _bullet(_lookup(QUALITY_NOTES, "data_quality"))),
        F.when(F.col("small_sample"), _bullet(SMALL_NOTE)), _trend_line())
    where = F.coalesce(F.when(F.col("village") != "", F.col("village")), F.lit("your area"))
    title = F.array(F.concat(where, F.lit(" — vegetation outlook, next ~3 months:")))
    lines = F.concat(title, own, levers("lens"), other, F.array_compact(notes))
    return decided.withColumn("message", F.concat_ws("\n", lines))


def audit(df: DataFrame, text: str = "message") -> DataFrame:
    """``failed_rule``: the first broken faithfulness rule of a text, NULL when it passes."""
    c = F.col
    df = df.withColumn("_low", F.lower(c(text)))
    low = c("_low")
    says = lambda words: has_any(low, words)
    num = lambda x: F.array(x.cast("string"), F.abs(x).cast("string"))
    allowed = F.concat(F.array(*[F.lit(n) for n in BASE_NUMBERS]), num(c("median_z")), num(c("sd")), num(c("pct_below")), num(c("plot_z")))
    invented = F.exists(F.regexp_extract_all(c(text), F.lit(NUMBER), F.lit(1)), lambda n: ~(
        F.array_contains(F.array_compact(allowed), n) | F.array_contains(F.array_compact(allowed), F.regexp_replace(n, "^-+", ""))))
    sev, eff, split = c("severity"), c("effective_confidence"), c("regime_split")
    fine = sev.isin("normal", "above")
    stated = (c("attribution") != "local") & ~c("data_poor_gate")
    wrong_confidence = F.lit(False)
    for level, words in CONFIDENCE_WORDS.items():
        wrong_confidence = wrong_confidence | ((eff != level) & says(words))
    rules = [
        (says(FORBIDDEN), "forbidden_word"), (says(SECOND_OPINION), "second_opinion"), (invented, "invented_number"),
        (low.rlike(WATCH_DRIFT), "watch_drift"),
        (split & ~(says(["irrigated"]) & says(RAINFED_WORDS)), "branch_missing"),
        (~split & says(RAINFED_BRANCH) & says(IRRIGATED_BRANCH), "branch_invented"),
        (fine & says(["below"]), "false_below"), (fine & low.rlike(FORWARD_DECLINE), "forward_decline"),
        (stated & (sev == "well_below") & ~says(WELL_BELOW_WORDS), "understated"),
        (stated & (sev == "below") & ~says(["below"]), "below_not_stated"),
        (stated & (sev == "below") & says(["well below", "well-below"]), "overstated"),
        (stated & (sev == "above") & ~says(["above"]), "above_not_stated"),
        (wrong_confidence, "confidence_word"),
        (c("small_sample") & ~says(SMALL_SAMPLE_WORDS), "small_sample_dropped"),
        ((rank_of(eff) < rank_of(c("spatial_confidence"))) & ~c("conf_capped") & ~says(QUALITY_WORDS), "quality_reason_dropped"),
    ]
    return df.withColumn("failed_rule", ladder(rules, F.lit(None).cast("string"))).drop("_low")


# --- requests, notes, errors -------------------------------------------------------------
def parse_request(df: DataFrame, text: str) -> DataFrame:
    """Latitude, longitude, date and regime named in a free text; no pair of decimals, no request."""
    nums = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"(-?\d{1,3}\.\d+)"), F.lit(1))
    day = F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1)
    ok = F.size(nums) >= 2
    return df.withColumns({
        "is_request": ok, "lat": F.when(ok, F.get(nums, F.lit(0)).cast("double")), "lon": F.when(ok, F.get(nums, F.lit(1)).cast("double")),
        "date": F.when(ok & (day != ""), day),
        "regime": F.when(ok, F.when(F.col(text).rlike("(?i)irrigat"), "irrigated").when(F.col(text).rlike("(?i)rain.?fed"), "rain-fed"))})


def sampling_note(df: DataFrame) -> DataFrame:
    """``note`` for plots read through stand-ins or not covered at all."""
    km = lambda c: F.col(c).cast("string")
    tile = F.initcap(F.regexp_replace(F.coalesce("proxy_tile", F.lit("")), "_", " "))
    proxy = F.concat(F.lit("• Note: your exact area isn't mapped yet — this uses the nearest mapped cropland ("), tile, F.lit(", ~"),
                     km("proxy_km"), F.lit(" km) as a nearby proxy; treat it as an area read."))
    veg = F.concat(F.lit("• Note: no mapped cropland near here — this reads NEARBY VEGETATION"),
                   F.when(F.col("veg_km") > 0, F.concat(F.lit(" (within ~"), km("veg_km"), F.lit(" km)"))).otherwise(""),
                   F.lit(" as a general area signal (not crop-specific), so treat it as a lower-confidence area read."))
    where = F.coalesce(F.nullif(F.initcap(F.concat_ws(", ", "tehsil", "district")), F.lit("")), F.lit("this area"))
    away = F.when(F.col("nearest_km") > 0, F.concat(F.lit(" (nearest mapped cropland is ~"), F.bround("nearest_km").cast("int").cast("string"), F.lit(" km away)"))).otherwise("")
    out = F.concat(where, F.lit(" isn't mapped for the vegetation outlook yet"), away, F.lit(
        " — there's no reliable local read here. Please check with your Krishi Vigyan Kendra (KVK)."))
    return df.withColumn("note", ladder([(F.col("coverage") == "proxy", proxy), (F.col("coverage") == "vegetation", veg),
                                         (F.col("coverage") == "out of coverage", out)], F.lit(None).cast("string")))


# Markers of an unreachable service.
NETWORK_MARKERS = [
    "nameresolution", "failed to resolve", "getaddrinfo", "max retries", "httpsconnectionpool", "httpconnectionpool",
    "connection refused", "connection reset", "connection aborted", "network is unreachable", "timed out", "timeout",
    "temporary failure in name resolution", "connectionerror", "read timed out",
]


def error_status(message: Column) -> Column:
    """Status class of an error text; the order of the tests matters."""
    low = F.lower(message)
    return ladder([
        (has_any(low, ["in the future", "invalid date", "must be today", "expected format"]), 422),
        (has_any(low, ["404", "not found"]), 422),
        (has_any(low, NETWORK_MARKERS), 503),
        (has_any(low, ["no usable data", "plot forecast unavailable", "no point forecasts"]), 422),
        (has_any(low, ["401", "403", "unauthorized", "forbidden"]), 502)], 502)


_FIELDS = "forecast_ndvi double, baseline_mean double, baseline_std double, target_date string, stale_fortnights int, anchor_stale_fortnights int"
REPLY_SCHEMA = (f"z double, {_FIELDS}, anomaly struct<z:double, baseline_mean:double, baseline_std:double>, "
                f"admin struct<state:string, district:string, tehsil:string>, debug struct<{_FIELDS.replace(' double', ':double').replace(' string', ':string').replace(' int', ':int')}>")


def extract_reply(df: DataFrame, body: str) -> DataFrame:
    """A forecast reply as flat columns; fields may sit at the top, under ``debug`` or ``anomaly``."""
    r = F.from_json(body, REPLY_SCHEMA)
    df = df.withColumn("_r", r)
    at = lambda n: F.col(f"_r.{n}")
    dig = lambda n: F.coalesce(at(n), at(f"debug.{n}"))
    # a zero counts as absent here, as in the contract
    base = lambda n: F.coalesce(F.nullif(dig(n), F.lit(0.0)), at(f"anomaly.{n}"))
    stale = F.coalesce(at("stale_fortnights"), at("anchor_stale_fortnights"), at("debug.stale_fortnights"), at("debug.anchor_stale_fortnights"))
    day = F.try_to_timestamp(F.substring(dig("target_date"), 1, 10), F.lit("yyyy-MM-dd"))
    return df.withColumns({
        "z": F.coalesce(at("anomaly.z"), at("z")), "forecast_ndvi": dig("forecast_ndvi"), "baseline_mean": base("baseline_mean"),
        "baseline_std": base("baseline_std"), "target_date": dig("target_date"), "target_month": F.month(day),
        "stale_fortnights": stale, "district": at("admin.district")}).drop("_r")


def response_view(df: DataFrame, verbose: bool = False) -> DataFrame:
    """The answer to one request: location, risk level, confidence, message (and the derivation)."""
    fields = [F.struct("regime", "lat", "lon", "village", "district", "tehsil").alias("location"), F.col("matched.risk_level").alias("risk_level"),
              F.col("effective_confidence").alias("confidence"), "message"]
    if verbose:
        show = levers_shown()
        fields += [
            F.struct("median_z", "pct_below", "sd", F.col("n").alias("n_points"), "small_sample", "severity",
                     F.col("spatial_confidence").alias("point_agreement"), "data_quality", "attribution").alias("derived"),
            F.col("trend").alias("trend_context"), F.when(show, F.col("lens")).alias("lens"),
            F.when(show & F.col("regime_split"), F.col("lens_irrigated")).alias("lens_irrigated")]
    return df.withColumn("response", F.struct(*fields))
