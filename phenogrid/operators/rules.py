"""Season lens, rule table and the decision per plot."""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phenogrid.operators import area
from phenogrid.functions.columns import ladder

RULE_FILE = Path(__file__).resolve().parents[1] / "rules" / "outlook_rules.csv"
RULE_COLUMNS = ["rule_order", "attribution", "regime", "severity", "confidence", "risk_level", "action_tier",
                "active_advisory", "escalate_if", "driver_check"]
RULE_SCHEMA = "rule_order int, " + ", ".join(f"{c} string" for c in RULE_COLUMNS[1:])

# Coarse box of the region whose rains come from October to December.
NE_BELT = {"lat": (8.0, 16.5), "lon": (76.0, 81.5)}
SW_WET_MONTHS = (6, 7, 8, 9)
NE_WET_MONTHS = (10, 11, 12)

# Drivers, triggers and levers per season.
LENS = {
    "wet": ("D1 rainfall deficit (+ D3 heat)", "the rains underperform (the monsoon that feeds your area)", (
        "conserve soil moisture (mulch, keep weeds down)",
        "a life-saving irrigation at the critical stage if a dry spell hits",
        "a foliar potassium (anti-stress) spray to ride out short dry spells",
    ), "Krishi Vigyan Kendra (KVK) / Gramin Krishi Mausam Seva (GKMS)"),
    "dry": ("D2 water-source depletion (+ D3 heat)", "your water source (canal / borewell / release) draws down", (
        "stretch limited water with micro-irrigation to the critical stage",
        "mulch to cut evaporation and water in the cooler hours",
        "an anti-transpirant / kaolin spray to cut heat stress",
    ), "Krishi Vigyan Kendra (KVK) + Water Users Association (WUA) / canal department"),
    "dry_fallow": ("(relevance gate — typically bare/fallow now)", "not applicable — re-check closer to sowing", (
        "nothing to act on now; re-check nearer your sowing window",
    ), "Krishi Vigyan Kendra (KVK)"),
}

# Fixed value: the row used when no rule matches.
NEUTRAL = {
    "attribution": "none", "severity": "any", "confidence": "low", "risk_level": "watch", "action_tier": "monitor",
    "active_advisory": "A weak / mixed signal for your area — nothing firm. Keep watching and confirm with your "
                       "Krishi Vigyan Kendra (KVK). One opinion only.",
    "escalate_if": "re-check next update", "driver_check": "",
}


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule table from storage: CSV with ``#`` comment lines and an explicit ``rule_order``."""
    df = spark.read.option("header", True).option("comment", "#").option("quote", '"').option("escape", '"').schema(RULE_SCHEMA).csv(path)
    return df.fillna("", subset=RULE_COLUMNS[1:])


def write_rules(rules: DataFrame, path: str) -> str:
    """Rule table to storage, in the form ``read_rules`` takes."""
    rules.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path


def default_rules(spark: SparkSession) -> DataFrame:
    """The packaged table (17 rows, read on the driver: executors need not see the package)."""
    with open(RULE_FILE, encoding="utf-8") as f:
        rows = list(csv.DictReader(line for line in f if not line.startswith("#")))
    return spark.createDataFrame([(int(r["rule_order"]), *[r[c] for c in RULE_COLUMNS[1:]]) for r in rows], RULE_SCHEMA)


def season(lat, lon, month, normals=None) -> Column:
    """Wet or dry: by the 12 monthly normals where given, else by month and belt."""
    in_belt = lat.between(*NE_BELT["lat"]) & lon.between(*NE_BELT["lon"])
    coarse = F.when(F.when(in_belt, month.isin(*NE_WET_MONTHS)).otherwise(month.isin(*SW_WET_MONTHS)), "wet").otherwise("dry")
    if normals is None:
        return coarse
    mean = F.aggregate(normals, F.lit(0.0), lambda a, x: a + x) / 12.0
    return F.when(F.size(normals) == 12, F.when(F.element_at(normals, month) > mean, "wet").otherwise("dry")).otherwise(coarse)


def lens_key(season_col, fallow, regime) -> Column:
    return ladder([(fallow, "dry_fallow"), (regime == "irrigated", "dry"), (season_col.isin("wet", "dry"), season_col)], "dry")


def lens(key: Column, season_col: Column, fallow: Column) -> Column:
    def one(k):
        driver, trigger, levers, resource = LENS[k]
        return F.struct(F.lit(driver).alias("driver"), F.lit(trigger).alias("escalate_if"),
                        F.array(*[F.lit(x) for x in levers]).alias("levers"), F.lit(resource).alias("resource"),
                        F.when(fallow, "dry_fallow").otherwise(season_col).alias("season"))
    return ladder([(key == "wet", one("wet")), (key == "dry_fallow", one("dry_fallow"))], one("dry"))


#: Every state that a decision may be in: three attributions, two regimes, four severities, three confidences.
STATES = {"attribution": ("regional", "local", "none"), "regime": ("rain-fed", "irrigated"),
          "severity": ("well_below", "below", "normal", "above"), "effective_confidence": ("low", "medium", "high")}


def with_rules(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Attach the whole (17-row) table as one ordered array: matching then needs no shuffle."""
    packed = rules.agg(F.array_sort(F.collect_list(F.struct(*RULE_COLUMNS))).alias("_rules"))
    return df.crossJoin(F.broadcast(packed))


def matches(attribution, regime, severity, confidence) -> Column:
    """All matching rules in file order (needs ``with_rules``)."""
    ok = lambda rule, val: (rule == val) | (rule == "any")
    return F.filter("_rules", lambda r: ok(r["attribution"], attribution) & ok(r["regime"], regime)
                    & ok(r["severity"], severity) & ok(r["confidence"], confidence))


def match(attribution, regime, severity, confidence) -> Column:
    """First matching rule, or the neutral row."""
    fields = [F.lit(0).alias("rule_order")] + [
        (regime if c == "regime" else F.lit(NEUTRAL[c])).alias(c) for c in RULE_COLUMNS[1:]]
    return F.coalesce(F.get(matches(attribution, regime, severity, confidence), F.lit(0)), F.struct(*fields))


def derive(facts: DataFrame) -> DataFrame:
    """Labels of a fact row: attribution, data quality and the three confidences.

    ``facts`` carries ``plot_z``, the area summary, ``clear_view`` and optionally ``conf_cap``.
    """
    cap = F.col("conf_cap") if "conf_cap" in facts.columns else F.lit(None).cast("string")
    df = facts.withColumns({
        "attribution": area.attribution(F.col("plot_z"), F.col("pct_below"), F.col("median_exact")),
        "data_quality": area.data_quality(F.col("clear_view"))})
    df = df.withColumn("overall_confidence", area.overall_confidence(F.col("spatial_confidence"), F.col("data_quality")))
    eff, capped = area.effective_confidence(F.col("overall_confidence"), F.col("data_quality"), cap)
    return df.withColumns({"effective_confidence": eff, "conf_capped": capped, "data_poor_gate": F.col("data_quality") == "poor"})


def decide(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Whole decision per row: derived labels, matched rule(s) and lens(es).

    An unspecified regime is evaluated as both; the row is split only if their sentences differ.
    Facts carry ``lat``, ``lon``, ``target_month``, ``regime`` and ``fallow`` besides the area.
    """
    df = with_rules(derive(facts), rules)
    c = F.col
    both = c("regime").isNull()
    first = F.coalesce(c("regime"), F.lit("rain-fed"))
    rule = lambda regime: match(c("attribution"), regime, c("severity"), c("effective_confidence"))
    df = df.withColumns({
        "season": season(c("lat"), c("lon"), c("target_month"), c("normals") if "normals" in df.columns else None),
        "matched": rule(first), "matched_irrigated": F.when(both, rule(F.lit("irrigated")))})
    view = lambda regime: lens(lens_key(c("season"), c("fallow"), regime), c("season"), c("fallow"))
    df = df.withColumns({"lens": view(first), "lens_irrigated": F.when(both, view(F.lit("irrigated")))})
    split = both & (c("matched.active_advisory") != c("matched_irrigated.active_advisory"))
    return df.withColumn("regime_split", F.coalesce(split, F.lit(False))).drop("_rules")
