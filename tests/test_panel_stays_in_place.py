"""Stored by location, the panel is not shuffled again by the few values of its administrative columns."""

from phenogrid.functions import quantiles
from phenogrid.operators import features, impute
from phenogrid.plans import features as fplan

SF = "/root/testdata/sf0.001"
LEVELS = ("state", "district", "tehsil")


def _shuffled(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [level for level in LEVELS if f"hashpartitioning({level}#" in plan]


def test_medians_and_codes_are_sent_to_the_rows(spark, monkeypatch):
    panel = fplan.stored_panel(spark, SF)
    fits = impute.fit_imputation(panel, ["sm_surface"])
    assert {fit.level for fit in fits} >= {"district", "state"}
    filled = impute.apply_imputation(panel, fits)
    codes = features.fit_label_codes(panel)
    coded = features.apply_label_codes(filled, codes)
    assert _shuffled(filled) == [] and _shuffled(coded) == []
    # too many groups to send: a shuffle, and the same rows
    monkeypatch.setattr(quantiles, "BROADCAST_GROUPS", 0)
    other = impute.apply_imputation(panel, impute.fit_imputation(panel, ["sm_surface"]))
    monkeypatch.undo()
    other = features.apply_label_codes(other, codes)
    assert _shuffled(other) == ["state", "district"]  # the medians'; codes are counted when they are applied
    cols = ["mws_id", "date", "sm_surface", *[f"{c}_encoded" for c in (*LEVELS, "mws_id")]]
    assert sorted(other.select(*cols).collect()) == sorted(coded.select(*cols).collect())
