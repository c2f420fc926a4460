"""Scores read the raw observations once, for a stored panel, however often they use the scored samples."""

from phenogrid.plans import evaluation
from phenogrid.sources import tables as t

SF = "/root/testdata/sf0.001"


def test_scored_samples_come_from_a_stored_panel(spark, monkeypatch):
    reads = []
    panel = t.source_panel
    monkeypatch.setattr(t, "source_panel", lambda *a: reads.append(1) or panel(*a))
    scored = evaluation.scored(spark, SF)
    assert len(reads) == 1 and not any("lineitem" in f for f in scored.inputFiles())
    assert scored.count() > 0
