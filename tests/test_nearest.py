"""Nearest search against brute force where targets are far away, dense nearby, or on the other side."""

import math
import random

import pytest
from pyspark.sql import functions as F

from phenogrid.operators import spatial
from phenogrid.operators.spatial import nearest_k


def km(a, b):
    la, lo, lb, lp = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def frames(spark, sites, targets):
    return (spark.createDataFrame([(i, *p) for i, p in enumerate(sites)], "site long, lat double, lon double"),
            spark.createDataFrame([(i, *p) for i, p in enumerate(targets)], "tid long, clat double, clon double"))


@pytest.mark.parametrize("broadcast", [0, 200_000])
@pytest.mark.parametrize("max_km", [None, 50.0])
@pytest.mark.parametrize("k", [1, 5])
def test_equal_to_brute_force(spark, monkeypatch, k, max_km, broadcast):
    monkeypatch.setattr(spatial, "BROADCAST_TARGETS", broadcast)
    r = random.Random(k)
    city = [(20 + r.uniform(-0.02, 0.02), 77 + r.uniform(-0.02, 0.02)) for _ in range(400)]
    wide = [(r.uniform(-60, 60), r.uniform(-180, 180)) for _ in range(60)]
    sites = [(20.1, 77.1), (-40.0, -100.0), (20.0, 77.0), (89.0, 0.0), *((r.uniform(-80, 80), r.uniform(-180, 180)) for _ in range(25))]
    targets = city + wide
    s, t = frames(spark, sites, targets)
    got = {}
    for x in nearest_k(s, ["site"], t, "tid", k, max_km=max_km).collect():
        got.setdefault(x["site"], []).append((x["rank"], x["km"]))
    for i, p in enumerate(sites):
        d = sorted(km(p, q) for q in targets)
        want = [x for x in d[:k] if max_km is None or x <= max_km]
        assert [x for _, x in sorted(got.get(i, []))] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_other_octant(spark, monkeypatch, broadcast):
    """Sites without any target in their part of the world don't meet all of them."""
    monkeypatch.setattr(spatial, "BROADCAST_TARGETS", broadcast)
    r = random.Random(7)
    targets = [(r.uniform(10, 30), r.uniform(70, 90)) for _ in range(3000)]
    sites = [(r.uniform(-30, -10), r.uniform(-110, -90)) for _ in range(300)]
    s, t = frames(spark, sites, targets)
    df = nearest_k(s, ["site"], t, "tid", 3)
    assert df.count() == 900
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not broadcast or "Exchange" not in plan


def test_index_ties_nulls_and_few_targets():
    import numpy as np

    from phenogrid.operators.sphere_index import SphereIndex

    index = SphereIndex([10.0, 10.0, -10.0], [20.0, 20.0, -160.0], np.array([0, 1, 2]))
    site, target, rank = index.nearest([10.0, float("nan"), -10.0, 90.0], [20.0, 1.0, 200.0, 0.0], 2)
    got = {}
    for s, t, r in zip(site.tolist(), target.tolist(), rank.tolist()):
        got.setdefault(s, []).append((r, t))
    assert got == {0: [(1, 0), (2, 1)], 2: [(1, 2), (2, 0)], 3: [(1, 0), (2, 1)]}
    # more targets asked for than there are
    assert sorted(SphereIndex([1.0], [1.0], np.array([0])).nearest([2.0], [2.0], 5)[1].tolist()) == [0]
    assert [len(x) for x in SphereIndex([], [], np.array([])).nearest([2.0], [2.0], 5)] == [0, 0, 0]


def test_pairs_measured_do_not_grow_with_density(monkeypatch):
    """A site in a city of 20,000 targets measures some dozens of them."""
    import numpy as np

    from phenogrid.operators.sphere_index import SphereIndex

    rnd = np.random.default_rng(1)
    index = SphereIndex(20 + rnd.normal(0, 0.02, 20_000), 77 + rnd.normal(0, 0.02, 20_000), np.arange(20_000))
    measured = []
    plain = SphereIndex._km
    monkeypatch.setattr(SphereIndex, "_km", lambda self, lat, lon, t: measured.append(len(t)) or plain(self, lat, lon, t))
    index.nearest(20 + rnd.normal(0, 0.02, 500), 77 + rnd.normal(0, 0.02, 500), 3)
    assert sum(measured) < 500 * 200
