"""The gap tracker reaches its state store a few times for a delivery, whatever the number of steps in it."""

from datetime import date

import pandas as pd
import pytest

from phenogrid.streaming import jobs
from test_continuous import Store

DAY = pd.Timestamp(date(2020, 1, 6))


class Counted(Store):
    calls = 0

    def getMapState(self, name, key, value):
        state, store = super().getMapState(name, key, value), self

        class M:
            def __getattr__(self, method):
                store.calls += 1
                return getattr(state, method)

        return M()


def deliver(tracker, steps, now_step):
    due = [DAY + pd.Timedelta(days=14 * s) for s in steps]
    list(tracker.handleInputRows(("m",), iter([pd.DataFrame({"step": steps, "missing": [s % 2 == 0 for s in steps], "due": due})]), None))
    mark = int((DAY + pd.Timedelta(days=14 * now_step)).timestamp() * 1000)
    now = type("T", (), {"getCurrentWatermarkInMs": lambda _: mark})()
    return [x for f in tracker.handleExpiredTimer(("m",), now, None) for x in zip(f["step"].tolist(), f["ndvi_gap_length"].tolist())]


@pytest.mark.parametrize("n", [10, 200])
def test_messages_do_not_grow_with_the_steps(n):
    store, tracker = Counted(), jobs.GapTracker(expire_days=100)
    tracker.init(store)
    # every step of the second delivery but one repeats a held step, whose later copy counts
    got = deliver(tracker, list(range(n))[::-1], n // 2) + deliver(tracker, list(range(n // 2 + 1, n + 1)), n)
    assert got == [(s, int(s % 2 == 0)) for s in range(n + 1)]
    assert store.calls <= 8
