"""Tables of the panel have partitions in proportion to the observations."""

import pytest

from phenogrid import session
from phenogrid.plans import features as fplan
from phenogrid.plans import outlook
from phenogrid.sources import tables as t

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("stored", [fplan.stored_panel, outlook.history])
def test_what_a_task_gets_does_not_grow(spark, monkeypatch, stored):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = t.table(spark, SF, "lineitem").count()
    monkeypatch.setattr(session, "ROWS_PER_TASK", 200)
    wanted = max(int(before), -(-rows // 200))
    found = stored(spark, SF)
    files = found.inputFiles()
    buckets = {f.rsplit("_", 1)[1].split(".")[0] for f in files}
    assert wanted > int(before) and max(map(int, buckets)) >= int(before) and max(map(int, buckets)) < wanted
    assert found.count() == stored(spark, SF).count() and spark.conf.get("spark.sql.shuffle.partitions") == before


def test_a_failure_gives_the_setting_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(ZeroDivisionError), session.shuffles_for(spark, 10 ** 9):
        1 / 0
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
