"""The lead weather is stored with partitions in proportion to the observations."""

from phenogrid import session
from phenogrid.plans import panel as pplan
from phenogrid.sources import tables as t

SF = "/root/testdata/sf0.001"


def test_what_a_task_gets_of_the_weather_does_not_grow(spark, monkeypatch):
    key, used = "spark.sql.shuffle.partitions", []
    before = spark.conf.get(key)
    monkeypatch.setattr(session, "ROWS_PER_TASK", 200)
    monkeypatch.setattr(pplan, "materialise", lambda *a: used.append(int(spark.conf.get(key))) or session.materialise(*a))
    out = pplan._weather(spark, SF)
    assert used == [-(-t.table(spark, SF, "lineitem").count() // 200)] and used[0] > int(before)
    assert spark.conf.get(key) == before and not any("lineitem" in f for f in out.inputFiles())
    assert out.count() == t.locations(spark, SF).count()
