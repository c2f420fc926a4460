"""The history that location medians are fitted on and applied to is reduced from the observations once."""

from pyspark.sql import functions as F

from phenogrid.functions.columns import round_cols
from phenogrid.operators import grid, impute
from phenogrid.plans import features as fplan
from phenogrid.plans import panel as pplan
from phenogrid.schema import WEATHER, WIND
from phenogrid.sources import tables as t

SF = "/root/testdata/sf0.001"
COLS = [*WEATHER[1:], *WIND]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower() + df._jdf.queryExecution().executedPlan().toString().lower()


def test_observations_are_read_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(impute, "fit_imputation", lambda df, *a, f=impute.fit_imputation, **b: (seen.append(df), f(df, *a, **b))[1])
    out = fplan.d02(spark, SF)
    assert len(seen) == 1 and "l_shipdate" not in _plan(seen[0]) and "l_shipdate" not in _plan(out)
    # the rows are those of the history reduced anew
    h = pplan.history(spark, SF)
    plain = round_cols(impute.apply_imputation(h, impute.fit_imputation(h, COLS, ladder=("mws_id",))).select("mws_id", "step", *COLS), COLS)
    assert sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))


def test_a_task_of_the_stored_history_gets_a_bounded_share(spark, monkeypatch):
    from phenogrid import session

    monkeypatch.setattr(session, "ROWS_PER_TASK", 200)
    stored = pplan.stored_history(spark, SF, ["et"])
    before = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = {f.rsplit("_", 1)[1].split(".")[0] for f in stored.inputFiles()}
    assert max(map(int, buckets)) >= before
    per = stored.groupBy("mws_id").agg(F.count("*").alias("n"))
    assert "exchange" not in per._jdf.queryExecution().executedPlan().toString().lower()


def test_panel_on_the_grid_is_the_reduced_observations_on_it(spark):
    # a cell with most of the rows, cells with readings of the next step's first days only, a location without observations
    obs = t.observations(spark, SF)
    busy = obs.limit(1).crossJoin(spark.range(20000).select(F.col("id").cast("int").alias("k")))
    obs = obs.where("step % 7 <> 3").unionByName(busy.withColumn("NDVI_raw", F.col("k") % 9000).drop("k"))
    cells = t.grid(spark, SF)
    cells = cells.unionByName(cells.limit(5).withColumn("mws_id", F.lit("none")))
    new = grid.fortnight_panel(cells, obs)
    old = grid.add_coverage(cells.join(grid.reduce_observations(obs), ["mws_id", "step"], "left")) \
        .withColumn("SummaryQA", F.coalesce(F.col("SummaryQA"), F.lit(3.0)))
    assert new.columns == old.columns
    doubles = [c for c, kind in new.dtypes if kind == "double"]
    rows = lambda df: sorted(map(str, df.withColumns({c: F.format_string("%.9e", c) for c in doubles}).collect()))
    assert rows(new) == rows(old)
    assert new.where("NDVI is not null and temperature_2m is null").count() > 0


def test_a_side_that_nobody_reads_is_left_out(spark):
    outer = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Outer")
    h = pplan.history(spark, SF)
    assert outer(h) == 2 and outer(h.select("mws_id", "step", *COLS)) == 1 and outer(h.select("mws_id", "step", "NDVI")) == 1
    # on the grid's own keys, the sides meet without another shuffle of both together
    assert "coalesce(mws_id" not in _plan(h)
