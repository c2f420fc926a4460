"""The first targets of every region in a given order, without testing all that a region touches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phenogrid.session import materialise

#: Tests of a region against a target that one task makes.
TESTS_PER_TASK = 5_000_000


def first_of_each(regions: DataFrame, key: list[str], targets: DataFrame, cell: list[str], order: list[str], k: int,
                  inside: Column, block: int) -> DataFrame:
    """The first ``k`` targets in ``order`` inside every region, with the region's ``key`` and their ``rank``.

    ``regions`` has a row for each cell that a region touches; ``targets`` have the cell they lie in, and no target lies in two
    cells of one region. ``inside`` may use the columns of both. The targets of a cell are ranked once and dealt into blocks; a
    region meets the first block of its cells, and goes on, by twice as many blocks each time, only where the next block
    begins before its k-th target so far. So its tests depend on k and its cells, not on the number of targets, unless the
    region holds few of what its cells hold.
    """
    spark = regions.sparkSession
    place = Window.partitionBy(*cell).orderBy(*order)
    ranked = materialise(targets.withColumn("_block", F.floor((F.row_number().over(place) - 1) / block).cast("int")), "ranked")
    starts = ranked.groupBy(*cell, "_block").agg(F.min(F.struct(*order)).alias("_from"))
    starts = materialise(starts, "starts")
    best = Window.partitionBy(*key).orderBy(*order)
    taken = [*key, *(c for c in targets.columns if c not in key)]
    pairs = materialise(regions.dropna(subset=key), "regions")
    done, found, low, high = [], None, 0, 1
    while True:
        # dealt by number: few bytes of regions and targets make many tests, which a task sized by bytes would take alone
        tests = pairs.count() * block * (high - low)
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tests // TESTS_PER_TASK))
        here = ranked.where(F.col("_block").between(low, high - 1)).drop("_block")
        new = pairs.repartition(n, *cell).join(here.repartition(n, *cell), cell).where(inside).select(*taken)
        if found is not None:
            new = new.unionByName(found.drop("rank"))
        first = new.repartition(n, *key).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        found = materialise(first, "found")
        last = found.where(F.col("rank") == k).select(*key, F.struct(*order).alias("_last"))
        rest = pairs.join(starts.where(F.col("_block") == high).drop("_block"), cell).join(last, key, "left")
        pairs = materialise(rest.where(F.col("_last").isNull() | (F.col("_from") < F.col("_last"))).drop("_from", "_last"), "open")
        going = pairs.select(*key).distinct()
        if pairs.isEmpty():
            return reduce(DataFrame.unionByName, [*done, found])
        done.append(found.join(going, key, "left_anti"))
        found = found.join(going, key, "left_semi")
        low, high = high, 2 * high + 1
