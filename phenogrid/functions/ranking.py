"""Global ranks without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenogrid.session import cut_lineage


def global_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Zero-based position of every row in the total order of ``order`` (unique per row).

    Rows are range-partitioned on the order, materialised so that partition ids stay fixed,
    numbered inside each partition and shifted by the sizes of the partitions before it. The
    offset table has one row per partition.
    """
    ranged = df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id())
    fixed = cut_lineage(ranged)
    sizes = fixed.groupBy("_pid").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_pid").orderBy(*order)
    return (
        fixed.withColumn("_rn", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_pid")
        .withColumn(name, (F.col("_off") + F.col("_rn") - 1).cast("long"))
        .drop("_pid", "_rn", "_off"))
