"""Answers known in advance: what a request at any date would get, as valid-from/valid-to intervals.

A request needs the last value at its anchor and the seasonal baseline of its target month. Both
change only when a new reading comes or a year ends, so each location's answers are two short lists of
intervals, bounded by the calendar. They are stored once, one row a location, in folders by a hash of the
location. A request then needs one equality join and a look into the lists; nothing of the history is aggregated
again, and only the folders of the locations asked for are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phenogrid.functions.columns import W
from phenogrid.operators import anomaly

FOLDERS = 256
BASELINE = ("baseline_mean", "baseline_std", "baseline_n")


def folder_of(location: Column, folders: int = FOLDERS) -> Column:
    return F.pmod(F.xxhash64(location), F.lit(folders)).cast("int")


def value_intervals(history: DataFrame) -> DataFrame:
    """(mws_id, valid_from, valid_to, current): each reading until the next one; the last has no end."""
    seen = history.where(F.col("NDVI").isNotNull() & F.col("date").isNotNull())
    return seen.select("mws_id", F.col("date").alias("valid_from"), F.lead("date").over(W()).alias("valid_to"), F.col("NDVI").alias("current"))


def baseline_intervals(history: DataFrame) -> DataFrame:
    """(mws_id, month, valid_from, valid_to, baseline): one row per year in which the month's baseline changes.

    A baseline uses the readings of the years before its target's, so a month's readings of a year
    count from the first of January after it.
    """
    seen = history.where(F.col("NDVI").isNotNull()).select("mws_id", "date", "NDVI")
    changes = seen.select("mws_id", F.expr("make_date(year(date) + 1, month(date), 1)").alias("target")).distinct()
    found = anomaly.seasonal_baseline(changes, seen)
    turns = Window.partitionBy("mws_id", "month").orderBy("valid_from")
    rows = found.select("mws_id", F.month("target").alias("month"), F.trunc("target", "year").alias("valid_from"), *BASELINE)
    return rows.withColumn("valid_to", F.lead("valid_from").over(turns))


def answers(history: DataFrame, folders: int = FOLDERS) -> DataFrame:
    """(folder, mws_id, values, baselines): the intervals of every location as two sorted lists."""
    values = value_intervals(history).groupBy("mws_id").agg(
        F.array_sort(F.collect_list(F.struct("valid_from", "valid_to", "current"))).alias("values"))
    baselines = baseline_intervals(history).groupBy("mws_id").agg(
        F.collect_list(F.struct("month", "valid_from", "valid_to", *BASELINE)).alias("baselines"))
    return values.join(baselines, "mws_id", "left").withColumn("folder", folder_of(F.col("mws_id"), folders))


def write_answers(history: DataFrame, path: str, folders: int = FOLDERS) -> None:
    """Store the answers of all locations, a file a folder."""
    rows = answers(history, folders)
    rows.repartition("folder").write.partitionBy("folder").mode("overwrite").parquet(path)


def refresh_answers(history: DataFrame, path: str, changed: DataFrame, folders: int = FOLDERS) -> None:
    """Write anew the folders of the locations in ``changed``; the others stay as they are.

    ``history`` is the whole history; only the rows of those folders are aggregated.
    """
    spark = history.sparkSession
    touched = changed.select(folder_of(F.col("mws_id"), folders).alias("folder")).distinct()
    part = history.withColumn("folder", folder_of(F.col("mws_id"), folders)).join(touched, "folder", "left_semi").drop("folder")
    key, before = "spark.sql.sources.partitionOverwriteMode", spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set(key, "dynamic")
    try:
        answers(part, folders).repartition("folder").write.partitionBy("folder").mode("overwrite").parquet(path)
    finally:
        spark.conf.set(key, before)


def read_answers(spark: SparkSession, path: str, asked: DataFrame | None = None, folders: int = FOLDERS) -> DataFrame:
    """The stored answers; with ``asked`` only the folders of its locations, at most ``folders`` numbers."""
    stored = spark.read.parquet(path)
    if asked is None:
        return stored
    numbers = [r[0] for r in asked.select(folder_of(F.col("mws_id"), folders).alias("folder")).distinct().collect()]
    return stored.where(F.col("folder").isin(numbers))


def look_up(requests: DataFrame, stored: DataFrame, anchor: str = "anchor", target: str = "target", folders: int = FOLDERS) -> DataFrame:
    """``requests`` with ``current`` and the baseline columns, by one equality join.

    A request without a location, a date or an interval at its date keeps NULLs, and a count of zero.
    """
    def at(row: Column, day: Column) -> Column:
        return (row["valid_from"] <= day) & (row["valid_to"].isNull() | (day < row["valid_to"]))

    joined = requests.withColumn("folder", folder_of(F.col("mws_id"), folders)).join(stored, ["folder", "mws_id"], "left")
    value = F.get(F.filter("values", lambda v: at(v, F.col(anchor))), F.lit(0))
    base = F.get(F.filter("baselines", lambda b: (b["month"] == F.month(target)) & at(b, F.col(target))), F.lit(0))
    out = joined.withColumns({"current": value["current"], "_base": base})
    return out.withColumns({
        "baseline_mean": F.col("_base.baseline_mean"), "baseline_std": F.col("_base.baseline_std"),
        "baseline_n": F.coalesce("_base.baseline_n", F.lit(0))}).drop("folder", "values", "baselines", "_base")
