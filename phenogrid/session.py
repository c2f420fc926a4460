"""Session set-up and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Observations whose shuffled aggregates one task takes: some 50 MB.
ROWS_PER_TASK = 500_000


def build_session(app: str = "phenogrid", cores: str | None = None) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own settings."""
    n = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", n if n.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def operators_alone(spark: SparkSession) -> None:
    """Chains of operators whose loop is too long for the JVM to compile are run operator by operator, unless the session says otherwise.

    The JVM interprets methods of over 8,000 bytes for ever, and Spark's own limit is 65,535: some 30 rounded columns are beyond it.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, "8000")


def densely_written(spark: SparkSession) -> None:
    """Files of rows that repeat most of the row before are written with zstd, unless the session says otherwise.

    Snappy, Spark's choice, copies at most 64 bytes at a time, so a repeated text of ten kilobytes still costs hundreds of bytes.
    """
    key = "spark.sql.parquet.compression.codec"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, "zstd")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only a session without that setting (local tests) gets a folder of its own.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return named or current.get()
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="phenogrid-")
    sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so later use neither recomputes nor re-plans it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's own folder under the shared one.

    The whole ``phenogrid-<application id>`` folder may be deleted once the application is over.
    """
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/phenogrid-{app}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, bucket: str | None = None) -> DataFrame:
    """Write ``df`` once as a columnar table in the shared folder and read it back.

    For frames that several later steps scan with different column subsets: unlike a
    checkpoint, the copy can be pruned and filtered by the scan. With ``bucket`` the rows are
    hashed into as many buckets as there are shuffle partitions, so later windows, aggregates
    and joins on that column need no exchange. Use it where rows per key are bounded (a panel).
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if bucket is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    with shuffles_released(spark):
        # hashed like the buckets, so every task writes one file
        df.repartition(n, bucket).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, bucket).saveAsTable(table)
    return spark.table(table)


@contextmanager
def shuffles_released(spark: SparkSession):
    """Shuffle files of what is executed inside go when it ends; else they stay until the driver happens to collect its garbage.

    For the storing of a table: nothing reads those shuffles again, and a session stores several.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextmanager
def shuffles_for(spark: SparkSession, rows: int):
    """Shuffle partitions and buckets in proportion to ``rows``, never fewer than the session has.

    Holds for what is executed inside, so it belongs around the storing of a table. With a fixed number, what one
    task reads would grow with the input.
    """
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, max(int(before), -(-rows // ROWS_PER_TASK)))
    try:
        yield
    finally:
        spark.conf.set(key, before)
