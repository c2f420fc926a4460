"""What the sample records and the stored panel take on disk."""

import os
from pathlib import Path

import pytest

from phenogrid import session
from phenogrid.plans import features as fplan
from phenogrid.plans import windows as wplan

SF = "/root/testdata/sf0.001"
CODEC = "spark.sql.parquet.compression.codec"


@pytest.fixture
def own_codec(spark):
    """The session as a caller brings it, without a codec of its own."""
    before = spark.conf.get(CODEC, None)
    spark.conf.unset(CODEC)
    yield
    spark.conf.unset(CODEC) if before is None else spark.conf.set(CODEC, before)


def _bytes(path):
    return sum(f.stat().st_size for f in Path(path).glob("*.parquet"))


def test_records_take_a_fraction_of_their_text(spark, tmp_path, own_codec):
    records = wplan.e06(spark, SF)
    records.write.parquet(f"{tmp_path}/dense")
    records.write.option("compression", "snappy").parquet(f"{tmp_path}/snappy")
    assert _bytes(f"{tmp_path}/dense") * 3 < _bytes(f"{tmp_path}/snappy")
    dense, plain = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("dense", "snappy"))
    keys = ["mws_id", "target_date"]
    assert sorted(dense.select(*keys).collect()) == sorted(plain.select(*keys).collect()) and dense.count() == records.count() > 0


def test_a_codec_of_the_session_stays(spark, own_codec):
    spark.conf.set(CODEC, "gzip")
    session.densely_written(spark)
    assert spark.conf.get(CODEC) == "gzip"


def test_a_stored_panel_leaves_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    sc = spark.sparkContext
    folders = [f.getAbsolutePath() for f in sc._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffles = lambda: {f: f.stat().st_size for top in folders for f in Path(top).glob("*/shuffle_*.data")}
    held = shuffles()
    stored = fplan.stored_panel(spark, SF)
    left = sum(size for f, size in shuffles().items() if f not in held)  # the counting of the observations leaves a row
    kept = sum(os.path.getsize(f.removeprefix("file:")) for f in stored.inputFiles())
    assert left * 10 < kept and spark.conf.get(key, None) == before
