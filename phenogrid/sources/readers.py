"""Readers of the stored inputs: columns are used by name, schemas are fixed."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenogrid.schema import MANIFEST_SCHEMA, PANEL_SCHEMA, PROFILE, REQUEST_SCHEMA


def _named_schema(header: list[str], contract: T.StructType) -> T.StructType:
    """Types of the contract in the order of the file; columns it does not name are read as text."""
    known = {f.name: f.dataType for f in contract}
    return T.StructType([T.StructField(c, known.get(c, T.StringType())) for c in header])


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    return spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path).columns


def read_csv(spark: SparkSession, path: str, contract: T.StructType, sep: str = ",", optional=()) -> DataFrame:
    """CSV by column name: no inference pass, one error naming every missing column."""
    header = _header(spark, path, sep)
    missing = [f.name for f in contract if f.name not in header and f.name not in optional]
    if missing:
        raise ValueError(f"{path}: missing column(s) {missing}; has {header}")
    df = spark.read.option("header", True).option("sep", sep).schema(_named_schema(header, contract)).csv(path)
    return df.select(*[F.col(f.name) if f.name in header else F.lit(None).cast(f.dataType).alias(f.name) for f in contract])


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """The panel from CSV, or from Parquet when the path says so."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(PANEL_SCHEMA).parquet(path)
    return read_csv(spark, path, PANEL_SCHEMA)


def detect_separator(spark: SparkSession, path: str) -> str:
    first = spark.read.text(path).limit(1).first()
    return "\t" if first is not None and "\t" in first[0] else ","


def read_static_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Profiles, comma- or tab-separated."""
    d = T.DoubleType()
    contract = T.StructType([T.StructField(c, T.StringType() if c == "mws_id" else d) for c in PROFILE])
    return read_csv(spark, path, contract, detect_separator(spark, path))


def read_manifest(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    df = read_csv(spark, path, MANIFEST_SCHEMA)
    return df.orderBy("mws_id").limit(limit) if limit else df


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, REQUEST_SCHEMA, optional=("date",))


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Wide vectors (e0, e1, ...) as one array column, in numeric order; no period means ANNUAL."""
    df = spark.read.parquet(path)
    vec = sorted((c for c in df.columns if re.fullmatch(r"e\d+", c)), key=lambda c: int(c[1:]))
    period = F.coalesce(F.col("half").cast("string"), F.lit("ANNUAL")) if "half" in df.columns else F.lit("ANNUAL")
    return df.select(F.col("mws_id").cast("string").alias("mws_id"), F.col("year").cast("int").alias("year"), period.alias("half"),
                     F.array(*[F.col(c).cast("float") for c in vec]).alias("embedding"))
