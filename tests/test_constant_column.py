"""A constant column has a spread of 1, however its rows are dealt out."""

from pyspark.sql import functions as F

from phenogrid.operators import scaling


def test_constant_column(spark):
    # in parts of 51 rows the merged mean is a little off, and the merged spread over zero
    rows = spark.range(0, 51 * 8, 1, 8).select(F.lit(1000.0).alias("x"), F.col("id").cast("double").alias("y"))
    got = scaling.fit_scaler(rows, ["x", "y"]).first()
    assert got["x_sd"] == 1.0 and got["y_sd"] > 1
