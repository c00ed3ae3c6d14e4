"""Numbering by ranges against a window over everything."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.operators.ordering import numbered


def test_numbers_equal_a_window(spark):
    rows = spark.range(3000).select((F.col("id") % 3 == 0).cast("int").alias("g"), F.when(F.col("id") % 50 != 0, F.xxhash64("id") % 97).alias("v"), F.col("id").alias("i"))
    for by in (["g"], []):
        got = {(r.i, r.n) for r in numbered(rows, by, ["v", "i"], "n").collect()}
        whole = rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("v", "i")))
        assert got == {(r.i, r.n) for r in whole.collect()}
    assert numbered(rows.limit(0), ["g"], ["v"], "n").count() == 0


def test_null_groups_are_groups(spark):
    rows = spark.createDataFrame([(None, 2), (None, 1), ("a", 5)], "g string, v int")
    assert {(r.g, r.v, r.n) for r in numbered(rows, ["g"], ["v"], "n").collect()} == {(None, 1, 1), (None, 2, 2), ("a", 5, 1)}
