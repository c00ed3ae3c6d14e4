"""Vectors for chunks without a model: signed feature hashing of search tokens.

A real embedding model plugs in as a column of vectors and a function of a query. This one needs no
download and gives the command line something to index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import tokenize

DIMENSIONS = 256


def embedded(rows: DataFrame, text: Column, dimensions: int = DIMENSIONS) -> DataFrame:
    """The rows with `embedding`: for each bucket the sum of the signs of the tokens that fall into it. Texts without tokens give zeros."""
    hashed = F.transform(tokenize(text), lambda t: F.xxhash64(t))
    signed = F.transform(hashed, lambda h: F.struct(F.pmod(h, F.lit(dimensions)).alias("at"), F.when(F.shiftright(h, 40).bitwiseAND(F.lit(1)) == 1, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("sign")))
    zero = F.array_repeat(F.lit(0.0), dimensions)
    added = lambda v, x: F.transform(v, lambda y, i: y + F.when(i == x["at"], x["sign"]).otherwise(F.lit(0.0)))
    return rows.withColumn("embedding", F.aggregate(signed, zero, added))


def query_vector(spark, text: str, dimensions: int = DIMENSIONS) -> list[float]:
    return embedded(spark.createDataFrame([(text,)], "text string"), F.col("text"), dimensions).head().embedding
