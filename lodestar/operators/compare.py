"""Side-by-side comparison of two ranked result sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare(left: DataFrame, right: DataFrame, key: str = "key", by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """(…, key, rank) twice to (…, key, left_rank, right_rank, side, rank_sum); of a repeated key the last rank counts."""
    keys = [*by, key]
    a = left.groupBy(*keys).agg(F.max("rank").alias("left_rank"))
    b = right.groupBy(*keys).agg(F.max("rank").alias("right_rank"))
    side = F.when(F.col("right_rank").isNull(), F.lit("left")).when(F.col("left_rank").isNull(), F.lit("right")).otherwise(F.lit("both"))
    return a.join(b, keys, "full_outer").withColumn("side", side).withColumn("rank_sum", F.col("left_rank") + F.col("right_rank"))


def overlap(left: DataFrame, right: DataFrame, key: str = "key", by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """(…, common, left_only, right_only): sizes of the intersection and the two differences."""
    return compare(left, right, key, by).groupBy(*by).agg(F.count_if(F.col("side") == "both").alias("common"), F.count_if(F.col("side") == "left").alias("left_only"), F.count_if(F.col("side") == "right").alias("right_only"))
