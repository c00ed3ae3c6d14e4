"""Numbering rows in order, without one task that holds them all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.storage import written


def numbered(rows: DataFrame, by: list[str], order: list[str | Column], name: str) -> DataFrame:
    """The rows with `name`, their number from 1 among those of equal `by`, in `order`.

    Rows are dealt by range of (by, order) and numbered within a range; the sizes of ranges, one thin row
    each, say where a range's numbers begin. So a group of any size is spread over tasks. Rows that are
    equal in `by` and `order` are numbered in any order.
    """
    ordered = written(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    sizes = ordered.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    first = sizes.select(F.struct(*by, "_part").alias("_at"), (F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_at.{c}")), by, F.col("_part") == F.col("_at._part"))
    return ordered.withColumn(name, inside).join(first, same).withColumn(name, (F.col(name) + F.col("_before")).cast("int")).drop("_part", "_at", "_before")
