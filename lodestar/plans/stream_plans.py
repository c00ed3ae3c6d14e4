"""Streaming queries: rows-only checks where no SQL stands for a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.storage import scratch
from lodestar.streaming import ledger_stream as R

from . import ledger_plans as P
from . import views as V
from .registry import query, table


def reply_files(spark, sf, path: str) -> None:
    """One reply per order date and segment: files of a landing folder."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    item = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("일자"), F.col("o_orderpriority").alias("가맹점"), F.col("o_totalprice").cast("bigint").alias("금액"), F.lit("기타").alias("분류"))
    rows = o.select(F.col("c_mktsegment").alias("card"), F.concat(F.lit("stmt_20"), F.date_format("o_orderdate", "yyMM"), F.lit(".html")).alias("filename"), item.alias("t"))
    replies = rows.groupBy("card", "filename").agg(F.to_json(F.struct(F.collect_list("t").alias("transactions"))).alias("json"))
    replies.repartition(3).write.mode("append").json(path)


@query("r1_r4_r7_ledger_stream", """WITH rows AS (SELECT DISTINCT c_mktsegment AS card, strftime(o_orderdate, '20%y%m') AS month_tab, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS merchant, CAST(trunc(o_totalprice) AS BIGINT) AS amount
  FROM orders JOIN customer ON o_custkey = c_custkey) SELECT month_tab, CAST(coalesce(sum(amount) FILTER (WHERE card <> 'HOUSEHOLD'), 0) AS BIGINT) AS grand_total FROM rows GROUP BY month_tab""")
def r1(spark, sf):
    """Two files per micro-batch, all delivered twice: the second delivery adds nothing."""
    root, inbox = scratch(spark, "stream"), scratch(spark, "inbox")
    for _ in range(2):
        reply_files(spark, sf, inbox)
        R.start(spark, inbox, root, max_files=2, personal=V.PERSONAL).awaitTermination()
    totals = spark.read.parquet(f"{root}/totals")
    return totals.select(F.col("month_tab").cast("string").alias("month_tab"), "grand_total")




@query("r6_dead_letters", f"WITH {P.REPLIES} SELECT CAST(batch_id AS VARCHAR) AS filename, error FROM checked WHERE attempt = 1 AND error IS NOT NULL")
def r6(spark, sf):
    """Invalid replies end in the dead-letter table with the reason; the others of their batch go on."""
    root, inbox = scratch(spark, "stream"), scratch(spark, "inbox")
    replies = P.replies(spark, sf).where("attempt = 1")
    replies.select(F.lit("BC").alias("card"), F.col("batch_id").cast("string").alias("filename"), "json").repartition(2).write.json(inbox)
    R.start(spark, inbox, root).awaitTermination()
    return spark.read.parquet(f"{root}/failed").select("filename", "error")
