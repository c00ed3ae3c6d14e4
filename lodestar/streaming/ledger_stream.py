"""The ledger as a stream: reply files arrive in a folder, each micro-batch updates the months it touches.

The sink is idempotent. What a batch adds is told from the ledger without the batch's own rows, so a batch
that is replayed after a failure at any point finds the same rows new; of these only the ones that the
ledger lacks are appended. Totals of all months that the batch touches are computed again, and the batch's
counts and failures are a part of their tables that is replaced. Counts are written last. A full replay
from a new checkpoint adds nothing twice either. The checkpoint is the marker of what was processed.
Replies that are not valid go to a dead-letter table with the reason, and the others of the batch go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.constants import CATEGORY_RULES, EXCLUDED_MERCHANTS
from lodestar.functions.text import month_tab
from lodestar.operators.ledger import append_counts, grand_totals, ledger_update, new_rows, subtotals, transactions, validated
from lodestar.sources.sinks import append_ledger, dead_letters, overwrite_months, overwrite_parts
from lodestar.storage import written

REPLY = "card string, filename string, json string"
LEDGER = "card string, day string, merchant string, amount bigint, category string, idx string, month_tab string"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger so far; a folder that does not exist yet is an empty ledger."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(LEDGER).parquet(path) if there else spark.createDataFrame([], LEDGER)


def update(batch: DataFrame, root: str, batch_id: int, *, rules=CATEGORY_RULES, excluded_merchants: list[str] = EXCLUDED_MERCHANTS, personal: list[str] | None = None) -> None:
    """One micro-batch: validate, classify, exclude, drop known rows, append, and recompute the totals of the touched months."""
    from lodestar.constants import PERSONAL_CARDS

    spark, mark = batch.sparkSession, f"{batch_id:09d}:"
    replies = written(batch.select("card", "filename", "json"), "replies")
    checked = written(validated(replies, ["card", "filename"]), "checked")
    good = replies.join(checked.where("valid").select("card", "filename"), ["card", "filename"], "left_semi")
    rows = transactions(good).withColumn("month_tab", month_tab(F.col("filename"))).withColumn("idx", F.concat(F.lit(mark), "filename", F.lit(":"), F.lpad(F.col("pos").cast("string"), 9, "0")))
    rows = written(rows.select("card", "day", "merchant", "amount", "category", "idx", "month_tab"), "rows")
    months = [r[0] for r in rows.select("month_tab").distinct().collect()]
    held = read_ledger(spark, f"{root}/ledger").where(F.col("month_tab").isin(months))
    candidates, added = ledger_update(rows, held.where(~F.startswith("idx", F.lit(mark))), rules=rules, excluded_merchants=excluded_merchants)
    added = written(added, "added")
    lacking = written(new_rows(added, held), "lacking")
    if not lacking.isEmpty():
        append_ledger(lacking, f"{root}/ledger")
    touched = read_ledger(spark, f"{root}/ledger").where(F.col("month_tab").isin(months))
    if not touched.isEmpty():
        overwrite_months(subtotals(touched, ["month_tab"]), f"{root}/subtotals")
        overwrite_months(grand_totals(touched, ["month_tab"], personal if personal is not None else PERSONAL_CARDS), f"{root}/totals")
    if not (bad := checked.where("NOT valid")).isEmpty():
        dead_letters(bad.withColumn("batch_id", F.lit(batch_id)), f"{root}/failed")
    counts = append_counts(candidates, added).withColumn("batch_id", F.lit(batch_id))
    if not counts.isEmpty():
        overwrite_parts(counts, f"{root}/counts", "batch_id")


def start(spark: SparkSession, inbox: str, root: str, *, max_files: int | None = None, every: str | None = None, **how) -> StreamingQuery:
    """Runs over the JSON reply files of a folder: all there are, then stops; or every so often (`every`, such as "4 hours"). `max_files` bounds a micro-batch. A new `root` is a full replay."""
    reader = spark.readStream.schema(REPLY)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    writer = reader.json(inbox).writeStream.option("checkpointLocation", f"{root}/checkpoint").foreachBatch(lambda df, i: update(df, root, i, **how))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
