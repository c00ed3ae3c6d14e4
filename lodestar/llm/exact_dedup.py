"""Exact dedup: rows with the same text, found by a 128-bit content hash and told apart by their bytes.

Plan. Texts are pre-aggregated by (hash, text) before the one shuffle that carries texts, so a group of
copies leaves each task as one row, however large it is; the aggregate compares the bytes of its keys.
What remains is thin (hash, digest, count, smallest or largest id per distinct text) and is written once.
Rows then find their group by the hash alone, in a join of thin rows that adaptive execution can split on
a hot hash. Only hashes that two distinct texts share, which are none in practice, need the texts again.

Defined results. A null text counts as empty. A null id never represents a group unless all its ids are
null. Rows that repeat both id and text are one document and get the same verdict. An empty table gives
an empty result. Extra columns, whatever their names, are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", content_hash: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    keep: which id of a group stays, "smallest" or "largest". content_hash: any function of the text;
    a weak one gives the same result, more slowly.
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), content_hash(text).alias("_hash"))
    group = (F.count(F.lit(1)).alias("group_size"), pick("_id").alias("keep_id"))
    texts = base.groupBy("_hash", "_text").agg(*group).select("_hash", "group_size", "keep_id", F.sha2("_text", 256).alias("text_sha256"))
    texts = written(texts, "exact-texts")
    shared = written(texts.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash"), "exact-shared")
    found = base.select("_id", "_hash").join(texts, "_hash")
    if not shared.isEmpty():  # a hash of two texts: these rows alone are joined by their bytes
        found = found.join(shared, "_hash", "left_anti")
        rows = base.join(shared, "_hash", "left_semi")
        own = rows.groupBy("_hash", "_text").agg(*group)
        found = found.unionByName(rows.join(own, ["_hash", "_text"]).withColumn("text_sha256", F.sha2("_text", 256)).drop("_text"))
    return found.select(F.col("_id").alias("doc_id"), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The documents whose id represents its group, with all their columns. Of rows that repeat an id that stays, all stay."""
    kept = exact_groups(docs, id_col=id_col, text_col=text_col, keep=keep).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept_id"]), "left_semi")


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
