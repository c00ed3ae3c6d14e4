"""Lexical ranking: term statistics and BM25 for many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestar.constants import BM25_B, BM25_K1
from lodestar.functions.text import bm25_weight, idf, tokenize
from lodestar.storage import small_enough, written

#: Query terms up to which the terms are broadcast; beyond, the join is left to the optimizer.
BROADCAST_TERMS = 100_000


def document_terms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, len, tokens): tokens in order, repeats kept."""
    tokens = tokenize(F.col(text_col))
    return docs.select(F.col(id_col).alias("id"), tokens.alias("tokens")).withColumn("len", F.size("tokens"))


def postings(terms: DataFrame) -> DataFrame:
    """(id, term, tf)."""
    return terms.select("id", F.explode("tokens").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(posting: DataFrame) -> DataFrame:
    """(term, df)."""
    return posting.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_statistics(terms: DataFrame) -> DataFrame:
    """One row: n_docs, avgdl, total_terms."""
    return terms.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avgdl"), F.sum("len").alias("total_terms"))


def query_terms(queries: DataFrame, query_col: str = "query") -> DataFrame:
    """(qid, term, qtf): a repeated query term counts as often as it is repeated."""
    return queries.select("qid", F.explode(tokenize(F.col(query_col))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))


def bm25_scores(docs: DataFrame, queries: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", query_col: str = "query", k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """(qid, id, score) of all documents with a score above 0.

    Documents are tokenized once, in place; only tokens that some query holds are exploded and shuffled, and
    these are counted per document before. The counts are written, and the same pass observes the number
    of documents and of their tokens, so nothing after it reads a text.
    """
    wanted = written(query_terms(queries, query_col), "query-terms")
    words = wanted.select("term").distinct()
    seen = Observation()
    terms = document_terms(docs, id_col, text_col).observe(seen, F.count(F.lit(1)).alias("n_docs"), F.sum("len").alias("total"))
    found = terms.select("id", "len", F.explode_outer("tokens").alias("term")).join(F.broadcast(words) if small_enough(words, BROADCAST_TERMS) else words, "term", "left_semi")
    tf = written(found.groupBy("id", "len", "term").agg(F.count(F.lit(1)).alias("tf")), "term-counts")
    if tf.isEmpty():  # an empty result has no plan left that could have observed anything
        return docs.sparkSession.createDataFrame([], StructType([StructField("qid", queries.schema["qid"].dataType), StructField("id", docs.schema[id_col].dataType), StructField("score", DoubleType())]))
    n_docs, total = seen.get["n_docs"], seen.get["total"] or 0
    scored = tf.join(document_frequency(tf), "term").join(wanted, "term")
    weight = F.col("qtf") * idf(F.lit(n_docs), F.col("df")) * bm25_weight(F.col("tf"), F.col("len"), F.lit(total / max(1, n_docs)), k1, b)
    return scored.groupBy("qid", "id").agg(F.sum(weight).alias("score")).where("score > 0")


def top(scored: DataFrame, k: int, *, by: str = "qid", order=None, name: str = "rank") -> DataFrame:
    """The first k of every query, ranked from 1. Rank filters are pushed below the shuffle as group limits."""
    w = Window.partitionBy(by).orderBy(*(order or [F.desc("score"), F.asc("id")]))
    return scored.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def bm25_top(docs: DataFrame, queries: DataFrame, *, pool: int = 40, keep=None, id_col: str = "doc_id", **how) -> DataFrame:
    """(qid, id, score, rank): the pool best of each query. `keep`, a predicate on the documents' columns, holds before the cut, while statistics stay those of the whole corpus."""
    scored = bm25_scores(docs, queries, id_col=id_col, **how)
    if keep is not None:
        scored = scored.join(docs.where(keep).select(F.col(id_col).alias("id")), "id", "left_semi")
    return top(scored, pool)
