"""Reciprocal rank fusion and the hybrid searcher."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.constants import KINDS, RRF_K
from lodestar.operators.lexical import bm25_top, top
from lodestar.operators.vector import nearest


def fuse(lists: list[tuple[str, float, DataFrame]], *, rrf_k: int = RRF_K, k: int | None = None) -> DataFrame:
    """(name, weight, ranked (qid, id, rank, …)) lists to (qid, id, score, <name>_rank, <name>_value …, retrievers, rank).

    <name>_value is a list's own figure, its column score or distance, if it has one. retrievers are the
    lists that hold the hit. A union and one aggregate instead of a full outer join per list. Equal scores
    keep the order of the lists: by the first list's rank, then the next one's.
    """
    names = [n for n, _, _ in lists]
    value = lambda df: next((F.col(c) for c in ("score", "distance") if c in df.columns), F.lit(None)).cast("double")
    parts = [df.select("qid", "id", F.lit(i).alias("_list"), F.col("rank").alias("_rank"), value(df).alias("_value"), (F.lit(float(w)) / (rrf_k + F.col("rank"))).alias("_part")) for i, (_, w, df) in enumerate(lists)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    rank_of = [F.max(F.when(F.col("_list") == i, F.col(f"_{what}"))).alias(f"{n}_{what}") for i, n in enumerate(names) for what in ("rank", "value")]
    fused = both.groupBy("qid", "id").agg(F.sum("_part").alias("score"), *rank_of)
    fused = fused.withColumn("retrievers", F.array_compact(F.array(*[F.when(F.col(f"{n}_rank").isNotNull(), F.lit(n)) for n in names])))
    order = [F.desc(F.round("score", 12)), *[F.asc_nulls_last(f"{n}_rank") for n in names], F.asc("id")]
    return top(fused, k if k is not None else 2**31 - 1, order=order)


class HybridSearcher:
    """Search over chunks (id, text, metadata struct) and their vectors (id, embedding).

    Filters act where they do in the contract: `kinds` before either cut, `file_sub` before the lexical
    and after the vector cut (`file_before=True` puts it before both), and vector hits without a chunk go
    after the cut. Of a hit, `retrievers` names those that ran, as a list of all hits shares it.
    """

    def __init__(self, chunks: DataFrame, vectors: DataFrame | None = None, embed=None):
        self.spark: SparkSession = chunks.sparkSession
        self.chunks, self.vectors, self.embed = chunks, vectors, embed
        text = F.concat_ws("\n", "text", "metadata.name", "metadata.file")
        self.corpus = chunks.select("id", text.alias("text"), F.col("metadata.kind").alias("kind"), F.col("metadata.file").alias("file"))

    def search(self, query: str, *, k: int = 5, pool: int = 40, rrf_k: int = RRF_K, w_bm25: float = 1.0, w_vec: float = 1.0, kinds: list[str] | None = None, file_sub: str | None = None, bm25_only: bool = False, vector_only: bool = False, vector: list[float] | None = None, file_before: bool = False) -> DataFrame:
        """Ranked hits: rank, score, id, bm25_rank, bm25_score, vector_rank, distance, retrievers, metadata, text."""
        if kinds and (bad := set(kinds) - set(KINDS)):
            raise ValueError(f"unknown kinds: {sorted(bad)}")
        of_kind = F.col("kind").isin(*kinds) if kinds else F.lit(True)
        of_file = F.contains(F.lower("file"), F.lower(F.lit(file_sub))) if file_sub else F.lit(True)
        if bm25_only and vector_only:
            raise ValueError("bm25_only and vector_only exclude each other")
        lists = []
        if not vector_only:
            ranked = bm25_top(self.corpus, self.spark.createDataFrame([(0, query)], "qid int, query string"), pool=pool, keep=of_kind & of_file, id_col="id")
            lists.append(("bm25", w_bm25, ranked))
        if not bm25_only and self.vectors is not None:
            vector = vector if vector is not None else self.embed(query)
            held = self.vectors.join(self.corpus.select("id", "kind", "file"), "id", "left")
            before = (of_kind | F.lit(False)) & (of_file if file_before else F.lit(True))
            hits = nearest(held, self.spark.createDataFrame([(0, [float(x) for x in vector])], "qid int, vector array<double>"), pool=pool, id_col="id", before=before)
            lists.append(("vector", w_vec, top(hits.join(self.corpus.where(of_file).select("id"), "id", "left_semi"), pool, order=[F.asc("distance"), F.asc("id")])))
        fused = fuse(lists, rrf_k=rrf_k, k=k).withColumn("retrievers", F.array(*[F.lit(n) for n, _, _ in lists]))
        for name in ("bm25", "vector"):
            if f"{name}_rank" not in fused.columns:
                fused = fused.withColumns({f"{name}_rank": F.lit(None).cast("int"), f"{name}_value": F.lit(None).cast("double")})
        out = fused.withColumnsRenamed({"bm25_value": "bm25_score", "vector_value": "distance"})
        return out.join(self.chunks, "id").select("rank", "score", "id", "bm25_rank", "bm25_score", "vector_rank", "distance", "retrievers", "metadata", "text").orderBy("rank")
