"""Exact nearest neighbours by cosine distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.lexical import top
from lodestar.storage import written

#: Query vectors held by every task at once; more are searched in blocks of this many.
BLOCK_QUERIES = 512
#: Vectors compared with a block at a time, and digits of a distance that count in the order.
BLOCK_VECTORS, DIGITS = 4096, 12


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows of an array column scaled to length 1, in doubles; which rows these are). Nulls, rows of another width than the first and rows without length have no direction and are left out."""
    width = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False), nan=-1).astype(np.int64)
    at = np.flatnonzero(width == max(1, int(width.max(initial=0))))
    if not len(at):
        return np.empty((0, 0)), at
    rows = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), -1)
    length = np.sqrt((rows * rows).sum(axis=1))
    good = np.isfinite(length) & (length > 0)
    return rows[good] / length[good, None], at[good]


def nearest(vectors: DataFrame, queries: DataFrame, *, pool: int = 40, id_col: str = "vec_id", vector_col: str = "embedding", query_vector: str = "vector", before=None, skip_self: bool = False) -> DataFrame:
    """(qid, id, distance, rank) of the pool nearest vectors of each query.

    A stated set of queries against all vectors, in blocks of BLOCK_QUERIES: the tasks of a scan multiply
    their vectors with a block as matrices and keep a pool per query, so what is shuffled is at most tasks x
    queries x pool rows. `before` filters vectors ahead of the cut. Exact: no index is approximated. Equal
    distances go by id. Vectors without length, and null ones, are near nothing.
    """
    spark = vectors.sparkSession
    base = (vectors.where(before) if before is not None else vectors).select(F.col(id_col).alias("id"), F.col(vector_col).alias("_v"))
    queries = queries.select("qid", F.col(query_vector).alias("_q"))
    if queries.count() > BLOCK_QUERIES:
        queries = written(queries, "query-vectors")
    n = max(1, -(-queries.count() // BLOCK_QUERIES))
    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, id {base.schema['id'].dataType.simpleString()}, distance double"
    return reduce(DataFrame.unionByName, [block_pools(base, spark, queries.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == k) if n > 1 else queries, pool, kinds, skip_self) for k in range(n)])


def block_pools(base: DataFrame, spark, block: DataFrame, pool: int, kinds: str, skip_self: bool) -> DataFrame:
    """nearest() for one block of queries."""
    held = block.toArrow().combine_chunks()
    asked, at = unit_rows(held["_q"].combine_chunks() if held.num_rows else pa.array([], pa.list_(pa.float64())))
    qids = [held["qid"][i].as_py() for i in at.tolist()]
    shared, qid_type = spark.sparkContext.broadcast((asked, qids)), held.schema.field("qid").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, qids = shared.value
        best: list[list[tuple]] = [[] for _ in qids]
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for s in range(0, batch.num_rows if qids else 0, BLOCK_VECTORS):
                part = batch.slice(s, BLOCK_VECTORS)
                rows, where = unit_rows(part.column(1))
                if not len(where) or rows.shape[1] != asked.shape[1]:
                    continue
                ids = part.column(0).take(pa.array(where)).to_pylist()
                distance = np.round(1 - asked @ rows.T, DIGITS)
                for q, qid in enumerate(qids):
                    d = distance[q]
                    limit = np.partition(d, pool)[pool] if len(d) > pool + 1 else np.inf
                    near = np.flatnonzero(d <= limit).tolist()
                    best[q] = sorted(best[q] + [(float(d[i]), ids[i]) for i in near if not (skip_self and ids[i] == qid)], key=lambda x: (x[0], x[1] is not None, x[1]))[:pool]
        for qid, found in zip(qids, best):
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([qid] * len(found), qid_type), pa.array([i for _, i in found], kind), pa.array([d for d, _ in found])], ["qid", "id", "distance"])

    return top(base.mapInArrow(run, kinds), pool, order=[F.asc("distance"), F.asc("id")])


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """The newest row of each key: incoming ones replace those that exist; of incoming repeats the one with the largest `seq` stays."""
    both = existing.withColumn("_new", F.lit(0)).withColumn("seq", F.lit(None).cast(incoming.schema["seq"].dataType)).unionByName(incoming.withColumn("_new", F.lit(1)))
    newest = both.groupBy(key).agg(F.max_by(F.struct(*[c for c in existing.columns if c != key]), F.struct("_new", "seq")).alias("_r"))
    return newest.select(key, "_r.*").select(*existing.columns)
