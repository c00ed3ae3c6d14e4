"""Quality classifier: supervised subword embeddings, averaged per document, with a softmax output.

A document is the average of the learned vectors of its hashed words, word pairs and character n-grams
(case kept). Word pairs are hashed by exclusive or, so a repeated word always meets the same bucket. Two
classes; vectors and output weights are trained together by numpy stochastic gradient descent on the
driver, from a bounded sample: about TRAIN_ROWS labelled rows of each class, of at most TRAIN_CHARS
characters, reduced to sparse counts on the executors, of which at most about TRAIN_BYTES bytes reach the
driver: of more, a share chosen by a hash of the id. An id that repeats is learned from once. For scoring, a bucket's vector times the output
weights is one number, so the model is an array of BUCKETS floats, broadcast; each text is read once and
nothing is shuffled.

Defined results. Null and empty texts are scored by the bias alone. Texts of any length are scored whole.
Repeated rows get equal results. Labels that are null are not learned from; without labels of both
classes the score is 0.5. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded_batches, bounded_sample, code_points, crc_mod, hash_place, mix, written

BITS, DIM, EPOCHS, RATE = 16, 16, 8, 2.0
BUCKETS = 1 << BITS
TRAIN_ROWS, TRAIN_CHARS, TRAIN_BYTES = 2000, 200_000, 256 << 20


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of words, word pairs, 2-, 3- and 4-grams of the texts, each text's first entry with the total at the end)."""
    cp, starts, ends = code_points(texts, gap=4)
    blank = (cp <= 32)
    start_of = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([starts, [len(cp)]])))
    value = np.where(blank, 32, cp).astype(np.uint32)
    padded = np.concatenate([value, np.full(4, 32, np.uint32)])
    h, parts, owners = value * np.uint32(0x9E3779B1), [], []
    inside = np.flatnonzero(~blank)
    for k in range(1, 4):
        h = h * np.uint32(0x01000193) + padded[k : k + len(value)] * np.uint32(0x9E3779B1)
        parts.append(((h[inside] ^ (h[inside] >> np.uint32(15))) * np.uint32(0x85EBCA77 + 2 * k)) >> np.uint32(32 - BITS))
        owners.append(start_of[inside])
    edge = np.diff(np.concatenate([[1], blank.view(np.int8), [1]]))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(begin):
        length = end - begin
        offset = inside - np.repeat(begin, length)
        whole = mix(np.add.reduceat(mix(cp[inside].astype(np.uint64) + (offset.astype(np.uint64) << np.uint64(32))), np.cumsum(length) - length))
        parts.append((whole >> np.uint64(64 - BITS)).astype(np.uint32))
        owners.append(start_of[begin])
        same = start_of[begin[1:]] == start_of[begin[:-1]]
        pair = mix((whole[1:] ^ whole[:-1]) + np.uint64(7))
        parts.append((pair[same] >> np.uint64(64 - BITS)).astype(np.uint32))
        owners.append(start_of[begin[1:]][same])
    owner, bucket = np.concatenate(owners), np.concatenate(parts)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.searchsorted(owner[order], np.arange(len(texts) + 1))


def sparse_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, text) to (id, label, buckets, counts)."""
    for batch in batches:
        ids, labels, texts = (batch.column(i).to_pylist() for i in range(3))
        for start, part in blocks(texts):
            bucket, bounds = features(part)
            rows = [np.unique(bucket[bounds[i] : bounds[i + 1]], return_counts=True) for i in range(len(part))]
            yield pa.RecordBatch.from_arrays([pa.array(ids[start : start + len(part)], batch.schema.field(0).type), pa.array(labels[start : start + len(part)], pa.int32()), pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([r[1].astype(np.int32) for r in rows], pa.list_(pa.int32()))], ["id", "label", "buckets", "counts"])


def descend(rows: list[tuple[int, np.ndarray, np.ndarray]], *, epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> tuple[np.ndarray, float]:
    """(weight of each bucket, bias) from (label, buckets, counts): softmax over two classes, classes weighted alike, rate falling to 0."""
    rng = np.random.default_rng(seed)
    vectors, out, bias = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32), np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    labels = np.array([r[0] for r in rows])
    if len(set(labels.tolist())) < 2:
        return np.zeros(BUCKETS, np.float32), 0.0
    weight = len(rows) / (2 * np.bincount(labels, minlength=2))
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, bucket, count = rows[i]
            lr = rate * (1 - done / steps) * weight[label]
            done += 1
            share = (count / max(1, count.sum())).astype(np.float32)
            mean = share @ vectors[bucket]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = out @ p
            out -= 0.1 * lr * np.outer(mean, p)
            bias -= 0.01 * lr * p
            vectors[bucket] -= (lr * share)[:, None] * back[None, :] * 10
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def train(sample: DataFrame, train_bytes: int = TRAIN_BYTES) -> tuple[np.ndarray, float]:
    """From (_id, _label, _text) rows, a bounded number of them."""
    kind = sample.schema["_id"].dataType.simpleString()
    rows = written(bounded_batches(sample).mapInArrow(sparse_counts, f"id {kind}, label int, buckets array<int>, counts array<int>"), "quality-counts")
    size = rows.agg(F.sum(8 * F.size("buckets").cast("long"))).first()[0] or 0
    if size > train_bytes:
        rows = rows.where(hash_place("bytes", F.col("id")) < train_bytes / size)
    got = rows.toArrow()
    rows = sorted(zip(got["id"].to_pylist(), got["label"].to_pylist(), range(got.num_rows)), key=lambda r: (str(r[0]), r[1]))
    arrays = [(c.combine_chunks().flatten().to_numpy(), np.concatenate([[0], np.cumsum(c.combine_chunks().value_lengths().to_numpy())])) for c in (got["buckets"], got["counts"])] if got.num_rows else []
    pick = lambda a, i: a[0][a[1][i] : a[1][i + 1]]
    return descend([(label, pick(arrays[0], i), pick(arrays[1], i)) for _, label, i in rows])


def scores(texts: list[str | None], weight: np.ndarray, bias: float) -> np.ndarray:
    out = np.zeros(len(texts))
    for start, part in blocks(texts):
        bucket, bounds = features(part)
        size = np.diff(bounds)
        filled = np.flatnonzero(size)
        if len(filled):
            out[start + filled] = np.add.reduceat(weight[bucket].astype(np.float64), bounds[:-1][filled]) / size[filled]
    return 1 / (1 + np.exp(-(out + bias)))


def predict(docs: DataFrame, model: tuple[np.ndarray, float], *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = shared.value
        for batch in batches:
            score = scores(batch.column(1).to_pylist(), weight, bias)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return bounded_batches(docs.select(id_col, text_col)).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, mod: int, left_out: int, per_class: int, most_chars: int) -> DataFrame:
    """(_id, _label, _text) of about `per_class` learnable ids of each class. Chosen from the distinct labels alone, so the broadcast side has a few thousand rows at any size, and only the texts chosen are shuffled."""
    learn = labels.where((crc_mod(F.col(id_col), mod) != left_out) & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).distinct()
    chosen = bounded_sample(learn, "_label", "_id", per_class)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).where(F.length("_text") <= most_chars)
    return rows.join(F.broadcast(chosen), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text"))


def judge_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out_mod: int = 5, threshold: float = 0.3) -> DataFrame:
    """Learns from labelled rows whose crc32(id as text) modulo `held_out_mod` is not 0, scores all: doc_id, held_out, score, predicted."""
    model = train(labelled_sample(docs, labels, "quality", id_col, text_col, held_out_mod, 0, TRAIN_ROWS, TRAIN_CHARS))
    scored = predict(docs, model, id_col=id_col, text_col=text_col, threshold=threshold)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), held_out_mod) == 0).alias("held_out"), "score", "predicted")
