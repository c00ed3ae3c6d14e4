"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of a bounded sample of labelled rows: about TRAIN_ROWS rows of each language,
chosen by a hash of the id, of at most TRAIN_CHARS characters each. Tasks add up their own counts, one
aggregate adds the tasks', and the log-probability matrix (BUCKETS rows, one column per language) is
broadcast: its size depends on the number of languages alone. Scoring reads each text once, in numpy
blocks of bounded size: bucket numbers of all n-grams form the indices of a sparse matrix with one row per
document, which is multiplied with the log-probabilities. No shuffle.

Defined results. A null text and a text without a letter are "und" with score 0. Texts of any length are
scored whole. Equal scores go to the language whose name sorts first. A text's result depends on the text
and the model alone, so repeated rows get equal results in any batch. Without any labelled row every
prediction is "und". An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded_batches, bounded_sample, code_points, crc_mod, lowered

BUCKETS, ORDERS, SMOOTHING = 1 << 16, (1, 2, 3), 0.5
TRAIN_ROWS, TRAIN_CHARS = 1500, 200_000
UNKNOWN = "und"
#: Rows taken from Arrow at a time.
SLICE = 1000
#: Probability of the best language from which accepted() takes it as told.
TOLD = 0.5


def gram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every n-gram, each text's first entry with the total at the end, whether a text has a letter). Runs of other characters count as one blank at a word's edge."""
    cp, starts, ends = code_points(texts, gap=max(ORDERS))
    low, letter = lowered(cp, letters_only=True)
    has = np.add.reduceat(letter.astype(np.int64), starts) > 0 if len(starts) else np.empty(0, bool)
    value = np.where(letter, low, 32).astype(np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each run of letters
    begins = keep.copy()
    for k in range(1, max(ORDERS)):  # blanks behind every text, where no n-gram begins: none reaches into the next text
        keep[ends + k], begins[ends + k] = True, False
    at = np.flatnonzero(keep)
    value, begins = value[at], begins[at]
    bounds = np.concatenate([[0], np.cumsum(begins)])[np.concatenate([np.searchsorted(at, starts), [len(value)]])]
    value = np.concatenate([value, np.full(max(ORDERS), 32, np.uint32)])
    n, out = len(at), np.empty((len(at), len(ORDERS)), np.uint16)
    h = np.zeros(n, np.uint32)
    for k in range(max(ORDERS)):
        h = h * np.uint32(0x01000193) + value[k : k + n] * np.uint32(0x9E3779B1)
        if k + 1 in ORDERS:
            out[:, ORDERS.index(k + 1)] = ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(16)
    return out[begins].reshape(-1), bounds * len(ORDERS), has


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to the task's own (lang, bucket, n)."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for start, part in blocks(texts):
            grams, bounds, _ = gram_buckets(part)
            for i in range(len(part)):
                table = counts.setdefault(langs[start + i], np.zeros(BUCKETS, np.int64))
                table += np.bincount(grams[bounds[i] : bounds[i + 1]], minlength=BUCKETS)
    for lang, table in counts.items():
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(table[at], pa.int64())], ["lang", "bucket", "n"])


def train(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities float32 of shape (BUCKETS, languages))."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) <= TRAIN_CHARS))
    sample = bounded_sample(rows.select(F.col(id_col), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text")), "_lang", id_col, per_language)
    counts = bounded_batches(sample.select("_lang", "_text")).mapInArrow(counted, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.full((BUCKETS, len(langs)), SMOOTHING)
    table[counts["bucket"].to_numpy(np.int64), np.searchsorted(langs, counts["lang"].to_numpy(str)) if langs else np.empty(0, np.int64)] += counts["n"].to_numpy(np.float64)
    return langs, np.log(table / table.sum(axis=0, keepdims=True)).astype(np.float32) if langs else np.empty((BUCKETS, 0), np.float32)


def scored(texts: list[str | None], langs: list[str], logp: np.ndarray) -> tuple[list[str], np.ndarray]:
    names, scores = [], np.zeros(len(texts))
    for start, part in blocks(texts):
        grams, bounds, has = gram_buckets(part)
        sums = np.zeros((len(part), len(langs)))
        filled = np.flatnonzero(bounds[1:] > bounds[:-1])
        if len(filled) and len(langs):
            for j in range(len(langs)):
                sums[filled, j] = np.add.reduceat(np.take(logp[:, j], grams).astype(np.float64), bounds[:-1][filled])
            top = sums.argmax(axis=1)
            chance = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        for i in range(len(part)):
            if has[i] and langs:
                names.append(langs[top[i]])
                scores[start + i] = chance[i]
            else:
                names.append(UNKNOWN)
    return names, scores


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast((model[0], np.asfortranarray(model[1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logp = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                part = batch.slice(first, SLICE)
                names, scores = scored(part.column(1).to_pylist(), langs, logp)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return bounded_batches(docs.select(id_col, text_col)).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out_mod: int = 5) -> DataFrame:
    """Learns from rows whose crc32(id as text) modulo `held_out_mod` is not 0, predicts all: doc_id, held_out, lang_pred, score."""
    model = train(docs.where(crc_mod(F.col(id_col), held_out_mod) != 0), id_col=id_col, text_col=text_col, lang_col=lang_col)
    return predict(docs, model, id_col=id_col, text_col=text_col).select("doc_id", (crc_mod(F.col("doc_id"), held_out_mod) == 0).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", told: float = TOLD) -> DataFrame:
    """The documents whose language could be told, with all their columns: the text and its verdict travel together, so nothing is joined.

    Rejected are texts that are "und" and those whose best language has a probability below `told`. Where
    no row has a language to learn from, every text with a letter stays.
    """
    langs, logp = train(docs.where(crc_mod(F.col(id_col), 5) != 0), id_col=id_col, text_col=text_col, lang_col=lang_col)
    if not langs:
        return docs.where(F.coalesce(F.rlike(text_col, F.lit(r"\p{L}")), F.lit(False)))
    shared = docs.sparkSession.sparkContext.broadcast((langs, np.asfortranarray(logp)))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                part = batch.slice(first, SLICE)
                found, score = scored(part.column(at).to_pylist(), names, table)
                yield part.filter(pa.array([x != UNKNOWN and s >= told for x, s in zip(found, score.tolist())], pa.bool_()))

    return bounded_batches(docs).mapInArrow(run, docs.schema)
