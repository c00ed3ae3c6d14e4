import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.llm import token_file as T


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(T.default_vocabulary())


def expected(rows, library):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [T.END_ID]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=repr)


def test_documents(documents, texts, library):
    assert sorted((tuple(r) for r in T.token_digest(documents).collect()), key=repr) == expected(list(texts.items()), library)


def test_awkward(awkward, empty, library):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert sorted((tuple(r) for r in T.token_digest(awkward).collect()), key=repr) == expected(rows, library)
    assert T.token_digest(empty).count() == 0


def test_cached_words_equal_whole_texts(rng, monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 50)
    own = T.Encoder(T.default_vocabulary())
    parts = ["a b\n\t", "ab c's  　é1!", "<|endoftext|> a", "  \n x'"]
    for _ in range(30):
        made = ["".join(rng.choice(rng.choice(parts)) for _ in range(rng.randint(0, 40))) for _ in range(100)]
        values, n = own.encode(pa.array(made), [])
        assert [values[b - a : b].tobytes() for a, b in zip(n, np.cumsum(n))] == own.direct(made)


def test_selective_reads(spark, documents, tmp_path):
    path = str(tmp_path / "tokens")
    T.write_tokens(documents, path, row_group_bytes=1 << 16, page_bytes=1 << 12)
    index = T.read_index(spark, path)
    assert index.count() == documents.count()
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    import glob

    import pyarrow.parquet as pq

    meta = pq.ParquetFile(glob.glob(f"{path}/*.parquet")[0]).metadata
    column = next(meta.row_group(0).column(i) for i in range(meta.num_columns) if "ids" in meta.row_group(0).column(i).path_in_schema)
    assert any("DICTIONARY" in e or "DELTA" in e for e in column.encodings) and column.has_offset_index
    ids = {r.doc_id: r.ids for r in T.read_tokens(spark, path).where("doc_id = 3").collect()}
    assert list(ids) == [3] and ids[3][-1] == T.END_ID


def test_runs_equal_the_library(rng):
    """Letters, marks, line ends and blanks in any order: cut into runs, and, where that is not allowed, whole."""
    parts = ["a", "é", "foo", "Élan", "'s", "'", "n't", ".", ",", "$$", "\n", "\n\n", "\t", " ", "  ", "1", "²", "ß", "<|endoftext|>", "word", "x-y", "中", "×", "_", "|", ".\nAb", "!\n", " ", " ", "😀", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(6000)]
    own = T.Encoder(T.default_vocabulary())
    assert own.by_word
    for allowed in (True, False):
        own.by_word = allowed
        values, n = own.encode(pa.array(texts), [7])
        whole = [own.library.encode(t, add_special_tokens=False).ids + [7] for t in texts]
        assert n.tolist() == list(map(len, whole)) and values.tolist() == [i for ids in whole for i in ids]


def test_a_hot_id_is_dealt_over_ranges(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.col("id") % 40, F.lit(" words")).alias("text")).repartition(4)
    path = str(tmp_path / "hot")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        T.write_tokens(rows, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r.n for r in T.read_index(spark, path).groupBy("part").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 4000 and max(sizes) < 0.5 * 4000
    got = T.read_index(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got) and all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:]))
