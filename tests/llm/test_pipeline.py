"""The pipeline against a brute-force version of every stage."""

import hashlib

import corpus_pipeline
from lodestar.llm import language_id, pieces
from lodestar.llm import queries as Q

from .test_decontaminate import overlaps
from .test_jaccard import brute


def test_whole_pipeline(spark, sf, documents):
    rows = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    langs, logp = language_id.train(documents.where(language_id.crc_mod(documents.doc_id, 5) != 0))
    names, scores = language_id.scored(list(rows.values()), langs, logp)
    rows = {i: t for (i, t), n, s in zip(rows.items(), names, scores) if n != "und" and s >= 0.5}
    first = {}
    for i, t in sorted(rows.items()):
        first.setdefault(t, i)
    rows = {i: t for t, i in first.items()}
    rows = {i: rows[i] for i in brute(list(rows.items()))}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {}
    for i, t in rows.items():
        if not any(len(set(x.split()) & set(t.split())) >= 8 and overlaps(t, x) for x in items):
            kept[i] = t
    own = pieces.vocabulary(pieces.default_vocabulary())
    expected = sorted((i, len(own.library.encode(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in kept.items())
    got = sorted((r.doc_id, r.n_tokens, r.text_sha256) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == expected and 0 < len(got) < documents.count()


def test_stages(spark, sf, documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, documents, sf).columns == documents.columns


def test_stages_on_awkward_and_empty_tables(spark, sf, awkward, empty):
    """Nulls, empty and very long texts, repeated rows, clashing columns, no rows: every stage keeps the columns, and the last one encodes what is left."""
    rows, docs = {}, awkward.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == awkward.columns
        rows[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
        assert stage(spark, empty, sf).count() == 0 and stage(spark, empty, sf).columns == empty.columns
    assert rows["language_id"] == [4, 5, 6, 8, 9, 10, 11, 12, 13]  # no language to learn from: all with a letter
    assert rows["exact_dedup"] == rows["simhash_near_dedup"] == rows["benchmark_decontamination"] == [4, 6, 8, 10, 11, 12, 13]
    last = corpus_pipeline.STAGES[-1][1]
    assert sorted(r.doc_id for r in last(spark, docs, sf).collect()) == [4, 6, 8, 10, 11, 12, 13] and last(spark, empty, sf).count() == 0
    repeated = awkward.where("doc_id = 8").union(awkward.where("doc_id = 8")).union(awkward.where("doc_id = 9"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        repeated = stage(spark, repeated, sf)
    assert [r.doc_id for r in repeated.select("doc_id").collect()] == [8, 8]


def test_names():
    assert sorted(Q.queries(), key=lambda n: int(n[2:].split("_")[0])) == [n for n in sorted(Q.queries(), key=lambda n: int(n[2:].split("_")[0]))] and len(Q.queries()) == 10
    assert set(Q.oracle_sql()) <= set(Q.queries())


def test_sql_gives_the_same_rows(spark, sf):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    for name, sql in Q.oracle_sql().items():
        df = Q.queries()[name](spark, sf)
        columns = sorted(df.columns)
        result = con.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        assert sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=repr)
