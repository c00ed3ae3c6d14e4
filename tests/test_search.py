import pytest
from pyspark.sql import functions as F

from lodestar.operators.compare import compare, overlap
from lodestar.operators.fusion import HybridSearcher, fuse
from lodestar.operators.vector import nearest, upsert


def ranked(spark, ids):
    return spark.createDataFrame([(0, i, r + 1) for r, i in enumerate(ids)], "qid int, id string, rank int")


def test_fusion_example(spark):
    got = fuse([("bm25", 1.0, ranked(spark, "ABC")), ("vector", 1.0, ranked(spark, "BDA"))]).orderBy("rank").collect()
    assert [r.id for r in got] == ["B", "A", "D", "C"]
    assert [round(r.score, 4) for r in got] == [0.0325, 0.0323, 0.0161, 0.0159]
    assert got[2].retrievers == ["vector"]


def test_equal_scores_keep_list_order(spark):
    got = fuse([("bm25", 1.0, ranked(spark, "AB")), ("vector", 1.0, ranked(spark, "BA"))]).orderBy("rank").collect()
    assert [r.id for r in got] == ["A", "B"]


def test_compare_takes_the_last_rank_of_repeats(spark):
    left = spark.createDataFrame([(0, "x", 1), (0, "x", 3), (0, "y", 2)], "qid int, key string, rank int")
    right = spark.createDataFrame([(0, "x", 1), (0, "z", 2)], "qid int, key string, rank int")
    got = {r.key: (r.left_rank, r.right_rank, r.side, r.rank_sum) for r in compare(left, right).collect()}
    assert got == {"x": (3, 1, "both", 4), "y": (2, None, "left", None), "z": (None, 2, "right", None)}
    assert overlap(left, right).first()[1:] == (1, 1, 1)


@pytest.fixture(scope="module")
def searcher(spark):
    meta = "struct<file:string,name:string,parent:string,kind:string,start_line:int,end_line:int,def_line:int,n_lines:int,docstring:string>"
    rows = [("a.py::save", "write rows to the sheet", ("a.py", "save", "", "function", 1, 2, 1, 2, "")), ("b.py::load", "read rows from the sheet", ("b.py", "load", "", "function", 1, 2, 1, 2, "")), ("b.py::Box", "a box", ("b.py", "Box", "", "class", 5, 9, 5, 5, ""))]
    chunks = spark.createDataFrame(rows, f"id string, text string, metadata {meta}")
    vectors = spark.createDataFrame([("a.py::save", [1.0, 0.0]), ("b.py::load", [0.0, 1.0]), ("b.py::Box", [0.7, 0.7]), ("gone", [1.0, 0.1])], "id string, embedding array<double>")
    return HybridSearcher(chunks, vectors, embed=lambda q: [1.0, 0.0])


def test_hybrid_search(searcher):
    hits = searcher.search("write sheet", k=3).collect()
    assert hits[0].id == "a.py::save" and hits[0].retrievers == ["bm25", "vector"] and "gone" not in [h.id for h in hits]


def test_single_retrievers_and_filters(searcher):
    assert [h.id for h in searcher.search("write", bm25_only=True).collect()] == ["a.py::save"]
    assert [h.vector_rank for h in searcher.search("x", vector_only=True).collect()] == [1, 2, 3]
    assert [h.id for h in searcher.search("box", kinds=["class"]).collect()] == ["b.py::Box"]
    assert {h.id for h in searcher.search("sheet", file_sub="B.PY").collect()} == {"b.py::load", "b.py::Box"}
    with pytest.raises(ValueError):
        searcher.search("x", kinds=["clas"])


def test_nearest_in_blocks(spark, monkeypatch):
    from lodestar.operators import vector

    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "vec_id int, embedding array<double>")
    q = v.where("vec_id < 9").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    whole = {tuple(r) for r in nearest(v, q, pool=4, skip_self=True).select("qid", "id", "rank").collect()}
    monkeypatch.setattr(vector, "BLOCK_QUERIES", 2)
    assert {tuple(r) for r in nearest(v, q, pool=4, skip_self=True).select("qid", "id", "rank").collect()} == whole and len(whole) == 36


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, seq int")
    assert sorted(map(tuple, upsert(old, new).collect())) == [(1, "a"), (2, "d"), (3, "e")]
