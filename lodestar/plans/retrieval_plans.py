"""Text, lexical, vector and fusion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar import show
from lodestar.functions import text as X
from lodestar.operators import compare as C
from lodestar.operators import lexical as B
from lodestar.operators import vector as N
from lodestar.operators.fusion import fuse
from lodestar.operators.graph import node_text
from lodestar.sources import files as S
from lodestar.sources import sinks as K

from . import views as V
from .registry import query, table

TOK = V.tokens_sql("text")
SAMPLES = ["parseTransactionsWithClaude", "PDFReader", "GS25", "B2B ensure_tab", "비밀번호 가", "été HTTPServer2Go", "", "A1bC2 XMLHttp Request42x", "BC바로카드 PDF 처리 흐름"]


@query("x1_x2_tokenize", f"SELECT doc_id, array_to_string({TOK}, ' ') AS tokens FROM documents")
def x1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.tokenize(F.col("text")), " ").alias("tokens"))


@query("x1_x2_tokenize_mixed", "SELECT n, array_to_string(" + TOK + ", ' ') AS tokens FROM (VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(SAMPLES)) + ") t(n, text)")
def x1_mixed(spark, sf):
    return spark.createDataFrame(list(enumerate(SAMPLES)), "n int, text string").select("n", F.array_join(X.tokenize(F.col("text")), " ").alias("tokens"))


TERMS = f"terms AS (SELECT doc_id AS id, {TOK} AS toks FROM documents), tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(toks) AS term FROM terms) GROUP BY ALL)"


@query("a6_corpus_statistics", f"WITH {TERMS} SELECT count(*) AS n_docs, round(avg(len(toks)), 6) AS avgdl, CAST(sum(len(toks)) AS BIGINT) AS total_terms FROM terms")
def a6(spark, sf):
    return B.corpus_statistics(B.document_terms(table(spark, sf, "documents"), "doc_id", "text")).withColumn("avgdl", F.round("avgdl", 6))


@query("a6_document_frequency", f"WITH {TERMS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term")
def a6_df(spark, sf):
    p = B.postings(B.document_terms(table(spark, sf, "documents"), "doc_id", "text"))
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query("x12_idf", f"WITH {TERMS} SELECT term, round(ln(1 + ((SELECT count(*) FROM terms) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM tf GROUP BY term")
def x12(spark, sf):
    terms = B.document_terms(table(spark, sf, "documents"), "doc_id", "text")
    df = B.document_frequency(B.postings(terms))
    return df.select("term", F.round(X.idf(B.corpus_statistics(terms).select("n_docs").scalar(), F.col("df")), 6).alias("idf"))


BM25 = f"{V.QUERIES}, {V.bm25_sql('documents', 'doc_id', 'text', 'queries')}"


@query("j5_query_terms", f"WITH {V.QUERIES} SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({V.tokens_sql('query')}) AS term FROM queries) GROUP BY ALL")
def j5(spark, sf):
    return B.query_terms(V.text_queries(spark, sf))


def scores(spark, sf):
    return B.bm25_scores(table(spark, sf, "documents"), V.text_queries(spark, sf))


@query("a7_x13_bm25_scores", f"WITH {BM25} SELECT qid, id, round(score, 6) AS score FROM bm25 WHERE score > 0")
def a7(spark, sf):
    return scores(spark, sf).withColumn("score", F.round("score", 6))


TOP = f"{BM25}, lex AS (SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM bm25) WHERE rank <= 40)"


def order():
    return [F.desc(F.round("score", 9)), F.asc("id")]


def lexical(spark, sf):
    return B.top(scores(spark, sf), 40, order=order())


@query("t1_w1_f8_bm25_top", f"WITH {TOP} SELECT qid, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM lex")
def t1(spark, sf):
    return lexical(spark, sf).withColumn("score", F.round("score", 6))


@query("t1_f3_f4_bm25_filtered", f"WITH {BM25} SELECT qid, id, CAST(rank AS INT) AS rank FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM bm25 JOIN documents ON doc_id = id WHERE lang IN ('en', 'fr') AND contains(lower(source), 'rc1')) WHERE rank <= 10")
def t1_filtered(spark, sf):
    """Filters hold before the cut; statistics stay those of all documents."""
    docs = table(spark, sf, "documents")
    keep = docs.where(F.col("lang").isin("en", "fr") & F.contains(F.lower("source"), F.lower(F.lit("RC1")))).select(F.col("doc_id").alias("id"))
    return B.top(scores(spark, sf).join(keep, "id", "left_semi"), 10, order=order()).select("qid", "id", "rank")


KNN = f"{V.VECTOR}, vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(distance, 9), id) AS rank FROM knn) WHERE rank <= 40)"


def vectors(spark, sf, pool=40, **how):
    hits = N.nearest(table(spark, sf, "embeddings"), V.vector_queries(spark, sf), pool=pool, skip_self=True, **how)
    return hits


@query("x11_cosine_distance", "SELECT q.vec_id AS qid, v.vec_id AS id, round(1 - list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance FROM embeddings v JOIN embeddings q ON q.vec_id = v.vec_id - v.vec_id % 20")
def x11(spark, sf):
    """Every vector's distance from the last query vector before it."""
    e = table(spark, sf, "embeddings")
    pairs = e.join(V.vector_queries(spark, sf), F.col("qid") == F.col("vec_id") - F.col("vec_id") % 20)
    return pairs.select("qid", F.col("vec_id").alias("id"), F.round(X.cosine_distance(F.col("embedding"), F.col("vector")), 6).alias("distance"))


@query("t2_w1_knn_top", f"WITH {KNN} SELECT qid, id, round(distance, 6) AS distance, CAST(rank AS INT) AS rank FROM vec")
def t2(spark, sf):
    return vectors(spark, sf).withColumn("distance", F.round("distance", 6))


@query("t2_f3_f4_f10_knn_filtered", f"WITH {V.VECTOR}, pool AS (SELECT * FROM (SELECT k.*, row_number() OVER (PARTITION BY qid ORDER BY round(distance, 9), id) AS r FROM knn k JOIN embeddings ON vec_id = id WHERE label IN (1, 2, 3)) WHERE r <= 40) SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY r) AS INT) AS rank FROM pool JOIN documents ON doc_id = id WHERE contains(lower(source), 'src1')")
def t2_filtered(spark, sf):
    """The kind is tested before the cut, the file and whether the chunk is known after it."""
    hits = vectors(spark, sf, before=F.col("label").isin(1, 2, 3))
    docs = table(spark, sf, "documents").where(F.contains(F.lower("source"), F.lit("src1"))).select(F.col("doc_id").alias("id"))
    return B.top(hits.drop("rank").join(docs, "id", "left_semi"), 40, order=[F.asc("distance"), F.asc("id")]).select("qid", "id", "rank")


FUSED = f"""{BM25}, lex AS (SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM bm25) WHERE rank <= 40),
{V.VECTOR}, vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(distance, 9), id) AS rank FROM knn) WHERE rank <= 40),
fused AS (SELECT coalesce(l.qid, v.qid) AS qid, coalesce(l.id, v.id) AS id, l.rank AS lr, v.rank AS vr, l.score AS bs, v.distance AS dist, coalesce(1.0 / (60 + l.rank), 0) + coalesce(1.0 / (60 + v.rank), 0) AS score
  FROM lex l FULL OUTER JOIN vec v ON l.qid = v.qid AND l.id = v.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, lr NULLS LAST, vr NULLS LAST, id) AS rank FROM fused)"""


def fused(spark, sf, k=None, w=(1.0, 1.0)):
    """Documents and vectors share ids here for their shape only; the tables declare no relation."""
    return fuse([("bm25", w[0], lexical(spark, sf)), ("vector", w[1], vectors(spark, sf))], k=k)


@query("j2_a8_w2_u1_fusion", f"WITH {FUSED} SELECT qid, id, round(score, 6) AS score, CAST(lr AS INT) AS bm25_rank, CAST(vr AS INT) AS vector_rank, CAST(rank AS INT) AS rank FROM ranked")
def j2(spark, sf):
    return fused(spark, sf).select("qid", "id", F.round("score", 6).alias("score"), "bm25_rank", "vector_rank", "rank")


@query("t3_k9_fusion_top", f"WITH {FUSED} SELECT qid, CAST(rank AS INT) AS rank, id, round(score, 6) AS score, round(bs, 4) AS bm25_score, round(dist, 4) AS distance, CASE WHEN lr IS NULL THEN 'vector' WHEN vr IS NULL THEN 'bm25' ELSE 'bm25+vector' END AS retrievers FROM ranked WHERE rank <= 8")
def t3(spark, sf):
    """As the result file has them: rounded by the sink, and read back from its JSON."""
    hits = fused(spark, sf, k=8).withColumnsRenamed({"bm25_value": "bm25_score", "vector_value": "distance"})
    lines = K.result_json(hits.select("qid", "rank", "id", "score", "bm25_score", "distance", F.array_join("retrievers", "+").alias("retrievers")))
    return lines.select(F.from_json("json", "qid bigint, rank int, id bigint, score double, bm25_score double, distance double, retrievers string").alias("h")).select("h.*")


@query("j3_hit_hydration", f"WITH {FUSED} SELECT r.qid, CAST(r.rank AS INT) AS rank, r.id, d.lang, d.source, substr(d.text, 1, 80) AS head FROM ranked r JOIN documents d ON d.doc_id = r.id WHERE r.rank <= 5")
def j3(spark, sf):
    hits = fused(spark, sf, k=5)
    return hits.join(table(spark, sf, "documents"), F.col("doc_id") == F.col("id")).select("qid", "rank", "id", "lang", "source", F.substring("text", 1, 80).alias("head"))


LISTS = f"{BM25}, lex AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM bm25), {V.VECTOR}, vec AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(distance, 9), id) AS rank FROM knn), l AS (SELECT qid, id % 100 AS key, max(rank) AS left_rank FROM lex WHERE rank <= 40 GROUP BY ALL), r AS (SELECT qid, id % 100 AS key, max(rank) AS right_rank FROM vec WHERE rank <= 40 GROUP BY ALL)"


@query("j15_t7_u4_compare", f"WITH {LISTS} SELECT coalesce(l.qid, r.qid) AS qid, coalesce(l.key, r.key) AS key, CAST(left_rank AS INT) AS left_rank, CAST(right_rank AS INT) AS right_rank, CASE WHEN r.key IS NULL THEN 'left' WHEN l.key IS NULL THEN 'right' ELSE 'both' END AS side, CAST(left_rank + right_rank AS INT) AS rank_sum FROM l FULL OUTER JOIN r ON l.qid = r.qid AND l.key = r.key")
def j15(spark, sf):
    key = (F.col("id") % 100).alias("key")
    return C.compare(lexical(spark, sf).select("qid", key, "rank"), vectors(spark, sf).select("qid", key, "rank"))


@query("u4_overlap_counts", f"WITH {LISTS} SELECT coalesce(l.qid, r.qid) AS qid, count(*) FILTER (WHERE l.key IS NOT NULL AND r.key IS NOT NULL) AS common, count(*) FILTER (WHERE r.key IS NULL) AS left_only, count(*) FILTER (WHERE l.key IS NULL) AS right_only FROM l FULL OUTER JOIN r ON l.qid = r.qid AND l.key = r.key GROUP BY 1")
def u4(spark, sf):
    key = (F.col("id") % 100).alias("key")
    return C.overlap(lexical(spark, sf).select("qid", key, "rank"), vectors(spark, sf).select("qid", key, "rank"))


@query("s18_query_list", "SELECT conv_id, turn, trim(line) AS query FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations) WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')")
def s18(spark, sf):
    lines = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("line"))
    q = F.trim("line")
    return lines.select("conv_id", "turn", q.alias("query")).where((F.col("query") != "") & ~F.startswith("query", F.lit("#")))


@query("f13_x16_u6_line_slice", "SELECT doc_id, n_lines, array_to_string(lines[2:4], chr(10)) AS part FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, len(string_split(text, chr(10))) AS n_lines FROM documents) WHERE n_lines >= 4")
def f13(spark, sf):
    docs = table(spark, sf, "documents").withColumn("n_lines", F.size(F.split("text", "\n")).cast("bigint")).where("n_lines >= 4")
    return docs.select("doc_id", "n_lines", X.line_slice(F.col("text"), F.lit(2), F.lit(4)).alias("part"))


@query("t8_line_limit", "SELECT doc_id, array_to_string(lines[1:3], chr(10)) || CASE WHEN len(lines) > 3 THEN chr(10) || '… (' || (len(lines) - 3) || ' more lines)' ELSE '' END AS shown FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)")
def t8(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.first_lines(F.col("text"), 3).alias("shown"))


@query("w9_a13_line_numbers", "SELECT doc_id, CAST(min(ln) AS INT) AS first_line, CAST(max(ln) AS INT) AS last_line, CAST(sum(length(line)) AS BIGINT) AS chars FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS ln, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE contains(line, 'the') GROUP BY doc_id")
def w9(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.contains("line", F.lit("the")))
    return lines.groupBy("doc_id").agg((F.min("at") + 1).alias("first_line"), (F.max("at") + 1).alias("last_line"), F.sum(F.length("line")).alias("chars"))


@query("a14_first_line", "SELECT d.doc_id, CAST(coalesce(f.ln, len(string_split(d.text, chr(10))) + 1) AS INT) AS first_line FROM documents d LEFT JOIN (SELECT doc_id, min(ln) AS ln FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS ln, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE contains(line, '|') GROUP BY doc_id) f USING (doc_id)")
def a14(spark, sf):
    lines = F.split("text", "\n")
    hit = F.array_min(F.filter(F.transform(lines, lambda line, i: F.when(F.contains(line, F.lit("|")), i + 1)), lambda i: i.isNotNull()))
    return table(spark, sf, "documents").select("doc_id", F.coalesce(hit, F.size(lines) + 1).alias("first_line"))


@query("f19_document_projection", "SELECT c_custkey, concat_ws(chr(10), c_name, nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END, '')) AS body FROM customer")
def f19(spark, sf):
    seg = F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.col("c_mktsegment"))
    nodes = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"), seg.alias("qualname"), *[F.lit("").alias(c) for c in ("signature", "docstring", "file", "text")])
    return nodes.select("c_custkey", node_text().alias("body"))


@query("x14_x15_doc_line", "SELECT doc_id, substr(trim(string_split(trim(text), chr(10))[1]), 1, 200) AS line, substr(lang || ' */', 1, 200) AS note FROM documents")
def x14(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.doc_line(F.col("text")).alias("line"), X.comment_text(F.concat(F.lit("// "), "lang", F.lit(" */"))).alias("note"))


@query("x17_x22_x23_x27_ids", "SELECT l_orderkey, l_linenumber, l_partkey, 'd/' || l_returnflag || '.py::' || l_linestatus || '::' || l_linenumber AS id, l_linestatus AS short, l_returnflag || '.py' AS base, l_linestatus || ' ─▶ ' || l_returnflag AS path FROM lineitem")
def x17(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("id", F.concat_ws("::", F.concat(F.lit("d/"), "l_returnflag", F.lit(".py")), "l_linestatus", "l_linenumber"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "id", X.short_id(F.col("id")).alias("short"), X.basename(F.split_part("id", F.lit("::"), F.lit(1))).alias("base"), X.path_text(F.array("id", "l_returnflag")).alias("path"))


@query("x24_hit_line", f"WITH {FUSED} SELECT qid, CAST(rank AS INT) AS rank, printf('%d. %.4f %s  %s:%d  [%s %s]', rank, score, 'doc' || id, 'c.py', id, 'b' || coalesce(CAST(lr AS VARCHAR), '-'), 'v' || coalesce(CAST(vr AS VARCHAR), '-')) AS line FROM ranked WHERE rank <= 3")
def x24(spark, sf):
    hits = fused(spark, sf, k=3).withColumn("metadata", F.struct(F.concat(F.lit("doc"), "id").alias("name"), F.lit("a/b/c.py").alias("file"), F.col("id").alias("start_line")))
    return hits.select("qid", "rank", show.hybrid_line().alias("line"))


@query("x26_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(json_object('id', event_id, 'type', event_type) AS VARCHAR) AS body FROM events")
def x26(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("body"))


@query("k6_vector_upsert", "SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id % 5 = 0")
def k6(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    old = e.where("id % 3 = 0").withColumn("label", F.col("label") + 50).withColumn("seq", F.lit(1))
    new = e.where("id % 3 = 0").withColumn("label", F.col("label") + 100).withColumn("seq", F.lit(2))
    more = e.where("id % 5 = 0").withColumn("id", F.col("id") + 1000000).withColumn("seq", F.lit(3))
    return N.upsert(e, old.unionByName(new).unionByName(more))


@query("u5_missing_keys", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'b' ELSE 'b,c' END AS missing FROM customer")
def u5(spark, sf):
    j = F.when(F.col("c_custkey") % 2 == 0, F.lit('{"a":1,"c":2,"x":0}')).otherwise(F.lit('{"a":null}'))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(F.array_sort(F.array_except(F.array(*[F.lit(k) for k in "abc"]), F.json_object_keys(j))), ",").alias("missing"))


@query("x9_mime_filename", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name || '_명세서.pdf' WHEN 1 THEN 'no. ' || 'é ' || c_name || ' end' ELSE c_name END AS name FROM customer")
def x9(spark, sf):
    half = lambda c: F.concat(F.lit("=?UTF-8?B?"), F.base64(c.cast("binary")), F.lit("?="))
    quoted = F.concat(F.lit("no. =?utf-8?Q?=C3=A9_?= =?utf-8?q?"), F.replace("c_name", F.lit("#"), F.lit("=23")), F.lit("?= end"))
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(half(F.col("c_name")), F.lit(" "), half(F.lit("_명세서.pdf")))).when(F.col("c_custkey") % 3 == 1, quoted).otherwise(F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", X.mime_filename(raw).alias("name"))


@query("x21_display_width", "SELECT c_custkey, length(c_name) + 4 AS width, substr(c_name, 1, 9) || '…' AS cut, c_mktsegment || repeat(' ', 12 - length(c_mktsegment)) AS cell FROM customer")
def x21(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", X.display_width(F.concat("c_name", F.lit("가나"))).cast("bigint").alias("width"), X.clipped(F.col("c_name"), 10).alias("cut"), X.padded(F.col("c_mktsegment"), 12).alias("cell"))
