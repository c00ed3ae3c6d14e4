"""Graph queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.constants import EDGE_WEIGHT, KIND_SEED_WEIGHT
from lodestar.operators import graph as G
from lodestar.sources import sinks as K
from lodestar.storage import written

from . import views as V
from .registry import query, table

ROUNDS = 40
QUERY = "ASIA building supplier 000000007 nation 3"
KIND_WEIGHT = "CASE kind " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in KIND_SEED_WEIGHT.items()) + " ELSE 1.0 END"
TYPE_WEIGHT = "CASE type " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in EDGE_WEIGHT.items()) + " ELSE 0.3 END"


def queries(spark):
    return spark.createDataFrame([(0, QUERY), (1, "machinery EUROPE customer 000000012")], "qid int, query string")


QUERIES = f"queries AS (SELECT * FROM (VALUES (0, '{QUERY}'), (1, 'machinery EUROPE customer 000000012')) t(qid, query))"


def text():
    return F.concat_ws("\n", *[F.nullif(F.col(c), F.lit("")) for c in ("name", "file")])


@query("u3_j10_logical_edges", f"WITH {V.LOGICAL} SELECT type, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM logical GROUP BY type")
def u3(spark, sf):
    nodes, edges = V.graph(spark, sf)
    return G.logical_edges(edges, nodes).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


@query("j8_f11_internal_edges", f"WITH {V.GRAPH}, inside AS (SELECT id FROM nodes WHERE NOT (kind = 'method' AND node_pos % 2 = 1)) SELECT src, dst, type FROM edges WHERE src IN (SELECT id FROM inside) AND dst IN (SELECT id FROM inside)")
def j8(spark, sf):
    nodes, edges = V.graph(spark, sf)
    nodes = nodes.withColumn("kind", F.when((F.col("kind") == "method") & (F.col("node_pos") % 2 == 1), F.lit("external")).otherwise(F.col("kind")))
    return G.internal_edges(edges, nodes).select("src", "dst", "type")


@query("a10_degrees", f"WITH {V.GRAPH} SELECT id, coalesce(o.n, 0) AS calls_out, coalesce(i.n, 0) AS called_by FROM nodes LEFT JOIN (SELECT src, count(*) AS n FROM edges WHERE type = 'CALLS' GROUP BY src) o ON o.src = id LEFT JOIN (SELECT dst, count(*) AS n FROM edges WHERE type = 'CALLS' GROUP BY dst) i ON i.dst = id")
def a10(spark, sf):
    return G.degrees(*V.graph(spark, sf))


@query("a11_histograms", f"WITH {V.GRAPH} SELECT 'kind' AS what, kind AS name, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'type', type, count(*) FROM edges GROUP BY type")
def a11(spark, sf):
    nodes, edges = V.graph(spark, sf)
    meta = K.graph_meta(nodes, edges)
    return meta.select(F.lit("kind").alias("what"), F.explode("by_kind").alias("name", "n")).unionByName(meta.select(F.lit("type").alias("what"), F.explode("by_edge").alias("name", "n")))


@query("t5_most_called", f"WITH {V.GRAPH} SELECT dst AS id, count(*) AS called_by FROM edges WHERE type = 'CALLS' GROUP BY dst ORDER BY called_by DESC, id LIMIT 10")
def t5(spark, sf):
    return G.degrees(*V.graph(spark, sf)).select("id", "called_by").orderBy(F.desc("called_by"), "id").limit(10)


@query("a16_w5_merge", f"WITH {V.GRAPH} SELECT id, CASE WHEN node_pos % 2 = 0 THEN name ELSE name || '!' END AS name, kind FROM nodes")
def a16(spark, sf):
    nodes = V.graph(spark, sf)[0].select("id", "name", "kind")
    pos = V.graph(spark, sf)[0].select("id", "name", "kind", "node_pos")
    later = pos.select("id", F.when(F.col("node_pos") % 2 == 0, F.lit("")).otherwise(F.concat("name", F.lit("!"))).alias("name"), F.lit(None).cast("string").alias("kind"), F.lit(2).alias("seq"))
    return G.merge_nodes(nodes.withColumn("seq", F.lit(1)).unionByName(later))


@query("a16_merge_edges", f"WITH {V.GRAPH} SELECT src, dst, type, false AS external FROM edges")
def a16_edges(spark, sf):
    edges = V.graph(spark, sf)[1]
    twice = edges.withColumn("external", F.lit(False)).unionByName(edges.withColumn("seq", F.col("seq") + 10**15).withColumn("external", F.lit(True)))
    return G.merge_edges(twice).select("src", "dst", "type", "external")


def pagerank_sql(rounds: int = ROUNDS) -> str:
    """The rounds as a chain of CTEs."""
    out = [V.GRAPH, "links AS MATERIALIZED (SELECT src, dst, count(*) OVER (PARTITION BY src) AS out FROM (SELECT DISTINCT src, dst FROM edges WHERE type = 'CALLS'))", "n AS (SELECT count(*) AS n FROM nodes)", "r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS r FROM nodes, n)"]
    for i in range(rounds):
        out.append(f"r{i + 1} AS MATERIALIZED (SELECT p.id, 0.15 / n + 0.85 * (coalesce(s.s, 0) + d.d / n) AS r FROM r{i} p LEFT JOIN (SELECT dst, sum(r / out) AS s FROM links JOIN r{i} ON id = src GROUP BY dst) s ON s.dst = p.id, n, (SELECT coalesce(sum(r), 0) AS d FROM r{i} WHERE id NOT IN (SELECT src FROM links)) d)")
    return ", ".join(out) + f", pr AS (SELECT id, r / max(r) OVER () AS pagerank FROM r{rounds})"


@query("a12_w8_pagerank", f"WITH {pagerank_sql()} SELECT id, round(pagerank, 6) AS pagerank FROM pr")
def a12(spark, sf):
    return G.pagerank(*V.graph(spark, sf), rounds=ROUNDS).withColumn("pagerank", F.round("pagerank", 6))


SEEDS = f"""{QUERIES}, node_docs AS (SELECT id, concat_ws(chr(10), name, nullif(file, '')) AS body FROM nodes), {V.bm25_sql("node_docs", "id", "body", "queries")},
weighed AS (SELECT qid, b.id, score * {KIND_WEIGHT} AS score, node_pos FROM bm25 b JOIN nodes USING (id)),
seeds AS (SELECT qid, id, seed_rank, score / max(score) OVER (PARTITION BY qid) AS seed_score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, node_pos) AS seed_rank FROM weighed WHERE score > 0) WHERE seed_rank <= 6)"""


def seeds(spark, sf):
    return G.seeds(V.graph(spark, sf)[0], queries(spark), text=text())


@query("j6_w4_a15_seeds", f"WITH {V.GRAPH}, {SEEDS} SELECT qid, id, CAST(seed_rank AS INT) AS seed_rank, round(seed_score, 6) AS seed_score FROM seeds")
def j6(spark, sf):
    return seeds(spark, sf).withColumn("seed_score", F.round("seed_score", 6))


def walks_sql() -> str:
    """All walks of up to two edges from the seeds, and the best of each node. Walks back to a node they have left never win."""
    return f"""weights AS (SELECT src, dst, type, pos, {TYPE_WEIGHT} AS w FROM logical),
w0 AS (SELECT qid, id AS seed, seed_rank, id, seed_score AS score, 'SEED' AS via, 0 AS hop, id AS path, '' AS trail FROM seeds),
w1 AS (SELECT qid, seed, seed_rank, dst AS id, score * 0.5 * w AS score, type AS via, 1 AS hop, path || '/' || dst AS path, trail || '/' || pos AS trail FROM w0 JOIN weights ON src = id WHERE score * 0.5 * w > 0.0001),
w2 AS (SELECT qid, seed, seed_rank, dst AS id, score * 0.5 * w AS score, type AS via, 2 AS hop, path || '/' || dst AS path, trail || '/' || pos AS trail FROM w1 JOIN weights ON src = id WHERE score * 0.5 * w > 0.0001 AND dst <> seed),
best AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY qid, id ORDER BY round(score, 12) DESC, CASE hop WHEN 0 THEN 0 ELSE 1 END, seed_rank, hop, trail) AS k
  FROM (SELECT * FROM w0 UNION ALL SELECT * FROM w1 UNION ALL SELECT * FROM w2)) WHERE k = 1)"""


def expanded(spark, sf):
    nodes, edges = V.graph(spark, sf)
    return G.expand(written(seeds(spark, sf), "seeds"), written(G.logical_edges(edges, nodes, with_siblings=False), "logical"), written(G.methods(nodes), "methods"))


@query("j9_j7_a9_f9_expansion", f"WITH {V.LOGICAL}, {SEEDS}, {walks_sql()} SELECT qid, id, round(score, 6) AS score, via, hop, seed, path FROM best")
def j9(spark, sf):
    return expanded(spark, sf).select("qid", "id", F.round("score", 6).alias("score"), "via", "hop", "seed", F.array_join("path", "/").alias("path"))


@query("t4_w3_graph_search", f"""WITH {pagerank_sql()}, logical AS (SELECT src, dst, type, '0' || lpad(CAST(seq AS VARCHAR), 18, '0') || '0' AS pos FROM edges
  UNION ALL SELECT dst, src, CASE type WHEN 'CALLS' THEN 'CALLED_BY' ELSE 'CONTAINED_BY' END, '0' || lpad(CAST(seq AS VARCHAR), 18, '0') || '1' FROM edges
  UNION ALL SELECT a.id, b.id, 'SIBLING', '1' || lpad(CAST(b.node_pos AS VARCHAR), 18, '0') || '0' FROM nodes a JOIN nodes b ON a.kind = 'method' AND b.kind = 'method' AND a.file = b.file AND a.id <> b.id), {SEEDS}, {walks_sql()},
ranked AS (SELECT b.*, b.score + 0.15 * pagerank AS total, row_number() OVER (PARTITION BY qid ORDER BY round(b.score + 0.15 * pagerank, 9) DESC, CASE hop WHEN 0 THEN 0 ELSE 1 END, seed_rank, hop, trail) AS rank
  FROM best b JOIN pr USING (id) JOIN nodes n USING (id) WHERE n.kind IN ('function', 'method'))
SELECT qid, CAST(rank AS INT) AS rank, id, round(total, 6) AS score, via, hop, seed FROM ranked WHERE rank <= 8""")
def t4(spark, sf):
    nodes, edges = V.graph(spark, sf)
    rank = G.pagerank(nodes, edges)
    hits = G.rank_hits(expanded(spark, sf), nodes, rank, k=8, centrality=0.15, kinds=["function", "method"])
    return hits.select("qid", "rank", "id", F.round("score", 6).alias("score"), "via", "hop", "seed")


CALLS = """symbols AS (SELECT s_nationkey AS file, s_suppkey AS id, 'f' || (s_suppkey % 7) AS name, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'C' || (s_suppkey % 2) END AS parent, s_suppkey AS pos FROM supplier),
calls AS (SELECT c_custkey AS seq, c_nationkey AS file, 'f' || (c_custkey % 9) AS target, c_custkey % 2 = 0 AS on_self, first(id ORDER BY pos) AS src, first(parent ORDER BY pos) AS src_parent FROM customer JOIN symbols ON file = c_nationkey GROUP BY ALL)"""


def call_tables(spark, sf):
    s = table(spark, sf, "supplier")
    symbols = s.select(F.col("s_nationkey").alias("file"), F.col("s_suppkey").cast("string").alias("id"), F.concat(F.lit("f"), F.col("s_suppkey") % 7).alias("name"), F.when(F.col("s_suppkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("C"), F.col("s_suppkey") % 2)).alias("parent"), F.lit("method").alias("kind"), F.col("s_suppkey").alias("sym_pos"))
    first = symbols.groupBy("file").agg(F.min_by("id", "sym_pos").alias("src"), F.min_by("parent", "sym_pos").alias("src_parent"))
    calls = table(spark, sf, "customer").select(F.col("c_nationkey").alias("file"), F.concat(F.lit("f"), F.col("c_custkey") % 9).alias("target"), (F.col("c_custkey") % 2 == 0).alias("on_self"), F.col("c_custkey").alias("seq")).join(first, "file")
    return symbols, calls


@query("j11_call_resolution", f"""WITH {CALLS}, candidates AS (SELECT c.seq, c.src, c.target, s.id, row_number() OVER (PARTITION BY c.seq ORDER BY CASE WHEN s.id IS NULL THEN 9
  WHEN s.id = c.src AND NOT (c.on_self AND c.src_parent <> '' AND s.parent = c.src_parent) THEN 9 WHEN c.on_self AND c.src_parent <> '' AND s.parent = c.src_parent THEN 0 WHEN c.src_parent <> '' AND s.parent = c.src_parent THEN 1 ELSE 2 END, s.pos) AS k,
  s.id IS NOT NULL AND (s.id <> c.src OR (c.on_self AND c.src_parent <> '' AND s.parent = c.src_parent)) AS ok FROM calls c LEFT JOIN symbols s ON s.file = c.file AND s.name = c.target)
SELECT CAST(src AS VARCHAR) AS src, CASE WHEN ok THEN CAST(id AS VARCHAR) ELSE '?' || target END AS dst, CASE WHEN ok THEN 'CALLS' ELSE 'CALLS_EXT' END AS type, NOT ok AS external, seq FROM candidates WHERE k = 1""")
def j11(spark, sf):
    from lodestar.operators.symbols import resolve_calls

    symbols, calls = call_tables(spark, sf)
    return resolve_calls(calls, symbols)


@query("j12_base_resolution", f"WITH {CALLS} SELECT CAST(c.src AS VARCHAR) AS src, coalesce(CAST(min(s.id) AS VARCHAR), c.target) AS dst, 'INHERITS' AS type, min(s.id) IS NULL AS external, c.seq FROM calls c LEFT JOIN symbols s ON s.file = c.file AND s.name = c.target GROUP BY c.src, c.target, c.seq")
def j12(spark, sf):
    from lodestar.operators.symbols import resolve_bases

    symbols, calls = call_tables(spark, sf)
    return resolve_bases(calls.select("file", "src", "target", "seq"), symbols)


@query("w6_next_boundary", "SELECT o_custkey, o_orderkey, coalesce(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1, 999999999) AS until FROM orders")
def w6(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.coalesce(F.lead("o_orderkey").over(w) - 1, F.lit(999999999)).alias("until"))


@query("w7_line_above", """WITH l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS ln, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))
SELECT doc_id, CAST(ln AS INT) AS line_no, last_value(nullif(trim(line), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS above FROM l""")
def w7(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    above = F.last(F.nullif(F.trim("line"), F.lit("")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("at").rowsBetween(-4, -1))
    return lines.select("doc_id", (F.col("at") + 1).alias("line_no"), above.alias("above"))


SCRIPTS = """scripts AS (SELECT c_custkey AS f, 'function a' || (c_custkey % 3) || '(x, y) {' || chr(10) || '  b' || (c_custkey % 2) || ' (x);' || chr(10) || '}' || chr(10) || '// note ' || c_custkey || chr(10) || 'const b0 = (z) => {' || chr(10) || '  return a1(z);' || chr(10) || '}' AS source FROM customer)"""


def scripts(spark, sf):
    c = table(spark, sf, "customer")
    text = F.concat(F.lit("function a"), F.col("c_custkey") % 3, F.lit("(x, y) {\n  b"), F.col("c_custkey") % 2, F.lit(" (x);\n}\n// note "), "c_custkey", F.lit("\nconst b0 = (z) => {\n  return a1(z);\n}"))
    return c.select(F.col("c_custkey").cast("string").alias("file"), text.alias("source"))


@query("p3_js_functions", f"WITH {SCRIPTS} SELECT CAST(f AS VARCHAR) AS file, 'a' || (f % 3) AS name, 1 AS start_line, 4 AS end_line, '' AS docstring, 'a' || (f % 3) || '(x, y)' AS signature FROM scripts UNION ALL SELECT CAST(f AS VARCHAR), 'b0', 5, 7, 'note ' || f, 'b0(z)' FROM scripts")
def p3(spark, sf):
    from lodestar.operators.symbols import js_functions

    return js_functions(scripts(spark, sf)).drop("text")


@query("j13_js_calls", f"WITH {SCRIPTS}, bodies AS (SELECT f, 'a' || (f % 3) AS name, array_to_string(string_split(source, chr(10))[1:4], chr(10)) AS body FROM scripts UNION ALL SELECT f, 'b0', array_to_string(string_split(source, chr(10))[5:7], chr(10)) FROM scripts) SELECT CAST(x.f AS VARCHAR) AS file, x.name AS src, y.name AS dst FROM bodies x JOIN bodies y ON x.f = y.f AND x.name <> y.name WHERE regexp_matches(x.body, '\\b' || y.name || '\\s*\\(')")
def j13(spark, sf):
    from lodestar.operators.symbols import js_calls, js_functions

    return js_calls(js_functions(scripts(spark, sf)))


def sources(spark, sf):
    """Python sources made from the customers, one file per nation."""
    c = table(spark, sf, "customer")
    body = F.concat(F.lit("def f"), "c_custkey", F.lit("(a, b=1):\n    \"\"\"doc "), "c_custkey", F.lit("\"\"\"\n    return f"), (F.col("c_custkey") + 25), F.lit("(a)\n"))
    files = c.groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", body.alias("b")))), lambda x: x["b"]), "").alias("source"))
    return files.select(F.concat(F.lit("n"), "c_nationkey", F.lit(".py")).alias("file"), "source")


BODY = "'def f' || k || '(a, b=1):' || chr(10) || '    \"\"\"doc ' || k || '\"\"\"' || chr(10) || '    return f' || (k + 25) || '(a)'"
FUNCTIONS = "fs AS (SELECT c_custkey AS k, c_nationkey AS n, 3 * (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) + 1 AS line FROM customer)"


@query("p1_chunks", f"WITH {FUNCTIONS} SELECT 'n' || n || '.py::f' || k || '::' || line AS id, CAST(3 AS INT) AS n_lines, 'doc ' || k AS docstring, {BODY} || chr(10) AS text FROM fs")
def p1(spark, sf):
    from lodestar.operators.symbols import chunks

    return chunks(sources(spark, sf)).select("id", "metadata.n_lines", "metadata.docstring", "text")


@query("p2_python_edges", f"WITH {FUNCTIONS}, nodes AS (SELECT 'n' || n || '.py::<module>' AS src, 'n' || n || '.py::f' || k AS dst, 'CONTAINS' AS type, false AS external FROM fs UNION ALL SELECT 'n' || a.n || '.py::f' || a.k, coalesce('n' || a.n || '.py::f' || b.k, '?f' || (a.k + 25)), CASE WHEN b.k IS NULL THEN 'CALLS_EXT' ELSE 'CALLS' END, b.k IS NULL FROM fs a LEFT JOIN fs b ON a.n = b.n AND b.k = a.k + 25) SELECT * FROM nodes")
def p2(spark, sf):
    from lodestar.operators.symbols import python_graph

    return python_graph(sources(spark, sf))[1].select("src", "dst", "type", "external")


MODULES = "mods AS (SELECT 'n' || n || '.py' AS file, count(*) AS n_functions FROM fs GROUP BY n)"


@query("p2_x18_x20_u6_python_nodes", f"""WITH {FUNCTIONS}, {MODULES} SELECT 'n' || n || '.py::f' || k AS id, 'f' || k AS name, 'function' AS kind, CAST(line AS INT) AS start_line, CAST(line + 2 AS INT) AS end_line, 'f' || k || '(a, b=1)' AS signature, 'doc ' || k AS docstring, {BODY} AS text, 'python' AS lang, false AS external FROM fs
  UNION ALL SELECT file || '::<module>', file, 'module', 1, 1, '', '', '', 'python', false FROM mods
  UNION ALL SELECT DISTINCT '?f' || (a.k + 25), 'f' || (a.k + 25), 'external', NULL, NULL, NULL, NULL, NULL, NULL, true FROM fs a WHERE NOT EXISTS (SELECT 1 FROM fs b WHERE a.n = b.n AND b.k = a.k + 25)""")
def p2_nodes(spark, sf):
    from lodestar.operators.symbols import python_graph

    return python_graph(sources(spark, sf))[0].select("id", "name", "kind", "start_line", "end_line", "signature", "docstring", "text", "lang", "external")


SIGNED = ["a, b=-1, *c, d=(1, 2), e, **f", "p, /, q={{'k': [1]}}, *, r=None", "x: int = 0, y: str = 'é', z=len", "self"]
SHOWN = ["a, b=-1, *c, d=(1, 2), e, **f", "p, q={'k': [1]}, *, r=None", "x=0, y='é', z=…", "self"]


@query("x18_x20_signatures_imports", "SELECT c_custkey, 'g' || c_custkey || '(' || [" + ", ".join("'" + x.replace("'", "''") + "'" for x in SHOWN) + "][c_custkey % 4 + 1] || ')' AS signature, ['os.path', '..pkg.name', 'json.loads', '..mod'][c_custkey % 4 + 1] AS imported FROM customer")
def x18(spark, sf):
    """A signature and an import per customer, each in a file of its own."""
    from lodestar.operators.symbols import python_symbols

    k = (F.col("c_custkey") % 4 + 1).cast("int")
    head = F.element_at(F.array(*[F.lit(x.replace("{{", "{").replace("}}", "}")) for x in SIGNED]), k)
    bring = F.element_at(F.array(*[F.lit(x) for x in ("import os.path", "from ..pkg import name", "from json import loads", "from . import mod")]), k)
    text = F.concat(bring, F.lit("\ndef g"), "c_custkey", F.lit("("), head, F.lit("): pass\n"))
    rows = python_symbols(table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("file"), text.alias("source")))
    return rows.groupBy(F.col("file").cast("bigint").alias("c_custkey")).agg(F.max(F.when(F.col("kind") == "function", F.col("signature"))).alias("signature"), F.max(F.when(F.col("row") == "import", F.col("target"))).alias("imported"))


@query("u2_graph_union", f"""WITH {FUNCTIONS}, {MODULES}, {SCRIPTS} SELECT lang, kind, count(*) AS n FROM (SELECT 'python' AS lang, 'function' AS kind FROM fs UNION ALL SELECT 'python', 'module' FROM mods
  UNION ALL SELECT 'javascript', unnest(['module', 'function', 'function']) FROM scripts) GROUP BY ALL""")
def u2(spark, sf):
    """Python and JavaScript graphs as one, without what lies outside."""
    from lodestar.operators.symbols import js_graph, python_graph, united

    nodes, _ = united(python_graph(sources(spark, sf)), js_graph(scripts(spark, sf)))
    return nodes.where("kind <> 'external'").groupBy("lang", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("t6_export_order", f"WITH {V.GRAPH} SELECT id, CAST(row_number() OVER (ORDER BY CASE WHEN file = '' THEN '~' ELSE file END, node_pos, id) AS INT) AS place FROM nodes")
def t6(spark, sf):
    """The place of every node: a full sort, by ranges."""
    from lodestar.operators.symbols import placed

    nodes = V.graph(spark, sf)[0].withColumn("file", F.nullif("file", F.lit(""))).withColumn("start_line", F.col("node_pos"))
    return placed(nodes, "place").select("id", "place")
