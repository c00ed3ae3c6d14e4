"""The ledger, corpus and graph views that the queries take from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import table

#: For the tables' part names and segments.
RULES = [(["ring", "bolt"], "HARDWARE"), (["small gear", "gear", "rod"], "DRIVE"), (["plate", "red"], "SHEET")]
EXCLUDED = ["blue anvil", "gizmo"]
PERSONAL = ["HOUSEHOLD"]
CATEGORIES = ["HARDWARE", "DRIVE", "SHEET", "STANDARD", "LARGE", "SMALL", "ECONOMY", "MEDIUM", "PROMO", "UNUSED"]
#: The month that arrives a second time.
REPLAYED = "199903"

def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """card, day, merchant, amount, category, month_tab, idx from line items with their orders, customers and parts."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    items = items.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    pad = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    idx = F.concat(pad("l_orderkey", 12), pad("l_linenumber", 2), pad("l_partkey", 10), pad("l_suppkey", 10), F.date_format("l_shipdate", "yyyyMMdd"), pad("cents", 14))
    return items.withColumn("cents", F.round(F.col("l_extendedprice") * 100).cast("bigint")).select(F.col("c_mktsegment").alias("card"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), F.col("p_name").alias("merchant"), F.col("l_extendedprice").cast("bigint").alias("amount"), F.col("p_type").alias("category"), F.date_format("l_shipdate", "yyyyMM").alias("month_tab"), idx.alias("idx"))

LEDGER = """ledger AS (SELECT c_mktsegment AS card, strftime(l_shipdate, '%Y-%m-%d') AS day, p_name AS merchant,
  CAST(trunc(l_extendedprice) AS BIGINT) AS amount, p_type AS category, strftime(l_shipdate, '%Y%m') AS month_tab,
  lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || lpad(CAST(l_partkey AS VARCHAR), 10, '0')
  || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') || strftime(l_shipdate, '%Y%m%d') || lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), 14, '0') AS idx
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"""

CLASSIFIED = LEDGER + """, classified AS (SELECT * REPLACE (CASE
  WHEN contains(merchant, 'ring') OR contains(merchant, 'bolt') THEN 'HARDWARE'
  WHEN contains(merchant, 'small gear') OR contains(merchant, 'gear') OR contains(merchant, 'rod') THEN 'DRIVE'
  WHEN contains(merchant, 'plate') OR contains(merchant, 'red') THEN 'SHEET' ELSE category END AS category) FROM ledger)"""

KEPT = CLASSIFIED + """, kept AS (SELECT * FROM classified WHERE NOT (contains(merchant, 'blue anvil') OR contains(merchant, 'gizmo')))"""

RUN_TOKENS = "regexp_extract_all({t}, '[A-Za-z0-9]+|[가-힣]+')"
CAMEL_TOKENS = "list_transform(regexp_extract_all(regexp_replace(regexp_replace(r, '[A-Z]([0-9])', ' \\1', 'g'), '([A-Z][a-z])', ' \\1', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda p: lower(p))"

def tokens_sql(text: str) -> str:
    """The tokenizer as SQL: a list of tokens, in order, repeats kept."""
    ascii_run = f"list_concat([lower(r)], list_filter({CAMEL_TOKENS}, lambda p: p <> lower(r)))"
    hangul = "CASE WHEN length(r) >= 2 THEN list_concat([r], list_transform(range(1, length(r)), lambda i: substr(r, CAST(i AS INT), 2))) ELSE [r] END"
    return f"flatten(list_transform({RUN_TOKENS.format(t=text)}, lambda r: CASE WHEN regexp_full_match(r, '[A-Za-z0-9]+') THEN {ascii_run} ELSE {hangul} END))"

#: Searches take as queries the rows whose id this divides.
EVERY = 20

def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, query): whole benchmark items, and their third word again."""
    third = F.coalesce(F.get(F.split("text", r"[ \n]+"), F.lit(2)), F.lit(""))
    return table(spark, sf_dir, "benchmark").where(F.col("item_id") % EVERY == 0).select(F.col("item_id").alias("qid"), F.concat_ws(" ", "text", third).alias("query"))

QUERIES = f"""queries AS (SELECT item_id AS qid, text || ' ' || coalesce(string_split_regex(text, '[ \\n]+')[3], '') AS query FROM benchmark WHERE item_id % {EVERY} = 0)"""

def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))

def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): regions hold nations, nations hold customers and suppliers, and a customer calls the three suppliers it buys from most."""
    t = lambda name: table(spark, sf_dir, name)
    region = t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("module").alias("kind"), F.lit("").alias("file"), F.lit("").alias("parent"), (F.lit(0) + F.col("r_regionkey")).cast("bigint").alias("node_pos"))
    nation = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("class").alias("kind"), F.concat(F.lit("r"), "n_regionkey").alias("file"), F.lit("").alias("parent"), (F.lit(1000) + F.col("n_nationkey")).cast("bigint").alias("node_pos"))
    customer = t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("name"), F.lit("function").alias("kind"), F.concat(F.lit("n"), "c_nationkey").alias("file"), F.lit("").alias("parent"), (F.lit(1000000) + F.col("c_custkey")).cast("bigint").alias("node_pos"))
    supplier = t("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("method").alias("kind"), F.concat(F.lit("n"), "s_nationkey").alias("file"), F.concat(F.lit("n"), "s_nationkey").alias("parent"), (F.lit(1000000000) + F.col("s_suppkey")).cast("bigint").alias("node_pos"))
    nodes = region.unionByName(nation).unionByName(customer).unionByName(supplier)
    pairs = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    most = pairs.withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("n"), F.asc("l_suppkey")))).where("k <= 3")
    calls = most.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.lit("CALLS").alias("type"), (F.lit(10**12) + F.col("o_custkey") * 10 + F.col("k")).cast("bigint").alias("seq"))
    holds = nodes.where("file <> ''").select(F.col("file").alias("src"), F.col("id").alias("dst"), F.lit("CONTAINS").alias("type"), F.col("node_pos").alias("seq"))
    return nodes, holds.unionByName(calls)

GRAPH = """nodes AS (
  SELECT 'r' || r_regionkey AS id, r_name AS name, 'module' AS kind, '' AS file, '' AS parent, CAST(r_regionkey AS BIGINT) AS node_pos FROM region
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'class', 'r' || n_regionkey, '', 1000 + n_nationkey FROM nation
  UNION ALL SELECT 'c' || c_custkey, c_name || ' ' || c_mktsegment, 'function', 'n' || c_nationkey, '', 1000000 + c_custkey FROM customer
  UNION ALL SELECT 's' || s_suppkey, s_name, 'method', 'n' || s_nationkey, 'n' || s_nationkey, 1000000000 + s_suppkey FROM supplier),
most AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, l_suppkey) AS k
  FROM (SELECT o_custkey, l_suppkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)) WHERE k <= 3),
edges AS (SELECT file AS src, id AS dst, 'CONTAINS' AS type, node_pos AS seq FROM nodes WHERE file <> ''
  UNION ALL SELECT 'c' || o_custkey, 's' || l_suppkey, 'CALLS', 1000000000000 + o_custkey * 10 + k FROM most)"""

LOGICAL = GRAPH + """, logical AS (
  SELECT src, dst, type, '0' || lpad(CAST(seq AS VARCHAR), 18, '0') || '0' AS pos FROM edges

  UNION ALL SELECT dst, src, CASE type WHEN 'CALLS' THEN 'CALLED_BY' ELSE 'CONTAINED_BY' END, '0' || lpad(CAST(seq AS VARCHAR), 18, '0') || '1' FROM edges
  UNION ALL SELECT a.id, b.id, 'SIBLING', '1' || lpad(CAST(b.node_pos AS VARCHAR), 18, '0') || '0' FROM nodes a JOIN nodes b ON a.kind = 'method' AND b.kind = 'method' AND a.file = b.file AND a.parent = b.parent AND a.id <> b.id)"""

def bm25_sql(docs: str, id_col: str, text_col: str, queries: str) -> str:
    """CTEs up to `bm25` (qid, id, score) over a relation of documents and one of queries."""
    return f"""bm_terms AS (SELECT {id_col} AS id, {tokens_sql(f"coalesce({text_col}, '')")} AS toks FROM {docs}),
bm_stats AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avgdl FROM bm_terms),
bm_tf AS (SELECT id, len(toks) AS dl, term, count(*) AS tf FROM (SELECT id, toks, unnest(toks) AS term FROM bm_terms) GROUP BY id, len(toks), term),
bm_df AS (SELECT term, count(*) AS df FROM bm_tf GROUP BY term),
bm_q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({tokens_sql("query")}) AS term FROM {queries}) GROUP BY ALL),
bm25 AS (SELECT qid, id, sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)))) AS score
  FROM bm_tf JOIN bm_q USING (term) JOIN bm_df USING (term), bm_stats GROUP BY qid, id)"""

VECTOR = f"""knn AS (SELECT q.vec_id AS qid, v.vec_id AS id, 1 - list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance
  FROM embeddings v JOIN embeddings q ON q.vec_id % {EVERY} = 0 AND q.vec_id <> v.vec_id)"""
