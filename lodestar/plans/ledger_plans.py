"""Ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.extract import statement_head
from lodestar.functions import text as X
from lodestar.operators import ledger as L
from lodestar.sources import files as S
from lodestar.sources import sinks as K
from lodestar.storage import scratch

from . import views as V
from .registry import query, table

COLS = ["card", "day", "merchant", "amount", "category", "month_tab", "idx"]


def classified(spark, sf):
    return V.ledger(spark, sf).withColumn("category", L.reclassify(F.col("merchant"), F.col("category"), V.RULES))


def kept(spark, sf):
    return classified(spark, sf).where(~L.excluded(F.col("merchant"), V.EXCLUDED))


def replayed(spark, sf):
    """The ledger's rows up to a month, and a batch that brings this month again, all later ones, and the rows of one of these twice."""
    rows = kept(spark, sf)
    batch = rows.where(F.col("month_tab") >= V.REPLAYED)
    return rows.where(F.col("month_tab") <= V.REPLAYED), batch.unionByName(batch.where(F.col("month_tab") == "199905").withColumn("idx", F.concat("idx", F.lit("b"))))


REPLAY = V.KEPT + f""", existing AS (SELECT * FROM kept WHERE month_tab <= '{V.REPLAYED}'),
batch AS (SELECT * FROM kept WHERE month_tab >= '{V.REPLAYED}' UNION ALL SELECT * REPLACE (idx || 'b' AS idx) FROM kept WHERE month_tab = '199905'),
added AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY month_tab, card, day, merchant, amount ORDER BY idx) AS n FROM batch) b
  WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM existing e WHERE e.month_tab = b.month_tab AND e.card = b.card AND e.day = b.day AND e.merchant = b.merchant AND e.amount = b.amount))"""


@query("ledger_report", f"WITH {V.KEPT} SELECT month_tab, card, CAST(sum(amount) AS BIGINT) AS subtotal, CAST(coalesce(sum(sum(amount)) FILTER (WHERE card <> 'HOUSEHOLD') OVER (PARTITION BY month_tab), 0) AS BIGINT) AS grand_total FROM kept GROUP BY month_tab, card")
def ledger_report(spark, sf):
    rows = L.subtotals(kept(spark, sf), ["month_tab"])
    from pyspark.sql import Window

    total = F.sum(F.when(~F.col("card").isin(*V.PERSONAL), F.col("subtotal"))).over(Window.partitionBy("month_tab"))
    return rows.select("month_tab", "card", "subtotal", F.coalesce(total, F.lit(0)).alias("grand_total"))


@query("f1_exclusion", f"WITH {V.KEPT} SELECT month_tab, count(*) AS n FROM kept GROUP BY month_tab")
def f1(spark, sf):
    return kept(spark, sf).groupBy("month_tab").agg(F.count(F.lit(1)).alias("n"))


LABELS = "(SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_name || ' 소계' WHEN 1 THEN '전체 합계' WHEN 2 THEN '' ELSE c_name END AS card FROM customer)"


def label_cells(spark, sf):
    k = F.col("c_custkey") % 5
    return table(spark, sf, "customer").select("c_custkey", F.when(k == 0, F.concat("c_name", F.lit(" 소계"))).when(k == 1, F.lit("전체 합계")).when(k == 2, F.lit("")).otherwise(F.col("c_name")).alias("card"))


@query("f2_summary_rows", f"SELECT c_custkey, card FROM {LABELS} WHERE NOT (card = '' OR card = '전체 합계' OR ends_with(card, ' 소계'))")
def f2(spark, sf):
    return label_cells(spark, sf).where(~L.is_summary_row(F.col("card")))


@query("f5_reclassify", f"WITH {V.CLASSIFIED} SELECT month_tab, category, count(*) AS n, CAST(sum(amount) AS BIGINT) AS total FROM classified GROUP BY ALL")
def f5(spark, sf):
    return classified(spark, sf).groupBy("month_tab", "category").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))


@query("f5_reclassify_table", f"WITH {V.CLASSIFIED} SELECT idx, merchant, amount, category FROM classified")
def f5_table(spark, sf):
    rules = spark.createDataFrame([(i, k, c) for i, (ks, c) in enumerate(V.RULES) for k in ks], "rule_no int, keyword string, category string")
    return L.reclassify_by_table(V.ledger(spark, sf), rules).select("idx", "merchant", "amount", "category")


def replies(spark, sf):
    """(batch_id, attempt, json): three attempts per customer, of the kinds that validation tells apart."""
    c = table(spark, sf, "customer")
    one = F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("attempt")
    k = (F.col("c_custkey") + F.col("attempt")) % 8
    good = F.format_string('{"일자":"2026-01-%02d","가맹점":"%s","금액":%d,"분류":"식비"}', (F.col("c_custkey") % 28 + 1).cast("int"), F.col("c_mktsegment"), F.col("c_custkey"))
    second = F.when(k == 1, F.lit("5")).when(k == 2, F.lit('{"일자":"2026-01-01","금액":1,"분류":"기타"}')).when(k == 3, F.lit('{"일자":"2026-01-01","가맹점":null,"금액":1,"분류":"기타"}')).when(k == 4, F.lit('{"일자":"2026-01-01","가맹점":"a","금액":"1","분류":"기타"}')).when(k == 5, F.lit('{"일자":"2026-01-01","가맹점":"a","금액":true,"분류":"기타"}')).when(k == 6, F.lit('{"일자":"2026-01-01","가맹점":"a","금액":1.5,"분류":"기타"}')).otherwise(F.lit('{"일자":7,"가맹점":"a","금액":1,"분류":"기타"}'))
    body = F.concat(F.lit('{"transactions":['), good, F.lit(","), second, F.lit("]}"))
    empty = F.when(F.col("c_custkey") % 50 == 3, F.lit('{"transactions":[]}')).when(F.col("c_custkey") % 50 == 4, F.lit('{"transactions":"none"}')).when(F.col("c_custkey") % 50 == 5, F.lit("not json"))
    return c.select("c_custkey", "c_mktsegment", one).select(F.col("c_custkey").alias("batch_id"), "attempt", F.coalesce(empty, body).alias("json"))


REPLIES = """replies AS (SELECT c_custkey AS batch_id, attempt, (c_custkey + attempt) % 8 AS k, c_custkey % 50 AS e, c_mktsegment AS m FROM customer, (VALUES (1), (2), (3)) t(attempt)),
checked AS (SELECT *, CASE e WHEN 3 THEN NULL WHEN 4 THEN 'no list of transactions' WHEN 5 THEN 'no list of transactions' ELSE CASE k WHEN 0 THEN 'day is not text' WHEN 7 THEN 'day is not text' WHEN 1 THEN 'not an object'
  WHEN 2 THEN 'missing: 가맹점' WHEN 3 THEN 'merchant is not text' WHEN 4 THEN 'amount is not a number' WHEN 5 THEN 'amount is not a number' END END AS error FROM replies)"""


@query("f6_f7_validation", f"WITH {REPLIES} SELECT batch_id, attempt, error IS NULL AS valid, CASE WHEN error IS NOT NULL AND e NOT IN (4, 5) THEN 1 END AS error_pos, error FROM checked")
def f6(spark, sf):
    return L.validated(replies(spark, sf), ["batch_id", "attempt"])


@query("p5_first_valid_reply", f"WITH {REPLIES} SELECT batch_id, min(attempt) FILTER (WHERE error IS NULL) AS attempt FROM checked GROUP BY batch_id")
def p5(spark, sf):
    return L.first_valid(replies(spark, sf)).select("batch_id", "attempt")


@query("d1_transactions_explode", f"""WITH {REPLIES} SELECT batch_id, attempt, 0 AS pos, printf('2026-01-%02d', batch_id % 28 + 1) AS day, m AS merchant, CAST(batch_id AS BIGINT) AS amount, '식비' AS category FROM checked WHERE error IS NULL AND e <> 3
  UNION ALL SELECT batch_id, attempt, 1, '2026-01-01', 'a', 1, '기타' FROM checked WHERE error IS NULL AND e <> 3""")
def d1(spark, sf):
    r = replies(spark, sf)
    good = L.validated(r, ["batch_id", "attempt"]).where("valid").select("batch_id", "attempt")
    return L.transactions(r.join(good, ["batch_id", "attempt"], "left_semi"))


@query("j1_ledger_dedup", f"WITH {REPLAY} SELECT month_tab, card, day, merchant, amount, category, idx FROM added")
def j1(spark, sf):
    existing, batch = replayed(spark, sf)
    return L.new_rows(batch, existing).select(*COLS)


@query("a5_append_counts", f"WITH {REPLAY} SELECT month_tab, CAST(count(*) FILTER (WHERE a = 1) AS BIGINT) AS added, CAST(count(*) FILTER (WHERE a = 0) - count(*) FILTER (WHERE a = 1) AS BIGINT) AS skipped FROM (SELECT month_tab, 0 AS a FROM batch UNION ALL SELECT month_tab, 1 FROM added) GROUP BY month_tab")
def a5(spark, sf):
    existing, batch = replayed(spark, sf)
    return L.append_counts(batch, L.new_rows(batch, existing))


@query("a1_subtotals", f"WITH {V.KEPT} SELECT month_tab, card, CAST(sum(amount) AS BIGINT) AS subtotal, min(idx) AS ord FROM kept GROUP BY month_tab, card")
def a1(spark, sf):
    return L.subtotals(kept(spark, sf), ["month_tab"])


@query("a2_grand_total", f"WITH {V.KEPT} SELECT month_tab, CAST(coalesce(sum(amount) FILTER (WHERE card <> 'HOUSEHOLD'), 0) AS BIGINT) AS grand_total FROM kept GROUP BY month_tab")
def a2(spark, sf):
    return L.grand_totals(kept(spark, sf), ["month_tab"], V.PERSONAL)


@query("a3_month_report", f"""WITH {V.KEPT}, ordered AS (SELECT *, min(idx) OVER (PARTITION BY month_tab, card) AS ord FROM kept),
lines AS (SELECT month_tab, 0 AS g, ord, 0 AS h, idx, 'detail' AS level, card AS label, day, merchant, amount, category FROM ordered
  UNION ALL SELECT month_tab, 0, ord, 1, NULL, 'subtotal', card || ' 소계', NULL, NULL, sum(amount), NULL FROM ordered GROUP BY month_tab, card, ord
  UNION ALL SELECT month_tab, 1, NULL, 1, NULL, 'total', '전체 합계', NULL, NULL, coalesce(sum(amount) FILTER (WHERE card <> 'HOUSEHOLD'), 0), NULL FROM ordered GROUP BY month_tab)
SELECT month_tab, CAST(row_number() OVER (PARTITION BY month_tab ORDER BY g, ord, h, idx) AS INT) AS line, level, label, day, merchant, CAST(amount AS BIGINT) AS amount, category FROM lines""")
def a3(spark, sf):
    return L.month_report(kept(spark, sf), V.PERSONAL)


CATEGORY_ROWS = ", ".join(f"({i}, '{c}')" for i, c in enumerate(V.CATEGORIES))


@query("a4_j14_category_summary", f"""WITH {V.KEPT} SELECT m.month_tab, d.ord, d.category, CAST(coalesce(sum(k.amount), 0) AS BIGINT) AS amount
FROM (SELECT DISTINCT month_tab FROM kept) m CROSS JOIN (VALUES {CATEGORY_ROWS}) d(ord, category)
LEFT JOIN (SELECT * FROM kept WHERE card <> 'HOUSEHOLD') k ON k.month_tab = m.month_tab AND k.category = d.category GROUP BY ALL""")
def a4(spark, sf):
    return L.category_summary(kept(spark, sf), ["month_tab"], V.CATEGORIES, V.PERSONAL)


def statement_files(spark, sf):
    o = table(spark, sf, "orders")
    card = F.element_at(F.array(*[F.lit(c) for c in ("BC", "SHINHAN", "HYUNDAI", "SAMSUNG")]), (F.col("o_custkey") % 4 + 1).cast("int"))
    ext = F.element_at(F.array(*[F.lit(c) for c in (".pdf", ".XLSX", ".html", ".htm", ".txt")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    stamp = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("회원번호2026089_"), F.date_format("o_orderdate", "yyyyMM"))).otherwise(F.concat(F.lit("2013"), F.date_format("o_orderdate", "MM")))
    return o.select("o_orderkey", card.alias("card_type"), F.concat(F.lit("stmt_"), stamp, ext).alias("filename"))


FILES = """files AS (SELECT o_orderkey, ['BC', 'SHINHAN', 'HYUNDAI', 'SAMSUNG'][o_custkey % 4 + 1] AS card_type,
  'stmt_' || CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN '회원번호2026089_' || strftime(o_orderdate, '%Y%m') ELSE '2013' || strftime(o_orderdate, '%m') END
  || ['.pdf', '.XLSX', '.html', '.htm', '.txt'][o_orderkey % 5 + 1] AS filename FROM orders)"""


@query("f12_x8_accepted_files", f"""WITH {FILES} SELECT o_orderkey, card_type, filename, '.' || lower(split_part(filename, '.', -1)) AS ext FROM files WHERE
 (card_type = 'BC' AND regexp_matches(lower(filename), '[.](pdf|xlsx|xls)$')) OR (card_type = 'SHINHAN' AND regexp_matches(lower(filename), '[.](pdf|html|htm)$')) OR (card_type IN ('HYUNDAI', 'SAMSUNG') AND regexp_matches(lower(filename), '[.](html|htm)$'))""")
def f12(spark, sf):
    return L.accepted_files(statement_files(spark, sf)).withColumn("ext", X.extension(F.col("filename")))


@query("f20_extract_path", f"""WITH {FILES} SELECT card_type, path, count(*) AS n FROM (SELECT card_type, CASE WHEN card_type = 'BC' THEN CASE WHEN regexp_matches(lower(filename), '[.]xlsx?$') THEN 'text' ELSE 'images' END
 WHEN card_type = 'SHINHAN' THEN CASE WHEN regexp_matches(lower(filename), '[.]html?$') THEN 'text' ELSE 'images' END ELSE 'text' END AS path FROM files) GROUP BY ALL""")
def f20(spark, sf):
    f = statement_files(spark, sf).withColumn("path", L.extract_path(F.col("card_type"), F.col("filename")))
    return f.groupBy("card_type", "path").agg(F.count(F.lit(1)).alias("n"))


@query("x3_month_tab", f"WITH {FILES} SELECT o_orderkey, coalesce(nullif(regexp_extract(filename, '(?:^|[^0-9])(20[0-9]{{2}}(?:0[1-9]|1[0-2]))(?:[0-9]{{2}})?(?:[^0-9]|$)', 1), ''), '시트1') AS tab FROM files")
def x3(spark, sf):
    return statement_files(spark, sf).select("o_orderkey", X.month_tab(F.col("filename")).alias("tab"))


@query("x5_amount_text", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice) AS BIGINT) AS amount FROM lineitem")
def x5(spark, sf):
    li = table(spark, sf, "lineitem")
    shown = F.concat(F.lit(" "), F.format_number(F.round("l_extendedprice"), 0), F.lit(" "))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", X.to_amount(shown).alias("amount"))


@query("x5_amount_number", "SELECT c_custkey, CAST(trunc(c_acctbal) AS BIGINT) AS amount FROM customer")
def x5_number(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.number_to_amount(F.col("c_acctbal")).alias("amount"))


@query("x6_serial_day", "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE strftime(DATE '1899-12-30' + CAST(30000 + o_orderkey % 20000 AS INT), '%Y-%m-%d') END AS day FROM orders")
def x6(spark, sf):
    serial = F.when(F.col("o_orderkey") % 11 != 0, (30000 + F.col("o_orderkey") % 20000).cast("double") + 0.25)
    return table(spark, sf, "orders").select("o_orderkey", X.serial_to_day(serial).alias("day"))


@query("x7_k4_amount_format", "SELECT c_custkey, CASE WHEN trunc(c_acctbal) < 0 THEN '-' ELSE '' END || format('{:,}', abs(CAST(trunc(c_acctbal) AS BIGINT))) || '원' AS shown, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS cell FROM customer")
def x7(spark, sf):
    whole = X.number_to_amount(F.col("c_acctbal"))
    return table(spark, sf, "customer").select("c_custkey", X.won(whole).alias("shown"), K.cell_text(F.when(F.col("c_custkey") % 7 != 0, F.col("c_name"))).alias("cell"))


def threads(spark, sf):
    o = table(spark, sf, "orders")
    card = F.element_at(F.array(*[F.lit(c) for c in ("BC", "SHINHAN", "HYUNDAI", "SAMSUNG")]), (F.col("o_custkey") % 4 + 1).cast("int"))
    name = F.element_at(F.array(*[F.lit(c) for c in ("a.pdf", "B.HTML", "c.xlsx")]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    att = F.struct(name.alias("name"), F.col("o_orderpriority").cast("binary").alias("bytes"))
    return o.select(F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("thread_id"), card.alias("card_type"), F.concat(card, F.lit(" "), F.when(F.col("o_orderkey") % 2 == 0, F.lit("명세서")).otherwise(F.lit("안내"))).alias("subject"), (F.col("o_orderstatus") != "P").alias("in_inbox"), F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("정산완료"))).alias("labels"), F.array(F.struct(F.array(att, att).alias("attachments")), F.struct(F.array(att).alias("attachments"))).alias("messages"))


THREADS = """threads AS (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS thread_id, ['BC', 'SHINHAN', 'HYUNDAI', 'SAMSUNG'][o_custkey % 4 + 1] AS card_type,
  o_orderkey % 2 = 0 AS named, o_orderstatus <> 'P' AS in_inbox, o_orderkey % 3 = 0 AS done, ['a.pdf', 'B.HTML', 'c.xlsx'][o_orderkey % 3 + 1] AS name, o_orderpriority AS body FROM orders),
found AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY card_type ORDER BY thread_id DESC) AS n FROM threads WHERE named AND in_inbox AND NOT done) WHERE n <= 20)"""
SUBJECTS = {c: c for c in ("BC", "SHINHAN", "HYUNDAI", "SAMSUNG")}


@query("s1_t9_mailbox_search", f"WITH {THREADS} SELECT thread_id, card_type FROM found")
def s1(spark, sf):
    return S.mailbox_search(threads(spark, sf), label="정산완료", word="명세서", subjects=SUBJECTS).select("thread_id", "card_type")


@query("s5_s20_attachments", f"""WITH {THREADS} SELECT thread_id, m AS message_no, a AS attachment_no, name AS filename, to_base64(encode(body)) AS file_base64, body FROM found, (VALUES (0, 0), (0, 1), (1, 0)) t(m, a)
 WHERE (card_type = 'BC' AND (ends_with(lower(name), '.pdf') OR ends_with(lower(name), '.xlsx'))) OR (card_type = 'SHINHAN' AND (ends_with(lower(name), '.pdf') OR ends_with(lower(name), '.html'))) OR (card_type IN ('HYUNDAI', 'SAMSUNG') AND ends_with(lower(name), '.html'))""")
def s5(spark, sf):
    found = S.attachments(S.mailbox_search(threads(spark, sf), label="정산완료", word="명세서", subjects=SUBJECTS))
    return L.accepted_files(found).select("thread_id", "message_no", "attachment_no", "filename", "file_base64", F.unbase64("file_base64").cast("string").alias("body"))


def cells(spark, sf):
    li = table(spark, sf, "lineitem")
    blank = F.col("l_linenumber") == 3
    row = F.array(F.col("l_returnflag"), F.date_format("l_shipdate", "yyyy-MM-dd"), F.when(F.col("l_linenumber") != 2, F.col("l_quantity").cast("int").cast("string")))
    return li.select(F.col("l_linestatus").alias("sheet"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_no"), F.when(blank, F.array(F.lit(""), F.lit(None).cast("string"))).otherwise(row).alias("cells"))


@query("s7_f18_statement_lines", "SELECT l_linestatus AS sheet, l_orderkey * 10 + l_linenumber AS row_no, l_returnflag || chr(9) || strftime(l_shipdate, '%Y-%m-%d') || chr(9) || CASE WHEN l_linenumber = 2 THEN '' ELSE CAST(CAST(trunc(l_quantity) AS INT) AS VARCHAR) END AS line FROM lineitem WHERE l_linenumber <> 3")
def s7(spark, sf):
    return S.statement_lines(cells(spark, sf))


PAGE = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


@query("s8_f15_page_text", f"SELECT page_id, {PAGE} AS body FROM pages")
def s8(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.checked_page_text(F.col("html")).alias("body"))


@query("f14_dated_lines", "SELECT page_id, len(regexp_extract_all(t, '\\b[0-9]{2}[.][0-9]{2}[.][0-9]{2}\\b')) >= 3 AS dated FROM (SELECT page_id, array_to_string(list_transform(range(page_id % 6), lambda i: '26.01.0' || i), ' ') AS t FROM pages)")
def f14(spark, sf):
    n = (F.col("page_id") % 6).cast("int")
    t = F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("26.01.0"), (i - 1).cast("string"))), " ")).otherwise(F.lit(""))
    return table(spark, sf, "pages").select("page_id", S.has_dates(t).alias("dated"))


@query("x10_page_position", "SELECT page_id, CAST(page_id % 9 AS INT) AS page, CASE WHEN page_id % 9 = 4 THEN NULL ELSE 9 END AS pages FROM pages WHERE page_id % 9 <> 4 UNION ALL SELECT page_id, NULL, NULL FROM pages WHERE page_id % 9 = 4")
def x10(spark, sf):
    t = F.when(F.col("page_id") % 9 == 4, F.lit("끝")).otherwise(F.format_string("… 현재페이지 %d / 전체페이지 9", (F.col("page_id") % 9).cast("int")))
    at = X.page_position(t)
    return table(spark, sf, "pages").select("page_id", at["page"].alias("page"), at["pages"].alias("pages"))


@query("f17_truncate", "SELECT doc_id, length(substr(text, 1, 15000)) AS n FROM documents")
def f17(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length(statement_head(F.col("text"))).cast("bigint").alias("n"))


@query("s11_month_scan", f"WITH {V.KEPT} SELECT card, day, merchant, amount, category, idx FROM kept WHERE month_tab = '{V.REPLAYED}'")
def s11(spark, sf):
    """Written by month, then one month is read: the scan lists one partition."""
    path = scratch(spark, "ledger")
    K.append_ledger(kept(spark, sf), path)
    return spark.read.parquet(path).where(F.col("month_tab") == V.REPLAYED).select("card", "day", "merchant", "amount", "category", "idx")


@query("k2_append", f"WITH {REPLAY}, after AS (SELECT * FROM existing UNION ALL SELECT * FROM added) SELECT month_tab, count(*) AS n, CAST(sum(amount) AS BIGINT) AS total FROM after GROUP BY month_tab")
def k2(spark, sf):
    """The ledger, with what is new in a batch appended to it, as read back."""
    path = scratch(spark, "ledger")
    existing, batch = replayed(spark, sf)
    K.append_ledger(existing, path)
    added = L.new_rows(batch, spark.read.schema(existing.select(*COLS).schema).parquet(path))
    K.append_ledger(added.select(*[c for c in existing.columns]), path)
    return spark.read.parquet(path).groupBy(F.col("month_tab").cast("string").alias("month_tab")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))


@query("ledger_cells", "SELECT c_custkey AS row_no, c_mktsegment AS card, strftime(DATE '1899-12-30' + CAST(46023 + c_custkey % 300 AS INT), '%Y-%m-%d') AS day, c_name AS merchant, CAST(1000 + c_custkey AS BIGINT) AS amount, '' AS category FROM customer WHERE c_custkey % 4 <> 0")
def ledger_cells(spark, sf):
    c = table(spark, sf, "customer")
    card = F.when(F.col("c_custkey") % 4 == 0, F.concat("c_mktsegment", F.lit(" 소계"))).otherwise(F.col("c_mktsegment"))
    row = F.array(card, (46023 + F.col("c_custkey") % 300).cast("string"), F.col("c_name"), F.format_number(1000 + F.col("c_custkey"), 0))
    return S.ledger_cells(c.select(F.col("c_custkey").alias("row_no"), row.alias("cells")))
