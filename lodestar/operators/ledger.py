"""The statement ledger: validation, classification, exclusion, dedup and the month's report.

Rows are (card, day, merchant, amount, category, month_tab) with `idx`, any ordered value that says which
row came first. Rule lists are parameters and stay small; they become chained expressions, not joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.constants import CARD_EXTENSIONS, CATEGORIES, CATEGORY_RULES, EXCLUDED_MERCHANTS, GRAND_TOTAL, PERSONAL_CARDS, SUBTOTAL_SUFFIX, TRANSACTION_KEYS
from lodestar.functions.text import extension
from lodestar.operators.ordering import numbered
from lodestar.storage import written

#: Rules that are broadcast at a time.
MAX_RULES = 10_000
KEY = ["month_tab", "card", "day", "merchant", "amount"]


def contains_any(c: Column, keywords: list[str]) -> Column:
    """Plain substring tests: keywords hold characters that patterns would take as wildcards."""
    return reduce(lambda a, k: a | F.contains(c, F.lit(k)), keywords, F.lit(False))


def excluded(merchant: Column, keywords: list[str] = EXCLUDED_MERCHANTS) -> Column:
    return F.coalesce(contains_any(merchant, keywords), F.lit(False))


def is_summary_row(first_cell: Column) -> Column:
    return F.coalesce((first_cell == "") | (first_cell == GRAND_TOTAL) | F.endswith(first_cell, F.lit(SUBTOTAL_SUFFIX)), F.lit(True))


def reclassify(merchant: Column, category: Column, rules=CATEGORY_RULES) -> Column:
    """The category of the first rule with a keyword in the merchant, else the category as it was."""
    out = category
    for keywords, name in reversed(list(rules)):
        out = F.when(contains_any(merchant, keywords), F.lit(name)).otherwise(out)
    return out


def reclassify_by_table(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """The same with rules (rule_no, keyword, category) in a table.

    Merchants are made distinct, and the rules meet them in blocks of about MAX_RULES, each broadcast; the
    first rule of each merchant is an aggregate, joined back by the merchant.
    """
    table = rules.select("rule_no", "keyword", F.col("category").alias("_rule_category"))
    n = max(1, -(-table.count() // MAX_RULES))
    merchants = rows.select("merchant").distinct()
    if n > 1:
        table, merchants = written(table, "rules"), written(merchants, "merchants")
    blocks = [table.where(F.pmod(F.xxhash64("rule_no", "keyword"), F.lit(n)) == k) if n > 1 else table for k in range(n)]
    hit = reduce(DataFrame.unionByName, [merchants.join(F.broadcast(b), F.contains("merchant", "keyword")) for b in blocks])
    first = hit.groupBy(F.col("merchant").alias("_merchant")).agg(F.min_by("_rule_category", "rule_no").alias("_new"))
    return rows.join(first, F.col("merchant") == F.col("_merchant"), "left").withColumn("category", F.coalesce("_new", "category")).drop("_merchant", "_new")


def shape_error(item: str, keys: list[str] = TRANSACTION_KEYS) -> Column:
    """What is wrong with a transaction, a VARIANT column: the first of not an object, missing keys, day, merchant, amount, category; null if nothing.

    Types are read from the value itself, since from_json would turn a number into text and text into null.
    """
    kind = lambda k: f"schema_of_variant(try_variant_get({item}, '$[\"{k}\"]'))"
    day, merchant, amount, category = keys
    missing = f"array_sort(filter(array({', '.join(repr(k) for k in keys)}), k -> NOT array_contains(coalesce(json_object_keys(to_json({item})), array()), k)))"
    number = f"({kind(amount)} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR {kind(amount)} LIKE 'DECIMAL%')"
    return F.expr(f"""CASE
        WHEN {item} IS NULL OR schema_of_variant({item}) NOT LIKE 'OBJECT%' THEN 'not an object'
        WHEN size({missing}) > 0 THEN concat('missing: ', array_join({missing}, ', '))
        WHEN NOT coalesce({kind(day)} = 'STRING', false) THEN 'day is not text'
        WHEN NOT coalesce({kind(merchant)} = 'STRING', false) THEN 'merchant is not text'
        WHEN NOT coalesce({number}, false) THEN 'amount is not a number'
        WHEN NOT coalesce({kind(category)} = 'STRING', false) THEN 'category is not text' END""")


def explode_replies(replies: DataFrame, json_col: str = "json") -> DataFrame:
    """(…, json) to one row per transaction: reply columns, pos, item. Replies without a transactions array give one row with pos null."""
    parsed = replies.withColumn("_v", F.try_parse_json(json_col)).withColumn("_kind", F.expr("schema_of_variant(try_variant_get(_v, '$.transactions'))"))
    items = F.expr("CASE WHEN _kind LIKE 'ARRAY%' THEN try_cast(try_variant_get(_v, '$.transactions') AS array<variant>) END")
    return parsed.select(*replies.columns, F.coalesce(F.startswith("_kind", F.lit("ARRAY")), F.lit(False)).alias("is_list"), F.posexplode_outer(items).alias("pos", "item"))


def validated(replies: DataFrame, batch_cols: list[str], json_col: str = "json") -> DataFrame:
    """One row per reply: batch columns, valid, error_pos, error. A single bad row makes the whole reply invalid; an empty list is valid."""
    rows = explode_replies(replies, json_col)
    rows = rows.withColumn("_error", F.when(~F.col("is_list"), F.lit("no list of transactions")).when(F.col("pos").isNotNull(), shape_error("item")))
    out = rows.groupBy(*batch_cols).agg(F.min(F.when(F.col("_error").isNotNull(), F.struct(F.coalesce("pos", F.lit(-1)).alias("pos"), F.col("_error").alias("error")))).alias("_bad"))
    return out.select(*batch_cols, F.col("_bad").isNull().alias("valid"), F.nullif(F.col("_bad.pos"), F.lit(-1)).alias("error_pos"), F.col("_bad.error").alias("error"))


def first_valid(replies: DataFrame, batch_col: str = "batch_id", attempt_col: str = "attempt", attempts: int = 3, json_col: str = "json") -> DataFrame:
    """(batch, attempt, json) to the first valid of at most `attempts` replies per batch: batch, attempt, json; both null if none is valid."""
    checked = replies.where(F.col(attempt_col) <= attempts).join(validated(replies, [batch_col, attempt_col], json_col), [batch_col, attempt_col])
    return checked.groupBy(batch_col).agg(F.min(F.when(F.col("valid"), F.col(attempt_col))).alias(attempt_col), F.min_by(F.when(F.col("valid"), F.col(json_col)), F.when(F.col("valid"), F.col(attempt_col))).alias(json_col))


def transactions(replies: DataFrame, keys: list[str] = TRANSACTION_KEYS, json_col: str = "json") -> DataFrame:
    """Valid replies as rows: reply columns, pos, day, merchant, amount, category; fractions of amounts cut off."""
    get = lambda k, t: F.expr(f"try_variant_get(item, '$[\"{k}\"]', '{t}')")
    day, merchant, amount, category = keys
    rows = explode_replies(replies, json_col).where("pos IS NOT NULL")
    return rows.select(*[c for c in replies.columns if c != json_col], "pos", get(day, "string").alias("day"), get(merchant, "string").alias("merchant"), get(amount, "double").cast("bigint").alias("amount"), get(category, "string").alias("category"))


def require_valid(replies: DataFrame, batch_cols: list[str], json_col: str = "json") -> DataFrame:
    """The replies as they are; reading one that is invalid is an error that names the first bad row."""
    checked = validated(replies, batch_cols, json_col)
    message = F.concat(F.lit("row "), F.coalesce(F.col("error_pos").cast("string"), F.lit("-")), F.lit(": "), F.col("error"))
    return replies.join(checked, batch_cols).where(F.when(F.col("valid"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))).select(*replies.columns)


def new_rows(candidates: DataFrame, existing: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Candidates that the ledger does not hold yet, the first of those that repeat in the batch. Keys match null-safely, within a month.

    The first of a key is an aggregate, so a row that repeats very often leaves each task once.
    """
    rest = [c for c in candidates.columns if c not in key]
    first = candidates.groupBy(*key).agg(F.min_by(F.struct(*rest), "idx").alias("_r")).select(*key, "_r.*").select(*candidates.columns)
    held = existing.select(*[F.col(k).alias(f"_h_{k}") for k in key])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in key])
    return first.join(held, on, "left_anti")


def append_counts(candidates: DataFrame, added: DataFrame) -> DataFrame:
    """(month_tab, added, skipped): what a batch brought and what it repeated."""
    both = candidates.select("month_tab", F.lit(1).alias("c"), F.lit(0).alias("a")).unionByName(added.select("month_tab", F.lit(0).alias("c"), F.lit(1).alias("a")))
    return both.groupBy("month_tab").agg(F.sum("a").alias("added"), (F.sum("c") - F.sum("a")).alias("skipped"))


def subtotals(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per card, with `ord`, the place at which the card first appears."""
    return rows.groupBy(*by, "card").agg(F.sum("amount").alias("subtotal"), F.min("idx").alias("ord"))


def grand_totals(rows: DataFrame, by: list[str], personal: list[str] = PERSONAL_CARDS) -> DataFrame:
    """Per month, over all cards but the personal ones; 0 if none is left."""
    return rows.groupBy(*by).agg(F.coalesce(F.sum(F.when(~F.col("card").isin(*personal), F.col("amount"))), F.lit(0)).alias("grand_total"))


def month_report(rows: DataFrame, personal: list[str] = PERSONAL_CARDS) -> DataFrame:
    """Details, a subtotal after each card in order of first appearance, and the grand total, with `level` (detail, subtotal, total) and `line`, per month.

    One pass of grouping sets; details keep their values as their groups have one row. Lines are numbered
    by range, so a month of any size is spread over tasks.
    """
    first = rows.groupBy("month_tab", "card").agg(F.min("idx").alias("ord"))
    same = F.col("month_tab").eqNullSafe(F.col("_m")) & F.col("card").eqNullSafe(F.col("_c"))
    rows = rows.join(first.select(F.col("month_tab").alias("_m"), F.col("card").alias("_c"), "ord"), same)
    c, shared = F.col, F.coalesce(~F.col("card").isin(*personal), F.lit(True)) if personal else F.lit(True)
    month, card, ord_, idx, day, merchant, category = (c(x) for x in ("month_tab", "card", "ord", "idx", "day", "merchant", "category"))
    sets = rows.groupingSets([(month, ord_, card, idx, day, merchant, category), (month, ord_, card), (month,)], month, ord_, card, idx, day, merchant, category)
    sets = sets.agg(F.sum("amount").alias("total"), F.sum(F.when(shared, F.col("amount"))).alias("shared"), F.grouping("card").alias("g_card"), F.grouping("idx").alias("g_idx"))
    level = F.when(F.col("g_card") == 1, F.lit("total")).when(F.col("g_idx") == 1, F.lit("subtotal")).otherwise(F.lit("detail"))
    label = F.when(F.col("g_card") == 1, F.lit(GRAND_TOTAL)).when(F.col("g_idx") == 1, F.concat("card", F.lit(SUBTOTAL_SUFFIX))).otherwise(F.col("card"))
    amount = F.when(F.col("g_card") == 1, F.coalesce("shared", F.lit(0))).otherwise(F.col("total"))
    lines = numbered(sets, ["month_tab"], ["g_card", "ord", "g_idx", "idx"], "line")
    return lines.select("month_tab", "line", level.alias("level"), label.alias("label"), "day", "merchant", amount.alias("amount"), "category")


def category_summary(rows: DataFrame, by: list[str], categories: list[str] = CATEGORIES, personal: list[str] = PERSONAL_CARDS) -> DataFrame:
    """Every category of the dimension for every month that has rows, in its order, 0 where nothing was spent."""
    spark = rows.sparkSession
    dimension = spark.createDataFrame(list(enumerate(categories)), "ord int, category string")
    sums = rows.where(~F.col("card").isin(*personal)).groupBy(*by, "category").agg(F.sum("amount").alias("_sum"))
    months = rows.select(*by).distinct() if by else None
    base = months.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("category")) for i, c in enumerate(categories)])).alias("d")).select(*by, "d.*") if by else dimension
    return base.join(sums, [*by, "category"], "left").select(*by, "ord", "category", F.coalesce("_sum", F.lit(0)).alias("amount"))


def accepted_files(files: DataFrame, extensions: dict[str, list[str]] = CARD_EXTENSIONS) -> DataFrame:
    """(card_type, filename, …): those whose name ends, in any case, with an extension that the card allows."""
    pairs = [(card, e) for card, es in extensions.items() for e in es]
    ok = reduce(lambda a, p: a | ((F.col("card_type") == p[0]) & F.endswith(F.lower("filename"), F.lit(p[1]))), pairs, F.lit(False))
    return files.where(ok)


def extract_path(card_type: Column, filename: Column) -> Column:
    """How a file is read: "text" or "images"."""
    e = extension(filename)
    return F.when(card_type == "BC", F.when(e.isin(".xlsx", ".xls"), F.lit("text")).otherwise(F.lit("images"))).when(card_type == "SHINHAN", F.when(e.isin(".html", ".htm"), F.lit("text")).otherwise(F.lit("images"))).otherwise(F.lit("text"))


def ledger_update(batch: DataFrame, existing: DataFrame, *, rules=CATEGORY_RULES, excluded_merchants: list[str] = EXCLUDED_MERCHANTS) -> tuple[DataFrame, DataFrame]:
    """(candidates, added): classified, not excluded, and of these the new ones."""
    classified = batch.withColumn("category", reclassify(F.col("merchant"), F.col("category"), rules))
    candidates = classified.where(~excluded(F.col("merchant"), excluded_merchants))
    return candidates, new_rows(candidates, existing)
