import json

import pytest
from pyspark.sql import functions as F

from lodestar.operators import ledger as L

ROW = "card string, day string, merchant string, amount bigint, category string, month_tab string, idx string"


def rows(spark, *values):
    return spark.createDataFrame([(*v, f"{i:03d}") for i, v in enumerate(values)], ROW)


def test_rule_order(spark):
    df = spark.createDataFrame([("이마트24 역삼",), ("(주)이마트 성수",), ("GS25",), ("무명",)], "merchant string")
    got = [r[0] for r in df.select(L.reclassify(F.col("merchant"), F.lit("기타"))).collect()]
    assert got == ["카페/간식", "식비", "카페/간식", "기타"]


def test_exclusion_is_a_plain_substring(spark):
    df = spark.createDataFrame([("후불무승인_1",), ("후불무승인A",), (None,)], "merchant string")
    assert [r[0] for r in df.select(L.excluded(F.col("merchant"))).collect()] == [True, False, False]


def test_dedup_within_month_and_batch(spark):
    batch = rows(spark, ("a", "d", "m", 1, "c", "202601"), ("a", "d", "m", 1, "c", "202601"), ("a", "d", "m", 1, "c", "202602"), ("b", None, "m", 1, "c", "202601"))
    held = rows(spark, ("b", None, "m", 1, "x", "202601"))
    added = L.new_rows(batch, held)
    assert sorted((r.month_tab, r.card, r.idx) for r in added.collect()) == [("202601", "a", "000"), ("202602", "a", "002")]
    counts = {r.month_tab: (r.added, r.skipped) for r in L.append_counts(batch, added).collect()}
    assert counts == {"202601": (1, 2), "202602": (1, 0)}


def test_report_of_personal_cards_alone(spark):
    df = rows(spark, ("현대카드", "d", "m", 5, "c", "202601"), ("현대카드", "d", "n", -2, "c", "202601"))
    assert [(r.level, r.label, r.amount) for r in L.month_report(df).orderBy("line").collect()] == [("detail", "현대카드", 5), ("detail", "현대카드", -2), ("subtotal", "현대카드 소계", 3), ("total", "전체 합계", 0)]


def test_report_keeps_first_appearance_order(spark):
    df = rows(spark, ("z", "d", "m", 1, "c", "t"), ("a", "d", "m", 2, "c", "t"), ("z", "d", "n", 3, "c", "t"))
    assert [r.label for r in L.month_report(df).orderBy("line").collect()] == ["z", "z", "z 소계", "a", "a 소계", "전체 합계"]


def test_category_summary_lists_all(spark):
    df = rows(spark, ("x", "d", "m", 7, "식비", "t"), ("현대카드", "d", "m", 9, "식비", "t"))
    got = {r.category: r.amount for r in L.category_summary(df, ["month_tab"]).collect()}
    assert len(got) == 10 and got["식비"] == 7 and got["교통"] == 0


GOOD = {"일자": "2026-01-01", "가맹점": "a", "금액": 1, "분류": "기타"}


@pytest.mark.parametrize(
    "item, error",
    [
        (GOOD, None),
        (GOOD | {"금액": 1.5}, None),
        (5, "not an object"),
        ({k: v for k, v in GOOD.items() if k != "분류"}, "missing: 분류"),
        (GOOD | {"일자": 20260101}, "day is not text"),
        (GOOD | {"가맹점": None}, "merchant is not text"),
        (GOOD | {"금액": "1"}, "amount is not a number"),
        (GOOD | {"금액": True}, "amount is not a number"),
        (GOOD | {"분류": 3}, "category is not text"),
    ],
)
def test_shape(spark, item, error):
    df = spark.createDataFrame([(1, json.dumps({"transactions": [GOOD, item]}, ensure_ascii=False))], "batch_id int, json string")
    assert L.validated(df, ["batch_id"]).first()[1:] == (error is None, None if error is None else 1, error)


@pytest.mark.parametrize("reply, valid", [('{"transactions":[]}', True), ('{"transactions":"x"}', False), ("{}", False), ("not json", False), (None, False)])
def test_reply_kinds(spark, reply, valid):
    df = spark.createDataFrame([(1, reply)], "batch_id int, json string")
    assert L.validated(df, ["batch_id"]).first().valid is valid


def test_invalid_reply_stops_the_batch(spark):
    df = spark.createDataFrame([(1, "{}")], "batch_id int, json string")
    with pytest.raises(Exception, match="no list"):
        L.require_valid(df, ["batch_id"]).collect()


def test_first_valid_of_three(spark):
    good = json.dumps({"transactions": [GOOD]}, ensure_ascii=False)
    df = spark.createDataFrame([(1, 1, "{}"), (1, 2, good), (1, 3, good), (2, 1, "{}"), (2, 4, good)], "batch_id int, attempt int, json string")
    assert sorted((r.batch_id, r.attempt or 0) for r in L.first_valid(df).collect()) == [(1, 2), (2, 0)]
