import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "given, tokens",
    [
        ("parseTransactionsWithClaude", ["parsetransactionswithclaude", "parse", "transactions", "with", "claude"]),
        ("비밀번호", ["비밀번호", "비밀", "밀번", "번호"]),
        ("GS25", ["gs25", "g", "25"]),
        ("B2B", ["b2b", "2", "b"]),
        ("ensure_tab", ["ensure", "tab"]),
        ("가", ["가"]),
        ("été", ["t"]),
        ("", []),
        (None, []),
    ],
)
def test_tokens(spark, given, tokens):
    assert one(spark, X.tokenize(F.lit(given).cast("string"))) == tokens


@pytest.mark.parametrize("name, tab", [("BC바로카드_20260813.pdf", "202608"), ("hyundaicard_202606.html", "202606"), ("회원번호2026089_20261215.pdf", "202612"), ("x_20261345.pdf", "시트1"), ("none.pdf", "시트1")])
def test_month_tab(spark, name, tab):
    assert one(spark, X.month_tab(F.lit(name))) == tab


@pytest.mark.parametrize("value, amount", [("1,234", 1234), ("", 0), (None, 0), (" -5 ", -5)])
def test_to_amount(spark, value, amount):
    assert one(spark, X.to_amount(F.lit(value).cast("string"))) == amount


def test_fractional_text_amount_is_an_error(spark):
    with pytest.raises(Exception):
        one(spark, X.to_amount(F.lit("1.5")))


def test_numbers_are_cut(spark):
    assert [one(spark, X.number_to_amount(F.lit(v))) for v in (1.9, -1.9)] == [1, -1]


def test_serial_day(spark):
    assert one(spark, X.serial_to_day(F.lit(46023))) == "2026-01-01"
    assert one(spark, X.serial_to_day(F.lit(None).cast("double"))) == ""
    assert [one(spark, X.day_cell(F.lit(v).cast("string"))) for v in ("46023", "2026-02-03", None)] == ["2026-01-01", "2026-02-03", ""]


def test_small_functions(spark):
    assert one(spark, X.won(F.lit(-1234567))) == "-1,234,567원"
    assert one(spark, X.extension(F.lit("A.B.PDF"))) == ".pdf"
    assert one(spark, X.basename(F.lit("a/b/c.py"))) == "c.py"
    assert one(spark, X.short_id(F.lit("a.py::f"))) == "f"
    assert one(spark, X.short_id(F.lit("plain"))) == "plain"
    assert one(spark, X.path_text(F.array(F.lit("a::x"), F.lit("a::y")))) == "x ─▶ y"
    assert one(spark, X.html_text(F.lit("<p>a</p><script>b</script><!-- c --> <b>d</b>"))) == "a d"
    assert one(spark, X.cosine_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0)))) == 1.0
    assert one(spark, X.cosine_distance(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
