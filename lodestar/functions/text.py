"""Scalar functions as Column expressions; none needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.constants import CAMEL_PIECES, DEFAULT_TAB, MONTH, PAGER, TOKEN_RUNS

#: ASCII runs that are one token: a word with at most its first letter in upper case, digits.
ONE_TOKEN = "^(?:[A-Z]?[a-z]+|[0-9]+)$"
EPOCH = "1899-12-30"


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def camel_parts(run: Column) -> Column:
    """The lower-case camel pieces of one ASCII run. Capitals right before a digit vanish."""
    return F.transform(F.regexp_extract_all(run, F.lit(CAMEL_PIECES), F.lit(0)), lambda p: F.lower(p))


def bigrams(run: Column) -> Column:
    n = F.length(run)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(run, i, F.lit(2)))).otherwise(empty_strings())


def tokenize(text: Column) -> Column:
    """Search tokens in order, repeats kept: ASCII runs in lower case and their camel pieces, Hangul runs and their bigrams. Null gives no tokens."""

    def of_run(run: Column) -> Column:
        low = F.lower(run)
        ascii_run = F.concat(F.array(low), F.filter(camel_parts(run), lambda p: p != low))
        other = F.when(F.rlike(run, F.lit("^[A-Za-z0-9]+$")), ascii_run).otherwise(F.concat(F.array(run), bigrams(run)))
        return F.when(F.rlike(run, F.lit(ONE_TOKEN)), F.array(low)).otherwise(other)

    return F.coalesce(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(TOKEN_RUNS), F.lit(0)), of_run)), empty_strings())


def month_tab(filename: Column, default: str = DEFAULT_TAB) -> Column:
    """YYYYMM of the leftmost date in a file name that no other digits touch."""
    return F.coalesce(F.nullif(F.concat(F.regexp_extract(filename, MONTH, 1), F.regexp_extract(filename, MONTH, 2)), F.lit("")), F.lit(default))


def to_amount(value: Column) -> Column:
    """An amount cell as whole numbers: commas dropped, blank and null 0, fractions of numbers cut off. Other text is an error."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(value.cast("string"), ",", "")), F.lit("")).cast("bigint"), F.lit(0).cast("bigint"))


def number_to_amount(value: Column) -> Column:
    return F.coalesce(value.cast("double").cast("bigint"), F.lit(0).cast("bigint"))


def serial_to_day(serial: Column) -> Column:
    """A spreadsheet's day number as YYYY-MM-DD; null gives the empty text."""
    return F.coalesce(F.date_format(F.date_add(F.lit(EPOCH).cast("date"), F.floor(serial.cast("double")).cast("int")), "yyyy-MM-dd"), F.lit(""))


def day_cell(text: Column) -> Column:
    """A day cell kept as text: whole numbers are day numbers, everything else stays."""
    return F.when(F.rlike(text, F.lit(r"^\d+(\.\d+)?$")), serial_to_day(text)).otherwise(F.coalesce(text, F.lit("")))


def won(amount: Column) -> Column:
    return F.concat(F.format_number(amount, 0), F.lit("원"))


def extension(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"(\.[^./]+)$", 1))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def short_id(node_id: Column) -> Column:
    """What follows the first "::" up to the next, or the id itself."""
    return F.coalesce(F.try_element_at(F.split(node_id, "::"), F.lit(2)), node_id)


def path_text(path: Column) -> Column:
    return F.array_join(F.transform(path, short_id), " ─▶ ")


def line_slice(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last of a text, from 1, both included."""
    return F.array_join(F.slice(F.split(text, "\n"), first, last - first + 1), "\n")


def doc_line(doc: Column) -> Column:
    return F.substring(F.trim(F.get(F.split(F.trim(doc), "\n"), F.lit(0))), 1, 200)


def comment_text(line: Column) -> Column:
    """A comment line without the marks that lead it; marks at its end stay."""
    return F.substring(stripped(F.regexp_replace(stripped(line), "^[/* ]+", "")), 1, 200)


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def source_lines(source: Column) -> Column:
    """The lines of a text file; the end of its last line begins no other."""
    return F.when(source == "", empty_strings()).otherwise(F.split(F.regexp_replace(source, r"\n\z", ""), "\n", -1))


def first_lines(text: Column, n: int = 40) -> Column:
    """At most n lines, then a note of how many are left out."""
    lines = F.split(text, "\n")
    return F.concat(F.array_join(F.slice(lines, 1, n), "\n"), F.when(F.size(lines) > n, F.concat(F.lit("\n… ("), (F.size(lines) - n).cast("string"), F.lit(" more lines)"))).otherwise(F.lit("")))


def page_position(text: Column) -> Column:
    """struct(page, pages) of a pager's text, both null without one."""
    number = lambda k: F.nullif(F.regexp_extract(text, PAGER, k), F.lit("")).cast("int")
    return F.struct(number(1).alias("page"), number(2).alias("pages"))


def html_text(html: Column) -> Column:
    """The text of a plain page: scripts, styles and comments dropped, tags to blanks, blanks joined."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, added up in doubles; null for vectors without length."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    product = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    length = lambda x: F.sqrt(total(F.transform(x, lambda v: v.cast("double") * v.cast("double"))))
    return 1 - product / F.nullif(length(a) * length(b), F.lit(0.0))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def bm25_weight(tf: Column, length: Column, average: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


ENCODED_WORD = r"=\?(?i:utf-8)\?[bBqQ]\?[^?]*\?="


def mime_filename(name: Column) -> Column:
    """A mail header's file name: words in UTF-8, base64 or quoted, decoded; the blanks between two of them dropped, other text kept as it is."""

    def decoded(word: Column) -> Column:
        body = F.regexp_extract(word, r"\?[bBqQ]\?([^?]*)\?=$", 1)
        escaped = body  # quoted words are written like queries of a url, with other marks
        for mark, code in (("%", "%25"), ("+", "%2B"), ("=", "%"), ("_", "%20")):
            escaped = F.replace(escaped, F.lit(mark), F.lit(code))
        base64 = F.rlike(word, F.lit(r"^=\?(?i:utf-8)\?[bB]"))
        return F.when(base64, F.try_to_binary(body, F.lit("base64")).cast("string")).otherwise(F.try_url_decode(escaped))

    joined = F.regexp_replace(name, rf"({ENCODED_WORD})\s+(?={ENCODED_WORD})", "$1")
    words = F.regexp_extract_all(joined, F.lit(ENCODED_WORD), F.lit(0))
    between = F.split(joined, ENCODED_WORD, -1)
    pieces = F.zip_with(between, words, lambda text, word: F.concat(text, F.coalesce(decoded(word), F.lit(""))))
    return F.when(F.size(words) > 0, F.array_join(pieces, "")).otherwise(name)


#: Characters two columns wide on a terminal: Hangul, kana, ideographs and full-width forms.
WIDE = "[\u1100-\u115f\u2e80-\u303e\u3041-\u33ff\u3400-\u4dbf\u4e00-\u9fff\ua000-\ua4cf\uac00-\ud7a3\uf900-\ufaff\ufe30-\ufe6f\uff00-\uff60\uffe0-\uffe6]"


def display_width(text: Column) -> Column:
    return F.length(text) + F.regexp_count(text, F.lit(WIDE))


def clipped(text: Column, width: int) -> Column:
    """At most `width` columns; a longer text ends in "…"."""
    fitting = F.filter(F.transform(F.sequence(F.lit(0), F.length(text)), lambda n: F.substr(text, F.lit(1), n)), lambda t: display_width(t) <= width - 1)
    return F.when(display_width(text) <= width, text).otherwise(F.concat(F.element_at(fitting, -1), F.lit("…")))


def padded(text: Column, width: int) -> Column:
    """Exactly `width` columns."""
    cut = clipped(text, width)
    return F.concat(cut, F.repeat(F.lit(" "), (F.lit(width) - display_width(cut)).cast("int")))
