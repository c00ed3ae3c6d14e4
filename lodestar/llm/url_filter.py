"""URL filters: ordered host and path rules, and a logistic regression on hashed character n-grams for the rest.

All of it is DataFrame expressions. The model is trained from a small labelled table of at most
MAX_EXAMPLES urls by gradient descent on the examples' coefficients (the weights are sums of examples
times coefficients, so this is the same model as descent on the weights), and reaches the scan as one
array of BUCKETS doubles from a scalar subquery: a fixed size, whatever the input. Judging a url needs no
shuffle and no join.

Defined results. Null urls and urls without "://" have an empty host and path, fit no rule, and are
scored like any other text (the bias alone decides). Any length is judged whole. Repeated rows get equal
results; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

BUCKETS, MAX_EXAMPLES, EPOCHS, RATE, L2 = 4096, 1000, 300, 0.5, 0.002

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

GOOD_URLS = """
https://www.cityjournal.example/news/2021/05/council-meeting https://library.uni-north.example/catalog/item/4821
https://docs.opentools.example/guide/install.html http://museum.example.org/exhibits/early-maps
https://blog.gardener.example.net/growing-tomatoes https://en.wiki.example.org/wiki/River_delta
https://weather.example.com/forecast/today http://www.schoolboard.example.org/minutes/2019/march.html
https://recipes.kitchen.example/bread/sourdough-basics https://health.gov.example/advice/influenza
https://forum.cyclists.example.net/t/brake-adjustment/221 https://research.example.edu/papers/soil-carbon.pdf
https://www.trainline.example/timetable/winter http://archive.example.org/details/radio-plays
https://developer.example.com/reference/http/status https://shop.books.example/history/roman-empire
https://m.thenews.example.com/en/4432 https://theatre.example.net/de/program/2020
https://www.parliament.example/bills/energy https://blog.physics.example.org/en/12/quantum-notes
http://localpaper.example.net/sports/rowing https://maps.example.com/trails/ridge-walk
https://courses.example.edu/algebra/lesson-4 https://news.example.org/fr/politique/budget
https://www.astronomy.example/observing/moon https://support.example.com/articles/printer-setup
http://choir.example.org/rehearsals.html https://www.farmers.example.net/market/prices
https://legal.example.org/statutes/tenancy https://the.example.org/en/7712
https://www.hospital.example/departments/cardiology https://tutorials.example.net/python/lists
https://www.chessclub.example.org/de/results/2018 https://ocean.example.edu/data/tides
https://biology.example.com/en/cells https://post.example.net/en/9911/letters
https://radio.example.org/es/cultura/teatro https://www.zoo.example/animals/otter
https://standards.example.org/iso/units https://travel.example.com/en/lisbon-on-foot
""".split()
BAD_URLS = """
http://free-casino-bonus.example/win/jackpot https://hot-xxx-cams.example/live/girls
http://cheap-pills-online.example/buy/viagra https://casino777.example.net/slots/spin
http://www.warez-crack.example/keygen/download https://bet-now.example.com/poker/bonus
http://replica-watches.example/buy/cheap https://xxxporn.example/videos/free
http://get-rich-fast.example/click?offer=1 https://loans-instant-cash.example/apply/now
http://adult-dating.example/sexy/singles https://torrent-cracked.example/full/serial
http://win-prize-click.example/claim/free-iphone https://slots-casino.example.net/free-spins
http://viagra-cialis.example/order/discount https://sex-chat.example/webcam/nude
http://payday-loan.example/fast-cash https://crypto-doubler.example/double/bitcoin
http://free-download-crack.example/keygen.exe https://nude-girls.example/xxx/gallery
http://poker-bet-casino.example/bonus/code https://cheap-meds.example/pills/order
http://click-here-win.example/lottery/prize https://porn-tube.example/xxx/video
http://serial-keygen.example/warez/dl https://betting-odds.example/jackpot/free
http://escort-adult.example/city/sexy https://hack-account.example/password/free
http://weight-loss-pills.example/miracle/buy https://spam-offers.example/click/track?id=9
http://free-money.example/claim/bonus https://live-xxx.example/cams/nude
http://casino-royal-bonus.example/deposit https://crack-serials.example/download/full
http://cheap-replica.example/bags/discount https://sexy-singles.example/adult/chat
http://jackpot-slots.example/casino/win https://instant-loan-cash.example/payday
http://cracked-apps.example/apk/free-download https://porn-xxx.example/free/tube
""".split()


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to "/", "?", "#" or the end, A-Z in lower case. Path: from there up to "?", "#" or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def grams(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """The distinct buckets of the character n-grams of the host (3 to 5) and of the path (3 and 4), each with its ends marked. A bucket is the first three hexadecimal digits of an MD5, which any SQL engine can tell."""

    def of(text: Column, kind: str, n: int) -> Column:
        marked = F.concat(F.lit("^"), text, F.lit("$"))
        last = F.length(marked) - (n - 1)
        hashed = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(kind), F.substr(marked, i, F.lit(n))).cast("binary")), 1, 3), 16, 10).cast("int"), F.lit(buckets)))
        return F.when(last >= 1, hashed).otherwise(F.array().cast("array<int>"))

    return F.array_distinct(F.concat(*(of(host, "h", n) for n in (3, 4, 5)), *(of(path, "p", n) for n in (3, 4))))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table that comes with the operator: (url, label), label 1 for unwanted."""
    return spark.createDataFrame([(u, 0) for u in GOOD_URLS] + [(u, 1) for u in BAD_URLS], "url string, label int")


def train(labelled: DataFrame, *, buckets: int = BUCKETS, epochs: int = EPOCHS, rate: float = RATE, l2: float = L2) -> DataFrame:
    """One row with `weights`, an array of buckets + 1 doubles, the bias last. Rows with a null url or label are left out; over MAX_EXAMPLES rows are an error."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.where("url IS NOT NULL AND label IS NOT NULL").select("url", "label").distinct().select(grams(host, path, buckets).alias("g"), F.col("label").cast("double").alias("y"), "url")
    ex = rows.agg(F.array_sort(F.collect_list(F.struct("url", "y", "g"))).alias("ex")).select(
        F.when(F.size("ex") > MAX_EXAMPLES, F.raise_error(F.lit(f"more than {MAX_EXAMPLES} labelled urls"))).otherwise(F.col("ex")).alias("ex")
    )
    like = lambda a, b: F.size(F.array_intersect(a["g"], b["g"])) / F.sqrt((F.size(a["g"]) * F.size(b["g"])).cast("double")) + 1.0
    kernel = ex.select("ex", F.posexplode("ex").alias("i", "e")).select("i", F.col("e.y").alias("y"), F.col("e.g").alias("g"), F.transform("ex", lambda o: like(F.col("e"), o)).alias("k"))
    one = kernel.groupBy().agg(F.array_sort(F.collect_list(F.struct("i", "y", "k", "g"))).alias("rows"))
    dot = lambda k, a: F.aggregate(F.zip_with(k, a, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    step = lambda a, _: F.zip_with(a, F.col("rows"), lambda ai, r: ai + F.lit(rate) * (r["y"] - 1 / (1 + F.exp(-dot(r["k"], a))) - F.lit(l2) * ai))
    fitted = one.select("rows", F.aggregate(F.sequence(F.lit(1), F.lit(epochs)), F.transform("rows", lambda r: F.lit(0.0)), step).alias("a"))
    by_row = fitted.select(F.explode(F.arrays_zip("rows", "a")).alias("x")).select(F.col("x.rows.g").alias("g"), F.col("x.a").alias("a"))
    parts = by_row.select(F.explode("g").alias("bucket"), (F.col("a") / F.sqrt(F.size("g").cast("double"))).alias("w")).unionByName(by_row.select(F.lit(buckets).alias("bucket"), F.col("a").alias("w")))
    summed = parts.groupBy("bucket").agg(F.sum("w").alias("w"))
    dense = labelled.sparkSession.range(buckets + 1).select(F.col("id").cast("int").alias("bucket")).join(summed, "bucket", "left")
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("w", F.lit(0.0)).alias("w")))), lambda x: x["w"]).alias("weights"))


def fitting_rule(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits: its host is the url's or a parent of it, its path begins the url's. The rules are a parameter, so their number is fixed."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, slash, rest = rule.partition("/")
        of_host = (host == rule_host) | F.endswith(host, F.lit("." + rule_host))
        found = F.when(of_host & F.startswith(path, F.lit(slash + rest)), F.lit(rule)).otherwise(found)
    return found


def judge_urls(pages: DataFrame, *, rules=RULES, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (the method's probability that the url is unwanted, to 6 digits)."""
    host, path = host_and_path(F.coalesce(F.col(url_col), F.lit("")))
    model = train(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    judged = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    judged = judged.select("*", fitting_rule(F.col("host"), F.col("path"), rules).alias("rule"), grams(F.col("host"), F.col("path")).alias("_g"), model.scalar().alias("_w"))
    total = F.aggregate("_g", F.lit(0.0), lambda s, b: s + F.get(F.col("_w"), b)) / F.sqrt(F.greatest(F.size("_g"), F.lit(1)).cast("double")) + F.get(F.col("_w"), F.lit(BUCKETS))
    verdict = F.lit(None).cast("string")
    for action, rule in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(action)).otherwise(verdict)
    return judged.withColumn("score", F.round(1 / (1 + F.exp(-total)), 6)).select("page_id", "host", "path", "rule", F.coalesce(verdict, F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "score")


def grams_sql(host: str, path: str) -> str:
    def of(text: str, kind: str, n: int) -> str:
        return f"CASE WHEN length({text}) + 2 >= {n} THEN list_transform(range(1, length({text}) + {4 - n}), lambda i: CAST('0x' || substr(md5('{kind}' || substr('^' || {text} || '$', CAST(i AS INT), {n})), 1, 3) AS INT)) ELSE [] END"

    parts = [of(host, "h", n) for n in (3, 4, 5)] + [of(path, "p", n) for n in (3, 4)]
    return "list_distinct(" + "list_concat(" * (len(parts) - 1) + parts[0] + "".join(f", {p})" for p in parts[1:]) + ")"


def oracle(rules=RULES) -> str:
    """The rules, the training and the scores as SQL."""
    rest = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    host, path = f"translate(regexp_extract({rest}, '^([^/?#]*)', 1), {letters})", f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"
    table = ", ".join([f"('{u}', 0.0)" for u in GOOD_URLS] + [f"('{u}', 1.0)" for u in BAD_URLS])
    fits = lambda r: f"(host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}')"
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in sorted(rules, key=lambda r: (-len(r[1]), r[1]))) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{a}'" for a, r in rules) + " ELSE CASE WHEN score >= 0.5 THEN 'block' ELSE 'allow' END END"
    return f"""WITH RECURSIVE labelled(url, y) AS (SELECT url, CAST(y AS DOUBLE) FROM (VALUES {table}) t(url, y)),
ex AS (SELECT url, y, {grams_sql("host", "path")} AS g, row_number() OVER (ORDER BY url) AS i FROM (SELECT url, y, {host} AS host, {path} AS path FROM labelled)),
k AS (SELECT a.i, any_value(a.y) AS y, list(len(list_intersect(a.g, b.g)) / sqrt(CAST(len(a.g) * len(b.g) AS DOUBLE)) + 1.0 ORDER BY b.i) AS row FROM ex a, ex b GROUP BY a.i),
m AS (SELECT list(y ORDER BY i) AS y, list(row ORDER BY i) AS k, count(*) AS n FROM k),
fit(step, a) AS (SELECT 0, list_transform(y, lambda v: CAST(0 AS DOUBLE)) FROM m
  UNION ALL SELECT step + 1, list_transform(range(1, n + 1), lambda i: a[i] + {RATE} * (y[i] - 1 / (1 + exp(-list_inner_product(k[i], a))) - {L2} * a[i])) FROM fit, m WHERE step < {EPOCHS}),
alpha AS (SELECT i, a[i] AS a, g FROM ex, fit WHERE step = {EPOCHS}),
w AS (SELECT bucket, sum(v) AS w FROM (SELECT unnest(g) AS bucket, a / sqrt(CAST(len(g) AS DOUBLE)) AS v FROM alpha) GROUP BY bucket),
judged AS (SELECT page_id, host, path, {rule} AS rule, {grams_sql("host", "path")} AS g FROM (SELECT page_id, {host} AS host, {path} AS path FROM (SELECT page_id, coalesce(url, '') AS url FROM pages))),
sums AS (SELECT page_id, sum(w) AS s FROM (SELECT page_id, unnest(g) AS bucket FROM judged) JOIN w USING (bucket) GROUP BY page_id),
scored AS (SELECT page_id, host, path, rule, round(1 / (1 + exp(-(coalesce(s, 0) / sqrt(CAST(greatest(len(g), 1) AS DOUBLE)) + (SELECT sum(a) FROM alpha)))), 6) AS score FROM judged LEFT JOIN sums USING (page_id))
SELECT page_id, host, path, rule, {verdict} AS verdict, score FROM scored"""
