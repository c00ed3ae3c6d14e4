import math

from lodestar.llm import url_filter as U


def expected_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


def expected_rule(host, path, rules):
    fits = [r for _, r in rules if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


URLS = ["http://WWW.Example.com/en/x?q#f", "https://example.com/en/", "https://a.example.com/EN/1", "http://com/", "http://xcom/", "http://b.net/es/1", "http://net", "no scheme", "", None, "://", "http://ÄB.net/fr/#a", "ftp://h?x/y", "http://a.com#/b", "http://x.y/" + "p" * 50_000, "http://a\nb.com/\nq"]


def test_parts_rules_and_rows(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS + URLS[:2])], "page_id bigint, url string, host string, _g string")
    got = {r.page_id: r for r in U.judge_urls(pages).collect()}
    assert len(got) == len(URLS) + 2
    for i, u in enumerate(URLS):
        host, path = expected_parts(u)
        rule = expected_rule(host, path, U.RULES)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict in ("allow", "block") and 0 <= got[i].score <= 1
        if rule:
            assert got[i].verdict == {r: a for a, r in U.RULES}[rule]
    assert got[0].verdict == got[len(URLS)].verdict


def test_empty_table(spark):
    assert U.judge_urls(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def test_training_equals_plain_descent(spark):
    """The coefficients' descent against the same descent on the weights, in Python."""
    rows = [("http://win-casino.example/bonus", 1), ("http://library.example/catalog", 0), ("http://casino.example/win", 1), ("http://museum.example/maps", 0)]
    labelled = spark.createDataFrame(rows, "url string, label int")
    weights = U.train(labelled, buckets=256, epochs=50).first().weights  # buckets modulo 256
    host, path = U.host_and_path(labelled.url)
    data = [(set(r.g), r.label) for r in labelled.select(U.grams(host, path, 256).alias("g"), "label").collect()]
    x = [{k: 1 / math.sqrt(len(g)) for k in g} | {256: 1.0} for g, _ in data]
    w = [0.0] * 257
    for _ in range(50):
        p = [1 / (1 + math.exp(-sum(w[k] * v for k, v in row.items()))) for row in x]
        step = [0.0] * 257
        for row, pi, (_, y) in zip(x, p, data):
            for k, v in row.items():
                step[k] += v * (y - pi)
        w = [wi * (1 - U.RATE * U.L2) + U.RATE * s for wi, s in zip(w, step)]
    assert max(abs(a - b) for a, b in zip(w, weights)) < 1e-9


def test_held_out_urls_of_the_labelled_table(spark):
    """Leave out every fifth labelled url, train on the others, and judge those left out without rules."""
    rows = U.labelled_urls(spark).collect()
    train, held = [r for i, r in enumerate(rows) if i % 5], [r for i, r in enumerate(rows) if not i % 5]
    pages = spark.createDataFrame([(i, r.url) for i, r in enumerate(held)], "page_id bigint, url string")
    got = {r.page_id: r.verdict for r in U.judge_urls(pages, rules=(), labelled=spark.createDataFrame(train, "url string, label int")).collect()}
    right = sum((got[i] == "block") == bool(r.label) for i, r in enumerate(held))
    assert right >= 0.8 * len(held)
