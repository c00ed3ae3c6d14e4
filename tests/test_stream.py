import json

from lodestar import extract as E
from lodestar.sources import sinks
from lodestar.streaming import ledger_stream as R


def reply(*rows):
    return json.dumps({"transactions": [dict(zip(("일자", "가맹점", "금액", "분류"), r)) for r in rows]}, ensure_ascii=False)


def drop(path, name, card, filename, body):
    path.mkdir(exist_ok=True)
    (path / name).write_text(json.dumps({"card": card, "filename": filename, "json": body}, ensure_ascii=False) + "\n")


def test_stream_is_idempotent_and_isolates_failures(spark, tmp_path):
    inbox, root = tmp_path / "inbox", str(tmp_path / "root")
    drop(inbox, "1.json", "BC", "a_20260105.pdf", reply(("2026-01-05", "GS25", 1000, "식비"), ("2026-01-05", "후불무승인_1", 9, "기타")))
    drop(inbox, "2.json", "현대카드", "b_202601.html", reply(("2026-01-06", "m", 500, "쇼핑")))
    drop(inbox, "3.json", "BC", "bad_202601.html", '{"transactions":[5]}')
    R.start(spark, str(inbox), root).awaitTermination()
    assert {r.card: r.subtotal for r in spark.read.parquet(f"{root}/subtotals").collect()} == {"BC": 1000, "현대카드": 500}
    assert spark.read.parquet(f"{root}/totals").first().grand_total == 1000
    assert spark.read.parquet(f"{root}/failed").first().error == "not an object"
    assert [r.category for r in R.read_ledger(spark, f"{root}/ledger").where("card = 'BC'").collect()] == ["카페/간식"]
    drop(inbox, "4.json", "BC", "a_20260105.pdf", reply(("2026-01-05", "GS25", 1000, "식비"), ("2026-01-07", "x", 1, "기타")))
    R.start(spark, str(inbox), root).awaitTermination()
    assert R.read_ledger(spark, f"{root}/ledger").count() == 3
    last = spark.read.parquet(f"{root}/counts").orderBy("batch_id", ascending=False).first()
    assert (last.added, last.skipped) == (1, 1)


def test_process_from_text(spark, tmp_path):
    files = spark.createDataFrame([("BC", "s_202602.pdf", "2026-02-01\tshop\t1,200\t쇼핑\nnoise\n26.02.03|cafe|-300\n"), ("BC", "t_202602.pdf", None)], "card string, filename string, text string")
    counts = E.process(files, str(tmp_path / "root")).first()
    assert (counts.added, counts.skipped) == (2, 0)


def test_extractor_retries(spark):
    replies = iter(["nope", '{"transactions":"x"}', reply(("2026-01-01", "a", 1, "기타"))])
    assert "2026-01-01" in E.with_retry(lambda c, t: next(replies), "BC", "text")

    def broken(card, text):
        raise RuntimeError("down")

    files = spark.createDataFrame([("BC", "a.pdf", "x")], "card string, filename string, text string")
    assert E.extract(files, broken).first().error == "down"


def test_month_overwrite_leaves_other_months(spark, tmp_path):
    path = str(tmp_path / "p")
    make = lambda *v: spark.createDataFrame(list(v), "v int, month_tab string")
    sinks.append_ledger(make((1, "202601"), (2, "202602")), path)
    sinks.overwrite_months(make((9, "202602")), path)
    assert sorted((r.v, str(r.month_tab)) for r in spark.read.parquet(path).collect()) == [(1, "202601"), (9, "202602")]


def state(spark, root):
    """Ledger, totals, subtotals, counts and failures, as sets of rows with how often each occurs."""
    from collections import Counter

    out = {}
    for name in ("ledger", "totals", "subtotals", "counts", "failed"):
        df = spark.read.parquet(f"{root}/{name}")
        out[name] = Counter(tuple(str(v) for v in r) for r in df.select(*sorted(df.columns)).collect())
    return out


def test_a_batch_that_fails_after_any_write_is_replayed(spark, tmp_path, monkeypatch):
    """Whatever was written before the failure, the replay ends as an undisturbed run does."""
    first = [("BC", "a_20260105.pdf", reply(("2026-01-05", "GS25", 1000, "식비"), ("2026-02-01", "x", 2, "기타")))]
    second = [("BC", "a_20260105.pdf", reply(("2026-01-05", "GS25", 1000, "식비"), ("2026-01-07", "y", 3, "기타"))), ("현대카드", "b_202602.html", reply(("2026-02-06", "m", 500, "쇼핑"))), ("BC", "c_202601.html", '{"transactions":[5]}')]
    frame = lambda rows: spark.createDataFrame(rows, R.REPLY)
    writers = ("append_ledger", "overwrite_months", "dead_letters", "overwrite_parts")
    real = {w: getattr(R, w) for w in writers}

    def run(root, broken=None):
        R.update(frame(first), root, 0)
        done = [0]

        def wrapped(write):
            def call(*args, **how):
                write(*args, **how)
                done[0] += 1
                if done[0] == broken:
                    raise RuntimeError("lost")

            return call

        if broken:
            for w in writers:
                monkeypatch.setattr(R, w, wrapped(real[w]))
            try:
                R.update(frame(second), root, 1)
                raise AssertionError("did not fail")
            except RuntimeError:
                pass
            for w in writers:
                monkeypatch.setattr(R, w, real[w])
        R.update(frame(second), root, 1)
        return state(spark, root)

    expected = run(str(tmp_path / "undisturbed"))
    assert len(expected["failed"]) == 1 and sum(expected["ledger"].values()) == 4
    for n in range(1, 6):
        assert run(str(tmp_path / f"broken{n}"), n) == expected
    R.update(frame(second), str(tmp_path / "undisturbed"), 2)
    again = state(spark, str(tmp_path / "undisturbed"))
    assert again["ledger"] == expected["ledger"] and again["totals"] == expected["totals"]
