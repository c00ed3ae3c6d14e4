import base64
import hashlib

import pytest

from pyspark.sql import functions as F

from lodestar.llm import warc as W

ROWS = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "http://a/4", ""), (5, "u\r\nWARC-Type: revisit", "é" * 50_000), (6, "http://a/6", "<p>y</p>"), (6, "http://a/6", "<p>y</p>"), (None, "http://n", "<p>x</p>"), (None, "http://m", "only")]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "?", "?") for r in rows], "page_id bigint, url string, html string, payload string, header string")


def expected(rows, at_least=0):
    out = []
    for i, _, t in rows:
        b = (t or "").encode()
        ids = [j for j, _, u in rows if (u or "").encode() == b and j is not None]
        holder = max(ids, default=None)
        revisit = len(b) >= at_least and i != holder
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", holder if revisit else None, True))
    return sorted(out, key=repr)


def test_round_trip(spark):
    assert sorted(map(tuple, W.archive_digest(pages(spark)).collect()), key=repr) == expected(ROWS)
    assert sorted(map(tuple, W.archive_digest(pages(spark), dedup_from_bytes=9).collect()), key=repr) == expected(ROWS, 9)


def test_payloads_are_stored_once_and_records_are_exact(spark, tmp_path):
    path = str(tmp_path / "archive")
    W.write_archive(pages(spark), path)
    assert spark.read.parquet(f"{path}/payloads").count() == len({t or "" for _, _, t in ROWS})
    records = {(r.page_id, bytes(r.record)) for r in W.read_records(spark, path).collect()}
    record = next(b for i, b in records if i == 2)
    head, block = record.split(b"\r\n\r\n", 1)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and block.endswith(b"<p>x</p>\r\n\r\n")
    parsed = {r.page_id: r for r in W.parse_records(W.read_records(spark, path)).where("page_id IS NOT NULL").collect()}
    assert parsed[1].record_type == "revisit" and parsed[1].refers_to == "<urn:page:2>" and b"<p>" not in bytes(parsed[1].block)
    assert parsed[5].record_type == "response" and parsed[5].content_length == len(parsed[5].block)
    assert bytes(parsed[5].block).split(b"\r\n\r\n", 1)[1].decode() == "é" * 50_000


def test_damaged_payload_is_seen(spark, tmp_path):
    path = str(tmp_path / "archive")
    W.write_archive(pages(spark), path)
    bad = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"z"))
    bad.write.parquet(str(tmp_path / "bad/payloads"))
    assert W.read_payloads(spark, str(tmp_path / "bad")).where("verified").count() == 0


def test_empty(spark):
    assert W.archive_digest(pages(spark, [])).count() == 0


def test_two_payloads_under_one_digest_stop_the_write(spark, tmp_path):
    path = str(tmp_path / "archive")
    with pytest.raises(ValueError, match="two payloads have the digest"):
        W.write_archive(pages(spark), path, strong_digest=lambda payload: F.lit("same"))
    assert not (tmp_path / "archive" / "records").exists()
    W.write_archive(pages(spark, [(1, "http://a", "x"), (2, "http://b", "x")]), path + "2", strong_digest=lambda payload: F.lit("same"))
    assert W.read_records(spark, path + "2").count() == 2


def test_rebuilt_records_give_the_digest_query(spark, tmp_path):
    """Every record is put together again and taken apart; payloads of revisits are those of the records they refer to."""
    path = str(tmp_path / "archive")
    rows = [r for r in ROWS if r[0] is not None and r != (6, "http://a/6", "<p>y</p>")] + [(9, "http://a/9", "\r\n\r\n"), (10, "http://a/10", "<p>x</p>")]
    W.write_archive(pages(spark, rows), path)
    parsed = {r.page_id: r for r in W.parse_records(W.read_records(spark, path)).collect()}
    assert set(parsed) == {i for i, _, _ in rows}
    for i, size, digest, kind, refers, _ in expected(rows):
        r = parsed[i]
        assert r.record_type == kind and r.refers_to == (f"<urn:page:{refers}>" if refers is not None else None) and r.digest == f"sha1:{digest}"
        payload = bytes(parsed[refers if refers is not None else i].block).split(b"\r\n\r\n", 1)[1]
        assert len(payload) == size and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest and len(r.block) == r.content_length
