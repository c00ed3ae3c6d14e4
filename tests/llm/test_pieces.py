import hashlib
import zlib

import numpy as np
import pytest

from lodestar.llm import pieces as P


@pytest.fixture(scope="module")
def own():
    return P.vocabulary(P.default_vocabulary())


def digest(own, t):
    ids = own.library.encode(t or "")
    return len(ids), zlib.crc32(np.array(ids, "<i4").tobytes()), hashlib.sha256((t or "").encode()).hexdigest(), len((t or "").encode())


def test_documents(documents, texts, own):
    """Small thresholds send most documents through the scan."""
    expected = {i: digest(own, t) for i, t in texts.items()}
    for how in ({}, {"giant_chars": 300, "chunk_chars": 200, "search": 32}):
        got = {r.doc_id: (r.n_tokens, r.ids_crc32, r.text_sha256, r.text_bytes) for r in P.round_trip(documents, **how).collect()}
        assert got == expected


def test_awkward(awkward, empty, own):
    rows = sorted(((r.doc_id, *digest(own, r.text)) for r in awkward.collect()), key=repr)
    assert sorted(map(tuple, P.round_trip(awkward).collect()), key=repr) == rows
    assert P.round_trip(empty).count() == 0


def test_decode(spark, documents, texts):
    got = {r.doc_id: r.text for r in P.decode(P.encode(documents)).collect()}
    assert got == {i: t or "" for i, t in texts.items()}


def scan(own, text, size, search):
    text = " " + text if text else ""
    at = own.cuts(text, size, search)
    wide = own.longest
    parts = [(text[max(0, a - wide) : a], text[a:b], text[b : b + wide]) for a, b in zip(at[:-1], at[1:])]
    matrices, most = [], 0
    for left, body, right in parts:
        entries = own.states(left, body)
        most = max(most, len(entries))
        matrices.append({(a, b): got[0] for a in entries for b in own.states(left + body, right) if (got := own.trace(left, body, right, a, b)) is not None})
    path, ids = P.states_between(matrices, (0, 0), (0, 0)), []
    for part, a, b in zip(parts, path[:-1], path[1:]):
        ids += own.trace(*part, a, b)[1]
    return ids, most, matrices


def test_scan_without_safe_boundaries(own, rng):
    """Cuts in the middle of words, of blanks and of repeated characters, with many states at a boundary."""
    most = 0
    for _ in range(300):
        letters = rng.choice(["abcdefgh ", "ent her in", "ab", "  a=", "éß日本😀 a", "aaaa    ====", "theationerin "])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 160)))
        ids, states, _ = scan(own, text, rng.choice([20, 30, 40]), rng.choice([1, 1, 4]))
        most = max(most, states)
        assert ids == own.library.encode(text), text
    assert most > 10


def test_product_is_associative(own):
    _, _, m = scan(own, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 2, 20, 1)
    left = P.product(P.product(m[0], m[1]), m[2])
    right = P.product(m[0], P.product(m[1], m[2]))
    assert left == pytest.approx(right) and left


def test_unsafe_giant_document(spark, own):
    """One long run of one character, and one of blanks: no boundary is safe."""
    rows = [(1, "a" * 900), (2, " " * 700 + "b"), (2, "a" * 900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in P.round_trip(df, giant_chars=100, chunk_chars=60, search=1).collect())
    assert got == sorted((i, *digest(own, t)[:2]) for i, t in rows)
