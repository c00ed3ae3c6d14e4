import hashlib

import pytest
from pyspark.sql import functions as F

from lodestar.llm import exact_dedup as E


def brute(rows, pick):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = pick([x for x in ids if x is not None], default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep, pick", [("smallest", min), ("largest", max)])
def test_awkward_rows(awkward, keep, pick):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = sorted((tuple(r) for r in E.exact_groups(awkward, keep=keep).collect()), key=repr)
    assert got == brute(rows, pick)


def test_collisions_are_told_apart_by_bytes(documents):
    """A hash of eight values gives the same groups as one of 128 bits."""
    weak = E.exact_groups(documents, content_hash=lambda t: F.pmod(F.length(t), F.lit(8)))
    assert sorted(map(tuple, weak.collect())) == sorted(map(tuple, E.exact_groups(documents).collect()))


def test_dedup_keeps_columns(documents, awkward, empty):
    kept = E.exact_dedup(documents)
    assert kept.columns == documents.columns and kept.count() == documents.select("text").distinct().count()
    assert E.exact_dedup(awkward).columns == awkward.columns
    assert E.exact_groups(empty).count() == 0 and E.exact_dedup(empty).count() == 0
