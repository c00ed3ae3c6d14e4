import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestar.llm import components, simhash as S


def plain_fingerprint(text, n=4):
    """Word for word from the definition, without numpy."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found, word = [], ""
    for c in lower + " ":
        if c == " " or "\t" <= c <= "\r":
            if word:
                found.append(word)
            word = ""
        else:
            word += c
    if not found:
        return 0
    shingles = [" ".join(found[i : i + n]) for i in range(max(1, len(found) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, distance=4):
    fp = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, f"{fp[i]:016x}", least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=repr)


def test_documents(documents, texts):
    assert sorted(map(tuple, S.near_groups(documents).collect()), key=repr) == brute(list(texts.items()))


def test_awkward(awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert sorted(map(tuple, S.near_groups(awkward).collect()), key=repr) == brute(rows)
    assert S.near_groups(empty).count() == 0 and S.near_dedup(empty).count() == 0
    assert S.near_dedup(awkward).columns == awkward.columns


def test_long_text_in_slices():
    text = " ".join(f"w{i % 977}" for i in range(140_000))
    assert S.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("groups", [5, 6, 7, 8])
@pytest.mark.parametrize("distance", [4])
def test_links_equal_all_pairs(spark, groups, distance):
    """Clusters of fingerprints around random centres, zero and all ones included."""
    rng = np.random.default_rng(groups)
    centres = [0, 2**64 - 1, *rng.integers(0, 2**63, 12).tolist()]
    values = set()
    for c in centres:
        for _ in range(25):
            values.add(c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)))
    values = sorted(values)
    classes = spark.createDataFrame([(S.signed(v), i) for i, v in enumerate(values)], "fp bigint, rep bigint")
    got = [tuple(sorted(r)) for r in S.links(classes, distance=distance, groups=groups).collect()]
    expected = {(i, j) for j, y in enumerate(values) for i, x in enumerate(values[:j]) if bin(x ^ y).count("1") <= distance}
    assert set(got) == expected and len(got) == len(expected)


def test_unary_counts_bound_the_distance(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(-(2**63), 2**63 - 1, 400)
    t = [r[1] for r in spark.createDataFrame([(i, int(x)) for i, x in enumerate(v)], "i int, fp bigint").select("i", S.unary_popcounts(F.col("fp"))).orderBy("i").collect()]
    for i in range(0, 399):
        counts = [[bin((int(x) & (2**64 - 1)) >> (2 * s) & 3).count("1") for s in range(32)] for x in v[i : i + 2]]
        manhattan = sum(abs(a - b) for a, b in zip(*counts))
        assert bin((t[i] ^ t[i + 1]) & (2**64 - 1)).count("1") == manhattan <= bin((int(v[i]) ^ int(v[i + 1])) & (2**64 - 1)).count("1")


def test_components(spark, rng):
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(1900, 2100)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: find(i) for i in root if find(i) != i}
