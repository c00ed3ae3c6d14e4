"""The pipeline's near-dedup stage against all pairs of shingle sets."""

import corpus_pipeline
from lodestar.llm import jaccard as J
from lodestar.llm import simhash as S


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    """Ids that stay: the smallest of each component of the pairs with a Jaccard similarity of 0.8 or more."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 5 * len(x & y) >= 4 * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(least.values())


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())


def test_stage_on_documents(spark, sf, documents, texts):
    got = corpus_pipeline.drop_near_copies(spark, documents, sf)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == brute(list(texts.items()))
    assert got.columns == documents.columns


def test_altered_copies_chains_and_common_lines(spark, rng):
    """Copies with 1 to 12 words changed, copies of copies, one line that all texts share, case and blanks, short texts."""
    word = lambda: f"w{rng.randint(0, 5000)}"
    line = [word() for _ in range(12)]
    texts = ["", "Word", "word", "a b c d e f", "A  b\nc d e f"]
    for length in (30, 60, 120, 400):
        for _ in range(6):
            at = line + [word() for _ in range(length)]
            for _ in range(8):
                texts.append(" ".join(at))
                if rng.random() < 0.5:  # from the last copy, else from the first
                    at = list(at)
                for _ in range(rng.randint(1, 1 + length // 40)):
                    at[rng.randrange(len(at))] = word()
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    expected = brute(rows)
    assert kept(spark, rows) == expected and len(expected) < len(rows) - 50


def test_sets_and_prefixes():
    text = " ".join(f"w{i % 977}" for i in range(3000))
    assert len(J.shingle_set(text)) == len(shingles(text)) and len(J.shingle_set(None)) == len(J.shingle_set("a b")) == 1
    hashes = J.shingle_set(text)
    for n in (1, 2, 5, 6, 9, 10, 11):
        assert len(J.prefix(hashes[:n], hashes[:0])[0]) == n - -(-4 * n // 5) + 1
    assert not set(J.prefix(hashes[:50], hashes[:20])[0].tolist()) & set(hashes[:20].tolist())


def test_sketches_never_differ_more_than_the_sets(spark, rng):
    """Sets of 1 to 3,000 shingles, from equal to disjoint: the bound holds, no pair of similarity 0.8 or more is ruled out, and of pairs about 0.7 hardly any is let through."""
    rows, known = [], []
    for n in (1, 5, 30, 146, 400, 1100, 3000):
        for part in (0, 0.05, 0.11, 0.2, 0.5, 1):
            for _ in range(4):
                x = [rng.getrandbits(64) for _ in range(n)]
                y = x[round(n * part) :] + [rng.getrandbits(64) for _ in range(round(n * part))]
                rows.append((len(rows), *({"n": n, **dict(zip(J.PARTS, J.sketch(J.np.array(v, "u8"))))} for v in (x, y))))
                known.append((n, len(set(x) & set(y)), len(set(x) | set(y))))
    fields = "n bigint, " + ", ".join(f"{c} bigint" for c in J.PARTS)
    df = spark.createDataFrame(rows, f"i int, x struct<{fields}>, y struct<{fields}>")
    let = {r.i for r in df.where(J.sketched("x", "y")).collect()}
    for (i, x, y), (n, common, union) in zip(rows, known):
        apart = sum(bin((x[c] ^ y[c]) & (2**64 - 1)).count("1") for c in J.PARTS)
        assert apart <= union - common
        assert 5 * common < 4 * union or i in let
        assert not (30 <= n <= 400 and 3 * common < 2 * union + 1) or i not in let


def test_fine_sketches_tell_of_large_sets_and_sizes_apart(spark, rng):
    """Also above 9 / 4 SKETCH shingles: pairs of 0.8 or more are let through, those about 0.7 or of other sizes are not; sizes lie on both sides of a power of two."""
    rows, known = [], []
    for n, m in ((1, 1), (250, 260), (300, 250), (1100, 1000), (2800, 2800), (4200, 4000), (9000, 1000)):
        for part in (0, 0.04, 0.1, 0.2, 1):
            x = [rng.getrandbits(64) for _ in range(n)]
            y = (x[round(n * part) :] + [rng.getrandbits(64) for _ in range(n)])[:m]
            rows.append((len(rows), *({"n": len(v), "fine": J.fine_sketch(J.np.array(v, "u8")).tolist()} for v in (x, y))))
            known.append((n, len(set(x) & set(y)), len(set(x) | set(y))))
    df = spark.createDataFrame(rows, "i int, x struct<n:bigint,fine:array<bigint>>, y struct<n:bigint,fine:array<bigint>>")
    let = {r.i for r in df.where(J.finely_sketched("x", "y")).collect()}
    for (i, *_), (n, common, union) in zip(rows, known):
        assert 5 * common < 4 * union or i in let
        assert n < 30 or 3 * common >= 2 * union + 1 or i not in let


def test_cells_are_thin_and_those_of_one_set_alone_go(spark, rng):
    """What is shuffled of cells is (cell, key, n, pos); frequent words come last in a prefix, so texts that share just these share no cell."""
    filler = [f"f{i}" for i in range(4)]
    rows = [(i, " ".join([*(f"u{i}-{j}" for j in range(40)), *(rng.choice(filler) for _ in range(60))])) for i in range(30)]
    rows += [(100, rows[0][1] + " end"), (101, rows[0][1] + " END")]
    marked = J.prefixes(spark.createDataFrame(rows, "doc_id bigint, text string"), S.majority)
    keys = {r.doc_id: r.key for r in marked.collect()}
    shared, *_ = J.shared_cells(marked)
    got = [tuple(r) for r in shared.collect()]
    assert shared.columns == ["cell", "key", "n", "pos"] and len(got) == len(set(got)) > 0
    assert {k for _, k, _, _ in got} == {keys[0], keys[100]} and keys[100] == keys[101]


def test_a_group_about_the_bound_makes_few_pairs(spark, rng, monkeypatch):
    """Copies of a template that share lines but are too different: they meet in cells, and their pairs are not made."""
    made, verified = [], J.verified
    monkeypatch.setattr(J, "verified", lambda pairs, *a: made.append(pairs.count()) or verified(pairs, *a))
    template = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        at = list(template)
        for j in rng.sample(range(150), 3):
            at[j] = f"x{i}-{j}"
        rows.append((i, " ".join(at)))
    assert kept(spark, rows) == brute(rows) and sum(made) < 300


def test_awkward(awkward, empty, spark):
    got = sorted((r.doc_id for r in S.similar_dedup(awkward).where("doc_id IS NOT NULL").select("doc_id").distinct().collect()))
    assert got == brute([(r.doc_id, r.text) for r in awkward.collect()])
    assert S.similar_dedup(awkward).columns == awkward.columns and S.similar_dedup(empty).count() == 0
