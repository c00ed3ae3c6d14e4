import re

import pytest

from lodestar.llm import decontaminate as D


def tokens(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c.isalnum():
            word += c.lower() if len(c.lower()) == 1 else c
        elif word:
            out.append(word)
            word = ""
    return out


def overlaps(doc, item, window=D.WINDOW, similarity=D.SIMILARITY):
    """Every alignment, every window."""
    d, q = tokens(doc), tokens(item)
    if len(q) < D.MIN_WORDS:
        return False
    w = min(window, len(q))
    for shift in range(-len(q) + 1, len(d)):
        same = [0 <= shift + i < len(d) and d[shift + i] == q[i] for i in range(len(q))]
        if any(sum(same[i : i + w]) >= similarity * w - 1e-9 for i in range(len(q) - w + 1)):
            return True
    return False


WORDS = [f"w{i}" for i in range(400)]


def corpus(rng):
    """Items, and documents with whole, cut, substituted and no passages of them."""
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(9, 50)))) for i in range(12)] + [(90, "too short an item"), (91, None), (92, "")]
    docs = []
    for n in range(120):
        filler = lambda k: [rng.choice(WORDS) for _ in range(k)]
        body, kind = filler(rng.randint(0, 60)), n % 4
        if kind:
            part = items[n % 12][1].split()
            if kind == 2:
                part = part[: max(8, len(part) // 2)]
            if kind == 3:
                part = [x if rng.random() > 0.12 else "subst" for x in part]
            body += part + filler(rng.randint(0, 30))
        docs.append((n, ", ".join(body).upper() if n % 5 == 0 else " ".join(body)))
    return docs, items


@pytest.mark.parametrize("block_chars", [D.BLOCK_CHARS, 400])
def test_planted_passages(spark, rng, block_chars):
    """Never a wrong overlap; all at up to a tenth of words substituted, and nearly all beyond."""
    docs, items = corpus(rng)
    truth = {i: sorted(k for k, t in items if overlaps(text, t)) for i, text in docs}
    got = D.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), block_chars=block_chars)
    found = {r.doc_id: r.item_ids for r in got.collect()}
    assert all(set(found[i]) <= set(truth[i]) for i in truth)
    missed = [i for i in truth if set(truth[i]) - set(found[i])]
    assert len(missed) <= 1 and not [i for i in missed if i % 4 in (1, 2)]
    kept = {r.doc_id for r in D.decontaminate(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), block_chars=block_chars).collect()}
    assert kept == {i for i in found if not found[i]}


def test_whole_items_in_documents(spark, sf, documents, texts):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    items = {r.item_id: plain(r.text) for r in benchmark.collect()}
    found = {r.doc_id: set(r.item_ids) for r in D.contaminated(documents, benchmark).collect()}
    for i, t in texts.items():
        whole = {k for k, v in items.items() if v in plain(t)}
        assert whole <= found[i]
    assert any(found.values()) and not all(found.values())


def test_awkward(spark, awkward, empty):
    items = spark.createDataFrame([("a", "one two three four five six seven eight nine ten"), ("b", None), ("c", "word " * 30)], "item_id string, text string")
    got = {r.doc_id: r.item_ids for r in D.contaminated(awkward, items).collect()}
    assert got[8] == ["a"] and got[9] == ["a"] and got[12] == ["c"] and got[5] == [] and got[None] == [] and len(got) == 14
    kept = D.decontaminate(awkward, items)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 3
    assert D.contaminated(empty, items).count() == 0
    assert D.decontaminate(awkward, items.limit(0)).count() == awkward.count()
    assert not D.contaminated(awkward, items.limit(0)).where("contaminated").count()


def test_short_items(spark):
    items = spark.createDataFrame([(1, "Paris in the spring"), (2, "Yes"), (3, "two words"), (4, "one two three four five six seven")], "item_id bigint, text string")
    docs = [(1, "we saw paris, in the SPRING again"), (2, "paris in the winter spring"), (3, "yes"), (4, "yes it is"), (5, "Two words!"), (6, "two words more"), (7, "x one two three four five six seven"), (8, "one two three four five six eight"), (9, None)]
    got = {r.doc_id: r.item_ids for r in D.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), items).collect()}
    assert got == {1: [1], 2: [], 3: [2], 4: [], 5: [3], 6: [], 7: [4], 8: [], 9: []}


@pytest.mark.parametrize("most, cells", [(1, 1), (20, 64), (D.MOST_HITS, D.CELLS)])
def test_repetitive_texts_in_slices(rng, monkeypatch, most, cells):
    """Few distinct words, so seeds meet in very many places; small limits give the same overlaps."""
    monkeypatch.setattr(D, "MOST_HITS", most)
    monkeypatch.setattr(D, "CELLS", cells)
    few = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items, docs = [few(rng.randint(4, 40)) for _ in range(6)] + ["a " * 30], [few(rng.randint(0, 60)) for _ in range(25)] + ["a " * 50]
    text, item, begin, equal = D.Block(list(range(len(items))), items).search(docs)
    found = dict(zip(zip(text.tolist(), item.tolist()), equal.tolist()))
    for t, doc in enumerate(docs):
        for i, q in enumerate(items):
            if len(tokens(q)) >= D.MIN_WORDS:
                assert not ((t, i) in found and not overlaps(doc, q))
                if f" {q.strip()} " in f" {doc} ":
                    assert found[t, i] == min(20, len(tokens(q)))
    assert found[25, 6] == 20


def test_one_word_repeated():
    """6,000 times 6,000 places end at once, in memory that does not grow with their product."""
    import tracemalloc

    block = D.Block([1], ["word " * 6000])
    tracemalloc.start()
    got = block.search(["word " * 6000, "word " * 100_000])
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    assert got[0].tolist() == [0, 1] and got[3].tolist() == [20, 20]
