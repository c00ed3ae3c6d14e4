"""Language ID, quality and toxicity: held-out accuracy and defined results."""

import zlib

import pytest
from pyspark.sql import functions as F

from lodestar.llm import language_id as L
from lodestar.llm import quality as Q
from lodestar.llm import toxicity as T

BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def big(spark):
    return spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")


def test_language_of_held_out_rows(big):
    docs, _ = big
    got = L.identify(docs)
    assert got.count() == docs.count() and [c for c, _ in got.dtypes] == ["doc_id", "held_out", "lang_pred", "score"]
    held = got.where("held_out").join(docs, "doc_id").select("doc_id", "lang", "lang_pred", "score").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in held)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)


def test_language_of_awkward_rows(big, awkward, empty):
    model = L.train(big[0])
    got = {r.doc_id: r.lang_pred for r in L.predict(awkward.where("doc_id IS NOT NULL"), model).collect()}
    assert {i for i, x in got.items() if x == "und"} == {1, 2, 3, 7} and len(got) == 13
    assert L.predict(empty, model).count() == 0
    assert {r.lang_pred for r in L.identify(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert L.identify(empty).count() == 0


def test_language_scores_equal_a_plain_sum(big):
    langs, logp = L.train(big[0])
    text = "Der die und das ist nicht"
    grams, bounds, _ = L.gram_buckets([text])
    sums = [sum(float(logp[g, j]) for g in grams[bounds[0] : bounds[1]]) for j in range(len(langs))]
    assert L.scored([text], langs, logp)[0] == [langs[sums.index(max(sums))]]
    both, _ = L.scored([text, None, text], langs, logp)
    assert both[0] == both[2] and both[1] == "und"


def plain_language_sums(text, langs, logp):
    """Naive Bayes character by character: letters in lower case, every run of others one blank behind a letter, and 1-, 2- and 3-grams that see blanks after the end."""
    seen, out = [], [0.0] * len(langs)
    for c in text:
        if c.isalpha():
            seen.append(c.lower() if ord(c) < 65536 and len(c.lower()) == 1 else c)
        elif seen and seen[-1] != " ":
            seen.append(" ")
    if seen and seen[-1] != " ":
        seen.append(" ")
    for i in range(len(seen)):
        h = 0
        for k in range(3):
            h = (h * 0x01000193 + ord(seen[i + k] if i + k < len(seen) else " ") * 0x9E3779B1) % 2**32
            bucket = ((h ^ (h >> 15)) * 0x85EBCA77 % 2**32) >> 16
            for j in range(len(langs)):
                out[j] += float(logp[bucket, j])
    return out


@pytest.mark.parametrize("rows", [1, 7, 10_000])
def test_language_of_a_text_is_its_own(big, rows):
    """The same label and score whatever shares the batch, and those of a plain naive Bayes."""
    import math

    langs, logp = L.train(big[0])
    texts = [t[a : a + n] for r in big[0].limit(300).collect() for t in [r.text or ""] for a, n in ((0, 2), (1, 6), (5, 40))] + ["ab", "xyz", "qqq", "a", "", None, "12 3", "ß é", "😀𝐀a", "a  b", " a"]
    names, scores = [], []
    for i in range(0, len(texts), rows):
        got = L.scored(texts[i : i + rows], langs, logp)
        names += got[0]
        scores += got[1].tolist()
    for t, name, score in zip(texts, names, scores):
        if not any(c.isalpha() for c in t or ""):
            assert (name, score) == ("und", 0)
            continue
        sums = plain_language_sums(t, langs, logp)
        assert name == langs[sums.index(max(sums))]
        assert score == pytest.approx(1 / sum(math.exp(x - max(sums)) for x in sums), rel=1e-6)
    alone = [L.scored([t], langs, logp) for t in texts]
    assert names == [a[0][0] for a in alone] and scores == [float(a[1][0]) for a in alone]


def test_language_filter_rejects_what_it_cannot_tell(spark, big, awkward, empty):
    docs, _ = big
    noise = spark.createDataFrame([(10**9, "..."), (10**9 + 1, None), (10**9 + 2, "x"), (10**9 + 3, "the and of the with that was")], "doc_id bigint, text string")
    both = docs.select("doc_id", "text", "lang").unionByName(noise, allowMissingColumns=True)
    model = L.train(both.where(L.crc_mod(F.col("doc_id"), 5) != 0))
    told = {r.doc_id for r in L.predict(both, model).where((F.col("lang_pred") != "und") & (F.col("score") >= L.TOLD)).collect()}
    kept = {r.doc_id for r in L.accepted(both).collect()}
    assert kept == told and 10**9 + 3 in kept and not {10**9, 10**9 + 1} & kept
    unlabelled = L.accepted(awkward.withColumn("lang", F.lit(None).cast("string")))
    assert {r.doc_id for r in unlabelled.collect()} == {4, 5, None, 6, 8, 9, 10, 11, 12, 13} and unlabelled.columns == awkward.columns
    assert L.accepted(empty).count() == 0


def test_filter_keeps_rows_and_columns(big):
    docs, _ = big
    kept = L.accepted(docs)
    assert kept.columns == docs.columns and kept.count() == docs.where(F.rlike("text", F.lit(r"\p{L}"))).count()


def auc(rows):
    rows = sorted(rows)
    pos = sum(y for _, y in rows)
    return (sum(i for i, (_, y) in enumerate(rows) if y) - pos * (pos - 1) / 2) / (pos * (len(rows) - pos))


@pytest.fixture(scope="module")
def bigger(spark):
    """A tenth of the labels are toxic; about one label in twenty is wrong, in either direction, so no score reaches an AUC of 1 (see the README)."""
    return tuple(spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))


@pytest.mark.parametrize("judge, label, mod, rest, least, size", [(Q.judge_quality, "quality", 5, 0, 0.97, "big"), (T.judge_toxicity, "toxic", 3, 1, 0.89, "bigger")])
def test_held_out_labels(request, judge, label, mod, rest, least, size):
    docs, labels = request.getfixturevalue(size)
    got = judge(docs, labels)
    assert got.count() == docs.count()
    rows = got.where("held_out").join(labels, "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % mod == rest and 0 <= r.score <= 1 for r in rows)
    assert auc([(r.score, r[label]) for r in rows]) >= least


@pytest.mark.parametrize("judge, label", [(Q.judge_quality, "quality"), (T.judge_toxicity, "toxic")])
def test_awkward_tables(spark, big, awkward, empty, judge, label):
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "x"), (3, None, "x"), (4, 0, "x"), (None, 1, "x"), (8, 1, "x")], f"doc_id bigint, {label} int, text string")
    assert judge(awkward, labels).count() == awkward.count()
    assert judge(awkward, labels.limit(0)).count() == awkward.count()
    assert judge(empty, labels).count() == 0


def test_kernel_equals_enumeration():
    """The dynamic programme against all pairs of subsequences."""
    from itertools import combinations

    def brute(a, b):
        total = 0.0
        for i in combinations(range(len(a)), T.ORDER):
            for j in combinations(range(len(b)), T.ORDER):
                if all(a[x] == b[y] for x, y in zip(i, j)):
                    total += T.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
        return total

    for a in ("idiot", "idxiot", "toidi", "iidiiott", "zzz", "日本語日本"):
        for b in ("idiot", "dio", "日本語"):
            assert T.subsequence_kernel(T.as_codes([a]), b)[0] == pytest.approx(brute(a, b), rel=1e-4, abs=1e-6)
        assert T.own_kernel(T.as_codes([a]))[0] == pytest.approx(brute(a, a), rel=1e-4, abs=1e-6)


def test_toxic_texts_of_every_language(bigger):
    """At the threshold, of held-out rows: recall in each language, and few texts labelled as clean."""
    docs, labels = bigger
    rows = T.judge_toxicity(docs, labels).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    for lang in ("en", "fr", "de", "es"):
        toxic = [r.predicted for r in rows if r.lang == lang and r.toxic == 1]
        assert sum(toxic) >= 0.85 * len(toxic) and len(toxic) > 10
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert sum(clean) <= 0.01 * len(clean)


def plain_kernel(a, b):
    """All pairs of equal subsequences, one by one."""
    from itertools import combinations

    total = 0.0
    for i in combinations(range(len(a)), T.ORDER):
        for j in combinations(range(len(b)), T.ORDER):
            if all(a[x] == b[y] for x, y in zip(i, j)):
                total += T.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def plain_score(text, model):
    """A text's score from the definition: tokens, their pieces, kernel values, largest and mean, margin, curve."""
    import math

    found, singles, tokens = (text or "").lower().split(), "", []
    for w in [*found, "end"]:
        singles = singles + w if len(w) == 1 else (tokens.append(singles) if len(singles) >= T.ORDER else None) or ""
    tokens += found

    def value(token, landmark):
        while token and not token[0].isalnum():
            token = token[1:]
        while token and not token[-1].isalnum():
            token = token[:-1]
        assert len(token) <= T.WINDOW
        best = 0.0
        for piece in [token] + [token[:k] for k in range(4, T.PART + 1) if k < len(token)]:
            if len(piece) >= T.ORDER and len(set(piece) & set(landmark)) >= min(T.ORDER, len(set(landmark))):
                v = min(1.0, plain_kernel(piece, landmark) / math.sqrt(plain_kernel(piece, piece) * plain_kernel(landmark, landmark)))
                best = max(best, math.exp((v - 1) / T.WIDTH))
        return round(best * 255) / 255

    m, margin = len(model.landmarks), model.bias
    for j, landmark in enumerate(model.landmarks):
        values = [value(t, landmark) for t in tokens]
        if values:
            margin += float(model.weight[j]) * max(values) + float(model.weight[m + j]) * T.MEAN_SCALE * sum(values) / len(values)
    return 1 / (1 + math.exp(-max(-60, min(60, model.curve[0] * margin + model.curve[1]))))


def test_toxicity_scores_equal_the_definition(rng):
    words = ["the", "house", "tree", "water", "green", "seven", "walk", "light"]
    insults = ["idiot", "stupido", "achlichung", "achlichten"]
    texts = [" ".join([rng.choice(words) for _ in range(6)] + ([insults[i // 2 % 4]] if i % 2 else [])) for i in range(160)]
    model = T.fit(texts, T.np.array([i % 2 for i in range(160)]))
    asked = ["the house", "you idiot", "an id-iot, really!", "i d i o t here", "achlichung achlichung tree", "", None, "(Stupido) water?", "achlich und so"]
    got = model.scores(asked)
    assert [float(x) for x in got] == pytest.approx([plain_score(t, model) for t in asked], abs=5e-3)
    assert min(got[1:5]) >= 0.7 and max(got[0], got[5], got[6]) < 0.3 and got[5] == got[6]


def test_toxicity_of_few_or_alike_labels():
    """Nothing to tell apart gives score 0; toxic landmarks alone, without ordinary ones, still learn disguises."""
    none = T.fit(["a b", "c d"], T.np.array([1, 0]))
    assert none.scores(["a b", None]).tolist() == pytest.approx([0, 0], abs=1e-12)
    assert T.fit(["idiot"] * 9, T.np.array([1] * 9)).scores(["idiot"])[0] < 1e-12
    texts = ["idiot one"] * 20 + [f"x{i} y" for i in range(20)]
    model = T.fit(texts, T.np.array([1] * 20 + [0] * 20))
    assert model.scores(["idi-otic"])[0] > model.scores(["nothing"])[0]


def plain_quality(text, weight, bias):
    """A text's score from the definition of its features, character by character."""
    import math

    m32, m64, buckets, words = 2**32, 2**64, [], []
    mark = lambda c: 32 if ord(c) <= 32 else ord(c)

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % m64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % m64
        return x ^ (x >> 31)

    for i, c in enumerate(text):
        if ord(c) > 32:
            h = mark(c) * 0x9E3779B1 % m32
            for k in range(1, 4):
                h = (h * 0x01000193 + (mark(text[i + k]) if i + k < len(text) else 32) * 0x9E3779B1) % m32
                buckets.append(((h ^ (h >> 15)) * (0x85EBCA77 + 2 * k) % m32) >> (32 - Q.BITS))
            if i == 0 or ord(text[i - 1]) <= 32:
                words.append([])
            words[-1].append(c)
    whole = [mix(sum(mix(ord(c) + (k << 32)) for k, c in enumerate(w)) % m64) for w in words]
    buckets += [w >> (64 - Q.BITS) for w in whole]
    buckets += [mix(((a ^ b) + 7) % m64) >> (64 - Q.BITS) for a, b in zip(whole, whole[1:])]
    return 1 / (1 + math.exp(-(sum(float(weight[b]) for b in buckets) / max(1, len(buckets)) + bias)))


def test_quality_scores_equal_the_definition(big):
    docs, labels = big
    weight, bias = Q.train(Q.labelled_sample(docs, labels, "quality", "doc_id", "text", 5, 0, Q.TRAIN_ROWS, Q.TRAIN_CHARS))
    texts = [r.text for r in docs.limit(40).collect()] + ["", None, "a", " a  b\tb\n", "é😀 x"]
    assert Q.scores(texts, weight, bias).tolist() == pytest.approx([plain_quality(t or "", weight, bias) for t in texts], rel=1e-5)
    alone = [Q.scores([t], weight, bias)[0] for t in texts]
    assert Q.scores(texts, weight, bias).tolist() == pytest.approx(alone, rel=1e-12)


def test_quality_sample_is_bounded_by_bytes(big, spark):
    docs, labels = big
    sample = Q.labelled_sample(docs, labels, "quality", "doc_id", "text", 5, 0, Q.TRAIN_ROWS, Q.TRAIN_CHARS)
    many = labels.unionByName(labels).unionByName(labels)
    again = Q.labelled_sample(docs.unionByName(docs), many, "quality", "doc_id", "text", 5, 0, Q.TRAIN_ROWS, Q.TRAIN_CHARS)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, sample.collect()))
    seen = []
    real = Q.descend
    try:
        Q.descend = lambda rows, **how: seen.append(sum(8 * len(b) for _, b, _ in rows)) or real(rows[:2], epochs=1)
        Q.train(sample)
        Q.train(sample, train_bytes=seen[0] // 10)
    finally:
        Q.descend = real
    assert 0 < seen[1] < seen[0] / 5


def test_defined_scores(spark, big, awkward):
    """Repeated rows, null and empty texts; without labels of both classes 0.5 (quality) and 0 (toxicity)."""
    docs, labels = big
    both = docs.select("doc_id", "text").unionByName(awkward.select("doc_id", "text").where("doc_id < 6").withColumn("doc_id", F.col("doc_id") + 10**9))
    for judge, label, without in ((Q.judge_quality, "quality", 0.5), (T.judge_toxicity, "toxic", 0.0)):
        got = {}
        for r in judge(both, labels).where("doc_id > 1000000000").collect():
            got.setdefault(r.doc_id - 10**9, set()).add((r.score, r.predicted))
        assert all(len(x) == 1 for x in got.values()) and got[1] == got[2] and got[4] == got[5]
        one = judge(both, labels.where(F.col(label) == 1)).agg(F.min("score"), F.max("score")).first()
        assert one[0] == pytest.approx(without, abs=1e-9) and one[1] == pytest.approx(without, abs=1e-9)


def test_gaps_and_insertions_raise_the_score(big):
    docs, labels = big
    model = T.train(Q.labelled_sample(docs, labels, "toxic", "doc_id", "text", 3, 1, T.TRAIN_ROWS, T.TRAIN_CHARS))
    plain, whole, spaced, inserted = model.scores(["the and of with", "the idiot of with", "the i d i o t of", "the idi-ot of"])
    assert whole > 2 * plain and spaced > 2 * plain and inserted > plain
    assert min(whole, spaced, inserted) >= 0.7 > plain


def test_units_and_windows():
    assert T.units("A b c word") == {"a", "b", "c", "word", "abc"} and T.units(None) == set()
    long = "abcdefghij" * 9
    parts = T.windows(long)
    assert all(len(p) <= T.WINDOW for p in parts) and "".join(p[: T.STEP] for p in parts[:-1]) + parts[-1] == long


def test_words_of_one_beginning_are_all_landmarks():
    """Five insults that share their first letters, which ordinary words have too, and one that is a longer word than a beginning holds."""
    insults = [f"achlich{x}" for x in ("heit", "ver", "pf", "zu", "ein")] + ["queciónjaadomentevier"]
    toxic = [{w, "die", f"wort{i}"} for w in insults for i in range(12)]
    other = [{f"achlich{x}", "die", f"wort{i}"} for x in ("ge", "au", "st", "te") for i in range(20)]
    labels = T.np.array([1] * len(toxic) + [0] * len(other))
    picked = T.chosen_landmarks(toxic + other, labels)
    assert all(any(w.startswith(p) and not any(o.startswith(p) for b in other for o in b) for p in picked) for w in insults)
    assert insults[-1] in picked
