"""Toxicity: a support vector machine on a subsequence string kernel with Nyström landmarks.

Kernel. Two character strings are compared by all subsequences of ORDER characters they share, each
weighted by DECAY to the power of the span it takes in either, and normalised by the strings' own values.
Gaps cost a factor but break nothing, so inserted characters and spaced-out letters still match.

Features. A text is the bag of its units: blank-separated tokens in lower case without outer punctuation,
and runs of one-character tokens joined. A unit's value at a landmark is the largest of its pieces, which are
its windows (one, unless it is long) and its shortest beginnings. At a landmark it has two
values: the mean of the kernel over its units, which is the kernel of the whole text and the landmark, and
the largest, which one insult in a long text raises. Landmarks are chosen from a bounded sample of labelled
sentences: strings (words and word beginnings) that cover many toxic texts and few others, or that toxic
texts hold densely and others do not, then frequent ordinary words. The kernel matrix of the landmarks to
the power -1/2 maps both values to Nyström coordinates, on which a linear SVM is trained by subgradient
descent, with a logistic curve on its margin.

Toxic training texts appear twice, the second time with a foreign character inside their insults; some
empty texts are added as clean ones, so that meeting no landmark speaks against toxicity.
Training uses about TRAIN_ROWS labelled rows of each class, of at most TRAIN_CHARS characters. The model
is a few kilobytes and is broadcast. Every text is scored whole, in place, without a shuffle. A worker
keeps the kernel values of at most REMEMBERED units.

Defined results. Null and empty texts get the score of a text that meets no landmark. Rows that repeat get
equal results. Null labels are not learned from; without labels of both classes every score is 0. An empty
table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded_batches, crc_mod
from .quality import labelled_sample

ORDER, DECAY = 3, 0.8
#: The Gaussian's width, and what the mean over a text's units is multiplied with.
WIDTH, MEAN_SCALE = 0.15, 60.0
#: Share of a text's tokens, and number of them, from which it holds a string densely.
DENSE, DENSE_COUNT = 0.005, 2
WINDOW, STEP = 24, 12
OTHER_LANDMARKS, PART = 8, 6
TRAIN_ROWS, TRAIN_CHARS, REMEMBERED = 1200, 50_000, 150_000


def stripped(unit: str) -> str:
    """Without outer characters that are neither letters nor digits."""
    if unit and unit[0].isalnum() and unit[-1].isalnum():
        return unit
    a, b = 0, len(unit)
    while a < b and not unit[a].isalnum():
        a += 1
    while b > a and not unit[b - 1].isalnum():
        b -= 1
    return unit[a:b]


def units(text: str | None) -> Counter[str]:
    """The tokens of a text, as they are, and its joined runs of one-character tokens, with how often they occur."""
    found = (text or "").lower().split()
    out = Counter(found)
    single = np.fromiter(map(len, found), np.int64, len(found)) == 1
    if single.any():
        edge = np.diff(np.concatenate([[0], single.view(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if b - a >= ORDER:
                out["".join(found[a:b])] += 1
    return out


def windows(unit: str) -> list[str]:
    unit = stripped(unit)
    return [unit] if len(unit) <= WINDOW else [unit[i : i + WINDOW] for i in range(0, len(unit) - WINDOW + STEP, STEP)]


def pieces(unit: str) -> list[str]:
    """The strings that stand for a token: its windows, and the beginnings that are as short as a landmark may be."""
    own = windows(unit)
    return own + [own[0][:k] for k in range(4, min(PART, len(own[0]) - 1) + 1)]


def as_codes(strings: list[str]) -> np.ndarray:
    """Code points, a string per column, padded with 0."""
    width = max(map(len, strings), default=0)
    joined = "".join([s.ljust(width, "\0") for s in strings]).encode("utf-32-le", "surrogatepass")
    return np.ascontiguousarray(np.frombuffer(joined, "<u4").reshape(len(strings), width).T)


def weighted_subsequences(codes: np.ndarray, match_of) -> np.ndarray:
    """The kernel's dynamic programme, for many strings at once: codes has a string per column, match_of(row) their equality with each character of the other side."""
    n, decay, square = codes.shape[1], np.float32(DECAY), np.float32(DECAY * DECAY)
    prefix, total, inner = None, np.zeros(n, np.float32), np.empty(n, np.float32)
    for row in codes:
        match = match_of(row) * square
        length = len(match)
        if prefix is None:  # prefix[i][j]: weighted subsequences of i characters of what was read and of the first j of the other, reaching both ends
            prefix = [np.ones((length, n), np.float32)] + [np.zeros((length, n), np.float32) for _ in range(ORDER - 1)]
        total += (match * prefix[ORDER - 1]).sum(axis=0)
        for i in range(ORDER - 1, 0, -1):
            step = match * prefix[i - 1]
            prefix[i] *= decay
            inner[:] = 0
            for j in range(length - 1):
                inner *= decay
                inner += step[j]
                prefix[i][j + 1] += inner
    return total


def subsequence_kernel(codes: np.ndarray, other: str) -> np.ndarray:
    """Kernel values of many strings (columns of code points, padded with 0) and one other string."""
    letters = np.array([[ord(c)] for c in other], np.uint32)
    return weighted_subsequences(codes, lambda row: (row[None, :] == letters).astype(np.float32))


def own_kernel(codes: np.ndarray) -> np.ndarray:
    """Kernel values of strings with themselves."""
    real = codes > 0
    return weighted_subsequences(codes, lambda row: ((row[None, :] == codes) & real).astype(np.float32))


def letter_masks(codes: np.ndarray) -> np.ndarray:
    """A 64-bit set of each string's characters."""
    bits = np.where(codes > 0, np.uint64(1) << (codes & np.uint32(63)).astype(np.uint64), np.uint64(0))
    return np.bitwise_or.reduce(bits, axis=0)


def similarities(strings: list[str], landmarks: list[str], own: np.ndarray, batch: int = 8192) -> np.ndarray:
    """Kernel values in the unit interval, one row per string: normalised by both strings' own values, then sharpened by the Gaussian of the distance they imply. Strings that share too few characters with a landmark have value 0 without computation; batches are of like length."""
    out = np.zeros((len(strings), len(landmarks)), np.float32)
    order = np.array(sorted((i for i, s in enumerate(strings) if len(s) >= ORDER), key=lambda i: len(strings[i])), np.int64)
    theirs = letter_masks(as_codes(landmarks))
    for s in range(0, len(order), batch):
        at = order[s : s + batch]
        part = [strings[i] for i in at]
        codes = as_codes(part)
        norm, masks = own_kernel(codes), letter_masks(codes)
        for j, landmark in enumerate(landmarks):
            common = np.flatnonzero(np.bitwise_count(masks & theirs[j]) >= min(ORDER, len(set(landmark))))
            if len(common):
                value = subsequence_kernel(np.ascontiguousarray(codes[:, common]), landmark) / np.sqrt(norm[common] * own[j])
                out[at[common], j] = np.exp((np.minimum(value, 1) - 1) / WIDTH)
    return out


def beginnings(word: str) -> set[str]:
    """The beginnings of a word that may be landmarks, itself included; none of a short one."""
    return {word[:k] for k in {*range(4, min(len(word), PART) + 1), min(len(word), 2 * PART), min(len(word), WINDOW)}} if len(word) >= 4 else set()


def dense_landmarks(counts: list[Counter[str]], labels: np.ndarray) -> list[str]:
    """Greedy cover of the toxic texts by word beginnings that many hold densely and few others do: stems that ordinary words share are told by how many there are."""
    holders: dict[str, list[int]] = defaultdict(list)
    for i, bag in enumerate(counts):
        total, own = sum(bag.values()), Counter()
        for u, n in bag.items():
            for s in beginnings(stripped(u)):
                own[s] += n
        for s, n in own.items():
            if n >= DENSE_COUNT and n >= DENSE * total:
                holders[s].append(i)
    need, picked, covered = max(3, int(labels.sum()) // 100), [], np.zeros(len(counts), bool)
    candidates = {s: (np.array([i for i in at if labels[i]], np.int64), sum(1 for i in at if not labels[i])) for s, at in holders.items() if len(at) >= need}
    candidates = {s: v for s, v in candidates.items() if len(v[0]) >= max(need, 4 * v[1])}
    while candidates:
        gains = {s: (int((~covered[at]).sum()) - 2 * others, len(s), s) for s, (at, others) in candidates.items()}
        best = max(candidates, key=gains.__getitem__)
        if gains[best][0] < need:
            break
        picked.append(best)
        covered[candidates.pop(best)[0]] = True
    return picked


def chosen_landmarks(bags: list[set[str]], labels: np.ndarray) -> list[str]:
    """landmark_kinds() as one list."""
    toxic, plain = landmark_kinds(bags, labels)
    return toxic + plain


def landmark_kinds(bags: list, labels: np.ndarray) -> tuple[list[str], list[str]]:
    """(greedy cover of the toxic texts by words and word beginnings that other texts seldom have, the most frequent ordinary words)."""
    holders: dict[str, list[int]] = defaultdict(list)
    for i, bag in enumerate(bags):
        for s in {s for u in bag for s in beginnings(stripped(u))}:
            holders[s].append(i)
    need = max(3, int(labels.sum()) // 60)
    candidates = {s: (np.array([i for i in at if labels[i]]), sum(1 for i in at if not labels[i])) for s, at in holders.items() if len(at) >= need}
    candidates = {s: v for s, v in candidates.items() if len(v[0]) >= max(need, 4 * v[1])}
    picked, covered = [], np.zeros(len(bags))
    while candidates:  # ends where too few toxic texts are left that nothing picked covers
        best, gain = None, 0.0
        for s, (at, others) in candidates.items():
            if (g := (float((0.6 ** covered[at]).sum()) - 2 * others) * (1 + 0.04 * len(s))) > gain:
                best, gain = s, g
        if best is None or gain < need / 2:
            break
        most = len(candidates[best][0])
        best = max((s for s, v in candidates.items() if s.startswith(best) and len(v[0]) >= 0.8 * most), key=lambda s: (len(s), s))
        picked.append(best)
        covered[candidates[best][0]] += 1
        found = set(candidates[best][0])  # of longer words, those with toxic texts of their own stay
        candidates = {s: v for s, v in candidates.items() if not best.startswith(s) and not (s.startswith(best) and found.issuperset(v[0]))}
    common = {s: n for s, at in holders.items() if (n := sum(1 for i in at if not labels[i])) >= need}
    plain: list[str] = []
    for s, _ in sorted(common.items(), key=lambda x: (-x[1], x[0])):
        if len(plain) == OTHER_LANDMARKS:
            break
        if all(s[:4] != p[:4] for p in picked + plain):
            plain.append(s)
    return picked, plain


def with_insertions(bag: Counter[str], landmarks: tuple[str, ...], seed: int) -> Counter[str] | None:
    """The bag with its insults disguised by a foreign character inside each: all of them for even seeds, else one alone, the others left out. None without an insult."""
    insults = sorted(u for u in bag if stripped(u).startswith(landmarks)) if landmarks else []
    if not insults:
        return None
    out = Counter({u: n for u, n in bag.items() if u not in set(insults)})
    for k, u in enumerate(insults if seed % 2 == 0 else [insults[seed % len(insults)]]):
        s = stripped(u)
        at = 1 + (len(s) + seed + k) % 3
        out[s[:at] + "-*_.x"[(seed + k) % 5] + s[at:]] += bag[u]
    return out


class Model:
    """Landmarks, the weights of the largest and of the mean value at each, bias, and the logistic curve; remembers the values of units, in steps of 1/255."""

    def __init__(self, landmarks: list[str], own: np.ndarray, weight: np.ndarray, bias: float, curve: tuple[float, float]):
        self.landmarks, self.own, self.weight, self.bias, self.curve = landmarks, own, weight, bias, curve
        self.known: dict[str, int] = {}
        self.values = np.zeros((0, len(landmarks)), np.uint8)

    def lookup(self, bags: list[Counter[str]]) -> np.ndarray:
        """The largest and the scaled mean value of each text at each landmark."""
        if len(self.known) > REMEMBERED:
            self.known, self.values = {}, self.values[:0]
        known = self.known
        new = list({u for b in bags for u in b}.difference(known))
        if new:
            cut = [pieces(u) for u in new]
            strings: dict[str, int] = {}
            which = np.array([strings.setdefault(w, len(strings)) for c in cut for w in c], np.int64)
            value = similarities(list(strings), self.landmarks, self.own)[which]
            first = np.cumsum([0, *map(len, cut)])[:-1]
            known.update(zip(new, range(len(self.values), len(self.values) + len(new))))
            self.values = np.concatenate([self.values, np.rint(np.maximum.reduceat(value, first) * 255).astype(np.uint8)])
        m = len(self.landmarks)
        out = np.zeros((len(bags), 2 * m), np.float32)
        for i, b in enumerate(bags):
            if b:
                values = self.values[np.fromiter(map(known.__getitem__, b), np.int64, len(b))]
                often = np.fromiter(b.values(), np.float32, len(b))
                out[i, :m] = values.max(axis=0)
                out[i, m:] = np.float32(MEAN_SCALE) / often.sum() * (often @ values)
        return out / np.float32(255)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = [np.zeros(0)]
        for _, part in blocks(texts):
            margin = self.lookup([units(t) for t in part]) @ self.weight + self.bias
            out.append(1 / (1 + np.exp(-np.clip(self.curve[0] * margin + self.curve[1], -60, 60))))
        return np.concatenate(out)


def fit(texts: list[str], labels: np.ndarray, *, rounds: int = 3000, penalty: float = 1e-4) -> Model:
    """Landmarks, Nyström coordinates, SVM and logistic curve from labelled texts."""
    if len(set(labels.tolist())) < 2:
        return Model([], np.zeros(0, np.float32), np.zeros(0, np.float32), 0.0, (0.0, -60.0))
    bags = [units(t) for t in texts]
    toxic, plain = landmark_kinds(bags, labels)
    toxic += [s for s in dense_landmarks(bags, labels) if s not in toxic]
    landmarks = toxic + [s for s in plain if s not in toxic]
    if not landmarks:  # too few texts to tell anything apart
        return Model([], np.zeros(0, np.float32), np.zeros(0, np.float32), 0.0, (0.0, -60.0))
    bent = [x for i, (b, label) in enumerate(zip(bags, labels)) if label == 1 and (x := with_insertions(b, tuple(toxic), i))]
    nothing = [Counter() for _ in range(1 + len(bags) // 20)]
    bags, labels = bags + bent + nothing, np.concatenate([labels, np.ones(len(bent), labels.dtype), np.zeros(len(nothing), labels.dtype)])
    own = own_kernel(as_codes(landmarks))
    k_mm = similarities(landmarks, landmarks, own).astype(np.float64)
    values, vectors = np.linalg.eigh(k_mm + 1e-3 * np.eye(len(landmarks)))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    root = np.kron(np.eye(2), root)  # the same map for largest and mean values
    raw = Model(landmarks, own, np.zeros(2 * len(landmarks), np.float32), 0.0, (1.0, 0.0)).lookup(bags).astype(np.float64)
    x = np.concatenate([raw @ root, np.ones((len(raw), 1))], axis=1)
    y = np.where(labels == 1, 1.0, -1.0)
    share = len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    w, mean = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(rounds):
        short = (y * (x @ w) < 1) * share * y
        w = w - 8.0 / np.sqrt(1 + t) * (penalty * w - x.T @ short / len(y))
        mean += w / rounds
    margin, prior = x @ mean, np.where(y > 0, 0.25, 1.75) * share  # toxic texts are the rarer ones
    a, b = 1.0, 0.0
    for _ in range(500):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -60, 60)))
        gap = (labels - p) * prior
        a, b = a + 0.5 * (gap * margin).mean(), b + 0.5 * gap.mean()
    return Model(landmarks, own, (root @ mean[:-1]).astype(np.float32), float(mean[-1]), (float(a), float(b)))


def train(sample: DataFrame) -> Model:
    """From (_id, _label, _text) rows, a bounded number of them."""
    got = sample.toArrow()
    rows = sorted(zip(*(got[c].to_pylist() for c in ("_id", "_label", "_text"))), key=lambda r: (str(r[0]), r[1], r[2]))
    return fit([r[2] for r in rows], np.array([r[1] for r in rows], np.int64))


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, score, predicted."""
    model.known, model.values = {}, model.values[:0]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            score = own.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return bounded_batches(docs.select(id_col, text_col)).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def judge_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out_mod: int = 3, held_out_rest: int = 1, threshold: float = 0.7) -> DataFrame:
    """Learns from labelled rows whose crc32(id as text) modulo `held_out_mod` is not `held_out_rest`, scores all: doc_id, held_out, score, predicted."""
    model = train(labelled_sample(docs, labels, "toxic", id_col, text_col, held_out_mod, held_out_rest, TRAIN_ROWS, TRAIN_CHARS))
    scored = predict(docs, model, id_col=id_col, text_col=text_col, threshold=threshold)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), held_out_mod) == held_out_rest).alias("held_out"), "score", "predicted")
