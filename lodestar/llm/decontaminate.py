"""Benchmark decontamination by spaced seeds.

Texts become sequences of word hashes (runs of letters and digits, in lower case). A seed is a fixed mask
over consecutive words: the words at its positions are hashed, those in between are ignored, so a
substituted word spoils only the masks that look at it. Documents' seeds are joined with the benchmark's
on their hashes; every hit lines up a document with an item, and the words around it are compared one by
one: the two overlap if some window of WINDOW lined-up words (of all words of an item with fewer) has at
least SIMILARITY of them equal.

The benchmark is held by every task, in blocks of at most BLOCK_CHARS characters (a longer item is a
block), so what is broadcast does not grow with it: a larger benchmark takes more passes over the
documents, and a block is released before the next. A bit table of fixed size rejects most seeds at once.
Documents are read in place, without a shuffle, and a passage that very many of them share costs each of
them its own comparison alone.

Repetitive texts. A seed that a text holds many times meets every place of it in an item. Up to MOST_HITS
such meetings are listed at a time; a text with more by itself is compared in all alignments with the
items whose seeds it holds, of which there are no more than words. Comparisons go by slices of at most
CELLS words, and a text and item with an entirely equal window need no further alignment.

Short items. Of items of EXACT_WORDS to MIN_WORDS - 1 words all words must be found, one after another.
Those of fewer words overlap the texts that consist of these words alone: such words occur anywhere.

Defined results. Null and empty texts and items overlap nothing. Texts of any length are searched whole.
Rows that repeat a document id are one document in contaminated(); decontaminate() judges rows. An empty
benchmark leaves all documents clean. Extra columns are kept by decontaminate() and not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded_batches, code_points, lowered, mix, words, written

#: Positions of each mask that count; the others are ignored.
MASKS = ((0, 1, 2, 3), (0, 1, 3, 4, 6), (0, 2, 3, 5, 6), (0, 3, 4, 5, 7))
WINDOW, SIMILARITY, MIN_WORDS, EXACT_WORDS = 20, 0.8, 8, 4
BLOCK_CHARS, TABLE_BITS = 8_000_000, 22
#: Meetings of seeds listed at a time, words compared at a time.
MOST_HITS, CELLS = 1_000_000, 1_000_000


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, each text's first word with the total at the end)."""
    cp, starts, _ = code_points(texts)
    low, word = lowered(cp)
    hashes, _, _, first = words(low, word, starts)
    return hashes, first


def seeds(hashes: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    """The seed at every position at which the mask still fits the sequence."""
    n = len(hashes) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, salt + 1, np.uint64)
    for k, at in enumerate(mask):
        total = total * np.uint64(0x9E3779B97F4A7C15) + (hashes[at : at + n] ^ np.uint64(k))
    return mix(total)


class Block:
    """Seeds of some items, sorted, with where they are; and the items' words."""

    def __init__(self, item_ids: list, texts: list[str | None], id_type: pa.DataType | None = None):
        self.id_type = id_type or pa.int64()
        self.hashes, self.first = hashed_words([t or "" for t in texts])
        self.item_ids, size = item_ids, np.diff(self.first)
        owner = np.repeat(np.arange(len(item_ids)), size)
        self.alone: dict[bytes, list[int]] = {}
        for i in np.flatnonzero((size > 0) & (size < EXACT_WORDS)).tolist():
            self.alone.setdefault(self.hashes[self.first[i] : self.first[i + 1]].tobytes(), []).append(i)
        keys, at = [], []
        for salt, mask in enumerate(MASKS):
            key, span = seeds(self.hashes, mask, salt), mask[-1]
            inside = (owner[: len(key)] == owner[span : span + len(key)]) & (size[owner[: len(key)]] >= (MIN_WORDS if salt else EXACT_WORDS))
            keys.append(key[inside])
            at.append(np.flatnonzero(inside))
        key, where = np.concatenate(keys), np.concatenate(at)
        order = np.argsort(key, kind="stable")
        self.key, self.where, self.owner = key[order], where[order], owner
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.key >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def search(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Overlaps as (text, item, word of the text at which the best window begins, equal words in it), by number in the lists given; one row per text and item."""
        hashes, first = hashed_words(texts)
        found: list[tuple] = [(np.empty(0, np.int64),) * 4]
        if self.alone:
            for t in np.flatnonzero(np.diff(first) < EXACT_WORDS).tolist():
                for i in self.alone.get(hashes[first[t] : first[t + 1]].tobytes(), ()):
                    found.append(tuple(np.array([x]) for x in (t, i, first[t], first[t + 1] - first[t])))
        if len(hashes) and len(self.key):
            found += self.met(hashes, first)
        text, item, begin, equal = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((begin, -equal, item, text))
        text, item, begin, equal = text[order], item[order], begin[order], equal[order]
        lead = np.ones(len(text), bool)
        lead[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
        return text[lead], item[lead], begin[lead] - first[text[lead]], equal[lead]

    def met(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple]:
        """Overlaps found at seeds that texts and items share, a text and item perhaps more than once."""
        at, lo, n = [], [], []
        for salt, mask in enumerate(MASKS):
            key = seeds(hashes, mask, salt)
            hit = np.flatnonzero(self.table[(key >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
            left, right = np.searchsorted(self.key, key[hit]), np.searchsorted(self.key, key[hit], "right")
            good = right > left
            at.append(hit[good])
            lo.append(left[good])
            n.append((right - left)[good])
        at, lo, n = np.concatenate(at), np.concatenate(lo), np.concatenate(n)
        if not len(at):
            return []
        order = np.argsort(at, kind="stable")
        at, lo, n = at[order], lo[order], n[order]
        text = np.searchsorted(first, at, "right") - 1
        begins = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))  # of each text's hits
        load = np.add.reduceat(n, begins)
        out, group, held = [], [], 0
        for k in range(len(begins)):
            stop = begins[k + 1] if k + 1 < len(begins) else len(at)
            if load[k] > MOST_HITS:
                out += self.repetitive(hashes, first, int(text[begins[k]]), lo[begins[k] : stop], n[begins[k] : stop])
                continue
            if group and held + load[k] > MOST_HITS:
                out.append(self.listed(hashes, first, *(np.concatenate([x[a:b] for a, b in group]) for x in (text, at, lo, n))))
                group, held = [], 0
            group.append((begins[k], stop))
            held += load[k]
        if group:
            out.append(self.listed(hashes, first, *(np.concatenate([x[a:b] for a, b in group]) for x in (text, at, lo, n))))
        return out

    def places(self, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Numbers lo, lo + 1, ... of each run, one after another."""
        return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def listed(self, hashes, first, text, at, lo, n) -> tuple:
        item_at = self.where[self.places(lo, n)]
        item = self.owner[item_at]
        # one comparison per text and alignment, however many seeds hit it
        line = np.unique(np.stack([np.repeat(text, n), item, np.repeat(at, n) - (item_at - self.first[item])]), axis=1)
        return self.compared(hashes, first, *line)

    def repetitive(self, hashes, first, text: int, lo, n) -> list[tuple]:
        """One text against all items whose seeds it holds, in every alignment."""
        lo, which = np.unique(lo, return_index=True)
        out = []
        for item in np.unique(self.owner[self.where[self.places(lo, n[which])]]).tolist():
            words = int(self.first[item + 1] - self.first[item])
            shifts = np.arange(int(first[text]) - words + 1, int(first[text + 1]))
            step = max(1, CELLS // words)
            for s in range(0, len(shifts), step):
                part = shifts[s : s + step]
                got = self.compared(hashes, first, np.full(len(part), text), np.full(len(part), item), part)
                out.append(got)
                if (got[3] == min(words, WINDOW)).any():
                    break
        return out

    def compared(self, hashes, first, text, item, shift) -> tuple:
        """compare() in slices of alignments with items of like length."""
        size = self.first[item + 1] - self.first[item]
        order = np.argsort(size, kind="stable")
        found, s = [(np.empty(0, np.int64),) * 4], 0
        while s < len(order):
            rows = max(1, CELLS // int(size[order[s]]))
            rows = max(1, min(rows, CELLS // int(size[order[min(s + rows, len(order)) - 1]])))
            part = order[s : s + rows]
            found.append(self.compare(hashes, first, text[part], item[part], shift[part]))
            s += rows
        return tuple(np.concatenate(x) for x in zip(*found))

    def compare(self, hashes: np.ndarray, first: np.ndarray, text: np.ndarray, item: np.ndarray, shift: np.ndarray):
        """Of alignments (the item's word 0 lies at the text's word `shift`), those that overlap, with their best window."""
        size = self.first[item + 1] - self.first[item]
        column = np.arange(int(size.max()))[None, :]
        at = shift[:, None] + column
        inside = (column < size[:, None]) & (at >= first[text][:, None]) & (at < first[text + 1][:, None])
        own = self.hashes[np.minimum(self.first[item][:, None] + column, len(self.hashes) - 1)]
        same = inside & (hashes[np.clip(at, 0, len(hashes) - 1)] == own)
        total = np.concatenate([np.zeros((len(item), 1), np.int64), np.cumsum(same, axis=1)], axis=1)
        width = np.minimum(size, WINDOW)
        stop = column + width[:, None]
        fits = stop <= size[:, None]
        equal = np.where(fits, np.take_along_axis(total, np.minimum(stop, size.max()), axis=1) - total[:, :-1], -1)
        best = equal.argmax(axis=1)
        most = equal[np.arange(len(item)), best]
        good = most >= np.where(size < MIN_WORDS, size, np.ceil(SIMILARITY * width - 1e-9))
        return text[good], item[good], (shift + best)[good], most[good]


def benchmark_blocks(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[Block]:
    """The benchmark's items in blocks, fetched one by one."""
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total * 2 // block_chars)) if total > block_chars else 1
    for k in range(n):
        rows = (items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else items).toArrow()
        ids, texts = rows["id"].to_pylist(), rows["text"].to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (str(ids[i]), texts[i]))
        yield Block([ids[i] for i in order], [texts[i] for i in order], rows.schema.field("id").type)


def released(rows: DataFrame, block: Broadcast, label: str) -> DataFrame:
    """The rows written out, so that the block they were made with can go."""
    rows = written(rows, label)
    block.destroy()
    return rows


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: doc_id, contaminated, item_ids (the overlapping items, ascending), spans (item, first word of the best window, equal words)."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"doc_id {kind}, spans array<struct<item_id:{item_kind},start_word:bigint,equal_words:bigint>>"
    parts, last = [], None
    for block in benchmark_blocks(benchmark, id_col=item_col, block_chars=block_chars):
        if last is not None:
            parts[-1] = released(parts[-1], last, "contaminated")
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = shared.value
            span_type = pa.list_(pa.struct([("item_id", held.id_type), ("start_word", pa.int64()), ("equal_words", pa.int64())]))
            for batch in batches:
                spans = [[] for _ in range(batch.num_rows)]
                for start, part in blocks(batch.column(1).to_pylist()):
                    for text, item, begin, equal in zip(*(x.tolist() for x in held.search(part))):
                        spans[start + text].append({"item_id": held.item_ids[item], "start_word": begin, "equal_words": equal})
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, span_type)], ["doc_id", "spans"])

        one = bounded_batches(docs.select(id_col, text_col)).mapInArrow(run, schema)
        parts.append(one.where(F.size("spans") > 0) if parts else one)
        last = shared
    found = reduce(DataFrame.unionByName, parts)
    found = found.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"))
    return found.select("doc_id", (F.size("spans") > 0).alias("contaminated"), F.array_distinct(F.transform("spans", lambda s: s["item_id"])).alias("item_ids"), "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that overlap no item, with all their columns. Between blocks, what is left is written to the shared folder."""
    at, last = docs.columns.index(text_col), None
    for block in benchmark_blocks(benchmark, id_col=item_col, block_chars=block_chars):
        if last is not None:
            docs = released(docs, last, "decontaminated")
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = shared.value
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for start, part in blocks(batch.column(at).to_pylist()):
                    clean[start + held.search(part)[0]] = False
                yield batch.filter(pa.array(clean))

        docs, last = bounded_batches(docs).mapInArrow(run, docs.schema), shared
    return docs
