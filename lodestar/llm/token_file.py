"""Token ids as Parquet list columns that can be read selectively.

Format. A folder of Parquet files in ascending id order: doc_id, n_tokens, part, part_start (ids before
the document in its part) and ids (a list). The ids are dictionary-encoded, and delta-encoded where a
dictionary grows too large (version 2 pages); row groups and pages have set sizes and column indexes, so
a reader takes metadata without the ids, or the pages of a few documents alone. A part is one task's
range of ids; the starts of parts are sums over one row per part.

Writing sorts texts by range, then encodes them in place, so the order costs one shuffle of texts. The
pretokenizer of a byte-level BPE always cuts before a blank that a character other than white space
follows, between a run of letters and other characters, and after a single line end, so what lies between
encodes alike alone and in its text. Each distinct run of letters is encoded once by the tokenizers
library's model, everything else by the whole library, and kept as bytes. Texts with a blank before white
space, where that does not hold, go to the library whole, as do all texts under another kind of tokenizer.

Defined results. Null counts as empty and gives the end id alone. Null ids sort first; rows that repeat an
id follow each other by the first LEAD characters of their texts. Texts of any length are encoded whole. An empty table gives an empty result
(the folder then has no rows). Extra columns are not stored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, scratch

END_ID, ROW_GROUP, PAGE = 2, 32 << 20, 256 << 10
#: Characters of a text by which rows that repeat an id are dealt.
LEAD = 64
#: Runs in a generation.
REMEMBERED = 200_000
#: Bytes of text that are encoded at a time; a longer text by itself.
BLOCK_BYTES = 4_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write each byte: visible Latin-1 characters as themselves, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}


#: A run of letters, with punctuation behind it, and at most one line end inside that another run of letters follows.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
WORD = f"^(?P<run>[{LETTERS}]+)(?:(?P<line>[{MARKS}]+\n)(?P<next>[{LETTERS}]+))?(?P<end>[{MARKS}]*)$"


def gathered(values: np.ndarray, size: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts lie one after another in `values`, `size` long each: (those that `order` names, in its order, their lengths)."""
    at = np.cumsum(size) - size
    length = size[order]
    place = np.repeat((at[order] - (np.cumsum(length) - length)).astype(np.int32), length)
    place += np.arange(len(place), dtype=np.int32)
    return values[place], length


def side_by_side(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), "<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4


class Encoder:
    """Texts to little-endian 32-bit ids, by the tokenizers library.

    Remembers the ids of runs and of odd words in two generations: what is met again moves to the new one,
    and a full one replaces the old.
    """

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library, self.known, self.before = Tokenizer.from_file(vocabulary), {}, {}
        how = json.loads(self.library.to_str())
        cut, model = how["pre_tokenizer"] or {}, how["model"]
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not how["normalizer"] and not how["post_processor"]
        plain = plain and model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        #: Whether words may be encoded apart; else every text goes to the library whole.
        self.by_word = bool(plain) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(rf"[\s{LETTERS}]", t["content"][0] + t["content"][-1]) for t in how["added_tokens"])
        self.letters = byte_letters()

    def direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def runs(self, keys: list[str]) -> list[bytes]:
        """The ids of runs of letters, blank-led or not: each is one pretoken, so the library's model alone decides."""
        spelled = "\n".join(keys).encode().decode("latin-1").translate(self.letters | {10: "\n"}).split("\n") if keys else []
        merged, ids, ends = self.library.model.tokenize, [], []
        for word in spelled:
            ids += [t.id for t in merged(word)]
            ends.append(4 * len(ids))
        whole = np.array(ids, dtype="<u4").tobytes()
        return [whole[a:b] for a, b in zip([0, *ends], ends)]

    def remembered(self, keys: list[str], encode: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The ids of distinct strings."""
        if len(self.known) > REMEMBERED:
            self.known, self.before = {}, self.known
        ids = list(map(self.known.get, keys))
        holes = [k for k, v in enumerate(ids) if v is None]
        lacking = [keys[k] for k in holes]
        found = list(map(self.before.get, lacking))
        fresh = iter(encode([w for w, v in zip(lacking, found) if v is None]))
        found = [next(fresh) if v is None else v for v in found]
        self.known.update(zip(lacking, found))
        for k, v in zip(holes, found):
            ids[k] = v
        return ids

    def words(self, words: pa.Array, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct blank-led words to (their ids one after another, number of ids of each); those that may not stand alone have none."""
        parts = pc.extract_regex(words, WORD)
        usual = np.asarray(parts.is_valid().to_numpy(zero_copy_only=False), bool) & alone
        odd = np.flatnonzero(alone & ~usual)
        coded = [parts.field(k).dictionary_encode() for k in range(4)]  # run, line, next, end; an absent one is the empty text
        names = [c.dictionary.to_pylist() for c in coded]
        keys = [" " + x for x in names[0]] + names[2]
        whole = self.remembered(keys, self.runs) + self.direct(names[1] + names[3]) + self.remembered(["\n" + words[k].as_py() for k in odd.tolist()], lambda x: self.direct([" " + w[1:] for w in x]))
        first = np.cumsum([0, len(names[0]), len(names[2]), len(names[1]), len(names[3])])
        order = np.full((len(words), 4), -1, np.int64)
        for column, k, base in ((0, 0, first[0]), (1, 1, first[2]), (2, 2, first[1]), (3, 3, first[3])):
            order[usual, column] = pc.fill_null(coded[k].indices, 0).to_numpy()[usual] + base
        order[odd, 0] = first[4] + np.arange(len(odd))
        values, size = side_by_side(whole)
        taken, length = gathered(values, np.append(size, 0), np.where(order < 0, len(size), order).reshape(-1))
        return taken, length.reshape(-1, 4).sum(axis=1)

    def encode(self, texts: pa.Array, tail: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each); `tail` ends each text's.

        Words are cut and made distinct by Arrow; Python sees the distinct runs alone. The ids are then
        gathered word by word from one array that holds those of distinct words, of first words (which no
        blank leads), of texts that are encoded whole, and the tail.
        """
        split = pc.split_pattern(texts, " ")
        n_words, first = np.diff(split.offsets.to_numpy()), split.offsets.to_numpy()[:-1].astype(np.int64)
        coded = split.flatten().dictionary_encode()
        index, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        first -= first[0] if len(first) else 0
        apart = pc.or_(pc.equal(words, ""), pc.utf8_is_space(pc.utf8_slice_codeunits(words, 0, 1)))
        alone = ~np.asarray(apart.to_numpy(zero_copy_only=False), bool)  # before white space, a blank belongs to a longer run
        # a text is cut if all its words but the first stand alone, and the first is there
        bad = ~alone[index] if self.by_word else np.ones(len(index), bool)
        openers = words.take(pa.array(index[first]))
        bad[first] = np.asarray(pc.equal(openers, "").to_numpy(zero_copy_only=False), bool) | (not self.by_word)
        whole = np.add.reduceat(bad, first) > 0 if len(first) else np.empty(0, bool)
        values, size = self.words(words, alone & self.by_word)
        openers = openers.dictionary_encode()
        heads = self.direct(["" if w else t for t, w in zip(openers.dictionary.to_pylist(), np.bincount(openers.indices.to_numpy()[~whole], minlength=len(openers.dictionary)) == 0)])
        rest = np.flatnonzero(whole)
        direct = self.direct([texts[k].as_py() for k in rest.tolist()])
        more, more_size = side_by_side(heads + direct + [np.array(tail, dtype="<u4").tobytes()])
        # the parts of every text in order: its words, or itself, and the tail
        index[first] = len(size) + openers.indices.to_numpy()
        n_parts = np.where(whole, 2, n_words + 1)
        begin = np.cumsum(n_parts) - n_parts
        order = np.empty(int(n_parts.sum()), np.int64)
        kept = np.repeat(~whole, n_words)
        place = np.arange(len(index)) + np.repeat(begin - first, n_words)
        order[place[kept]] = index[kept]
        order[begin[rest]] = len(size) + len(heads) + np.arange(len(rest))
        order[begin + n_parts - 1] = len(size) + len(more_size) - 1
        out, length = gathered(np.concatenate([values, more]), np.concatenate([size, more_size]), order)
        return out, np.add.reduceat(length, begin) if len(begin) else np.empty(0, np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def row_blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """(first, number) of consecutive texts of at most `limit` bytes together, or of one."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    first, done = 0, 0
    while first < len(ends):
        stop = max(first + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield first, stop - first
        first, done = stop, int(ends[stop - 1])


def write_tokens(docs: DataFrame, path: str, *, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, row_group_bytes: int = ROW_GROUP, page_bytes: int = PAGE) -> None:
    vocabulary, kind = vocabulary or default_vocabulary(), docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, before = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for first, n_rows in row_blocks(texts):
                values, n = own.encode(texts.slice(first, n_rows), [end_id])
                ends = np.cumsum(n)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values.view("<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n_rows), pa.array(n), pa.array(np.full(n_rows, part, np.int32)), pa.array(before + ends - n), ids], ["doc_id", "n_tokens", "part", "part_start", "ids"])
                before += int(ends[-1])

    # a repeated id is dealt by its texts, and a repeated row by where it was read, so neither fills a range by itself
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.substring(text_col, 1, LEAD).alias("lead"))
    ranged = keyed.repartitionByRange("id", "lead", F.spark_partition_id()).sortWithinPartitions("id", "lead", "text").select("id", "text")
    tokens = bounded_batches(ranged).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, part int, part_start bigint, ids array<int>")
    options = {"compression": "snappy", "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.writer.version": "v2", "parquet.enable.dictionary": "true"}
    tokens.write.options(**options).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, part: read without touching the ids."""
    rows = spark.read.parquet(path).select("doc_id", "n_tokens", "part", "part_start")
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    return rows.join(before, "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "part")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens, part, part_start, ids."""
    return spark.read.parquet(path)


def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, part, part_start, ids) to (doc_id, part, part_start, n_tokens, ids_crc32), from the ids alone."""
    for batch in batches:
        ids = batch.column(3)
        values, at = ids.values.to_numpy().astype("<u4", copy=False), ids.offsets.to_numpy()
        view = memoryview(np.ascontiguousarray(values)).cast("B")
        crc = np.fromiter((zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())), np.int64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(at).astype(np.int64)), pa.array(crc)], ["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])


def token_digest(docs: DataFrame, *, path: str | None = None, id_col: str = "doc_id", **how) -> DataFrame:
    """Writes the token file, reads it back, and gives one row per document: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens")
    write_tokens(docs, path, id_col=id_col, **how)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = spark.read.parquet(path).select("doc_id", "part", "part_start", "ids").mapInArrow(checksums, f"doc_id {kind}, part int, part_start bigint, n_tokens bigint, ids_crc32 bigint")
    sizes = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    return rows.join(before, "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
