"""Exact Jaccard similarity of shingle sets: what verifies SimHash's pairs, and finds those it cannot.

Two texts are linked if their sets of SHINGLE-word shingles have a similarity of SIMILARITY or more. Every such
pair is found: the shingles of a text are put in one fixed order, and two linked sets then share one among
the first n - ceil(s n) + 1 of each, its prefix. Prefixes are joined by equality; a length bound, the bound
that the places of a shared shingle put on the overlap and that of the sketches leave few pairs. Their prefixes
are intersected, and where these share enough, the whole sets.

Disk. A cell's row is three numbers (cell, set, its size and place), shuffled once for all cells; only rows of cells
that sets of several components share go further, and sketches come to these, or to pairs, afterwards.

Sketches. A set's sketch has bit i set if an odd number of its hashes fall on i, of SKETCH bits. A shingle of both
sets cancels out in the exclusive or of their sketches, so its bits never outnumber the shingles that only one set
has: a pair whose sketches differ in more bits than the similarity allows is none, and no link is lost. The
join's own condition tells this, so that a group of texts that are nearly similar enough makes hardly more pairs
than it has links. Of sets of over 9 / 4 SKETCH shingles such a sketch says nothing. Pairs are therefore sifted by
sketches that grow with the set, of two bits or more a shingle; the longer of two is folded to the shorter's length.

Order. Shingles that a bounded sample of texts shows to be common come last, the others by how frequent their
words are in that sample, then by their hash. Any order gives the same links; this one keeps out of prefixes what
texts share by chance: common lines, and runs of words that are frequent everywhere. Otherwise the shared cells
would grow faster than the table.

Sets that are equal form one class. A shingle's hash in a prefix is a cell; cells that hold one class alone
are left out before anything is joined (components.linked() does the rest).

Defined results. Null counts as empty; texts of fewer than SHINGLE words have one shingle, their words. Words
go by ASCII, in lower case. Shingles and sets are known by 64-bit hashes. Repeated rows get equal results. An
empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, bounded_batches, scratch, shingle_hashes, transient, written
from .components import small

SEED, SHINGLE = 42, 5
#: Numerator and denominator.
SIMILARITY = (4, 5)
#: Texts of the sample, how many of them make a shingle common, and the most shingles kept as common.
SAMPLE, COMMON, MOST_COMMON = 4000, 8, 10_000
#: The most words whose frequency in the sample is kept; others count as rare.
MOST_WORDS = 50_000
#: Bits of a sketch, and the columns that hold 64 each.
SKETCH = 512
PARTS = [f"s{i}" for i in range(SKETCH // 64)]
EMPTY = np.array([xxhash.xxh64_intdigest(b"", SEED)], np.uint64)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the word shingles, sorted; without words that of the empty text."""
    hashes = shingle_hashes(text, shingle, SEED)
    return np.unique(hashes) if len(hashes) else EMPTY


def levels_of(text: str | None, known: dict[bytes, int], n: int) -> np.ndarray:
    """How frequent the words of each of a text's n shingles are: the sum of their levels, at most 255."""
    levels = np.cumsum([0, *(known.get(w, 0) for w in (text or "").encode("utf-8", "replace").lower().split())])
    width = len(levels) - n
    return np.minimum(levels[width:] - levels[:-width], 255)


def prefix(hashes: np.ndarray, common: np.ndarray, levels: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """The first n - ceil(s n) + 1 of n hashes, common ones last, those of low levels first, and the place of the last of these in the order (equal places may be of neighbouring hashes)."""
    top, bottom = SIMILARITY
    n = len(hashes)
    level = (0 if levels is None else levels) + 256 * np.isin(hashes, common, assume_unique=True)
    order = np.lexsort((hashes, level))[: n + (-top * n) // bottom + 1]
    end = order[-1]
    return hashes[order], (int(level[end]) << 54) + (int(hashes[end]) >> 10)


def sketch(hashes: np.ndarray, bits: int = SKETCH) -> list[int]:
    """For each of the bits whether an odd number of the hashes fall on it, as signed longs."""
    odd = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8").tolist()


def fine_sketch(hashes: np.ndarray) -> np.ndarray:
    """A sketch of at least two bits a shingle; its length in bits is a power of two from SKETCH on."""
    return np.array(sketch(hashes, max(SKETCH, 1 << (2 * len(hashes) - 1).bit_length())), np.int64)


def arrays(docs: DataFrame, ids: list[str], text_col: str, made: str, make) -> DataFrame:
    """The id columns, and what make(text) gives as a tuple of columns."""
    fields = docs.select(*ids).schema
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [made]
    schema = docs.sparkSession.createDataFrame([], made).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                rows = list(zip(*(make(t.as_py()) for t in part.column(part.num_columns - 1))))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *rows_to_arrow(rows)], [*part.schema.names[:-1], *schema.names])

    return bounded_batches(docs.select(*ids, text_col)).mapInArrow(run, ", ".join(kinds))


def rows_to_arrow(columns: list[tuple]) -> list[pa.Array]:
    """Integers, or lists of them from numpy arrays."""
    out = []
    for column in columns:
        if isinstance(column[0], np.ndarray):
            offsets = np.concatenate([[0], np.cumsum([len(c) for c in column])]).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(column).view(np.int64))))
        else:
            out.append(pa.array(column, pa.int64()))
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def set_key(hashes: np.ndarray) -> int:
    return signed(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))


def common_parts(docs: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, dict[bytes, int]]:
    """Of a bounded sample of texts the hashes of shingles that many of them hold, sorted, and a level of each word that occurs twice or more: the number of binary digits of its count."""
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    sample = docs.where(place < min(1.0, SAMPLE / max(1, docs.count())))
    sets = arrays(sample, [id_col], text_col, "hashes array<bigint>", lambda t: (shingle_set(t),))
    counts = sets.select(F.explode("hashes").alias("hash")).groupBy("hash").count().where(F.col("count") >= COMMON)
    found = counts.orderBy(F.desc("count"), "hash").limit(MOST_COMMON).collect()
    words = sample.select(F.explode(F.split(ascii_lower(F.col(text_col)), r"[\x20\x09-\x0D]+")).alias("word")).groupBy("word").count().where("count > 1 AND word <> ''")
    levels = {r.word.encode("utf-8", "replace"): r["count"].bit_length() for r in words.orderBy(F.desc("count"), "word").limit(MOST_WORDS).collect()}
    return np.sort(np.array([r.hash for r in found], np.int64).view(np.uint64)), levels


def similar(common: Column, n: Column, m: Column) -> Column:
    """Whether `common` of n and m shingles make the similarity."""
    top, bottom = SIMILARITY
    return (top + bottom) * common >= top * (n + m)


def possible(a: str, b: str) -> Column:
    """What a linked pair fulfils at the first shingle that it shares, and often another pair does not."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return similar(F.least(n - F.col(f"{a}.pos"), m - F.col(f"{b}.pos")), n, m)


def possible_by_sketch(a: str, b: str) -> Column:
    return possible(a, b) & sketched(a, b)


def sketched(a: str, b: str) -> Column:
    """Whether the sketches let two sets be similar: they differ in no more bits than the sets in shingles."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = reduce(add, (F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in PARTS))
    return similar((n + m - apart) / 2, n, m)


def finely_sketched(a: str, b: str) -> Column:
    """The same by the fine sketches, of which one is at most twice as long if the sizes allow the similarity."""
    n, m, x, y = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.fine"), F.col(f"{b}.fine")

    def folded(own: Column, other: Column) -> Column:
        half = F.floor(F.size(own) / 2).cast("int")
        return F.when(F.size(own) > F.size(other), F.zip_with(F.slice(own, 1, half), F.slice(own, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(own)

    apart = F.aggregate(F.zip_with(folded(x, y), folded(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, k: s + k)
    return F.when(similar(F.least(n, m), n, m), similar((n + m - apart) / 2, n, m)).otherwise(False)


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()


def ended(pairs: DataFrame, marked: DataFrame, *columns: str) -> DataFrame:
    """The pairs with columns of their two sets, as structs x and y."""
    one = marked.join(small(written(ends(pairs), "ends")), "key", "left_semi").select("key", F.struct(*columns).alias("s")).dropDuplicates(["key"])
    one = written(one, "ended")
    return pairs.join(one.select(F.col("key").alias("a"), F.col("s").alias("x")), "a").join(one.select(F.col("key").alias("b"), F.col("s").alias("y")), "b")


def sifted(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """Without the pairs whose sketches differ too much."""
    return written(ended(written(pairs, "pairs"), marked, "n", "fine").where(finely_sketched("x", "y")).select("a", "b"), "sifted")


def promising(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """Without the pairs whose prefixes share too little: what is shared besides lies behind the prefix that ends first."""
    x, y = F.col("x.n") - F.size("x.prefix"), F.col("y.n") - F.size("y.prefix")
    behind = F.when(F.col("x.last") < F.col("y.last"), x).when(F.col("x.last") > F.col("y.last"), y).otherwise(F.greatest(x, y))
    both = ended(pairs, marked, "n", "last", "prefix")
    return both.where(similar(F.size(F.array_intersect("x.prefix", "y.prefix")) + behind, F.col("x.n"), F.col("y.n"))).select("a", "b")


def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text of a, text of b) to the (a, b) whose sets are similar; of texts of a that follow each other the set is made once."""
    top, bottom = SIMILARITY
    known: tuple[int | None, np.ndarray] = (None, EMPTY)
    for batch in batches:
        good = np.zeros(batch.num_rows, bool)
        for i, (a, x, y) in enumerate(zip(*(batch.column(k) for k in (0, 2, 3)))):
            if known[0] != a.as_py():
                known = (a.as_py(), shingle_set(x.as_py()))
            other = shingle_set(y.as_py())
            common = len(np.intersect1d(known[1], other, assume_unique=True))
            good[i] = (top + bottom) * common >= top * (len(known[1]) + len(other))
        yield batch.select([0, 1]).filter(pa.array(good))


def verified(pairs: DataFrame, marked: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """Those of the pairs (a, b) of set keys whose sets are similar. Texts are shuffled rather than their sets, which take more bytes."""
    spark, path = pairs.sparkSession, scratch(pairs.sparkSession, "links")
    with transient(spark):
        pairs = written(promising(written(pairs, "pairs"), marked), "promising")
        one = written(marked.join(small(written(ends(pairs), "ends")), "key", "left_semi").groupBy("key").agg(F.min("text_hash").alias("text_hash")), "needed")
        hashed = docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
        texts = hashed.join(small(one), "text_hash").groupBy("key").agg(F.first("text").alias("text"))
        texts = written(texts.withColumn("text", F.coalesce("text", F.lit(""))), "texts")
        both = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("y")), "b").join(texts.select(F.col("key").alias("a"), F.col("text").alias("x")), "a")
        bounded_batches(both.select("a", "b", "x", "y")).mapInArrow(alike, "a bigint, b bigint").write.parquet(path)
    return spark.read.parquet(path)


def prefixes(docs: DataFrame, majority, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, text_hash, key (of its set), n (shingles in it), fp (majority of its shingles' hashes), last, the parts of its sketch, fine (the other sketch), prefix. Each text is read once."""
    shared = docs.sparkSession.sparkContext.broadcast(common_parts(docs, id_col, text_col))

    def mark(text: str | None) -> tuple:
        common, known = shared.value
        hashes = shingle_hashes(text, SHINGLE, SEED)
        distinct, at = np.unique(hashes, return_index=True) if len(hashes) else (EMPTY, None)
        taken, last = prefix(distinct, common, None if at is None else levels_of(text, known, len(hashes))[at])
        return set_key(distinct), len(distinct), signed(majority(hashes)), last, *sketch(distinct), fine_sketch(distinct), taken

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return written(arrays(rows, ["doc_id", "text_hash"], "text", f"key bigint, n bigint, fp bigint, last bigint, {' bigint, '.join(PARTS)} bigint, fine array<bigint>, prefix array<bigint>", mark), "prefixes")


def shared_cells(marked: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]:
    """(cell, key, n, pos) of the distinct sets: where a set has a shingle of its prefix, if another set has it too. With it what gives (cell, key, comp, n, pos) from these rows, and what adds the sketches to them."""
    placed = marked.select("key", "n", F.posexplode("prefix").alias("pos", "cell")).select("cell", "key", (F.shiftleft(F.col("n"), 31) + F.col("pos")).alias("at"))
    of = Window.partitionBy("cell")
    shared = placed.withColumn("_lo", F.min("key").over(of)).withColumn("_hi", F.max("key").over(of)).where("_lo <> _hi")
    shared = shared.select("cell", "key", F.shiftright("at", 31).alias("n"), F.col("at").bitwiseAND(F.lit((1 << 31) - 1)).alias("pos"))
    shared = written(shared.dropDuplicates(["cell", "key"]), "shared")

    def with_sketches(rows: DataFrame) -> DataFrame:
        keys = written(rows.select("key").distinct(), "met-keys")
        return rows.join(marked.select("key", *PARTS).join(small(keys), "key", "left_semi").dropDuplicates(["key"]), "key")

    return shared, lambda rows: rows.select("cell", "key", "comp", "n", "pos"), with_sketches
