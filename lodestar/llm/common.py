"""What the operators of this subpackage share: tables, the shared scratch folder, text arrays."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.storage import drop_scratch, scratch, shared_dir, small_enough, transient, written

__all__ = ["ascii_lower", "blocks", "bounded_batches", "bounded_sample", "char_tables", "code_points", "crc_mod", "drop_scratch", "hash_place", "lowered", "mix", "scratch", "shared_dir", "shingle_hashes", "small_enough", "table", "transient", "words", "written"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a batch that goes to a Python worker: texts may be long, and a worker and its executor hold a batch several times.
BATCH_ROWS = 1000


def bounded_batches(rows: DataFrame) -> DataFrame:
    """The frame as it is. Batches for Python workers get BATCH_ROWS rows from now on, unless the session has set a number of its own."""
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(BATCH_ROWS))
    return rows


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def crc_mod(id_column: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % n


# ---------------------------------------------------------------- texts as arrays of code points

_TABLES: dict[str, np.ndarray] = {}
#: Characters of one numpy block; a longer text forms a block of its own.
BLOCK_CHARS = 400_000


def char_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the code points below 65,536: their lower case (where that is one code point), and whether they are letters or digits, and letters."""
    if not _TABLES:
        lower, word, letter = np.arange(65536, dtype=np.uint32), np.zeros(65536, dtype=bool), np.zeros(65536, dtype=bool)
        for i in range(65536):
            c = chr(i)
            if (low := c.lower()) != c and len(low) == 1:
                lower[i] = ord(low)
            word[i], letter[i] = c.isalnum(), c.isalpha()
        _TABLES.update(lower=lower, word=word, letter=letter)
    return _TABLES["lower"], _TABLES["word"], _TABLES["letter"]


def blocks(texts: list[str | None], limit: int = BLOCK_CHARS):
    """Consecutive slices (first, texts) of at most `limit` characters, or of one text."""
    start, size, part = 0, 0, []
    for i, t in enumerate(texts):
        t = t or ""
        if part and size + len(t) > limit:
            yield start, part
            start, size, part = i, 0, []
        part.append(t)
        size += len(t)
    if part:
        yield start, part


def code_points(texts: list[str], gap: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of the texts with `gap` zeros after each, starts, ends)."""
    joined = ("\0" * gap).join(texts) + "\0" * gap
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(lengths + gap) - (lengths + gap)
    return cp, starts, starts + lengths


def lowered(cp: np.ndarray, letters_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(code points in lower case, which are letters or digits, or which are letters). Case is kept from code point 65,536 on."""
    lower, word, letter = char_tables()
    kind = letter if letters_only else word
    if len(cp) and int(cp.max()) >= 65536:
        high = cp >= 65536
        low = np.where(high, 0, cp)
        rare, which = np.unique(cp[high], return_inverse=True)
        is_kind = kind[low]
        is_kind[high] = np.array([chr(c).isalpha() if letters_only else chr(c).isalnum() for c in rare.tolist()], bool)[which]
        return np.where(high, cp, lower[low]), is_kind
    return lower[cp], kind[cp]


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing of uint64 values; wraps around."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(cp: np.ndarray, is_word: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of letters and digits: (64-bit hashes, starts, ends, index of each text's first word, with the total at the end)."""
    edge = np.diff(np.concatenate([[0], is_word.view(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.concatenate([np.searchsorted(begin, starts), [len(begin)]])
    if not len(begin):
        return np.empty(0, np.uint64), begin, end, first
    at, length = np.flatnonzero(is_word), end - begin
    offset = at - np.repeat(begin, length)
    value = mix(cp[at].astype(np.uint64) + (offset.astype(np.uint64) << np.uint64(32)))
    return mix(np.add.reduceat(value, np.cumsum(length) - length) + _M1), begin, end, first


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of `shingle` words in lower case (of all words, if fewer), in order, repeats included; nothing without words. bytes.lower and bytes.split go by ASCII."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    n = max(1, len(found) - shingle + 1)
    starts, stops = np.concatenate([[0], ends[: n - 1] + 1]), ends[min(shingle, len(found)) - 1 :]
    out = np.empty(n, np.uint64)
    for i in range(0, n, 65536):
        out[i : i + 65536] = [digest(joined[a:b], seed) for a, b in zip(starts[i : i + 65536].tolist(), stops[i : i + 65536].tolist())]
    return out


def hash_place(salt: str, id_column: Column) -> Column:
    """A fixed place of an id between 0 and 1."""
    return F.pmod(F.xxhash64(F.lit(salt), id_column), F.lit(1 << 30)) / float(1 << 30)


def bounded_sample(rows: DataFrame, class_col: str, id_col: str, per_class: int, max_classes: int = 1000) -> DataFrame:
    """About `per_class` rows of each class (all of a smaller one), chosen by a fixed hash of the id: the same rows whatever the partitioning, and no shuffle of texts."""
    sizes = rows.groupBy(class_col).count().limit(max_classes + 1).collect()
    if len(sizes) > max_classes:
        raise ValueError(f"{class_col} has more than {max_classes} values")
    share = F.lit(0.0)
    for row in sizes:
        share = F.when(F.col(class_col) == row[0], F.lit(min(1.0, per_class / row[1]))).otherwise(share)
    return rows.where(hash_place("sample", F.col(id_col)) < share)
