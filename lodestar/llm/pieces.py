"""SentencePiece encoding and decoding, with giant documents cut up and joined by a max-plus scan.

The vocabulary's algorithm merges the best-scored pair of neighbours until none is left. A sequence of
pieces is what it gives for a text if and only if every two neighbours are what it gives for their own
concatenation, so the encoding is the one path of a lattice whose states are pieces over spans of the text.
That makes it a max-plus product: cut the text at boundaries; the states of a boundary are the pieces that
can hold the character before it; a chunk's transfer matrix has, for a left and a right state, the score of
the path between them, or minus infinity where the library's encoding of the span between does not begin and
end with them. Matrices are multiplied associatively, first within runs of RUN chunks, then over the runs
of a document; the states of all boundaries follow, and every chunk is traced back on its own.

Boundaries are put where no piece of the vocabulary can cross (such as before a blank after another
character) if there is such a place near; a boundary has one state there, and matrices are 1 by 1. Texts
without such a place get the full matrices.

Documents of at most GIANT_CHARS characters are encoded in place. Longer ones are cut, their chunks spread
over the cluster, and chunk encodings put together per document; no task holds more of a document than its
ids. Both ways give the library's own result.

Defined results. Null counts as empty and has no ids. Texts of any length are encoded whole. Rows that
repeat get equal results. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded_batches, written

GIANT_CHARS, CHUNK_CHARS, RUN, SEARCH = 65_536, 32_768, 64, 512
NEVER = float("-inf")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """A SentencePiece model whose normalisation keeps texts as they are, but for the blank put before them."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = range(self.library.get_piece_size())
        plain = [i for i in size if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))]
        self.score = {self.library.id_to_piece(i).replace("▁", " "): self.library.get_score(i) for i in plain}
        self.longest = max(map(len, self.score), default=1)
        self.pairs = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        self.guard = len(self.library.encode("\n"))

    def encode_raw(self, span: str) -> list[int]:
        """The ids of a span as it stands, without a blank before it: a newline, which no piece holds, is put first and its ids are taken away."""
        return self.library.encode("\n" + span)[self.guard :]

    def widths(self, span: str, ids: list[int]) -> list[tuple[int, int, int]]:
        """(first id, number of ids, characters) of each symbol; a character outside the vocabulary is one symbol of several byte ids."""
        out, k, at = [], 0, 0
        while k < len(ids):
            if self.library.is_byte(ids[k]):
                n = len(span[at].encode("utf-8", "surrogatepass"))
                out.append((k, n, 1))
            else:
                n = 1
                out.append((k, 1, len(self.library.id_to_piece(ids[k]))))
            k, at = k + n, at + out[-1][2]
        return out

    def cuts(self, text: str, size: int = CHUNK_CHARS, search: int = SEARCH) -> list[int]:
        """Boundaries about every `size` characters, at places that no piece can cross where one is near."""
        out, at = [0], 0
        while len(text) - at > size + search:
            near = at + size
            at = next((b for b in range(near, near - search, -1) if text[b - 1 : b + 1] not in self.pairs), near)
            out.append(at)
        return [*out, len(text)]

    def states(self, left: str, right: str) -> list[tuple[int, int]]:
        """The symbols that can hold the last character of `left`, as (characters left of the boundary, characters right of it)."""
        if not left:
            return [(0, 0)]
        if not right or left[-1] + right[0] not in self.pairs:
            return [(0, 0)]
        found = [(1, 0)]
        for a in range(1, min(self.longest, len(left)) + 1):
            for b in range(0, min(self.longest - a, len(right)) + 1):
                if (a, b) != (1, 0) and left[len(left) - a :] + right[:b] in self.score:
                    found.append((a, b))
        return found

    def trace(self, left: str, body: str, right: str, entry: tuple[int, int], leave: tuple[int, int]) -> tuple[float, list[int]] | None:
        """The score and the ids of the path from one state to another, the entry's own symbol left out; None if there is none."""
        a, skip = entry
        _, over = leave
        if skip > len(body) + over:
            return None
        span = (left[len(left) - a :] if a else "") + body + right[:over]
        ids = self.encode_raw(span)
        symbols = self.widths(span, ids)
        if a + skip:  # the first symbol must be the entry's own
            if not symbols or symbols[0][2] != a + skip:
                return None
            if leave != (0, 0) and symbols[-1][2] != sum(leave):
                return None
            own = symbols[0][1]
        else:
            if leave != (0, 0) and (not symbols or symbols[-1][2] != sum(leave)):
                return None
            own = 0
        return float(sum(self.library.get_score(i) for i in ids[own:])), ids[own:]


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


Matrix = dict[tuple[tuple[int, int], tuple[int, int]], float]


def product(x: Matrix, y: Matrix) -> Matrix:
    """Max-plus product of two transfer matrices; entries that are left out are minus infinity."""
    rows: dict = {}
    for (b, c), s in y.items():
        rows.setdefault(b, []).append((c, s))
    out: Matrix = {}
    for (a, b), s in x.items():
        for c, t in rows.get(b, ()):
            if s + t > out.get((a, c), NEVER):
                out[a, c] = s + t
    return out


def states_between(matrices: list[Matrix], entry: tuple[int, int], leave: tuple[int, int]) -> list[tuple[int, int]]:
    """The states of the best path at every boundary, first and last included."""
    best, back = {entry: 0.0}, []
    for m in matrices:
        new, how = {}, {}
        for (a, b), s in m.items():
            if a in best and best[a] + s > new.get(b, NEVER):
                new[b], how[b] = best[a] + s, a
        back.append(how)
        best = new
    path = [leave]
    for how in reversed(back):
        path.append(how[path[-1]])
    return path[::-1]


def packed(matrix: Matrix) -> list[dict]:
    return [{"a": a, "b": b, "c": c, "d": d, "s": s} for ((a, b), (c, d)), s in matrix.items()]


def unpacked(cells) -> Matrix:
    return {((int(x["a"]), int(x["b"])), (int(x["c"]), int(x["d"]))): float(x["s"]) for x in cells}


CELLS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("c", pa.int32()), ("d", pa.int32()), ("s", pa.float64())]))
CELLS_SQL = "array<struct<a:int,b:int,c:int,d:int,s:double>>"


def list_column(rows: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *[np.array(r, np.int32) for r in rows]])))


def encode_small(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path).library
        for batch in batches:
            for start, texts in blocks(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), list_column(own.encode(texts, num_threads=1))], ["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return bounded_batches(docs.select(id_col, text_col)).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def encode_giant(docs: DataFrame, id_col: str, text_col: str, path: str, chunk_chars: int = CHUNK_CHARS, search: int = SEARCH) -> DataFrame:
    """(doc_id, ids) of documents by the scan."""
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        wide = own.longest
        for batch in batches:
            ids, keys, texts = (batch.column(i).to_pylist() for i in range(3))
            for i, key, t in zip(ids, keys, texts):
                text = " " + t if t else ""
                at = own.cuts(text, chunk_chars, search)
                last = len(at) - 2
                for first in range(0, last + 1, 64):
                    ks = range(first, min(last + 1, first + 64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i] * len(ks), batch.schema.field(0).type), pa.array([key] * len(ks), pa.int64()), pa.array(list(ks), pa.int32()), pa.array([last] * len(ks), pa.int32())]
                        + [pa.array(x, pa.string()) for x in ([text[max(0, at[k] - wide) : at[k]] for k in ks], [text[at[k] : at[k + 1]] for k in ks], [text[at[k + 1] : at[k + 1] + wide] for k in ks])],
                        ["doc_id", "key", "chunk", "last", "l", "body", "r"],
                    )

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            cells = []
            for left, body, right in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                matrix: Matrix = {}
                for a in own.states(left, body):
                    for b in own.states(left + body, right):
                        if (got := own.trace(left, body, right, a, b)) is not None:
                            matrix[a, b] = got[0]
                cells.append(packed(matrix))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, CELLS)], ["key", "chunk", "cells"])

    def run_product(pdf):
        pdf = pdf.sort_values("chunk")
        out = unpacked(pdf["cells"].iloc[0])
        for cells in pdf["cells"].iloc[1:]:
            out = product(out, unpacked(cells))
        return pdf.head(1)[["key", "run"]].assign(cells=[packed(out)])

    def run_states(pdf):
        pdf = pdf.sort_values("run")
        path = states_between([unpacked(c) for c in pdf["cells"]], (0, 0), (0, 0))
        return pdf[["key", "run"]].assign(a=[p[0] for p in path[:-1]], b=[p[1] for p in path[:-1]], c=[p[0] for p in path[1:]], d=[p[1] for p in path[1:]])

    def chunk_states(pdf):
        pdf = pdf.sort_values("chunk")
        x = pdf.iloc[0]
        path = states_between([unpacked(c) for c in pdf["cells"]], (int(x["a"]), int(x["b"])), (int(x["c"]), int(x["d"])))
        return pdf[["key", "chunk"]].assign(a=[p[0] for p in path[:-1]], b=[p[1] for p in path[:-1]], c=[p[0] for p in path[1:]], d=[p[1] for p in path[1:]])

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            rows = []
            for left, body, right, a, b, c, d in zip(*(batch.column(i).to_pylist() for i in range(3, 10))):
                rows.append(own.trace(left, body, right, (a, b), (c, d))[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], list_column(rows)], ["doc_id", "key", "chunk", "ids"])

    keyed = docs.select(F.col(id_col), F.monotonically_increasing_id().alias("key"), F.col(text_col))
    chunks = bounded_batches(keyed).mapInArrow(cut, f"doc_id {kind}, key bigint, chunk int, last int, l string, body string, r string")
    chunks = written(chunks.repartition("key", "chunk"), "piece-chunks")
    matrices = written(bounded_batches(chunks.select("key", "chunk", "l", "body", "r")).mapInArrow(transfer, f"key bigint, chunk int, cells {CELLS_SQL}"), "piece-matrices").withColumn("run", F.floor(F.col("chunk") / RUN).cast("int"))
    runs = matrices.groupBy("key", "run").applyInPandas(run_product, f"key bigint, run int, cells {CELLS_SQL}")
    between = runs.groupBy("key").applyInPandas(run_states, "key bigint, run int, a int, b int, c int, d int")
    states = matrices.join(between, ["key", "run"]).groupBy("key", "run").applyInPandas(chunk_states, "key bigint, chunk int, a int, b int, c int, d int")
    traced_chunks = chunks.join(states, ["key", "chunk"]).select("doc_id", "key", "chunk", "l", "body", "r", "a", "b", "c", "d").mapInArrow(traced, f"doc_id {kind}, key bigint, chunk int, ids array<int>")
    whole = traced_chunks.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])).alias("ids"))
    return whole.select("doc_id", "ids")


def encode(docs: DataFrame, *, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", giant_chars: int = GIANT_CHARS, chunk_chars: int = CHUNK_CHARS, search: int = SEARCH) -> DataFrame:
    """One row per document: doc_id, ids."""
    path = model or default_vocabulary()
    giant = F.coalesce(F.length(text_col), F.lit(0)) > giant_chars
    small = docs.where(~giant).select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
    return encode_small(small, id_col, text_col, path).unionByName(encode_giant(docs.where(giant), id_col, text_col, path, chunk_chars, search))


def decode(encoded: DataFrame, *, model: str | None = None) -> DataFrame:
    """(doc_id, ids) to (doc_id, text)."""
    path = model or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path).library
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.decode(batch.column(1).to_pylist(), num_threads=1), pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return bounded_batches(encoded.select("doc_id", "ids")).mapInArrow(run, f"doc_id {kind}, text string")


def digest(encoded: DataFrame, *, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), text_sha256 and text_bytes (of the decoded text in UTF-8)."""
    path = model or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path).library
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                ids = part.column(1)
                values, at = ids.values.to_numpy().astype("<i4", copy=False), ids.offsets.to_numpy().tolist()
                rows = [values[a:b] for a, b in zip(at[:-1], at[1:])]
                texts = [t.encode() for t in own.decode([r.tolist() for r in rows], num_threads=1)]
                columns = [pa.array([len(r) for r in rows], pa.int64()), pa.array([zlib.crc32(r.tobytes()) for r in rows], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_tokens", "ids_crc32", "text_sha256", "text_bytes"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return bounded_batches(encoded.select("doc_id", "ids")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_crc32 bigint, text_sha256 string, text_bytes bigint")


def round_trip(docs: DataFrame, *, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Encodes and decodes every whole text."""
    return digest(encode(docs, model=model, id_col=id_col, text_col=text_col, **how), model=model)
