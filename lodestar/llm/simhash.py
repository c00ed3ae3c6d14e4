"""SimHash near-dedup by a segment-popcount embedding.

Fingerprints: 64 bits per document, from XXH64 of its word shingles, in numpy; each text is read once.

Links. Equal fingerprints form classes first, so copies never meet as pairs. A fingerprint is cut into 32
segments of 2 bits, and each segment is mapped to its bit count. The Manhattan distance of two such
vectors never exceeds the Hamming distance of the fingerprints. Written in unary (0: 00, 1: 01, 2: 11),
the vector is again 64 bits wide and Manhattan distance is the bit count of an exclusive or. The grid:
coordinates are dealt to `groups` groups; two vectors within distance k differ in at most k groups, so
they share a cell in at least one choice of groups - k groups. Cells are joined by equality (one row per
fingerprint and choice), the join's own condition keeps pairs within Manhattan distance k, then those
within Hamming distance k, and a pair is emitted for its first common choice alone. Every `groups` gives
the same links; more groups make cells smaller and rows more numerous, and grid_groups() picks them by
the number of fingerprints so that the pairs compared per fingerprint stay bounded.

Components. Of the links only enough are made to connect what any of them connects: a cell's members are
compared with one of them first, then those not yet tied to its bulk with the others. So a template with n
variants gives about n links, not n * n. Fingerprints are the nodes; ids come in at the end. links() lists
every pair, for those who want them.

similar_dedup(), the stage of the corpus pipeline, takes 5-word shingles and a Jaccard similarity of 0.8.

Defined results. Null counts as empty; texts without words have fingerprint zero and link like any other.
Texts of any length are read whole. A null id never represents a group unless all its ids are null; such a
group has a null component. Repeated rows get equal results. An empty table gives an empty result. Extra
columns are not read (near_dedup and similar_dedup return them unchanged).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import jaccard as sets
from .common import bounded_batches, scratch, shingle_hashes, transient, written
from .components import linked, small
from .jaccard import signed

SEED, SHINGLE, DISTANCE = 42, 4, 4
SEGMENTS = 32
LOW_BITS = 0x5555555555555555


def majority(hashes: np.ndarray) -> int:
    """64 bits, bit i set if it is set in more than half of the hashes; 0 for none."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The majority of the hashes of the word shingles, repeats included."""
    return majority(shingle_hashes(text, shingle, SEED))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return bounded_batches(docs.select(id_col, text_col)).mapInArrow(run, f"doc_id {kind}, fp bigint")


def unary_popcounts(fp: Column) -> Column:
    """The bit counts of the 32 two-bit segments, each written in unary in its two bits."""
    low, high = fp.bitwiseAND(F.lit(LOW_BITS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW_BITS))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def grid_groups(fingerprints_n: int, distance: int = DISTANCE) -> int:
    """The number of coordinate groups. A further group costs more rows per fingerprint and makes random meetings about ten times rarer; this keeps them at about a thousand per fingerprint."""
    groups = distance + 2
    while fingerprints_n > 5_000_000 * 10 ** (groups - distance - 2) and groups < distance + 5:
        groups += 1
    return groups


def grid(distance: int, groups: int) -> list[tuple[int, list[int]]]:
    """For each choice of groups - distance groups: (mask of its bits, masks of the groups before its last that it leaves out)."""
    masks = []
    for g in range(groups):
        segments = range(g * SEGMENTS // groups, (g + 1) * SEGMENTS // groups)
        masks.append(sum(3 << (2 * s) for s in segments))
    return [(signed(sum(masks[g] for g in choice)), [signed(masks[g]) for g in range(choice[-1]) if g not in choice]) for choice in combinations(range(groups), groups - distance)]


def links(classes: DataFrame, *, distance: int = DISTANCE, groups: int | None = None) -> DataFrame:
    """(fp, rep) with distinct fingerprints to (a, b): every pair of representatives whose fingerprints differ in at most `distance` bits, once."""
    choices = grid(distance, groups or grid_groups(classes.count(), distance))
    skipped = max(len(s) for _, s in choices)
    t = unary_popcounts(F.col("fp"))
    cell = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("t").bitwiseAND(F.lit(m)).alias("cell")) for i, (m, _) in enumerate(choices)]))
    side = classes.where("rep IS NOT NULL").select("fp", "rep", t.alias("t")).select("fp", "rep", "t", cell.alias("c")).select("fp", "rep", "t", "c.choice", "c.cell")
    left = side.select(*[F.col(c).alias(f"l_{c}") for c in side.columns])
    right = side.select(*[F.col(c).alias(f"r_{c}") for c in side.columns])
    apart = F.col("l_t").bitwiseXOR(F.col("r_t"))
    on = (F.col("l_choice") == F.col("r_choice")) & (F.col("l_cell") == F.col("r_cell")) & (F.col("l_fp") < F.col("r_fp"))
    on &= F.bit_count(apart) <= distance
    on &= F.bit_count(F.col("l_fp").bitwiseXOR(F.col("r_fp"))) <= distance
    for k in range(skipped):  # an earlier choice would hold this pair if a group left out agreed
        by_choice = F.get(F.array(*[F.lit(s[k] if k < len(s) else None).cast("long") for _, s in choices]), F.col("l_choice"))
        on &= by_choice.isNull() | (apart.bitwiseAND(by_choice) != 0)
    return left.join(right, on).select(F.col("l_rep").alias("a"), F.col("r_rep").alias("b"))


def grid_cells(distance: int, groups: int) -> Callable[[DataFrame], DataFrame]:
    """(key, fp, comp) to (cell, key, fp, comp): a row for each cell of the grid that a fingerprint lies in. A cell is known by a hash of its choice and its counts."""
    masks = [m for m, _ in grid(distance, groups)]
    cells = F.array(*[F.xxhash64(F.lit(i), unary_popcounts(F.col("fp")).bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])
    return lambda rows: rows.select(F.explode(cells).alias("cell"), "key", "fp", "comp")


def within(distance: int) -> Callable[[str, str], Column]:
    """Whether two fingerprints are within the distance: by the bound on their bit counts, then by themselves."""
    apart = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= distance
    return lambda a, b: apart(unary_popcounts(F.col(f"{a}.fp")), unary_popcounts(F.col(f"{b}.fp"))) & apart(F.col(f"{a}.fp"), F.col(f"{b}.fp"))


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, groups: int | None = None) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest id reachable over links, its own included)."""
    spark = docs.sparkSession
    marked = written(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    path = scratch(spark, "components")
    with transient(spark):
        cells = grid_cells(distance, groups or grid_groups(classes.count(), distance))
        roots = linked(classes.select(F.col("fp").alias("key"), "fp"), cells, within(distance), label="simhash")
        roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        tied = classes.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "rep")
        tied.join(tied.groupBy("root").agg(F.min("rep").alias("least")), "root").select("fp", "least").write.parquet(path)
    by_fp = classes.join(spark.read.parquet(path), "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"))
    return marked.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents that represent their group, with all their columns."""
    found = near_groups(docs, id_col=id_col, text_col=text_col, **how)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept_id"]), "left_semi")


def similar_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every group of texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more the smallest id, with all its columns.

    Fingerprints of the 5-word shingles go through the grid, and the pairs that its first round finds are
    verified by their sets. Similar texts may differ in more bits than a grid can span (about 10 of 64 at
    0.8), so what it leaves apart is joined on shingles, exactly (see jaccard.py).
    """
    spark = docs.sparkSession
    path = scratch(spark, "kept")
    with transient(spark):
        marked = sets.prefixes(docs, majority, id_col=id_col, text_col=text_col)
        check = lambda pairs: sets.verified(sets.sifted(pairs, marked), marked, docs, text_col)
        prints = written(marked.groupBy("key").agg(F.min("fp").alias("fp")), "prints")
        cells = grid_cells(DISTANCE, grid_groups(prints.count(), DISTANCE))
        roots = linked(prints, cells, within(DISTANCE), verified=check, whole=False, label="simhash")
        shared, cells, with_sketches = sets.shared_cells(marked)
        whole = (with_sketches, sets.possible_by_sketch)
        roots = linked(shared, cells, sets.possible, verified=check, roots=roots, stars=2, whole=whole, label="shingles")
        placed = marked.select("doc_id", "key").join(small(roots), F.col("key") == F.col("node"), "left")
        kept = placed.groupBy(F.coalesce("root", "key").alias("comp")).agg(F.min("doc_id").alias("_kept_id"))
        kept.select("_kept_id").distinct().write.parquet(path)
    kept = spark.read.parquet(path)
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept_id"]), "left_semi")
