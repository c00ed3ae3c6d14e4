"""Connected components of an edge table, and links within cells, in rounds of joins on thin rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, small_enough, transient, written

#: Thin rows up to which a side is broadcast; more are joined by shuffle.
MOST_BROADCAST = 500_000


def small(rows: DataFrame) -> DataFrame:
    """To be broadcast, if it was counted to be small."""
    return F.broadcast(rows) if small_enough(rows, MOST_BROADCAST) else rows


def connected_components(edges: DataFrame, *, max_rounds: int = 100) -> DataFrame:
    """(a, b) edges between comparable ids to (node, root): root is the smallest id reachable. Nodes without an edge to another node are not listed.

    Alternates the two star operations: every node first ties its larger neighbours to the smallest
    id around it, then its smaller neighbours and itself. Each round is written to the shared folder,
    so lineage stays short. Minima are aggregates with map-side combination; the joins that follow are
    plain equi-joins on the node, which adaptive execution splits where a node has very many edges.
    """
    spark, path = edges.sparkSession, scratch(edges.sparkSession, "components")
    with transient(spark):
        edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        state = None
        for _ in range(max_rounds if not edges.isEmpty() else 0):
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
            large = written(large, "large-star")
            low = large.groupBy("a").agg(F.min("b").alias("m"))
            edges = written(large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "small-star")
            now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
            if now == state:
                break
            state = now
        else:
            if state is not None:
                raise RuntimeError("components did not settle")
        edges.select(F.col("a").alias("node"), F.col("b").alias("root")).write.parquet(path)
    return spark.read.parquet(path)


def merged(roots: DataFrame | None, links: DataFrame, label: str) -> DataFrame:
    """(node, root) after more (a, b) links: only what they add to the components, as links between these, is searched for components."""
    if roots is None:
        return connected_components(links)
    of = small(roots)
    for c in ("a", "b"):
        links = links.join(of, F.col(c) == F.col("node"), "left").withColumn(c, F.coalesce("root", c)).drop("node", "root")
    new = connected_components(links)
    moved = roots.join(small(new.select(F.col("node").alias("_from"), F.col("root").alias("_to"))), F.col("root") == F.col("_from"), "left")
    return written(moved.select("node", F.coalesce("_to", "root").alias("root")).unionByName(new), f"{label}-roots")


def linked(rows: DataFrame, cells: Callable[[DataFrame], DataFrame], near: Callable[[str, str], Column], *, verified: Callable[[DataFrame], DataFrame] | None = None, roots: DataFrame | None = None, stars: int = 1, whole: bool | tuple[Callable[[DataFrame], DataFrame], Callable[[str, str], Column]] = True, label: str = "links") -> DataFrame:
    """(node, root): the components of the keys that share a cell and are linked; root is the smallest key reachable, and itself not listed.

    rows: a row per key with what cells(rows) needs to give (cell, key, comp, …), a row per cell of a key,
    and what near(l, r) reads; near says whether the rows under the aliases l and r may be linked; verified
    keeps the true links of (a, b) pairs, where near alone does not decide. `roots` are components that are
    known before.

    First, `stars` times, every cell's members are compared with one of them, one of two that are drawn for
    each round among those of a large group, which ties most of the group at linear cost. Then, if links are
    to be `whole`, members that are not yet connected with the bulk of their cell, the component of the one,
    are compared with all members of other components: pairs of one component are never made, so n texts
    that are all alike give about n links and not n * n. In place of True, `whole` may be what adds columns to
    the members that come so far, and a sharper `near` that reads them: rows stay thin until then.
    """
    for turn in range(stars + bool(whole)):
        now = rows.withColumn("comp", F.col("key"))
        if roots is not None:
            now = rows.join(small(roots), F.col("key") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "key")).drop("node", "root")
        now = cells(now)
        others = [c for c in now.columns if c != "cell"]
        drawn = F.xxhash64(F.lit(turn), F.col("cell").bitwiseAND(F.lit(1)), F.col("key")).alias("_drawn")
        centre = now.groupBy("cell").agg(F.min(F.struct(drawn, *others)).alias("_one"), (F.min("comp") != F.max("comp")).alias("_spread")).where("_spread").select("cell", "_one.*").drop("_drawn")
        if turn == stars:
            now = written(now.join(centre.select("cell", F.col("comp").alias("_bulk")), "cell"), f"{label}-members")
            if isinstance(whole, tuple):
                now, near = written(whole[0](now), f"{label}-wide"), whole[1]
            left = now.where("comp <> _bulk")
        else:
            left = centre
        met = left.alias("l").join(now.alias("r"), (F.col("l.cell") == F.col("r.cell")) & (F.col("l.comp") != F.col("r.comp")) & near("l", "r"))
        met = met.select(F.least("l.key", "r.key").alias("a"), F.greatest("l.key", "r.key").alias("b")).distinct()
        roots = merged(roots, verified(met) if verified else written(met, label), label)
    return roots
