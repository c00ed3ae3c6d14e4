"""Command line: chunk, index, graph, search, graph-search, compare and interactive sessions."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestar import show
from lodestar.constants import KINDS
from lodestar.operators import embedding, symbols
from lodestar.operators.fusion import HybridSearcher
from lodestar.operators.graph import GraphSearcher
from lodestar.sources import files, sinks
from lodestar.storage import written


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestar")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("repl", "graph-repl"):
        p = sub.add_parser(name)
        p.add_argument("path")
        p.add_argument("question", nargs="*", help="answer this one question and end")
        p.add_argument("-k", type=int, default=5)
        p.add_argument("--vectors", help="folder of vectors that index wrote")
        p.add_argument("--full", action="store_true")
    p = sub.add_parser("index", help="vectors of chunks, upserted by id")
    p.add_argument("path")
    p.add_argument("out")
    p.add_argument("--reset", action="store_true", help="start over instead of adding to what is there")
    p.add_argument("--query", help="search for this afterwards")
    for name in ("chunk", "graph"):
        p = sub.add_parser(name)
        p.add_argument("root")
        p.add_argument("out")
        p.add_argument("--class-mode", choices=["methods", "full"], default="methods")
        p.add_argument("--min-lines", type=int, default=0)
    for name, k in (("search", 8), ("graph-search", 8), ("compare", 5)):
        p = sub.add_parser(name)
        p.add_argument("path")
        p.add_argument("query", help="a query, or for compare a file of queries")
        p.add_argument("-k", type=int, default=k)
        p.add_argument("--kind", action="append")
        p.add_argument("--file")
        p.add_argument("--full", action="store_true")
        p.add_argument("--depth", type=int, default=2)
        p.add_argument("--decay", type=float, default=0.5)
        p.add_argument("--graph", help="folder of the graph, for compare")
        p.add_argument("--vectors", help="folder of vectors that index wrote")
        p.add_argument("--pool", type=int, default=40)
        p.add_argument("--rrf-k", type=int, default=60)
        p.add_argument("--w-bm25", type=float, default=1.0)
        p.add_argument("--w-vec", type=float, default=1.0)
        p.add_argument("--json", action="store_true")
        p.add_argument("--stacked", action="store_true", help="for compare: blocks, one list under the other")
        p.add_argument("--width", type=int, default=60)
        only = p.add_mutually_exclusive_group()
        only.add_argument("--bm25-only", action="store_true")
        only.add_argument("--vector-only", action="store_true")
    return top


class Session:
    """An interactive search: lines that begin with ":" set what follows, others are queries."""

    HELP = ":n K  :kind NAMES  :file PART  :depth N  :decay X  :bm25  :vec  :both  :full  :reset  :quit"

    def __init__(self, searcher, graph: bool, blocks: bool = False):
        """blocks: hits are shown as blocks of text, else as JSON."""
        self.searcher, self.graph, self.blocks = searcher, graph, blocks
        self.reset()

    def reset(self) -> None:
        self.k, self.kinds, self.file, self.full, self.depth, self.decay, self.mode = 5, None, None, False, 2, 0.5, "both"

    def command(self, line: str) -> str:
        name, _, value = line[1:].partition(" ")
        value = value.strip()
        if name == "n":
            self.k = max(1, int(value))
        elif name == "kind":
            kinds = [x for x in value.replace(",", " ").split()]
            if bad := set(kinds) - set(KINDS):
                return f"unknown kinds: {', '.join(sorted(bad))}; what was set stays"
            self.kinds = kinds or None
        elif name == "file":
            self.file = value or None
        elif name == "depth":
            self.depth = int(value)
        elif name == "decay":
            self.decay = float(value)
        elif name in ("bm25", "vec", "vector", "both") and not self.graph:
            if name in ("vec", "vector") and self.searcher.vectors is None:
                return "no vectors to search; what was set stays"
            self.mode = "vec" if name == "vector" else name
            return f"retrievers: {self.mode}"
        elif name == "full":
            self.full = not self.full
        elif name == "reset":
            self.reset()
        else:
            return self.HELP
        return f"n={self.k} kinds={self.kinds} file={self.file} full={self.full} depth={self.depth} decay={self.decay}"

    def answer(self, line: str) -> list[str]:
        how = {"depth": self.depth, "decay": self.decay} if self.graph else {"bm25_only": self.mode == "bm25" or self.searcher.vectors is None, "vector_only": self.mode == "vec"}
        hits = self.searcher.search(line, k=self.k, kinds=self.kinds, file_sub=self.file, **how)
        if self.blocks:
            return shown(hits, self.graph, body=True, most=10**9 if self.full else show.MOST_LINES)
        return [r.json for r in sinks.result_json(hits, self.full).collect()]

    def run(self, lines) -> None:
        for line in map(str.strip, lines):
            if line in (":quit", ":q"):
                return
            if line:
                print("\n".join([self.command(line)] if line.startswith(":") else self.answer(line) or ["no hits"]))


def shown(hits, graph: bool, **how) -> list[str]:
    """Hits as blocks; there are as many as were asked for."""
    rows = [r.asDict(recursive=True) for r in hits.collect()]
    return [(show.graph_block(r, explain=True, **how) if graph else show.hybrid_block(r, **how)) for r in rows]


def hybrid_searcher(spark: SparkSession, path: str, vectors: str | None) -> HybridSearcher:
    return HybridSearcher(files.chunk_file(spark, path), spark.read.parquet(vectors) if vectors else None, lambda q: embedding.query_vector(spark, q))


def index(spark: SparkSession, path: str, out: str, reset: bool = False) -> int:
    """Writes the vectors of a chunk file, replacing those of the same id; the number of vectors then."""
    found = embedding.embedded(files.chunk_file(spark, path), F.col("text")).select("id", "embedding").withColumn("seq", F.monotonically_increasing_id())
    existing = written(spark.read.parquet(out), "vectors") if not reset and exists(spark, out) else None
    sinks.write_vectors(existing, found, out, reset=reset)
    return spark.read.parquet(out).count()


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def compare_files(spark: SparkSession, args) -> None:
    """The queries of a file, answered by both searchers and shown together."""
    hybrid, graph = hybrid_searcher(spark, args.path, args.vectors), graph_searcher(spark, args.graph)
    for row in files.query_list(spark, args.query).collect():
        left = hybrid.search(row.query, k=args.k, kinds=args.kind, file_sub=args.file, bm25_only=args.vectors is None)
        right = graph.search(row.query, k=args.k, kinds=args.kind, file_sub=args.file, depth=args.depth, decay=args.decay)
        left, right = written(left, "left").orderBy("rank"), written(right, "right").orderBy("rank")
        shared = show.overlap_lines(*(show.keyed(r.asDict(recursive=True) for r in hits.collect()) for hits in (left, right)))
        if args.stacked:
            how = {"body": args.full, "most": 10**9 if args.full else 12}
            print(show.stacked(row.query, shown(left, False, **how), shown(right, True, **how), shared))
        else:
            lines = [[r.line for r in hits.orderBy("rank").select(line.alias("line")).collect()] for hits, line in ((left, show.hybrid_line()), (right, show.graph_line()))]
            print(show.side_by_side(row.query, *lines, shared, args.width))


def graph_searcher(spark: SparkSession, path: str) -> GraphSearcher:
    return GraphSearcher(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lodestar").getOrCreate()
    if args.command == "chunk":
        found = symbols.chunks(files.source_files(spark, args.root, [".py"]), args.class_mode)
        sinks.write_jsonl(found.where(F.col("error").isNull() & (F.col("metadata.n_lines") >= args.min_lines)).drop("error"), args.out)
    elif args.command == "graph":
        nodes, edges = build_graph(spark, args.root)
        sinks.write_graph(nodes, edges, args.out)
        sinks.graph_meta(nodes, edges).show(truncate=False)
    elif args.command == "index":
        print(f"{index(spark, args.path, args.out, args.reset)} vectors")
        if args.query:
            print("\n".join(shown(hybrid_searcher(spark, args.path, args.out).search(args.query, k=5, vector_only=True), False)))
    elif args.command in ("repl", "graph-repl"):
        graph = args.command == "graph-repl"
        session = Session(graph_searcher(spark, args.path) if graph else hybrid_searcher(spark, args.path, args.vectors), graph, blocks=True)
        session.k, session.full = args.k, args.full
        session.run([" ".join(args.question)] if args.question else sys.stdin)
    elif args.command in ("search", "graph-search"):
        graph = args.command == "graph-search"
        if graph:
            hits = graph_searcher(spark, args.path).search(args.query, k=args.k, kinds=args.kind, file_sub=args.file, depth=args.depth, decay=args.decay)
        else:
            how = {"pool": args.pool, "rrf_k": args.rrf_k, "w_bm25": args.w_bm25, "w_vec": args.w_vec, "bm25_only": args.bm25_only or args.vectors is None, "vector_only": args.vector_only}
            hits = hybrid_searcher(spark, args.path, args.vectors).search(args.query, k=args.k, kinds=args.kind, file_sub=args.file, **how)
        print("\n".join([r.json for r in sinks.result_json(hits, args.full).collect()] if args.json else shown(hits, graph, body=args.full, most=10**9)))
    else:
        compare_files(spark, args)


def build_graph(spark: SparkSession, root: str):
    """(nodes, edges) of a folder's Python and JavaScript files, with degrees, places and edge order."""
    from lodestar.operators.graph import degrees

    nodes, edges = symbols.united(symbols.python_graph(files.source_files(spark, root, [".py"])), symbols.js_graph(files.source_files(spark, root, [".js", ".gs"])))
    return symbols.placed(nodes.join(degrees(nodes, edges), "id")), edges


if __name__ == "__main__":
    main()
