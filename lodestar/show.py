"""How results are shown: one line for each hit, blocks, and two result lists side by side or one under the other.

Lines are Column expressions. Blocks and pages take collected hits, of which there are as many as were asked for.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Mapping
from itertools import zip_longest

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.constants import VIA_LONG, VIA_SHORT
from lodestar.functions.text import basename

MOST_LINES = 40


def place(prefix: str, rank: Column) -> Column:
    return F.concat(F.lit(prefix), F.coalesce(rank.cast("string"), F.lit("-")))


def hit_line(tag: Column) -> Column:
    """rank, score, name, file and line of a hit with a metadata struct, and a tag."""
    return F.format_string("%d. %.4f %s  %s:%d  [%s]", F.col("rank"), F.col("score"), F.col("metadata.name"), basename(F.col("metadata.file")), F.col("metadata.start_line"), tag)


def hybrid_line() -> Column:
    """A hybrid hit in one line, with its place in each list."""
    return hit_line(F.concat_ws(" ", place("b", F.col("bm25_rank")), place("v", F.col("vector_rank"))))


def graph_line() -> Column:
    """A graph hit in one line, with how it was reached."""
    via = F.lower("via") == "seed"
    label = F.coalesce(F.create_map(*[F.lit(x) for pair in VIA_SHORT.items() for x in pair])[F.when(via, F.lit("seed")).otherwise(F.col("via"))], F.col("via"))
    return hit_line(F.when(via, label).otherwise(F.concat(label, F.col("hop").cast("string"))))


def named(node_id: str) -> str:
    return node_id.partition("::")[2] or node_id


def body_lines(text: str, most: int) -> list[str]:
    lines = (text or "").rstrip("\n").splitlines()
    rest = [f"… (+{len(lines) - most}줄, --full 로 전체 보기)"] if len(lines) > most else []
    return ["    " + "-" * 68, *("    | " + line for line in lines[:most] + rest)]


def block(hit: Mapping, details: list[str], *, body: bool, most: int) -> str:
    m = hit["metadata"]
    head = f"[{hit['rank']}] {hit['score']:.4f}  {m['file']}:{m['start_line']}-{m['end_line']}  {m['name']}  ({m['kind']})"
    return "\n".join([head, *("    " + d for d in details if d), *(body_lines(hit["text"], most) if body and hit["text"] else [])])


def quoted(m: Mapping) -> str:
    return f'"{m["docstring"]}"' if m.get("docstring") else ""


def hybrid_block(hit: Mapping, *, body: bool = False, most: int = MOST_LINES) -> str:
    """A hybrid hit with its figures, first line of documentation and, if asked for, its text."""
    figures = [f"bm25#{hit['bm25_rank'] or '-'}", f"vec#{hit['vector_rank'] or '-'}"]
    figures += [f"{name}={hit[key]:.{digits}f}" for name, key, digits in (("dist", "distance", 3), ("bm25", "bm25_score", 2)) if hit[key] is not None]
    return block(hit, ["  ".join(figures), quoted(hit["metadata"])], body=body, most=most)


def graph_block(hit: Mapping, *, body: bool = False, explain: bool = False, most: int = MOST_LINES) -> str:
    """A graph hit with how it was reached, its degrees, signature and, if asked for, its path and text."""
    m, seed = hit["metadata"], hit["via"].lower() == "seed"
    reached = VIA_LONG["seed"] if seed else f"{VIA_LONG.get(hit['via'], hit['via'])} · {hit['hop']}홉 · from {named(hit['seed'])}"
    path = "경로: " + " ─▶ ".join(map(named, hit["path"])) if explain and len(hit["path"]) > 1 else ""
    return block(hit, [f"{reached}   calls_out={m.get('calls_out')} called_by={m.get('called_by')} pr={hit['pagerank']}", m.get("signature") or "", quoted(m), path], body=body, most=most)


def columns_of(text: str) -> int:
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def fitted(text: str, width: int) -> str:
    """Exactly `width` columns of a terminal; a longer text ends in "…" where that fits."""
    if columns_of(text) > width:
        while text and columns_of(text) >= width:
            text = text[:-1]
        text += "…"
    return text + " " * (width - columns_of(text))


def overlap_lines(left: Mapping[str, int], right: Mapping[str, int]) -> list[str]:
    """What two results share, by the sum of the ranks, and what each has alone; keys are "file::name"."""
    both = sorted(left.keys() & right.keys(), key=lambda k: (left[k] + right[k], left[k]))
    listed = lambda names: ", ".join(names) or "—"
    return [f"\n공통 {len(both)}: " + listed(f"{named(k)}(v{left[k]}/g{right[k]})" for k in both), "vector 고유: " + listed(named(k) for k in left if k not in right), "graph  고유: " + listed(named(k) for k in right if k not in left)]


def keyed(hits: Iterable[Mapping]) -> dict[str, int]:
    return {f"{h['metadata']['file']}::{h['metadata']['name']}": h["rank"] for h in hits}


def side_by_side(query: str, left: list[str], right: list[str], shared: list[str], width: int) -> str:
    """Two lists of lines in columns of `width`, and what they share."""
    rule = 2 * width + 3
    rows = [("▎VECTOR  (BM25 + 벡터 RRF)", "▎GRAPH  (씨앗 + 엣지 확장)"), ("", ""), *zip_longest(left, right, fillvalue="")]
    return "\n".join(["\n" + "=" * rule, f"질의: {query!r}", "-" * rule, *(f"{fitted(a, width)} | {b}" for a, b in rows), *shared])


def stacked(query: str, left: list[str], right: list[str], shared: list[str]) -> str:
    """Two lists of blocks, one under the other, and what they share."""
    part = lambda title, blocks: [f"── {title} " + "─" * 40, *(line for b in blocks for line in (b, ""))]
    return "\n".join(["\n" + "=" * 78, f"질의: {query!r}", "=" * 78, "", *part("VECTOR (BM25 + 벡터 RRF)", left), *part("GRAPH (씨앗 + 엣지 확장)", right), *shared])
