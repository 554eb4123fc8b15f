"""Graphs as DOT, Mermaid or JSON: (part, ord, line) tables, sorted by ids."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import nodes_of
from ..operators.order import numbered

_LABEL = {"Imports": "", "References": "references", "Extends": "extends", "Implements": "implements"}


def _escaped(c: str) -> Column:
    return F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def _mermaid(c: Column) -> Column:
    for mark, code in {"\\": "\\\\", '"': "#quot;", "[": "#91;", "]": "#93;", "|": "#124;", "(": "#40;", ")": "#41;", "{": "#123;", "}": "#125;"}.items():
        c = F.replace(c, F.lit(mark), F.lit(code))
    return c


def _label() -> Column:
    out = F.lower("kind")
    for k, v in _LABEL.items():
        out = F.when(F.col("kind") == k, v).otherwise(out)
    return out


def dot_lines(edges: DataFrame) -> DataFrame:
    """(part, a, b, line) of a DOT document's nodes (0) and edges (1)."""
    n = nodes_of(edges).select(F.lit(0).alias("part"), F.col("id").alias("a"), F.lit("").alias("b"), F.concat(F.lit('  "'), _escaped("id"), F.lit('" [label="'), _escaped("label"), F.lit('"];')).alias("line"))
    label = F.when(_label() == "", "").otherwise(F.concat(F.lit(' [label="'), _label(), F.lit('"]')))
    e = edges.select(F.lit(1), "src", F.concat_ws("\n", "dst", "kind"), F.concat(F.lit('  "'), _escaped("src"), F.lit('" -> "'), _escaped("dst"), F.lit('"'), label, F.lit(";")))
    return n.union(e)


def mermaid_lines(edges: DataFrame) -> DataFrame:
    """(part, a, b, line); a node's name is n and its place in the order of ids, so no two meet."""
    n = numbered(nodes_of(edges), [F.col("id")], "at", 0).select("id", "label", F.concat(F.lit("n"), "at").alias("name"))
    out = n.select(F.lit(0).alias("part"), F.col("id").alias("a"), F.lit("").alias("b"), F.concat(F.lit("  "), "name", F.lit('["'), _mermaid(F.col("label")), F.lit('"]')).alias("line"))
    arrow = F.when(_label() == "", "-->").when(F.col("kind") == "References", "-.->|references|").otherwise(F.concat(F.lit("-->|"), _label(), F.lit("|")))
    e = edges.join(n.select(F.col("id").alias("src"), F.col("name").alias("x")), "src").join(n.select(F.col("id").alias("dst"), F.col("name").alias("y")), "dst")
    return out.union(e.select(F.lit(1), "src", F.concat_ws("\n", "dst", "kind"), F.concat(F.lit("  "), "x", F.lit(" "), arrow, F.lit(" "), "y")))


_FRAMES = {"dot": (dot_lines, ["digraph dependencies {", "  rankdir=LR;", "  node [shape=box];", ""], ["}"]), "mermaid": (mermaid_lines, ["```mermaid", "graph LR"], ["```"])}


def render(edges: DataFrame, how: str):
    """The document's lines: dot, mermaid or json."""
    if how == "json":
        yield '{"nodes": ['
        yield from _separated(nodes_of(edges).orderBy("id").select("id", "label"))
        yield '], "edges": ['
        yield from _separated(edges.orderBy("src", "dst", "kind").select(F.col("src").alias("from"), F.col("dst").alias("to"), "kind"))
        yield "]}"
        return
    make, top, end = _FRAMES[how]
    yield from top
    for r in make(edges).orderBy("part", "a", "b").toLocalIterator():
        yield r.line
    yield from end


def _separated(df: DataFrame):
    held = None
    for r in df.toLocalIterator():
        if held is not None:
            yield held + ","
        held = json.dumps(r.asDict(), ensure_ascii=False)
    if held is not None:
        yield held
