"""Text forms of graphs: JSON, DOT, Mermaid, byte stream, terminal drawings, type stubs.

The line forms stay distributed (a DataFrame of lines); whole documents are for graphs that a reader looks at.
"""

from __future__ import annotations

import json
import keyword
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.errors import GraphError, TooLargeError
from arbora.graph import Graph

NODE = "name string, payload string"
EDGE = "`from` string, `to` string, weight double, label string"


def json_lines(g: Graph) -> DataFrame:
    """kind, line: a JSON object per node and edge (nulls left out)."""
    n = g.nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("name", "payload")).alias("line"))
    e = g.edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "weight", "label")).alias("line"))
    return n.unionByName(e)


def to_json(g: Graph, payloads: bool = True) -> str:
    """One JSON document {nodes, edges}; metadata isn't written."""
    fields = ["name", "payload"] if payloads else ["name"]
    nodes = [json.loads(r[0]) for r in g.nodes.orderBy("ord", "name").select(F.to_json(F.struct(*fields))).toLocalIterator()]
    edges = [json.loads(r[0]) for r in g.edges.orderBy("edge_id", "src", "dst").select(F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "weight", "label"))).toLocalIterator()]
    return json.dumps({"nodes": nodes, "edges": edges}, indent=2, ensure_ascii=False)


def from_json(spark: SparkSession, text: str) -> Graph:
    doc = F.from_json(F.lit(text), f"nodes array<struct<{NODE.replace(' ', ':').replace(',:', ',')}>>, edges array<struct<from:string,to:string,weight:double,label:string>>")
    one = spark.range(1).select(doc.alias("d"))
    nodes = one.select(F.posexplode("d.nodes").alias("ord", "n")).select("n.name", "n.payload", "ord")
    edges = one.select(F.posexplode("d.edges").alias("edge_id", "e")).select(F.col("e.from").alias("src"), F.col("e.to").alias("dst"), "e.weight", "e.label", "edge_id")
    return Graph(nodes, edges)


def dot_lines(g: Graph) -> DataFrame:
    """kind, line of a DOT document; an edge shows its label, else its weight if not 1."""
    text = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    shown = F.coalesce("label", F.when(F.col("weight") != 1, F.col("weight").cast("string")))
    tail = F.when(shown.isNotNull(), F.concat(F.lit(" [label="), text(shown), F.lit("]"))).otherwise("")
    n = g.nodes.select(F.lit("node").alias("kind"), F.concat(F.lit("  "), text(F.col("name")), F.lit(";")).alias("line"))
    return n.unionByName(g.edges.select(F.lit("edge").alias("kind"), F.concat(F.lit("  "), text(F.col("src")), F.lit(" -> "), text(F.col("dst")), tail, F.lit(";")).alias("line")))


def to_dot(g: Graph) -> str:
    return "digraph {\n" + "\n".join(r[0] for r in dot_lines(g).orderBy(F.desc("kind"), "line").select("line").toLocalIterator()) + "\n}\n"


def mermaid_lines(g: Graph) -> DataFrame:
    label = F.when(F.col("label").isNotNull(), F.concat(F.lit('-->|"'), "label", F.lit('"| '))).otherwise("--> ")
    n = g.nodes.select(F.lit("node").alias("kind"), F.concat(F.lit("    "), "name", F.lit('["'), "name", F.lit('"]')).alias("line"))
    return n.unionByName(g.edges.select(F.lit("edge").alias("kind"), F.concat(F.lit("    "), "src", F.lit(" "), label, "dst").alias("line")))


def to_mermaid(g: Graph) -> str:
    return "graph TD\n" + "\n".join(r[0] for r in mermaid_lines(g).orderBy(F.desc("kind"), "line").select("line").toLocalIterator()) + "\n"


# ---- byte stream: counts and length-prefixed UTF-8 strings, little-endian ----


def put_text(text: str | None) -> bytes:
    if text is None:
        return b"\0"
    raw = text.encode("utf-8")
    return b"\1" + struct.pack("<Q", len(raw)) + raw


def to_bytes(g: Graph) -> bytes:
    out = []
    nodes = list(g.nodes.orderBy("ord", "name").select("name", "payload").toLocalIterator())
    out.append(struct.pack("<Q", len(nodes)))
    out += [put_text(r[0]) + put_text(r[1]) for r in nodes]
    edges = list(g.edges.orderBy("edge_id", "src", "dst").select("src", "dst", "weight", "label").toLocalIterator())
    out.append(struct.pack("<Q", len(edges)))
    out += [put_text(r[0]) + put_text(r[1]) + struct.pack("<d", r[2]) + put_text(r[3]) for r in edges]
    return b"".join(out)


def byte_rows(raw: bytes) -> tuple[list[tuple], list[tuple]]:
    """(name, payload) of the nodes and (src, dst, weight, label) of the edges of a byte stream."""
    at = 0

    def take(fmt: str):
        nonlocal at
        if at + struct.calcsize(fmt) > len(raw):
            raise GraphError("the byte stream ends too soon")
        (v,) = struct.unpack_from(fmt, raw, at)
        at += struct.calcsize(fmt)
        return v

    def text() -> str | None:
        nonlocal at
        if not take("<B"):
            return None
        n = take("<Q")
        if at + n > len(raw):
            raise GraphError("the byte stream ends too soon")
        at += n
        return raw[at - n : at].decode("utf-8")

    nodes = [(text(), text()) for _ in range(take("<Q"))]
    return nodes, [(text(), text(), take("<d"), text()) for _ in range(take("<Q"))]


def from_bytes(spark: SparkSession, raw: bytes) -> Graph:
    nodes, edges = byte_rows(raw)
    n = spark.createDataFrame([(*r, k) for k, r in enumerate(nodes)], "name string, payload string, ord long")
    return Graph(n, spark.createDataFrame([(*r, k) for k, r in enumerate(edges)], "src string, dst string, weight double, label string, edge_id long"))


# ---- for people ----


def pretty(layers: list[list[str]], max_nodes: int = 50, horizontal: bool = False) -> str:
    """Layers of names as text; refuses larger graphs."""
    if sum(map(len, layers)) > max_nodes:
        raise TooLargeError(f"more than {max_nodes} nodes to draw")
    if not layers:
        return "(empty graph)"
    if horizontal:
        return " --> ".join("{" + ", ".join(x) + "}" if len(x) > 1 else x[0] for x in layers)
    rows = ["   ".join(f"[{n}]" for n in x) for x in layers]
    width = max(map(len, rows))
    return "\n".join(line for k, r in enumerate(rows) for line in ([r.center(width).rstrip()] if k == 0 else ["|".center(width).rstrip(), "v".center(width).rstrip(), r.center(width).rstrip()]))


def to_svg(layers: list[list[str]], edges: list[tuple[str, str]]) -> str:
    """A plain SVG drawing of layers and edges."""
    from html import escape

    at = {n: (80 + 140 * k, 40 + 80 * y) for y, x in enumerate(layers) for k, n in enumerate(x)}
    w = 160 + 140 * max((len(x) for x in layers), default=1)
    lines = [f'<line x1="{at[a][0]}" y1="{at[a][1] + 15}" x2="{at[b][0]}" y2="{at[b][1] - 15}" stroke="black"/>' for a, b in edges]
    boxes = [f'<rect x="{x - 60}" y="{y - 15}" width="120" height="30" fill="white" stroke="black"/><text x="{x}" y="{y + 5}" text-anchor="middle">{escape(n)}</text>' for n, (x, y) in at.items()]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{w}" height="{80 * max(1, len(layers))}">{"".join(lines + boxes)}</svg>'


def generate_stub(names: list[str], types: dict[str, str] | None = None, cls: str = "Results") -> str:
    """A .pyi class with one attribute a node that is a valid identifier, and a lookup for all."""
    good = [n for n in names if n.isidentifier() and not keyword.iskeyword(n)]
    body = [f"    {n}: {(types or {}).get(n, 'Any')}" for n in good]
    over = [f"    @overload\n    def __getitem__(self, name: Literal[{n!r}]) -> {(types or {}).get(n, 'Any')}: ..." for n in names]
    return "\n".join(["from typing import Any, Literal, overload", "", f"class {cls}:", *(body + over or ["    ..."]), ""])
