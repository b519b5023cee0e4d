"""The node-selection language: text -> syntax tree -> one lazy DataFrame.

    expr  := diff ('|' diff)*        loosest
    diff  := both ('-' both)*
    both  := atom ('&' atom)*
    atom  := '(' expr ')' | roots | leaves | critical_path
           | (ancestors | descendants | predecessors | successors) '(' name ')'
           | (depth | in_degree | out_degree) op number
           | name ':' glob | name

All operators are left-associative.  Names with operator characters are written in quotes.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.errors import GraphError
from arbora.graph import Graph

_TOKEN = re.compile(r"\s*(?:(?P<op><=|>=|==|<|>)|(?P<sign>[|&()-])|(?P<quoted>\"[^\"]*\"|'[^']*')|(?P<word>[^\s|&()<>=\"'-]+))")
CALLS = ("ancestors", "descendants", "predecessors", "successors")
NUMBERS = ("depth", "in_degree", "out_degree")


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise GraphError(f"can't read {text[at:]!r}")
        kind = m.lastgroup
        out.append((kind, m[kind]))
        at = m.end()
    return out


def parse(text: str) -> tuple:
    """Nested tuples: ("|", a, b), ("-", a, b), ("&", a, b) and leaves like ("call", f, name)."""
    rest = tokens(text)
    if not rest:
        raise GraphError("empty expression")

    def take(kind: str | None = None, value: str | None = None) -> str:
        if not rest or (kind and rest[0][0] != kind) or (value and rest[0][1] != value):
            raise GraphError(f"expected {value or kind} in {text!r}")
        return rest.pop(0)[1]

    def name() -> str:
        kind, value = rest.pop(0) if rest else ("", "")
        if kind == "quoted":
            return value[1:-1]
        if kind != "word":
            raise GraphError(f"expected a name in {text!r}")
        return value

    def chain(sign: str, below) -> tuple:
        left = below()
        while rest and rest[0] == ("sign", sign):
            take()
            left = (sign, left, below())
        return left

    def expr() -> tuple:
        return chain("|", lambda: chain("-", lambda: chain("&", atom)))

    def atom() -> tuple:
        if rest and rest[0] == ("sign", "("):
            take()
            inner = expr()
            take("sign", ")")
            return inner
        quoted = bool(rest) and rest[0][0] == "quoted"
        word = name()
        if not quoted:
            if word in ("roots", "leaves", "critical_path"):
                return (word,)
            if word in CALLS and rest and rest[0] == ("sign", "("):
                take()
                arg = name()
                take("sign", ")")
                return ("call", word, arg)
            if word in NUMBERS and rest and rest[0][0] == "op":
                op = take("op")
                number = take("word")
                if not number.isdigit():
                    raise GraphError(f"expected a number in {text!r}")
                return ("number", word, op, int(number))
            if word.startswith("name:"):
                glob = word[5:] or name()
                return ("glob", glob)
        return ("name", word)

    tree = expr()
    if rest:
        raise GraphError(f"unexpected {rest[0][1]!r} in {text!r}")
    return tree


def compiled(g: Graph, tree: tuple) -> DataFrame:
    """DataFrame (name) of a syntax tree; set operators are semi and anti joins."""
    kind = tree[0]
    if kind in "|-&":
        a, b = compiled(g, tree[1]), compiled(g, tree[2])
        if kind == "|":
            return a.unionByName(b).distinct()
        return a.join(b, "name", "left_anti" if kind == "-" else "left_semi")
    if kind == "roots":
        return g.roots()
    if kind == "leaves":
        return g.leaves()
    if kind == "critical_path":
        return g.critical_path().select("name")
    if kind == "call":
        g._require([tree[2]])
        return getattr(g, tree[1])(tree[2]).select("name").distinct()
    if kind == "number":
        _, what, op, n = tree
        col = g.levels().withColumnRenamed("level", "depth") if what == "depth" else g.degrees()
        c = F.col(what)
        return col.where({"<=": c <= n, ">=": c >= n, "==": c == n, "<": c < n, ">": c > n}[op]).select("name")
    if kind == "glob":
        return g.matching_glob(tree[1])
    g._require([tree[1]])
    return g.nodes.where(F.col("name") == tree[1]).select("name")


def select(g: Graph, text: str, ranked: bool = False) -> DataFrame:
    """Names that the expression selects; with ``ranked`` also their rank in Kahn order."""
    found = compiled(g, parse(text))
    return found.join(g.topological_rank(), "name") if ranked else found
