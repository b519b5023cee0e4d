"""Templates with {{name}} placeholders."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from arbora.errors import TemplateError

_MISSING = object()
_HOLE = re.compile(r"\{\{\s*([A-Za-z_]\w*)\s*\}\}")


@dataclass
class Param:
    """A template parameter: type, default, validator."""

    name: str
    kind: type = str
    default: object = _MISSING
    check: Callable[[object], bool] | None = None

    def value(self, given: dict) -> object:
        v = given.get(self.name, self.default)
        if v is _MISSING:
            raise TemplateError(f"{self.name} is missing")
        if not isinstance(v, self.kind):
            raise TemplateError(f"{self.name} must be {self.kind.__name__}")
        if self.check and not self.check(v):
            raise TemplateError(f"{self.name} is not valid: {v!r}")
        return v


def substitute(text: object, values: dict) -> object:
    """Replace placeholders; a text that is only a placeholder keeps the value's type, unknown ones stay."""
    if isinstance(text, dict):
        return {substitute(k, values): substitute(v, values) for k, v in text.items()}
    if isinstance(text, list):
        return [substitute(v, values) for v in text]
    if not isinstance(text, str):
        return text
    whole = _HOLE.fullmatch(text)
    if whole and whole[1] in values:
        return values[whole[1]]
    return _HOLE.sub(lambda m: str(values[m[1]]) if m[1] in values else m[0], text)


class GraphTemplate:
    """Nodes and edges with placeholders, rendered into a driver-side graph."""

    def __init__(self, params: list[Param] = ()):
        self.params = {p.name: p for p in params}
        self.nodes: list[tuple] = []
        self.edges: list[tuple] = []

    def node(self, name: str, payload: object = None, metadata: object = None) -> GraphTemplate:
        self.nodes.append((name, payload, metadata))
        return self

    def edge(self, src: str, dst: str, weight: float = 1.0, label: str | None = None) -> GraphTemplate:
        self.edges.append((src, dst, weight, label))
        return self

    def values(self, given: dict) -> dict:
        unknown = set(given) - set(self.params)
        if unknown:
            raise TemplateError(f"unknown parameters: {sorted(unknown)}")
        return {n: p.value(given) for n, p in self.params.items()}

    def render(self, **given):
        from arbora.dag import DAG

        v, dag = self.values(given), DAG()
        for row in self.nodes:
            dag.add_node(*substitute(list(row), v))
        for row in self.edges:
            dag.add_edge(*substitute(list(row), v))
        return dag


    def render_builder(self, **given):
        """The same as an unfinished builder."""
        from arbora.dag import DAGBuilder

        v, out = self.values(given), DAGBuilder()
        for row in self.nodes:
            out.add_node(*substitute(list(row), v))
        for row in self.edges:
            out.add_edge(*substitute(list(row), v))
        return out

    def render_calls(self, tasks: dict, **given) -> tuple:
        """The rendered graph and its tasks: names are substituted, a task takes the values it has parameters for."""
        import inspect

        v = self.values(given)
        calls = {}
        for name, fn in tasks.items():
            own = {k: v[k] for k in inspect.signature(fn).parameters if k in v}
            calls[str(substitute(name, v))] = lambda fn=fn, own=own: fn(**own)
        return self.render(**given), calls


def render_column(text: str, values: dict[str, Column]) -> Column:
    """A column of rendered texts, one a row: bulk rendering without leaving SQL."""
    parts, at = [], 0
    for m in _HOLE.finditer(text):
        parts.append(F.lit(text[at : m.start()]))
        parts.append(values[m[1]].cast("string") if m[1] in values else F.lit(m[0]))
        at = m.end()
    return reduce(lambda a, b: F.concat(a, b), [*parts, F.lit(text[at:])])
