"""Type contracts on edges: what a node gives must fit what the next one takes."""

from __future__ import annotations

import types
import typing
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass
class NodeContract:
    inputs: dict[str, object] = field(default_factory=dict)
    output: object = object


@dataclass
class Violation:
    src: str
    dst: str
    expected: object
    actual: object


def compatible(given: object, wanted: object) -> bool:
    """Covariant check; object and Any take all, unions by member, generics pairwise, unknown things pass."""
    if wanted in (object, typing.Any, None) or given in (typing.Any, object):
        return True
    if isinstance(wanted, T.DataType) or isinstance(given, T.DataType):
        return _fits(given, wanted)
    unions = (typing.Union, types.UnionType)
    if typing.get_origin(given) in unions:
        return all(compatible(g, wanted) for g in typing.get_args(given))
    if typing.get_origin(wanted) in unions:
        return any(compatible(given, w) for w in typing.get_args(wanted))
    a, b = typing.get_origin(given) or given, typing.get_origin(wanted) or wanted
    if not (isinstance(a, type) and isinstance(b, type)):
        return True
    if not issubclass(a, b):
        return False
    x, y = typing.get_args(given), typing.get_args(wanted)
    return not x or not y or len(x) != len(y) or all(map(compatible, x, y))


def _fits(given: object, wanted: object) -> bool:
    """A struct fits if it has all wanted fields with fitting types."""
    if isinstance(given, T.StructType) and isinstance(wanted, T.StructType):
        have = {f.name: f.dataType for f in given.fields}
        return all(f.name in have and _fits(have[f.name], f.dataType) for f in wanted.fields)
    return given == wanted


def extract_contracts(tasks: dict[str, Callable]) -> dict[str, NodeContract]:
    """From annotations of functions; unannotated ones have none."""
    out = {}
    for name, fn in tasks.items():
        try:
            hints = typing.get_type_hints(fn)
        except Exception:  # noqa: BLE001  an annotation that can't be resolved says nothing
            continue
        if hints:
            out[name] = NodeContract({k: v for k, v in hints.items() if k != "return"}, hints.get("return", object))
    return out


def validate_contracts(edges: Iterable[tuple[str, str]], contracts: dict[str, NodeContract]) -> list[Violation]:
    found = []
    for a, b in edges:
        if a in contracts and b in contracts and a in contracts[b].inputs:
            want, got = contracts[b].inputs[a], contracts[a].output
            if not compatible(got, want):
                found.append(Violation(a, b, want, got))
    return found
