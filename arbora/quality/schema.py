"""Expectations of DataFrames, checked in one pass."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class ColumnRule:
    name: str
    dtype: str | None = None
    nullable: bool = True
    required: bool = True


@dataclass
class FrameRules:
    columns: list[ColumnRule] = field(default_factory=list)
    min_rows: int | None = None
    max_rows: int | None = None


def violations(df: DataFrame, rules: FrameRules) -> DataFrame:
    """column, kind (missing, dtype, null_values, min_rows, max_rows), n.

    A dtype matches if it is part of the column's type name, in any case.
    """
    spark, have = df.sparkSession, {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out: list[tuple[str | None, str, int]] = []
    for r in rules.columns:
        if r.name not in have:
            if r.required:
                out.append((r.name, "missing", 0))
        elif r.dtype and r.dtype.lower() not in have[r.name].lower():
            out.append((r.name, "dtype", 0))
    strict = [r.name for r in rules.columns if not r.nullable and r.name in have]
    if strict or rules.min_rows is not None or rules.max_rows is not None:
        row = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"c{k}") for k, c in enumerate(strict)]).first()
        out += [(c, "null_values", int(row[f"c{k}"])) for k, c in enumerate(strict) if row[f"c{k}"]]
        if rules.min_rows is not None and row["n"] < rules.min_rows:
            out.append((None, "min_rows", int(row["n"])))
        if rules.max_rows is not None and row["n"] > rules.max_rows:
            out.append((None, "max_rows", int(row["n"])))
    return spark.createDataFrame(out, "column string, kind string, n long")


class FramePipeline:
    """Named steps that give DataFrames, each checked against its rules after it completed."""

    def __init__(self):
        self.steps: list[tuple[str, Callable, list[str]]] = []
        self.rules: dict[str, FrameRules] = {}

    def step(self, name: str, fn: Callable, deps: list[str] = (), rules: FrameRules | None = None) -> FramePipeline:
        self.steps.append((name, fn, list(deps)))
        if rules:
            self.rules[name] = rules
        return self

    def run(self) -> tuple[dict[str, object], list[tuple[str, str | None, str, int]]]:
        """(results by step, violations as (step, column, kind, n)); what isn't a DataFrame violates its rules."""
        results: dict[str, object] = {}
        found = []
        for name, fn, deps in self.steps:
            results[name] = fn(*[results[d] for d in deps])
            if name in self.rules:
                if isinstance(results[name], DataFrame):
                    found += [(name, *r) for r in violations(results[name], self.rules[name]).collect()]
                else:
                    found.append((name, None, "not_a_dataframe", 0))
        return results, found
