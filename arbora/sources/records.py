"""Graphs from records and Parquet."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.graph import Graph


def from_frame(rows: DataFrame, name: str = "name", deps: str | None = None, payload: list[str] | None = None) -> Graph:
    """One node a row, its payload all columns (or the named ones) as JSON, an edge from each of ``deps``."""
    keep = payload if payload is not None else rows.columns
    nodes = rows.select(F.col(name).alias("name"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in keep])).alias("payload"))
    if deps is None:
        return Graph(nodes, nodes.sparkSession.createDataFrame([], "src string, dst string"))
    return Graph(nodes, rows.select(F.explode(deps).alias("src"), F.col(name).alias("dst")))


def as_dict(record: object) -> dict:
    if isinstance(record, dict):
        return record
    if dataclasses.is_dataclass(record) and not isinstance(record, type):
        return dataclasses.asdict(record)
    for method in ("model_dump", "dict"):
        if hasattr(record, method):
            return getattr(record, method)()
    return vars(record)


def from_records(spark: SparkSession, records: Iterable, name_field: str = "name", edge_fn: Callable | None = None, payload_fn: Callable | None = None) -> Graph:
    """From Python records (dict, dataclass, model); ``edge_fn(record)`` lists the names it depends on."""
    nodes, edges = [], []
    for n, record in enumerate(records):
        row = as_dict(record)
        name = str(row[name_field])
        value = payload_fn(record) if payload_fn else row
        nodes.append((name, json.dumps(value, default=str), n))
        edges += [(str(dep), name) for dep in (edge_fn(record) if edge_fn else [])]
    g = Graph(spark.createDataFrame(nodes, "name string, payload string, ord long"), spark.createDataFrame(edges, "src string, dst string"))
    return g.validate()


def save(g: Graph, path: str) -> None:
    """Write nodes and edges as a pair of Parquet tables."""
    g.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    g.edges.write.mode("overwrite").parquet(f"{path}/edges")


def load(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))
