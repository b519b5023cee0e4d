"""Versioned graphs as append-only mutation logs.

log: version, mutation_type (add_node, remove_node, add_edge, remove_edge, set_payload, set_metadata), name,
src, dst, weight, label, payload, metadata; missing columns count as null.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.errors import GraphError
from arbora.graph import Graph

COLUMNS = {"version": "long", "mutation_type": "string", "name": "string", "src": "string", "dst": "string", "weight": "double", "label": "string", "payload": "string", "metadata": "map<string,string>"}


def shaped(log: DataFrame) -> DataFrame:
    return log.select(*[(F.col(c) if c in log.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])


def at_version(log: DataFrame, version: int | None = None, base: Graph | None = None) -> Graph:
    """The graph after all mutations up to ``version``: last mutation wins, removal of a node takes its edges.

    Edges are a bag: of a pair's additions since either end was last removed, as many of the first ones go as
    there were removals of the pair since.
    """
    m = shaped(log)
    if version is not None:
        m = m.where(F.col("version") <= version)
    if base is not None:
        n = base.nodes.select(F.lit(0).alias("version"), F.lit("add_node").alias("mutation_type"), "name", "payload", "metadata")
        e = base.edges.select(F.lit(0).alias("version"), F.lit("add_edge").alias("mutation_type"), "src", "dst", "weight", "label")
        m = m.unionByName(shaped(n)).unionByName(shaped(e))
    kind = F.col("mutation_type")
    of_node = m.where(kind.isin("add_node", "remove_node", "set_payload", "set_metadata"))
    when = lambda k, c="version": F.max(F.when(kind == k, F.col(c)))
    state = of_node.groupBy("name").agg(when("add_node").alias("added"), when("remove_node").alias("gone"))
    alive = state.where("added is not null and (gone is null or added > gone)")
    since = of_node.join(alive.select("name", "added"), "name").where("version >= added")
    last = since.groupBy("name").agg(
        F.max_by("payload", F.when(kind.isin("add_node", "set_payload"), F.col("version"))).alias("payload"),
        F.max_by("metadata", F.when(kind.isin("add_node", "set_metadata"), F.col("version"))).alias("metadata"),
        F.min("version").alias("ord"),
    )
    of_edge = m.where(kind.isin("add_edge", "remove_edge"))
    gone = state.where("gone is not null").select("name", "gone")
    e = of_edge.join(gone.select(F.col("name").alias("src"), F.col("gone").alias("g1")), "src", "left").join(gone.select(F.col("name").alias("dst"), F.col("gone").alias("g2")), "dst", "left")
    e = e.where("version > coalesce(g1, -1) and version > coalesce(g2, -1)")
    removed = e.where(kind == "remove_edge").groupBy("src", "dst").agg(F.count("*").alias("removals"))
    order = Window.partitionBy("src", "dst").orderBy("version")
    e = e.where(kind == "add_edge").withColumn("n", F.row_number().over(order)).join(removed, ["src", "dst"], "left").where("n > coalesce(removals, 0)")
    return Graph(last, e.select("src", "dst", "weight", "label", F.col("version").alias("edge_id")))


def history(log: DataFrame, since: int = -1) -> DataFrame:
    return shaped(log).where(F.col("version") > since).orderBy("version")


def diff_versions(log: DataFrame, a: int, b: int, base: Graph | None = None) -> DataFrame:
    from arbora.operators.analysis import diff

    return diff(at_version(log, a, base), at_version(log, b, base))


class VersionedGraph:
    """Mutations with a version each; base graph is version 0."""

    def __init__(self, spark: SparkSession, base: Graph | None = None, compact_every: int | None = None):
        self.spark, self.base, self.compact_every = spark, base, compact_every
        self.version = self.floor = 0
        self.rows: list[tuple] = []

    def _log(self, kind: str, **args) -> int:
        self.version += 1
        given = {"version": self.version, "mutation_type": kind, **args}
        self.rows.append(tuple(given.get(c) for c in COLUMNS) + (time.time(),))
        if self.compact_every and len(self.rows) >= self.compact_every:
            self.compact()
        return self.version

    @staticmethod
    def _text(payload: object) -> str | None:
        return None if payload is None else json.dumps(payload, default=str)

    def add_node(self, name: str, payload: object = None, metadata: dict | None = None) -> int:
        return self._log("add_node", name=name, payload=self._text(payload), metadata=metadata)

    def remove_node(self, name: str) -> int:
        return self._log("remove_node", name=name)

    def add_edge(self, src: str, dst: str, weight: float = 1.0, label: str | None = None) -> int:
        return self._log("add_edge", src=src, dst=dst, weight=weight, label=label)

    def remove_edge(self, src: str, dst: str) -> int:
        return self._log("remove_edge", src=src, dst=dst)

    def set_payload(self, name: str, payload: object) -> int:
        return self._log("set_payload", name=name, payload=self._text(payload))

    def set_metadata(self, name: str, metadata: dict) -> int:
        return self._log("set_metadata", name=name, metadata=metadata)

    @property
    def log(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, ", ".join(f"{c} {t}" for c, t in COLUMNS.items()) + ", timestamp double")

    def at_version(self, version: int | None = None) -> Graph:
        v = self.version if version is None else version
        if not self.floor <= v <= self.version:
            raise ValueError(f"version {v} is not between {self.floor} and {self.version}")
        return at_version(self.log, v, self.base)

    def compact(self, keep: int = 0) -> None:
        """Make the state ``keep`` versions ago the base and drop the log before it."""
        at = self.version - keep
        self.base = self.at_version(at).snapshot()
        self.rows = [r for r in self.rows if r[0] > at]
        self.floor = at

    def fork(self, version: int | None = None) -> VersionedGraph:
        v = self.version if version is None else version
        if not self.floor <= v <= self.version:
            raise ValueError(f"version {v} is not kept")
        out = VersionedGraph(self.spark, self.base, self.compact_every)
        out.rows, out.version, out.floor = [r for r in self.rows if r[0] <= v], v, self.floor
        return out

    def history(self, since: int = -1) -> DataFrame:
        return history(self.log, since)

    def diff_versions(self, a: int, b: int) -> DataFrame:
        for v in (a, b):
            if not self.floor <= v <= self.version:
                raise GraphError(f"version {v} is not kept")
        return diff_versions(self.log, a, b, self.base)
