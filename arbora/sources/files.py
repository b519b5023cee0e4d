"""A data source for graphs in files: JSON lines or the byte stream, read and written in partitions.

``spark.read.format("arbora_graph").load(path)`` gives a row for each node and edge, a task for each part file;
``write_graph`` and ``read_graph`` do the same for a ``Graph``.  Every part is complete in itself: a part in the byte form
is a byte stream as ``text.from_bytes`` reads it.  Parts are written under another name and get their own when the whole
job is done, so parts of lost or repeated tasks are never read.  Paths may be of any store that pyarrow knows.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from arbora.errors import GraphError
from arbora.graph import Graph
from arbora.session import ship_package
from arbora.sources.text import byte_rows, put_text

SCHEMA = "kind string, name string, payload string, src string, dst string, weight double, label string, place long"
FORMS = {"json": ".jsonl", "bytes": ".graph"}
#: Rows of one part file, so that a writer holds no more.
PART_ROWS = 200_000


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Part(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[Part]:
        from pyarrow import fs

        store, top = _store(self.path)
        found = store.get_file_info(fs.FileSelector(top, recursive=False))
        return [Part(f.path) for f in sorted(found, key=lambda f: f.path) if f.base_name.endswith(tuple(FORMS.values())) and not f.base_name.startswith("_")]

    def read(self, partition: Part) -> Iterator[tuple]:
        store, _ = _store(self.path)
        with store.open_input_stream(partition.path) as f:
            raw = f.read()
        if partition.path.endswith(FORMS["json"]):
            for line in raw.decode("utf-8").splitlines():
                r = json.loads(line)
                if "name" in r:
                    yield "node", r["name"], r.get("payload"), None, None, None, None, r.get("place")
                else:
                    yield "edge", None, None, r["from"], r["to"], r.get("weight", 1.0), r.get("label"), r.get("place")
            return
        nodes, edges = byte_rows(raw)
        yield from (("node", name, payload, None, None, None, None, None) for name, payload in nodes)
        yield from (("edge", None, None, src, dst, weight, label, None) for src, dst, weight, label in edges)


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.form = options["path"], options.get("form", "json")
        if self.form not in FORMS:
            raise GraphError(f"unknown form {self.form}")

    def _put(self, rows: list) -> str:
        store, top = _store(self.path)
        store.create_dir(top, recursive=True)
        name = f"part-{uuid.uuid4().hex}{FORMS[self.form]}"
        with store.open_output_stream(f"{top}/_{name}") as f:
            f.write(self._packed(rows))
        return name

    def _packed(self, rows: list) -> bytes:
        nodes, edges = [r for r in rows if r["kind"] == "node"], [r for r in rows if r["kind"] == "edge"]
        if self.form == "json":
            made = [{"name": r["name"], "payload": r["payload"], "place": r["place"]} for r in nodes]
            made += [{"from": r["src"], "to": r["dst"], "weight": r["weight"], "label": r["label"], "place": r["place"]} for r in edges]
            return "".join(json.dumps({k: v for k, v in r.items() if v is not None}, ensure_ascii=False) + "\n" for r in made).encode()
        out = [struct.pack("<Q", len(nodes)), *[put_text(r["name"]) + put_text(r["payload"]) for r in nodes]]
        out += [struct.pack("<Q", len(edges)), *[put_text(r["src"]) + put_text(r["dst"]) + struct.pack("<d", r["weight"]) + put_text(r["label"]) for r in edges]]
        return b"".join(out)

    def write(self, iterator: Iterator) -> Written:
        held, names = [], []
        for row in iterator:
            held.append(row)
            if len(held) >= PART_ROWS:
                names.append(self._put(held))
                held = []
        if held:
            names.append(self._put(held))
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, top = _store(self.path)
        for message in messages:
            for name in message.names if message else []:
                store.move(f"{top}/_{name}", f"{top}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, top = _store(self.path)
        for message in messages:
            for name in message.names if message else []:
                store.delete_file(f"{top}/_{name}")


class GraphFiles(DataSource):
    """``arbora_graph``: options path and, for writing, form (json or bytes)."""

    @classmethod
    def name(cls) -> str:
        return "arbora_graph"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise GraphError("parts are only added; take a new folder")
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(GraphFiles)


def rows_of(g: Graph) -> DataFrame:
    """A row of ``SCHEMA`` for each node and edge."""
    null = lambda *names: [F.lit(None).cast("double" if n == "weight" else "string").alias(n) for n in names]
    n = g.nodes.select(F.lit("node").alias("kind"), "name", "payload", *null("src", "dst", "weight", "label"), F.col("ord").alias("place"))
    return n.unionByName(g.edges.select(F.lit("edge").alias("kind"), *null("name", "payload"), "src", "dst", "weight", "label", F.col("edge_id").alias("place")))


def graph_of(rows: DataFrame) -> Graph:
    return Graph(rows.where("kind = 'node'").select("name", "payload", F.col("place").alias("ord")), rows.where("kind = 'edge'").select("src", "dst", "weight", "label", F.col("place").alias("edge_id")))


def write_graph(g: Graph, path: str, form: str = "json") -> None:
    register(g.spark)
    rows_of(g).write.format("arbora_graph").option("form", form).mode("append").save(path)


def read_graph(spark: SparkSession, path: str) -> Graph:
    register(spark)
    return graph_of(spark.read.format("arbora_graph").load(path))
