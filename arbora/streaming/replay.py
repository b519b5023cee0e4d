"""Run logs: reading, replay at a time, streaming last values, Chrome traces."""

from __future__ import annotations

import hashlib
import json
import os
import pickle
import threading
import time
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from arbora.operators.fixpoint import global_rank

RUN_LOG = "t double, name string, fp string, dur_ns long, effect string, replayable boolean, error string, metadata map<string,string>"
TRACE = "event_type string, timestamp double, node_name string, step_index int, duration double, error string, metadata map<string,string>"


class RunLogWriter:
    """Appends records of a run to ``<folder>/<run>.jsonl``; values go to ``<folder>/values``, equal ones once.

    A value's file is named by the hash of its pickle (``fp`` of the record), so runs that give the same value
    share it.  Written by the driver: the folder must be one that it and the readers share.
    """

    def __init__(self, folder: str, run: str):
        self.folder, self.values = Path(folder), Path(folder, "values")
        self.values.mkdir(parents=True, exist_ok=True)
        self._file = (self.folder / f"{run}.jsonl").open("a", encoding="utf-8")
        self._turn, self._zero = threading.Lock(), time.monotonic()

    def record(self, name: str, value: object = None, seconds: float = 0.0, effect: str = "pure", error: str | None = None, metadata: dict | None = None) -> str | None:
        """The fingerprint of the value; values that can't be pickled are noted as not replayable."""
        fp = None
        if error is None:
            try:
                raw = pickle.dumps(value)
            except Exception:  # noqa: BLE001
                raw = None
            if raw is not None:
                fp = hashlib.sha256(raw).hexdigest()
                self._keep(fp, raw)
        row = {"t": time.monotonic() - self._zero, "name": name, "fp": fp, "dur_ns": int(seconds * 1e9), "effect": effect, "replayable": fp is not None, "error": error, "metadata": {str(k): str(v) for k, v in (metadata or {}).items()}}
        with self._turn:
            self._file.write(json.dumps(row) + "\n")
            self._file.flush()
        return fp

    def _keep(self, fp: str, raw: bytes) -> None:
        at = self.values / fp
        if not at.exists():
            part = self.values / f"{fp}.{os.getpid()}.{threading.get_ident()}.part"
            part.write_bytes(raw)
            part.replace(at)

    def value(self, fp: str) -> object:
        return pickle.loads((self.values / fp).read_bytes())

    def callbacks(self):
        """Callbacks that record every node of a run."""
        from arbora.runtime.base import ExecutionCallbacks

        began: dict[str, float] = {}
        took = lambda n: time.monotonic() - began.get(n, time.monotonic())
        return ExecutionCallbacks(
            on_start=lambda n: began.__setitem__(n, time.monotonic()), on_complete=lambda n, v: self.record(n, v, took(n)), on_failure=lambda n, e: self.record(n, seconds=took(n), error=repr(e)),
        )

    def close(self) -> None:
        self._file.close()

    def __enter__(self) -> RunLogWriter:
        return self

    def __exit__(self, *error) -> None:
        self.close()


def summary(trace: DataFrame) -> DataFrame:
    """event_type, n: how often each kind of event occurs in a trace."""
    return trace.groupBy("event_type").agg(F.count("*").alias("n"))


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of a folder and all below it; lines that don't parse are dropped."""
    return spark.read.schema(RUN_LOG).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path)


def list_runs(spark: SparkSession, path: str) -> DataFrame:
    """path of every run file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(path).select("path").orderBy("path")


def replay(log: DataFrame, at: float | None = None) -> DataFrame:
    """Last record of each name before the first record (by seq) later than ``at``."""
    kept = log
    if at is not None:
        stop = log.where(F.col("t") > at).agg(F.min("seq").alias("stop"))
        kept = log.join(F.broadcast(stop)).where("stop is null or seq < stop").drop("stop")  # one row
    last = kept.groupBy("name").agg(F.max_by(F.struct(*[c for c in log.columns if c != "name"]), "seq").alias("r"))
    return last.select("name", "r.*")


def last_values(stream: DataFrame) -> DataFrame:
    """Streaming form of replay: the latest record of each name by t (update or complete mode)."""
    return stream.groupBy("name").agg(F.max_by(F.struct("t", "fp", "error"), "t").alias("last")).select("name", "last.*")


class _Last(StatefulProcessor):
    """A name's last record (by seq) not later than ``at``; given out once the watermark has passed ``at``."""

    def __init__(self, at: float):
        self.at, self.due = at, int(at * 1000) + 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seq long, t double, fp string, error string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        had = self.last.get() if self.last.exists() else None
        best = had
        for r in rows:
            if r["t"] <= self.at and (best is None or r["seq"] > best[0]):
                best = (r["seq"], r["t"], r["fp"], r["error"])
        if best is not had:
            self.last.update(tuple(best))
            if had is None:
                self.handle.registerTimer(self.due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        seq, t, fp, error = self.last.get()
        self.last.clear()
        yield Row(name=key[0], seq=seq, t=t, fp=fp, error=error)

    def close(self) -> None:
        pass


def replay_stream(stream: DataFrame, at: float, late: str = "10 minutes") -> DataFrame:
    """name, seq, t, fp, error: streaming form of ``replay`` for a log whose times don't fall with seq, in whatever order it arrives.

    State is one record a name, kept by event time: a name's row comes, once, when the watermark (``late`` behind the
    greatest time seen) has passed ``at``.  Append mode; needs the RocksDB state store.
    """
    timed = stream.select("name", "seq", "t", "fp", "error", F.timestamp_seconds("t").alias("ts")).withWatermark("ts", late)
    return timed.groupBy("name").transformWithState(_Last(at), "name string, seq long, t double, fp string, error string", "Append", "EventTime")


def rates(stream: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Records and errors a window of event time, late ones within the watermark; an extension."""
    timed = stream.withColumn("ts", F.timestamp_seconds("t")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "name").agg(F.count("*").alias("n"), F.count("error").alias("errors"))


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(RUN_LOG).option("mode", "DROPMALFORMED").json(path)


def chrome_trace(trace: DataFrame) -> DataFrame:
    """line: Chrome trace events (microseconds, a thread id per node) of node starts and ends."""
    kind = F.when(F.col("event_type").endswith("started"), "B").when(F.col("event_type").rlike("(completed|failed|timed_out|cancelled)$"), "E")
    ids, _ = global_rank(trace.where("node_name is not null").select("node_name").distinct(), ["node_name"], "tid", 1)
    e = trace.where("node_name is not null").withColumn("ph", kind).where("ph is not null").join(ids, "node_name")
    return e.select(F.to_json(F.struct(F.col("node_name").alias("name"), "ph", (F.col("timestamp") * 1e6).cast("long").alias("ts"), F.lit(1).alias("pid"), "tid")).alias("line"))
