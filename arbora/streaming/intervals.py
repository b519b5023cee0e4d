"""Versioned graphs as tables: an append-only Parquet log of mutations, and intervals of versions in which things hold.

A node or edge holds from the version that added it up to (not including) the one that took it away: ``node_intervals``
and ``edge_intervals`` compute these from a log, and any version is read from them by one filter.  ``VersionTable`` keeps
the log and snapshots under a folder; nothing of it passes through the driver but version numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.errors import GraphError
from arbora.graph import Graph
from arbora.streaming.versions import COLUMNS, shaped

OPEN = (1 << 63) - 1


def node_intervals(log: DataFrame) -> DataFrame:
    """name, payload, metadata, added, valid_from, valid_to: a row for each state of each node, from ``added`` its life's begin."""
    m = shaped(log).where(F.col("mutation_type").isin("add_node", "remove_node", "set_payload", "set_metadata"))
    kind, w = F.col("mutation_type"), Window.partitionBy("name").orderBy("version")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = m.withColumn("life", F.sum(F.when(kind == "remove_node", 1).otherwise(0)).over(so_far)).where(kind != "remove_node").unionByName(
        m.where(kind == "remove_node").withColumn("life", F.lit(None).cast("long")), allowMissingColumns=True
    )
    m = m.withColumn("valid_to", F.coalesce(F.lead("version").over(w), F.lit(OPEN)))
    in_life = Window.partitionBy("name", "life").orderBy("version").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda c, *kinds: F.max_by(c, F.when(kind.isin(*kinds), F.col("version"))).over(in_life)
    states = m.where("life is not null").select(
        "name", last("payload", "add_node", "set_payload").alias("payload"), last("metadata", "add_node", "set_metadata").alias("metadata"),
        F.min(F.when(kind == "add_node", F.col("version"))).over(in_life).alias("added"), F.col("version").alias("valid_from"), "valid_to",
    )
    return states.where("added is not null")  # what is set before a node is there has no effect


def edge_intervals(log: DataFrame) -> DataFrame:
    """src, dst, weight, label, valid_from, valid_to of every edge; removing a node takes its edges.

    Of a pair's edges since either end was last removed, the k-th removal takes the k-th added.
    """
    m = shaped(log)
    kind = F.col("mutation_type")
    e = m.where(kind.isin("add_edge", "remove_edge")).select("version", "mutation_type", "src", "dst", "weight", "label")
    pairs = e.select("src", "dst").distinct()
    gone = m.where(kind == "remove_node").select("version", "name")
    cut = lambda end: gone.join(pairs.withColumnRenamed(end, "name"), "name").withColumnRenamed("name", end)
    cuts = cut("src").select("version", "src", "dst").unionByName(cut("dst").select("version", "src", "dst")).distinct().withColumn("mutation_type", F.lit("cut"))
    all_ = e.unionByName(cuts, allowMissingColumns=True)
    w = Window.partitionBy("src", "dst").orderBy("version")  # one pair's changes
    all_ = all_.withColumn("era", F.sum(F.when(F.col("mutation_type") == "cut", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ahead = Window.partitionBy("src", "dst").orderBy("version").rowsBetween(1, Window.unboundedFollowing)
    all_ = all_.withColumn("end", F.min(F.when(F.col("mutation_type") == "cut", F.col("version"))).over(ahead)).where("mutation_type <> 'cut'")
    no = F.row_number().over(Window.partitionBy("src", "dst", "era", "mutation_type").orderBy("version"))
    all_ = all_.withColumn("no", no)
    taken = all_.where("mutation_type = 'remove_edge'").select("src", "dst", "era", "no", F.col("version").alias("taken"))
    out = all_.where("mutation_type = 'add_edge'").join(taken, ["src", "dst", "era", "no"], "left")
    to = F.least(F.coalesce("end", F.lit(OPEN)), F.coalesce("taken", F.lit(OPEN)))
    return out.select("src", "dst", "weight", "label", F.col("version").alias("valid_from"), to.alias("valid_to")).where("valid_to > valid_from")


def as_of(nodes: DataFrame, edges: DataFrame, version: int) -> Graph:
    """The graph that holds at a version, from its tables of intervals."""
    now = (F.col("valid_from") <= version) & (F.col("valid_to") > version)
    n = nodes.where(now).select("name", "payload", "metadata", F.col("added").alias("ord"))
    return Graph(n, edges.where(now).select("src", "dst", "weight", "label", F.col("valid_from").alias("edge_id")))


class VersionTable:
    """A log under ``folder``: log/ (mutations), and after ``compact`` the state at the floor as its first mutations."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @property
    def log(self) -> DataFrame:
        return shaped(self.spark.read.schema(", ".join(f"{c} {t}" for c, t in COLUMNS.items()) + ", timestamp double").parquet(f"{self.folder}/log"))

    def span(self) -> tuple[int, int]:
        """(first, last) version that can be read."""
        row = self.log.agg(F.min("version"), F.max("version")).first()
        return int(row[0] or 0), int(row[1] or 0)

    def append(self, mutations: DataFrame) -> int:
        """Add mutations with versions behind those there; gives the last version."""
        rows = shaped(mutations)
        low, high = rows.agg(F.min("version"), F.max("version")).first()
        if low is None:
            raise GraphError("nothing to append")
        try:
            last = self.span()[1]
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            last = None
        if last is not None and low <= last:
            raise GraphError(f"version {low} is not behind {last}")
        rows.write.mode("append").parquet(f"{self.folder}/log")
        return int(high)

    def at(self, version: int | None = None) -> Graph:
        low, high = self.span()
        v = high if version is None else version
        if not low <= v <= high:
            raise GraphError(f"version {v} is not between {low} and {high}")
        log = self.log.where(F.col("version") <= v)
        return as_of(node_intervals(log), edge_intervals(log), v)

    def history(self, since: int = -1) -> DataFrame:
        return self.log.where(F.col("version") > since)

    def fork(self, folder: str, version: int | None = None) -> VersionTable:
        """A table of its own with the log up to a version."""
        low, high = self.span()
        v = high if version is None else version
        if not low <= v <= high:
            raise GraphError(f"version {v} is not between {low} and {high}")
        self.log.where(F.col("version") <= v).write.parquet(f"{folder}/log")
        return VersionTable(self.spark, folder)

    def compact(self, folder: str, version: int) -> VersionTable:
        """A table under a new folder that begins with the state at ``version``; what came before can't be read there.

        Of parallel edges in that state any may be the first that a later removal takes.
        """
        g = self.at(version)
        n = g.nodes.select(F.lit(version).cast("long").alias("version"), F.lit("add_node").alias("mutation_type"), "name", "payload", "metadata")
        e = g.edges.select(F.lit(version).cast("long").alias("version"), F.lit("add_edge").alias("mutation_type"), "src", "dst", "weight", "label")
        shaped(n).unionByName(shaped(e)).unionByName(self.history(version)).write.parquet(f"{folder}/log")
        return VersionTable(self.spark, folder)
