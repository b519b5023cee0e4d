"""Longest sums into every node of a deep graph, in rounds that follow the logarithm of its depth.

value(v) = max(base(v), value(u) + weight(u, v) over all u -> v).  A node with one way in is a function of what is
before it, max(b, value(p) + w), and two such functions compose to a third, so pointers over all nodes with at most one
way in are doubled at once: chains, trees, and what merging parallel ways makes of series-parallel graphs are gone
after a few rounds of doubling.  What is left has two ways into every node; of it, nodes that no two are neighbours
and whose ways in times ways out are few are taken out together, each pair of its ways becoming one.  That halves narrow
lattices again and again.  A core that gives in to neither is relaxed hop by hop.  At the end the nodes taken
out get their values in reverse order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.errors import CycleError
from arbora.operators.fixpoint import checkpoint

#: A node is taken out if that makes at most so many times the ways it has.
FILL = 2
#: Reductions go on while each takes at least this share of the nodes.
SHARE = 0.05
#: Nodes without a way out are taken out first while they are at least this share.
LEAVES = 0.3


def _doubled(single: DataFrame, n: int) -> DataFrame:
    """(name, p, w, b): pointers moved up until they end (p null) or reach a node that isn't ``single``."""
    table = checkpoint(single)
    for _ in range(math.ceil(math.log2(n + 1)) + 2):
        up = table.select(F.col("name").alias("p"), F.col("p").alias("pp"), F.col("w").alias("pw"), F.col("b").alias("pb"), F.lit(True).alias("on"))
        moved = table.join(up, "p", "left")
        table = checkpoint(moved.select(
            "name", F.when(F.col("on"), F.col("pp")).otherwise(F.col("p")).alias("p"),
            F.when(F.col("on"), F.col("w") + F.coalesce("pw", F.lit(0.0))).otherwise(F.col("w")).alias("w"),
            F.when(F.col("on"), F.greatest("b", F.col("w") + F.col("pb"))).otherwise(F.col("b")).alias("b"), F.coalesce("on", F.lit(False)).alias("on"),
        ))
        if table.where("on").isEmpty():
            return table.drop("on")
        table = table.drop("on")
    raise CycleError([table.where("p is not null").agg(F.min("name")).first()[0]])


def _merged(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.max("w").alias("w"))


def _rebased(nodes: DataFrame, more: DataFrame) -> DataFrame:
    """nodes (name, b) raised by more (name, b)."""
    up = more.groupBy("name").agg(F.max("b").alias("up"))
    return nodes.join(up, "name", "left").select("name", F.greatest("b", "up").alias("b"))


def _core(nodes: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """(name, value) hop by hop; only what rose is sent on."""
    now = checkpoint(nodes.withColumnRenamed("b", "value"))
    front = now
    for _ in range(n + 1):
        sent = front.join(edges, front["name"] == edges["src"]).groupBy(F.col("dst").alias("name")).agg(F.max(F.col("value") + F.col("w")).alias("up"))
        risen = now.join(sent, "name", "left").select("name", F.greatest("value", "up").alias("value"), F.coalesce(F.col("up") > F.col("value"), F.lit(False)).alias("rose"))
        risen = checkpoint(risen)
        front, now = risen.where("rose").select("name", "value"), risen.select("name", "value")
        if front.isEmpty():
            return now
    raise CycleError(["?"])


def longest_sums(nodes: DataFrame, edges: DataFrame, own: str) -> DataFrame:
    """(name, value): own + the greatest value before it, if that is above 0; raises on a cycle.

    ``nodes`` have name and the column ``own``, ``edges`` src and dst.
    """
    cost = nodes.select("name", F.col(own).cast("double").alias("b"))
    e = edges.select("src", "dst").distinct().join(cost.select(F.col("name").alias("dst"), F.col("b").alias("w")), "dst").select("src", "dst", "w")
    return weighted_sums(cost, e)


def weighted_sums(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, value) for nodes (name, b) and edges (src, dst, w), ends of edges among the nodes."""
    nodes, edges = checkpoint(nodes), checkpoint(_merged(edges))
    layers: list[tuple[DataFrame, DataFrame]] = []  # (name, b) and (name, p, w) of what was taken out
    n = nodes.count()
    while n:  # what no other value needs
        out = nodes.join(edges.select(F.col("src").alias("name")).distinct(), "name", "left_anti")
        out = checkpoint(out)
        taken = out.count()
        if taken < LEAVES * n:
            break
        gone = out.select(F.col("name").alias("dst"))
        layers.append((out, checkpoint(edges.join(gone, "dst", "left_semi").select(F.col("dst").alias("name"), F.col("src").alias("p"), "w"))))
        nodes, edges = checkpoint(nodes.join(out.select("name"), "name", "left_anti")), checkpoint(edges.join(gone, "dst", "left_anti"))
        n -= taken
    while n:
        loop = edges.where("src = dst").select("src").first()
        if loop:
            raise CycleError([loop[0], loop[0]])
        ways = edges.groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("n"), F.min("src").alias("p"), F.min("w").alias("w"))
        single = nodes.join(ways, "name", "left").where("n is null or n = 1").select("name", "p", F.coalesce("w", F.lit(0.0)).alias("w"), "b")
        single = _doubled(single, n)
        taken = single.count()
        layers.append((single.select("name", "b"), single.where("p is not null").select("name", "p", "w")))
        kept = nodes.join(single.select("name"), "name", "left_anti")
        into = edges.join(kept.select(F.col("name").alias("dst")), "dst", "left_semi").join(single.select(F.col("name").alias("src"), "p", F.col("w").alias("sw"), F.col("b").alias("sb"), F.lit(True).alias("hit")), "src", "left")
        into = checkpoint(into)
        nodes = checkpoint(_rebased(kept, into.where("hit").select(F.col("dst").alias("name"), (F.col("w") + F.col("sb")).alias("b"))))
        edges = into.where("hit is null or p is not null").select(F.coalesce("p", "src").alias("src"), "dst", (F.col("w") + F.coalesce("sw", F.lit(0.0))).alias("w"))
        edges = checkpoint(_merged(edges))
        n -= taken
        if n and taken < SHARE * (n + taken):
            nodes, edges, layer, taken = _thinned(nodes, edges)
            n -= taken
            if taken:
                layers.append(layer)
            if n and taken < SHARE * (n + taken):
                break
    values = _core(nodes, edges, n) if n else nodes.select("name", F.col("b").alias("value"))
    for own, ways in reversed(layers):
        up = ways.join(values.select(F.col("name").alias("p"), "value"), "p").groupBy("name").agg(F.max(F.col("value") + F.col("w")).alias("up"))
        values = checkpoint(values.unionByName(own.join(up, "name", "left").select("name", F.greatest("b", "up").alias("value"))))
    return values


def _thinned(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, tuple[DataFrame, DataFrame], int]:
    """Nodes and edges without a set of nodes no two of which are neighbours, and that set's layer and size."""
    ends = edges.select(F.col("dst").alias("name"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(edges.select(F.col("src").alias("name"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    ends = ends.groupBy("name").agg(F.sum("i").alias("i"), F.sum("o").alias("o")).where(F.col("i") * F.col("o") <= FILL * (F.col("i") + F.col("o")))
    free = checkpoint(ends.select("name", F.struct(F.xxhash64("name").alias("h"), "name").alias("key")))
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = both.join(free.select(F.col("name").alias("src"), F.col("key").alias("k")), "src").groupBy(F.col("dst").alias("name")).agg(F.min("k").alias("k"))
    out = checkpoint(free.join(near, "name", "left").where("k is null or key < k").select("name"))
    gone = lambda c: out.withColumnRenamed("name", c)
    into = checkpoint(edges.join(gone("dst"), "dst", "left_semi"))
    own = checkpoint(nodes.join(out, "name", "left_semi"))
    over = edges.join(gone("src"), "src", "left_semi").select(F.col("src").alias("m"), F.col("dst").alias("x"), F.col("w").alias("v"))
    through = into.join(over, F.col("dst") == F.col("m")).select("src", F.col("x").alias("dst"), (F.col("w") + F.col("v")).alias("w"))
    raised = over.join(own.select(F.col("name").alias("m"), "b"), "m").select(F.col("x").alias("name"), (F.col("b") + F.col("v")).alias("b"))
    left = checkpoint(_rebased(nodes.join(out, "name", "left_anti"), raised))
    rest = edges.join(gone("src"), "src", "left_anti").join(gone("dst"), "dst", "left_anti")
    rest = checkpoint(_merged(rest.select("src", "dst", "w").unionByName(through)))
    return left, rest, (own, into.select(F.col("dst").alias("name"), F.col("src").alias("p"), "w")), out.count()
