"""Reached sets by doubled pointers, and components that are linked where their edges lie (findings of round 4)."""

import random

from pyspark.sql import functions as F

from arbora.graph import Graph
from arbora.operators import fixpoint


def _kept(monkeypatch) -> list[int]:
    rows, keep = [], fixpoint.checkpoint

    def counted(df):
        out = keep(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(fixpoint, "checkpoint", counted)
    return rows


def _chains(spark, n: int, length: int):
    nodes = spark.range(n * length).select("id", F.format_string("v%06d", "id").alias("name"))
    e = nodes.where(F.col("id") % length + 1 < length).select(F.col("name").alias("src"), F.format_string("v%06d", F.col("id") + 1).alias("dst"))
    return Graph(nodes.select("name"), e)


def test_reached_set_is_that_of_plain_search(spark):
    """Any graph: cycles, loops, parallel edges, unknown ends (F17, F21)."""
    r = random.Random(5)
    for n, m in [(2, 1), (12, 10), (30, 29), (30, 45), (40, 120), (60, 62)]:
        edges = [(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(m)]
        edges += edges[: m // 4] + [("n0", "n0"), (None, "n1"), ("n1", None)]
        starts = {f"n{r.randrange(n)}" for _ in range(2)} | {"elsewhere"}
        want, todo = set(starts), list(starts)
        while todo:
            x = todo.pop()
            more = {b for a, b in edges if a == x and b is not None} - want
            want |= more
            todo += more
        e = spark.createDataFrame(edges, "src string, dst string")
        got = [x["name"] for x in fixpoint.reach_set(e, spark.createDataFrame([(x,) for x in starts] * 2, "name string")).collect()]
        assert sorted(got) == sorted(want), (n, m)


def test_dirty_set_of_long_chains_needs_few_rounds(spark, monkeypatch):
    """No components are looked for, and rounds follow the logarithm of the depth (F17, F21)."""
    g, rows = _chains(spark, 3, 2000), _kept(monkeypatch)
    monkeypatch.setattr(fixpoint, "component_sizes", None)
    changed = spark.createDataFrame([("v000000",), ("v000007",), ("v005000",)], "name string")
    assert sorted(x["name"] for x in g.dirty_set(changed).collect()) == [f"v{i:06d}" for i in [*range(2000), *range(5000, 6000)]]
    assert len(rows) < 20 and sum(rows) < 15 * 6000


def test_components_of_edges_that_lie_together_need_no_contraction(spark, monkeypatch):
    """(F25, and all that deals components to tasks)"""
    g, rows = _chains(spark, 40, 200), _kept(monkeypatch)
    e = g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).coalesce(2)
    want = {f"v{i:06d}": f"v{i - i % 200:06d}" for i in range(8000)}
    monkeypatch.setattr(fixpoint, "PIECE_EDGES", 1000)
    got = fixpoint.components(e, whole=0)
    assert {x["node"]: x["root"] for x in got.collect()} == want
    assert sum(rows) < 3 * 8000
    got = fixpoint.components(e.repartition(7, F.rand(3)), whole=0)
    assert {x["node"]: x["root"] for x in got.collect()} == want


def test_few_scattered_links_are_joined_without_rounds(spark, monkeypatch):
    """Each round leaves plans, broadcasts and code in the driver (the pipeline's near-duplicates took more than 1500 MB there)."""
    e = _chains(spark, 20, 60).edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).repartition(5, F.rand(2))
    rows = _kept(monkeypatch)
    assert {x["node"]: x["root"] for x in fixpoint.components(e).collect()} == {f"v{i:06d}": f"v{i - i % 60:06d}" for i in range(1200)}
    assert len(rows) <= 3
