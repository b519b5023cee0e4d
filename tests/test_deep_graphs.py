"""Labels, contraction and doubling: operators of deep and large graphs in rounds, against the driver-side DAG."""

import random

import pytest
from pyspark.sql import functions as F

from arbora.dag import DAG
from arbora.errors import CycleError
from arbora.graph import Graph
from arbora.operators import contraction, fixpoint, labels


def frames(spark, names, edges, strategy):
    n = spark.createDataFrame([(x,) for x in names], "name string")
    return Graph(n, spark.createDataFrame(edges, "src string, dst string"), strategy)


def layered(r, n, chance, chain=0):
    """Random edges by name order, some repeated, and a chain hung below."""
    names = [f"n{k:04d}" for k in range(n)]
    edges = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if r.random() < chance]
    edges += [(names[0], names[k]) for k in range(1, 5)] + [(names[k], names[-1]) for k in range(n - 4, n - 1)]
    edges += edges[:3]
    tail = [f"z{k:04d}" for k in range(chain)]
    if tail:
        edges += [(names[-1], tail[0]), *zip(tail, tail[1:])]
    return names + tail, edges


@pytest.fixture(scope="module", params=["kernel", "rounds"])
def both(request, spark):
    r = random.Random(8)
    names, edges = layered(r, 10, 0.25, 5)
    dag = DAG()
    dag.add_nodes(names)
    dag.add_edges(edges)
    return dag, frames(spark, names, edges, request.param).snapshot()


def pairs_of(df, a, b):
    return {(r[a], r[b]) for r in df.collect()}


def test_index(both):
    dag, g = both
    spark = g.spark
    below = {n: set(dag.descendants(n)) for n in dag}
    every = spark.createDataFrame([(a, b) for a in dag for b in dag], "src string, dst string")
    assert all(r["reaches"] == (r["dst"] in below[r["src"]]) for r in g.can_reach(every).collect())
    some = g.nodes.where("name like '%3' or name = 'n0000'")
    asked = [r["name"] for r in some.collect()]
    assert pairs_of(g.reachable_from(some), "start", "name") == {(a, b) for a in asked for b in below[a]}
    assert pairs_of(g.ancestors_of(some), "start", "name") == {(a, b) for a in asked for b in dag.ancestors(a)}
    assert {r["name"]: r["n"] for r in g.reachability_index().sizes().collect()} == {n: len(below[n]) for n in dag}


def test_pairs_and_dirty_set(both):
    dag, g = both
    spark = g.spark
    below = {n: set(dag.descendants(n)) for n in dag}
    every = spark.createDataFrame([(a, b) for a in dag for b in dag] * 2, "src string, dst string")
    got = g.are_ancestors(every).collect()
    assert len(got) == 2 * len(below) ** 2 and all(r["reaches"] == (r["dst"] in below[r["src"]]) for r in got)
    assert g.is_ancestor("n0000", "z0004") and not g.is_ancestor("z0004", "n0000") and not g.is_ancestor("n0000", "n0000")
    assert g.are_ancestors(every.limit(0)).count() == 0
    changed = ["n0003", "n0007", "z0002", "not there"]
    rows = g.dirty_set(spark.createDataFrame([(x,) for x in changed * 2], "name string")).collect()
    assert sorted(r["name"] for r in rows) == sorted(set().union(*({x} | below[x] for x in changed if x in below)))


def test_levels_orders_reduction(both):
    dag, g = both
    lvl = {n: k for k, x in enumerate(dag.topological_levels()) for n in x}
    assert {r["name"]: r["level"] for r in g.levels().collect()} == lvl
    assert {r["name"]: r["rank"] for r in g.topological_rank().collect()} == {n: k for k, n in enumerate(dag.topological_sort())}
    assert pairs_of(g.transitive_reduction().edges, "src", "dst") == set(dag.transitive_reduction().edges())
    r = random.Random(3)
    costs = {n: float(r.randint(-2, 9)) for n in dag}
    frame = g.spark.createDataFrame(list(costs.items()), "name string, cost double")
    if g.strategy == "rounds":
        want = {}
        for n in reversed(dag.topological_sort()):
            want[n] = costs[n] + max([0.0, *[want[m] for m in dag.successors(n)]])
        assert {x["name"]: x["bottom_level"] for x in g.bottom_levels(frame).collect()} == want
    place = {x["name"]: (x["level"], x["place"]) for x in g.levels_priority(frame.withColumnRenamed("cost", "priority")).collect()}
    assert place == {n: (k, i + 1) for k in set(lvl.values()) for i, n in enumerate(sorted((m for m in lvl if lvl[m] == k), key=lambda m: (-costs[m], m)))}


@pytest.mark.parametrize("strategy", ["kernel", "rounds"])
def test_dominators(spark, strategy):
    names = list("rabcdefgh")
    edges = [("r", "a"), ("a", "b"), ("b", "c"), ("r", "d"), ("d", "e"), ("e", "c"), ("c", "f"), ("f", "g"), ("b", "g"), ("g", "h"), ("x", "h"), ("b", "c")]
    dag = DAG()
    dag.add_nodes([*names, "x"])
    dag.add_edges(edges)
    g = frames(spark, [*names, "x"], edges, strategy)
    for root in ("r", "b"):
        assert {r["name"]: r["idom"] for r in g.dominator_tree(root).collect()} == dag.dominator_tree(root)


def test_paths_by_number(both):
    dag, g = both
    every = sorted(dag.all_paths("n0000", "z0002"))
    assert len(every) > 3
    for n in (3, len(every) + 5):
        got = [r["path"] for r in g.all_paths("n0000", "z0002", n).collect()]
        assert sorted(got) == every[:n]
    assert g.all_paths("z0002", "n0000", 4).count() == 0


def test_first_of_very_many_paths(spark):
    """Nine layers of eleven nodes, each joined to all of the next: more than 10^9 paths."""
    layer = [["s"], *[[f"{x}{k:02d}" for k in range(11)] for x in "abcdefghi"], ["t"]]
    edges = [(x, y) for a, b in zip(layer, layer[1:]) for x in a for y in b]
    g = Graph.from_edges(spark.createDataFrame(edges, "src string, dst string"))
    got = sorted(r["path"] for r in g.all_paths("s", "t", 30).collect())
    want = [["s", *[f"{x}00" for x in "abcdefg"], f"h{k // 11:02d}", f"i{k % 11:02d}", "t"] for k in range(30)]
    assert got == want


def test_longest_sums_of_lattices(spark):
    """Two ways into every node: nothing to double, so nodes are taken out of the lattice."""
    n = 4
    ladder = [(f"{x}{k}", f"{y}{k + 1}") for k in range(n) for x in "ab" for y in "ab"]
    g = Graph.from_edges(spark.createDataFrame(ladder, "src string, dst string"))
    got = contraction.longest_sums(g.nodes.withColumn("one", F.lit(1.0)), g.edges, "one").collect()
    assert all(r["value"] == int(r["name"][1:]) + 1 for r in got) and len(got) == 2 * (n + 1)


def test_rounds_of_a_chain_follow_the_logarithm_of_its_depth(spark, monkeypatch):
    g = Graph.from_edges(spark.range(5_000).select(F.concat(F.lit("c"), "id").alias("src"), F.concat(F.lit("c"), F.col("id") + 1).alias("dst")), strategy="rounds")
    real, rounds = contraction.checkpoint, []
    monkeypatch.setattr(contraction, "checkpoint", lambda df: rounds.append(1) or real(df))
    assert g.levels().where("level <> cast(substring(name, 2) as int)").isEmpty() and len(rounds) < 40


def test_cycles_are_found_by_contraction(spark):
    for edges in ([("a", "b"), ("b", "a")], [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("y", "a"), ("y", "b")]):
        g = Graph.from_edges(spark.createDataFrame(edges, "src string, dst string"))
        with pytest.raises(CycleError):
            contraction.longest_sums(g.nodes.withColumn("one", F.lit(1.0)), g.edges, "one")


def test_running_in_ranges(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("k"), (F.col("id") % 7).alias("v"))
    rows = sorted((r["k"], r["v"]) for r in df.collect())
    for name, agg in (("sum", F.sum), ("max", F.max)):
        got = sorted((r["k"], r["out"]) for r in fixpoint.running(df, ["k"], "v", "out", agg, small=90).collect())
        fold = {"sum": sum, "max": max}[name]
        assert got == [(k, fold([v for _, v in rows[:i]]) if i else None) for i, (k, _) in enumerate(rows)]
    assert fixpoint.running_total(df.limit(0), ["k"], "v", "out").count() == 0
    got = sorted((r["k"], r["out"]) for r in fixpoint.running_total(df, ["k"], "v", "out", small=9).collect())
    assert got[0][1] == 0 and got[-1][1] == sum(v for _, v in rows[:-1])


def test_points_inside_intervals(spark):
    r = random.Random(5)
    points = [(r.randrange(64),) for _ in range(40)]
    spans = [(a, a + r.randrange(0, 20)) for a in (r.randrange(50) for _ in range(25))]
    got = labels.inside(spark.createDataFrame(points, "x long"), "x", spark.createDataFrame(spans, "lo long, hi long"), "lo", "hi", 7)
    assert sorted(map(tuple, got.collect())) == sorted((x, a, b) for (x,) in points for a, b in spans if a <= x < b)


def test_dominators_kernel_in_linear_time():
    import time

    from arbora.kernels import Adjacency

    names = [f"n{k:06d}" for k in range(50_000)]
    adj = Adjacency(names, zip(names, names[1:]))
    began = time.process_time()
    assert adj.dominators(0)[49_999] == 49_998
    assert time.process_time() - began < 10


def test_stale_references(spark):
    from arbora.errors import StaleNodeRefError

    g = Graph(spark.createDataFrame([("a", 1), ("b", 2)], "name string, epoch long"), spark.createDataFrame([], "src string, dst string"))
    ref = lambda *rows: spark.createDataFrame(list(rows), "name string, epoch long")
    assert g.resolve(ref(("a", 1), ("b", 2))).count() == 2
    for stale in (("a", 0), ("c", 1)):
        with pytest.raises(StaleNodeRefError):
            g.resolve(ref(("b", 2), stale))


def test_empty_graph_in_rounds(spark):
    g = Graph(spark.createDataFrame([], "name string"), spark.createDataFrame([], "src string, dst string"), "rounds")
    assert g.levels().count() == 0 and g.topological_rank().count() == 0 and g.transitive_reduction().edge_count() == 0 and g.reachability_index().sizes().count() == 0


# ---- explanation and changes ----


@pytest.mark.parametrize("strategy", ["kernel", "rounds"])
def test_what_if_rows(spark, strategy):
    from arbora.operators import analysis

    edges = [("a", "b"), ("a", "c"), ("b", "d"), ("b", "e"), ("c", "e"), ("d", "f"), ("e", "f"), ("x-1", "y/2")]
    g = Graph.from_edges(spark.createDataFrame(edges, "src string, dst string"), strategy=strategy)
    got = {tuple(r) for r in analysis.what_if(g, add_nodes=["zz", "b"], add_edges=[("f", "g"), ("q", "d")], remove_nodes=["a"]).collect()}
    path = {("critical_path", k, n, None) for k, n in enumerate("bdfg")}
    assert got == path | {("node_count", None, None, 10), ("edge_count", None, None, 8), ("width_delta", None, None, 2), ("orphaned", None, "b", None), ("orphaned", None, "c", None)}
    assert [tuple(r)[1:3] for r in analysis.what_if(g, add_edges=[("f", "a")]).orderBy("place").collect()] == list(enumerate("fabdf"))


def test_only_the_cone_of_a_change_is_relaxed_again(spark):
    from arbora.operators import analysis

    r = random.Random(6)
    names, edges = layered(r, 16, 0.15)
    g = frames(spark, names, edges, "kernel").snapshot()
    gone, new = spark.createDataFrame([("n0004",)], "name string"), spark.createDataFrame([("n0002", "n0009"), ("n0000", "zz")], "src string, dst string")
    h = analysis.changed(g, add_edges=new, remove_nodes=gone, remove_edges=spark.createDataFrame([edges[-1]], "src string, dst string"))
    want = {(x["name"], x["level"]) for x in h.levels().collect()}
    assert {(x["name"], x["level"]) for x in analysis.relevelled(g, g.levels(), h).collect()} == want


def test_explain_on_one_long_chain(spark):
    from arbora.operators import analysis

    g = Graph.from_edges(spark.range(2000).selectExpr("concat('n', lpad(id, 5, '0')) as src", "concat('n', lpad(id + 1, 5, '0')) as dst"))
    assert tuple(analysis.explain(g).selectExpr("max(size(dominates))", "sum(descendants)", "max(ancestors)").first()) == (2000, 2001 * 1000, 2000)


@pytest.mark.parametrize("strategy", ["kernel", "rounds"])
def test_dominated_by_every_node(spark, strategy):
    from arbora.operators import analysis

    names, edges = layered(random.Random(9), 9, 0.25)
    dag = DAG()
    dag.add_nodes(names)
    dag.add_edges(edges)
    for row in analysis.dominated(frames(spark, names, edges, strategy)).collect():
        n, up, down = row["name"], set(dag.ancestors(row["name"])), set(dag.descendants(row["name"]))
        assert row["dominates"] == sorted(m for m in down if not (set(dag.ancestors(m)) - {n} - up - down)), n
