import pytest

from arbora.dag import DAG
from arbora.errors import CycleError, DuplicateNodeError, GraphError, NodeNotFoundError
from arbora.graph import Graph
from arbora.operators import analysis
from arbora.plans.selection import parse, select
from arbora.sources import text
from arbora.streaming.versions import VersionedGraph

EDGES = [("a", "b"), ("a", "c"), ("b", "d"), ("b", "e"), ("c", "e"), ("d", "f"), ("e", "f"), ("x-1", "y/2")]


@pytest.fixture(scope="module")
def dag():
    d = DAG()
    d.add_nodes(["a", "b", "c", "d", "e", "f", "x-1", "y/2", "lone é"])
    d.add_edges(EDGES)
    return d


@pytest.fixture(scope="module")
def graph(spark, dag):
    return dag.graph(spark).snapshot()


def col(df, name="name"):
    return sorted(r[name] for r in df.collect())


def as_map(df, k, v):
    return {r[k]: r[v] for r in df.collect()}


@pytest.mark.parametrize("strategy", ["kernel", "rounds"])
def test_both_strategies_equal_the_local_dag(graph, dag, strategy):
    g = Graph(graph.nodes, graph.edges, strategy)
    local = {n: k for k, x in enumerate(dag.topological_levels()) for n in x}
    assert as_map(g.levels(), "name", "level") == local
    costs = g.spark.createDataFrame([("b", 5.0), ("zz", 7.0), ("d", 0.0)], "name string, cost double")
    assert as_map(g.bottom_levels(costs), "name", "bottom_level") == dag.bottom_levels({"b": 5.0, "d": 0.0})
    pairs = {(r["src"], r["dst"]) for r in g.closure().collect()}
    assert pairs == {(a, b) for a in dag for b in dag.descendants(a)}
    assert as_map(g.dominator_tree("a"), "name", "idom") == dag.dominator_tree("a")
    assert as_map(g.topological_rank(), "name", "rank") == {n: k for k, n in enumerate(dag.topological_sort())}


def test_reach_paths_plans(graph, dag):
    assert set(col(graph.descendants("b"))) == dag.descendants("b")
    assert set(col(graph.ancestors("f"))) == dag.ancestors("f")
    assert sorted(r["path"] for r in graph.all_paths("a", "f").collect()) == dag.all_paths("a", "f")
    assert graph.shortest_path("a", "f").first()["path"] == dag.shortest_path("a", "f")
    costs = {"c": 9.0}
    frame = graph.spark.createDataFrame(list(costs.items()), "name string, cost double")
    assert tuple(graph.longest_path("a", "f", frame).first()) == dag.longest_path("a", "f", costs)
    assert [r["name"] for r in graph.critical_path(frame).orderBy("place").collect()] == dag.critical_path(costs)[0]
    plan = {n.name: n.start_time for s in dag.execution_plan(costs).steps for n in s}
    assert as_map(graph.execution_plan(frame), "name", "start_time") == plan
    plan = {n.name: n.start_time for s in dag.execution_plan_constrained(2, costs).steps for n in s}
    assert as_map(graph.execution_plan_constrained(2, frame), "name", "start_time") == plan
    assert graph.would_create_cycle("f", "a") and not graph.would_create_cycle("a", "f")


def test_transforms(graph, dag):
    assert {tuple(r)[:2] for r in graph.transitive_reduction().edges.collect()} == set(dag.transitive_reduction().edges())
    assert {tuple(r)[:2] for r in graph.collapse(["b", "c"], "m").edges.collect()} == set(dag.collapse(["b", "c"], "m").edges())
    with pytest.raises(DuplicateNodeError):
        graph.collapse(["b"], "a")
    with pytest.raises(NodeNotFoundError):
        graph.subgraph(["zz"])
    with pytest.raises(DuplicateNodeError):
        graph.subgraph(["a", "a"])
    assert set(col(graph.subgraph_by_depth("b", 1, "both").nodes)) == {"a", "b", "d", "e"}
    s = analysis.stats(graph).first().asDict()
    assert {k: s[k] for k in ("node_count", "edge_count", "depth", "width", "component_count")} == {k: dag.stats()[k] for k in ("node_count", "edge_count", "depth", "width", "component_count")}
    with pytest.raises(GraphError):
        graph.matching_regex("(?=a)")


def test_validation(spark, graph):
    graph.validate()
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "z")], "src string, dst string")
    with pytest.raises(CycleError):
        Graph.from_edges(e).validate()
    with pytest.raises(NodeNotFoundError):
        Graph(spark.createDataFrame([("a",)], "name string"), e).validate()


def test_empty_graph(spark):
    g = Graph(spark.createDataFrame([], "name string"), spark.createDataFrame([], "src string, dst string"))
    assert analysis.stats(g).first()["node_count"] == 0
    assert g.levels().count() == 0 and g.closure().count() == 0 and g.critical_path().count() == 0 and g.topological_rank().count() == 0
    assert [r["code"] for r in analysis.lint(g).collect()] == ["EMPTY_GRAPH"]


def test_selection(graph):
    assert parse("a - b & c") == ("-", ("name", "a"), ("&", ("name", "b"), ("name", "c")))
    assert col(select(graph, "ancestors(f) & depth <= 1")) == ["a", "b", "c"]
    assert col(select(graph, '"x-1" | name:y*')) == ["x-1", "y/2"]
    assert col(select(graph, "leaves - (roots | f)")) == ["y/2"]
    for bad in ("", "a &", "depth < x", "(a", "a )"):
        with pytest.raises(GraphError):
            parse(bad)


def test_round_trips(spark, graph, tmp_path):
    from arbora.sources.records import from_records, load, save

    back = text.from_bytes(spark, text.to_bytes(graph))
    assert col(back.nodes) == col(graph.nodes) and back.edge_count() == graph.edge_count()
    assert col(text.from_json(spark, text.to_json(graph)).nodes) == col(graph.nodes)
    save(graph, str(tmp_path / "g"))
    assert col(load(spark, str(tmp_path / "g")).nodes) == col(graph.nodes)
    assert "digraph" in text.to_dot(graph) and "graph TD" in text.to_mermaid(graph)
    g = from_records(spark, [{"name": "a"}, {"name": "b", "deps": ["a"]}], edge_fn=lambda r: r.get("deps", []))
    assert [tuple(r)[:2] for r in g.edges.collect()] == [("a", "b")]


def test_versions(spark):
    v = VersionedGraph(spark)
    for n in "ab":
        v.add_node(n, {"n": n})
    v.add_edge("a", "b")
    v.remove_node("b")
    at = v.add_node("b")
    assert v.at_version(3).edge_count() == 1 and v.at_version(at).edge_count() == 0
    assert col(v.at_version(4).nodes) == ["a"]
    f = v.fork(3)
    assert f.version == 3 and f.at_version().edge_count() == 1
    assert {(r["kind"], r["change"]) for r in v.diff_versions(3, 4).collect()} == {("node", "removed"), ("edge", "removed")}
    v.compact()
    with pytest.raises(ValueError):
        v.at_version(1)
    assert col(v.at_version().nodes) == ["a", "b"]


def test_stream_of_run_logs(spark, tmp_path):
    from arbora.streaming.replay import last_values, list_runs, read_run_log, read_stream

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "r.jsonl").write_text('{"t": 1.0, "name": "a", "fp": "x"}\nnot json\n{"t": 2.0, "name": "a", "fp": "y"}\n')
    assert read_run_log(spark, str(tmp_path)).where("name is not null").count() == 2 and list_runs(spark, str(tmp_path)).count() == 1
    q = last_values(read_stream(spark, str(tmp_path / "d")).where("name is not null")).writeStream.outputMode("complete").format("memory").queryName("latest").start()
    q.processAllAvailable()
    q.stop()
    assert [r["fp"] for r in spark.table("latest").collect()] == ["y"]


def test_quality(spark):
    from arbora.quality.contracts import compatible
    from arbora.quality.schema import ColumnRule, FramePipeline, FrameRules

    p = FramePipeline().step("x", lambda: spark.range(3), rules=FrameRules([ColumnRule("id", "int"), ColumnRule("no")], min_rows=5))
    _, bad = p.run()
    assert sorted(k for _, _, k, _ in bad) == ["min_rows", "missing"]
    assert compatible(bool, int) and not compatible(str, int) and compatible(list[int], list) and compatible(int, int | str) and not compatible(int | str, int)


def test_global_rank_in_ranges(spark):
    from pyspark.sql import functions as F

    from arbora.operators.fixpoint import global_rank

    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("k"))
    got, n = global_rank(df, ["k"], "r", 5, small=100)
    rows = sorted((r["k"], r["r"]) for r in got.collect())
    assert n == 1000 and [r for _, r in rows] == list(range(5, 1005))


def test_reach_has_no_bound(spark, monkeypatch):
    from arbora.operators import fixpoint

    monkeypatch.setattr(fixpoint, "MAX_ROUNDS", 3, raising=False)
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(6)], "src string, dst string")
    got = fixpoint.reach(edges, spark.createDataFrame([("n0",)], "name string")).collect()
    assert sorted((r["name"], r["hops"]) for r in got) == [(f"n{i}", i) for i in range(1, 7)]


def test_divisors_of_large_sizes(spark, tmp_path):
    from arbora.plans import derived

    spark.createDataFrame([(300,), (600,), (900,), (7,)], "p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = derived.divisors(spark, str(tmp_path)).edges.collect()
    assert sorted((r["src"], r["dst"]) for r in got) == [("s300", "s600"), ("s300", "s900")]


# ---- cycles, checks, iterators, parts ----


@pytest.mark.parametrize("strategy", ["kernel", "rounds"])
def test_cycles(spark, strategy):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("f", "g"), ("g", "f"), ("h", "h"), ("e", "f")]
    g = Graph.from_edges(spark.createDataFrame(edges, "src string, dst string"), strategy=strategy)
    assert {r["cycle"]: r["names"] for r in g.find_cycles().collect()} == {"a": ["a", "b", "c"], "f": ["f", "g"], "h": ["h"]}
    assert col(g.cyclic_core()) == ["a", "b", "c", "f", "g", "h"]
    with pytest.raises(CycleError) as e:
        g.validate()
    assert e.value.args and g.cycle_through("a") == ["a", "b", "c", "a"] and g.cycle_through("d") == [] and g.cycle_through("h") == ["h", "h"]


def test_closing_path_and_checked_changes(graph):
    spark = graph.spark
    assert graph.closing_path("f", "a") == ["a", "b", "d", "f"] and graph.closing_path("a", "f") is None and graph.closing_path("a", "a") == ["a"]
    assert graph.would_create_cycle("f", "a") and not graph.would_create_cycle("a", "f")
    pair = lambda *p: spark.createDataFrame(list(p), "src string, dst string")
    with pytest.raises(CycleError):
        graph.add_edges(pair(("f", "a")))
    with pytest.raises(NodeNotFoundError):
        graph.add_edges(pair(("a", "nobody")))
    with pytest.raises(DuplicateNodeError):
        graph.add_nodes(spark.createDataFrame([("a",)], "name string"))
    with pytest.raises(CycleError):
        graph.collapse(["a", "f"], "af")
    with pytest.raises(CycleError):
        graph.merge(Graph.from_edges(pair(("f", "a"))))
    assert graph.merge(Graph.from_edges(pair(("f", "z")))).node_count() == graph.node_count() + 1
    assert graph and not Graph(graph.nodes.limit(0), graph.edges.limit(0))
    assert [tuple(r) for r in graph.creating_cycles(pair(("f", "a"), ("a", "f"), ("b", "b"))).orderBy("src").collect()] == [("b", "b"), ("f", "a")]


def test_iterators(graph, dag):
    assert list(graph.iter_roots()) == sorted(dag.roots()) and list(graph.iter_leaves()) == sorted(dag.leaves())
    assert list(graph.iter_ancestors("f")) == sorted(dag.ancestors("f")) and list(graph.iter_descendants("b")) == sorted(dag.descendants("b"))
    assert list(graph.iter_topological()) == dag.topological_sort()
    assert [sorted(x) for x in graph.iter_levels()] == [sorted(x) for x in dag.topological_levels()]


def test_paths_with_a_limit_are_the_first(graph, dag):
    every = sorted(dag.all_paths("a", "f"))
    for n in range(1, len(every) + 2):
        assert sorted(r["path"] for r in graph.all_paths("a", "f", n).collect()) == every[:n]


def test_all_orders(spark, graph, dag):
    sub = ["b", "c", "d", "e", "f"]
    got = graph.subgraph(sub).all_topological_orders().orderBy("order_id", "rank").collect()
    orders = {}
    for r in got:
        orders.setdefault(r["order_id"], []).append(r["name"])
    below = {n: dag.descendants(n) for n in sub}
    assert len(orders) == len(set(map(tuple, orders.values()))) and list(orders.values()) == sorted(orders.values())
    assert all(o.index(n) < o.index(m) for o in orders.values() for n in sub for m in below[n] if m in sub)
    assert graph.subgraph(sub).all_topological_orders(2).select("order_id").distinct().count() == 2
    deep = Graph.from_edges(spark.createDataFrame([(f"n{k:05d}", f"n{k + 1:05d}") for k in range(3000)], "src string, dst string"))
    assert deep.all_topological_orders(3).count() == 3001


def test_dominated(graph, dag):
    for r in analysis.explain(graph).collect():
        n, up, down = r["name"], dag.ancestors(r["name"]), dag.descendants(r["name"])
        want = sorted(m for m in down if not (dag.ancestors(m) - {n} - up - down))
        assert r["dominates"] == want, n


def test_parts(spark, graph, dag):
    import random

    from arbora.kernels import Adjacency

    r = random.Random(4)
    names = [f"n{k:03d}" for k in range(60)]
    edges = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if r.random() < 0.06]
    g = Graph(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(edges, "src string, dst string"))
    adj = Adjacency(names, edges)
    cost = {n: float(r.randint(0, 9)) for n in names}
    costs = spark.createDataFrame(list(cost.items()), "name string, cost double")
    for k in (1, 3, 7, 100):
        assert as_map(g.partition_balanced(k, costs), "name", "partition_id") == dict(zip(names, adj.part_balanced(k, lambda i: cost[names[i]])))
    for k in (2, 4):
        start, part = adj.part_by_levels(k), adj.part_low_cut(k, lambda i: cost[names[i]])
        cut = lambda p: sum(p[names.index(a)] != p[names.index(b)] for a, b in edges)
        assert set(part) == set(start) and cut(part) <= cut(start) and all(part[names.index(a)] <= part[names.index(b)] for a, b in edges)


def test_components_whole_and_in_rounds(spark):
    import random

    from arbora.operators import fixpoint

    r = random.Random(2)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(260)]
    e = spark.createDataFrame(pairs, "a long, b long").repartition(4)
    rounds = {tuple(x) for x in fixpoint.components(e).collect()}
    assert {tuple(x) for x in fixpoint.components(e, whole=10_000).collect()} == rounds
    assert {tuple(x) for x in fixpoint.components(e, whole=10).collect()} == rounds
    assert fixpoint.components(e.limit(0), whole=10).count() == 0
