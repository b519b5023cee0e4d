"""Tables of intervals and the version table against the log's own reading of a version."""

import random

import pytest

from arbora.errors import GraphError
from arbora.streaming.intervals import VersionTable, as_of, edge_intervals, node_intervals
from arbora.streaming.versions import at_version

KIND = "version long, mutation_type string, name string, src string, dst string, weight double, label string, payload string"


@pytest.fixture(scope="module")
def rows():
    r, names, out = random.Random(2), "abcd", []
    for v in range(1, 90):
        kind = r.choice(["add_node", "add_node", "remove_node", "add_edge", "add_edge", "add_edge", "remove_edge", "set_payload"])
        a, b = r.sample(names, 2)
        edge = kind.endswith("edge")
        out.append((v, kind, None if edge else a, a if edge else None, b if edge else None, float(v) if edge else None, None, None if edge else f"p{v}"))
    return out


def shape(g):
    return sorted(map(tuple, g.nodes.select("name", "payload").collect())), sorted(map(tuple, g.edges.select("src", "dst", "weight").collect()))


def test_every_version_from_intervals(spark, rows):
    log = spark.createDataFrame(rows, KIND)
    nodes, edges = node_intervals(log).cache(), edge_intervals(log).cache()
    for v in (0, 7, 30, 55, 89):
        assert shape(as_of(nodes, edges, v)) == shape(at_version(log, v)), v


def test_version_table(spark, rows, tmp_path):
    t = VersionTable(spark, str(tmp_path / "a"))
    frame = lambda part: spark.createDataFrame(part, KIND)
    assert t.append(frame(rows[:40])) == 40 and t.append(frame(rows[40:])) == 89
    with pytest.raises(GraphError):
        t.append(frame(rows[:2]))
    want = shape(at_version(frame(rows), 60))
    assert t.span() == (1, 89) and shape(t.at(60)) == want and t.history(80).count() == 9
    f = t.fork(str(tmp_path / "b"), 60)
    assert f.span() == (1, 60) and shape(f.at()) == want
    c = t.compact(str(tmp_path / "c"), 60)
    assert shape(c.at(60)) == want and shape(c.at())[0] == shape(t.at())[0]
    for v in (59, 90):
        with pytest.raises(GraphError):
            c.at(v)


@pytest.mark.parametrize("form", ["json", "bytes"])
def test_graph_files_in_parts(spark, tmp_path, form):
    import os

    from arbora.graph import Graph
    from arbora.sources import text
    from arbora.sources.files import read_graph, write_graph

    nodes = spark.createDataFrame([(f'n"{k} é', f'{{"k": {k}}}' if k % 2 else None) for k in range(40)], "name string, payload string").repartition(3)
    edges = spark.createDataFrame([('n"1 é', 'n"2 é', 2.5, "x"), ('n"1 é', 'n"2 é', 1.0, None)], "src string, dst string, weight double, label string")
    folder = str(tmp_path / form)
    write_graph(Graph(nodes, edges), folder, form)
    back = read_graph(spark, folder)
    assert sorted(map(tuple, back.nodes.select("name", "payload").collect()), key=repr) == sorted(map(tuple, nodes.collect()), key=repr)
    assert sorted(map(tuple, back.edges.select("src", "dst", "weight", "label").collect()), key=repr) == sorted(map(tuple, edges.collect()), key=repr)
    parts = [f for f in os.listdir(folder) if f.startswith("part-")]
    assert len(parts) > 2 and not [f for f in os.listdir(folder) if f.startswith("_part")]
    if form == "bytes":
        with open(os.path.join(folder, parts[0]), "rb") as f:
            assert text.from_bytes(spark, f.read()).node_count() >= 0
    write_graph(Graph(nodes.limit(0), edges.limit(0)), folder, form)
    assert read_graph(spark, folder).node_count() == 40
