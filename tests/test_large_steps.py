"""Steps whose memory, disk or time grew faster than their input (findings of round 4)."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from arbora.graph import Graph
from arbora.llm import alignment
from arbora.llm.queries import tokenizer_path
from arbora.operators import analysis, fixpoint
from arbora.plans import catalog, derived


def test_blocks_of_documents_lie_in_row_groups_of_few(spark, tmp_path):
    """A task's buffer, and what is read at once, don't grow with the number of its blocks (F1)."""
    docs = spark.range(60, numPartitions=1).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 1500), x -> conv(hash(x, id), 10, 36)), ' ')").alias("text"))
    folder = str(tmp_path / "blocks")
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    made = alignment.described(docs, *paths, 1 << 10)
    made.write.options(compression="zstd", **alignment.ROW_GROUPS | {"parquet.block.size": 1 << 20}).parquet(folder)
    (name,) = glob.glob(f"{folder}/*.parquet")
    meta = pq.ParquetFile(name).metadata
    sizes = [(meta.row_group(k).num_rows, meta.row_group(k).total_byte_size) for k in range(meta.num_row_groups)]
    assert meta.num_rows == 60 and len(sizes) > 2 and max(s for _, s in sizes) < 3 << 20, sizes


def _chains(spark, n: int, length: int, step: int = 1):
    """n chains of ``length`` nodes; each node leads to those up to ``step`` behind it."""
    nodes = spark.range(n * length).select(F.format_string("v%05d", "id").alias("name"), F.col("id"))
    e = nodes.select("id", F.col("name").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(step))).alias("k")).where(F.col("id") % length + F.col("k") < length)
    return Graph(nodes.select("name"), e.select("src", F.format_string("v%05d", F.col("id") + F.col("k")).alias("dst")))


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_components_handle_each_edge_a_few_times(spark, monkeypatch):
    """Rows written in all rounds stay a few times the edges, however long the chains (F8 to F10, F12, F16 to F22)."""
    g, rows, keep = _chains(spark, 4, 700), [], fixpoint.checkpoint

    def counted(df):
        out = keep(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(fixpoint, "checkpoint", counted)
    got = fixpoint.components(g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    assert {r["node"]: r["root"] for r in got.collect()} == {f"v{i:05d}": f"v{i - i % 700:05d}" for i in range(2800)}
    assert sum(rows) < 10 * 2796


def test_a_chain_with_shortcuts_keeps_an_interval_a_node(spark):
    """(F4, F18, F19)"""
    g = _chains(spark, 5, 40, 2)
    index = g.reachability_index()
    assert index.nodes.agg(F.max(F.size("los"))).first()[0] == 1
    assert _rows(index.sizes()) == [(f"v{i:05d}", 39 - i % 40) for i in range(200)]
    rest = _chains(spark, 5, 40, 2)
    rest.strategy = "rounds"
    assert _rows(rest.reachability_index().sizes()) == _rows(index.sizes())


def test_dominated_nodes_are_counted_by_component(spark):
    """(F3)"""
    e = analysis.explain(_chains(spark, 30, 20), listed=False)
    assert _rows(e.select("name", "dominated")) == [(f"v{i:05d}", 19 - i % 20) for i in range(600)]
    g = _chains(spark, 2, 9, 3)
    want = _rows(analysis.explain(g).select("name", "ancestors", "descendants", F.size("dominates").cast("long")))
    g.strategy = "rounds"
    assert _rows(analysis.explain(g, listed=False).select("name", "ancestors", "descendants", "dominated")) == want


def test_lineage_in_tasks_is_that_of_rounds(spark):
    """Repeated and unknown names keep their rows (F11)."""
    g = _chains(spark, 3, 12, 2)
    done = g.nodes.select("name", F.when(F.xxhash64("name") % 3 == 0, "failed").otherwise("completed").alias("status"))
    names = g.nodes.select("name").unionByName(spark.createDataFrame([("v00005",), ("nobody",)], "name string"))
    got = _rows(analysis.lineage(g, done, names))
    g.strategy = "rounds"
    assert _rows(analysis.lineage(g, done, names)) == got and len(got) == 38


def test_trees_are_trimmed_before_cycles_are_looked_for(spark):
    """(F13 to F15, F23)"""
    e = spark.range(1, 2000).select(F.concat(F.lit("n"), (F.col("id") / 10).cast("long")).alias("src"), F.concat(F.lit("n"), "id").alias("dst"))
    assert Graph.from_edges(e)._trimmed().isEmpty()
    more = e.unionByName(spark.createDataFrame([("n5", "n0")], "src string, dst string"))
    assert _rows(Graph.from_edges(more)._trimmed()) == [("n0", "n5"), ("n5", "n0")]


def test_world_by_groups_grows_with_its_tables(spark, tmp_path):
    """Edges follow the rows, not their pairs; what dominates and what lies above is the same (F2, F6, F7)."""
    put = lambda df, name: df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    put(spark.range(2).select(F.col("id").alias("r_regionkey")), "region")
    put(spark.range(4).select(F.col("id").alias("n_nationkey"), (F.col("id") % 2).alias("n_regionkey")), "nation")
    put(spark.range(300).select(F.col("id").alias("c_custkey"), (F.col("id") % 3).alias("c_nationkey")), "customer")
    put(spark.range(160).select(F.col("id").alias("s_suppkey"), (F.col("id") % 4).alias("s_nationkey")), "supplier")
    put(spark.range(400).select(F.col("id").alias("o_orderkey"), (F.col("id") % 300).alias("o_custkey")), "orders")
    a, b = derived.world(spark, str(tmp_path)), derived.world_by_groups(spark, str(tmp_path))
    assert b.edge_count() < 3 * b.node_count() and a.edge_count() > b.edge_count()
    real = b.nodes.where("name not like 'group:%'")
    names = a.nodes.where("name like 'order:%' or name like 'c%'")
    want = _rows(a.ancestors_of(names).groupBy("start").count())
    for strategy in ("auto", "rounds"):
        b = Graph(b.nodes, b.edges, strategy)
        assert _rows(b.ancestor_counts(names, real)) == want
    assert _rows(catalog.QUERIES["dominators_world"](spark, str(tmp_path))) == _rows(a.dominator_tree("world"))
