"""Graphs as two DataFrames.

``nodes``: name, payload (JSON text), metadata map<string,string>, epoch, ord.
``edges``: src, dst, weight, label, edge_id; a bag, so parallel edges stay.
Every operator is a relational program; iterated ones have two forms with equal results, one over whole
components inside tasks and one by rounds of joins, chosen by the size of the largest component.
"""

from __future__ import annotations

from functools import cached_property
from itertools import chain, count, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.errors import CycleError, DuplicateNodeError, EdgeNotFoundError, GraphError, NodeNotFoundError, StaleNodeRefError, TooLargeError
from arbora.functions.patterns import glob_to_regex
from arbora.kernels import Adjacency
from arbora.operators import contraction, fixpoint

NODE_COLUMNS = {"payload": "string", "metadata": "map<string,string>", "epoch": "long", "ord": "long"}
EDGE_COLUMNS = {"weight": "double", "label": "string", "edge_id": "long"}
SEQUENTIAL_NODES = 2_000_000


def _shaped(df: DataFrame, keys: list[str], optional: dict[str, str], defaults: dict[str, object]) -> DataFrame:
    cols = [F.col(k).cast("string").alias(k) for k in keys]
    for name, kind in optional.items():
        given = F.col(name) if name in df.columns else F.lit(defaults.get(name))
        if name in defaults:
            given = F.coalesce(given, F.lit(defaults[name]))
        cols.append(given.cast(kind).alias(name))
    return df.select(*cols)


class Graph:
    """A directed acyclic graph; methods give DataFrames or new graphs and never change this one."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, strategy: str = "auto"):
        self.nodes = _shaped(nodes, ["name"], NODE_COLUMNS, {"epoch": 0})
        self.edges = _shaped(edges, ["src", "dst"], EDGE_COLUMNS, {"weight": 1.0})
        self.strategy = strategy

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def _same(self, nodes: DataFrame, edges: DataFrame) -> Graph:
        return Graph(nodes, edges, self.strategy)

    @classmethod
    def from_edges(cls, edges: DataFrame, nodes: DataFrame | None = None, strategy: str = "auto") -> Graph:
        """A graph whose nodes are the given ones and all ends of edges."""
        ends = edges.select(F.col("src").alias("name")).unionByName(edges.select(F.col("dst").alias("name"))).distinct()
        if nodes is not None:
            missing = ends.join(nodes, "name", "left_anti")
            ends = nodes.unionByName(missing, allowMissingColumns=True)
        return cls(ends, edges, strategy)

    # ---- validation ----

    def validate(self) -> Graph:
        """Raise on duplicate names, edges with unknown ends, or a cycle (the error carries one)."""
        self._check_nodes()
        self._check_ends(self.edges)
        self._check_cycles()
        return self

    def _check_nodes(self) -> None:
        twice = self.nodes.groupBy("name").count().where("count > 1").select("name").first()
        if twice:
            raise DuplicateNodeError(twice[0])

    def _check_ends(self, edges: DataFrame) -> None:
        ends = edges.select(F.explode(F.array("src", "dst")).alias("name"))
        lost = ends.join(self.nodes, "name", "left_anti").first()
        if lost:
            raise NodeNotFoundError(lost[0])

    def _check_cycles(self) -> None:
        e = self._trimmed()
        at = None if e.isEmpty() else Graph.from_edges(e, strategy=self.strategy).strong_components().where("on_cycle").agg(F.min("name")).first()[0]
        if at is not None:
            raise CycleError(self.cycle_through(at))

    def _trimmed(self) -> DataFrame:
        """Edges without most that can't lie on cycles: those from roots and to leaves, while a tenth of the edges go."""
        e = self.edges.select("src", "dst").distinct()
        n = None
        while True:
            e = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            e = fixpoint.checkpoint(e.select("src", "dst"))
            m = e.count()
            if not m or n is not None and m > 0.9 * n:
                return e
            n = m

    def strong_components(self) -> DataFrame:
        """name, component (the smallest name that it shares a cycle with, or its own), on_cycle."""
        loops = self.edges.where("src = dst").select(F.col("src").alias("name")).distinct().withColumn("__loop", F.lit(True))
        if self._kernel():
            def kernel(adj: Adjacency, cols: dict) -> dict[str, list]:
                return {"name": adj.names, "component": adj.label(adj.strong_components())}

            found = fixpoint.by_component(self.nodes, self.edges, self._components[0], kernel, "name string,component string")
        else:
            found = self._strong_by_rounds()
        found = fixpoint.checkpoint(found)
        size = found.groupBy("component").agg(F.count("*").alias("__n"))
        out = found.join(loops, "name", "left").join(size, "component")
        return out.select("name", "component", ((F.col("__n") > 1) | F.coalesce("__loop", F.lit(False))).alias("on_cycle"))

    def _strong_by_rounds(self) -> DataFrame:
        """Colours: every node takes the smallest name that reaches it; what reaches that node in its colour is one component."""
        left = fixpoint.checkpoint(self.nodes.select("name"))
        e = fixpoint.checkpoint(self.edges.where("src <> dst").select("src", "dst").distinct())
        done: DataFrame | None = None
        while not left.isEmpty():
            color = left.withColumn("color", F.col("name"))
            while True:
                sent = e.join(color.withColumnRenamed("name", "src"), "src").groupBy(F.col("dst").alias("name")).agg(F.min("color").alias("up"))
                now = fixpoint.checkpoint(color.join(sent, "name", "left").select("name", F.least("color", "up").alias("color"), F.coalesce(F.col("up") < F.col("color"), F.lit(False)).alias("changed")))
                color = now.select("name", "color")
                if now.where("changed").isEmpty():
                    break
            same = e.join(color.select(F.col("name").alias("src"), F.col("color").alias("a")), "src").join(color.select(F.col("name").alias("dst"), F.col("color").alias("b")), "dst")
            back = same.where("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
            part = fixpoint.reach(back, color.where("name = color"), None, True).select("name", F.col("start").alias("component"))
            part = fixpoint.checkpoint(part)
            done = part if done is None else done.unionByName(part)
            left = fixpoint.checkpoint(left.join(part, "name", "left_anti"))
            e = fixpoint.checkpoint(e.join(left.withColumnRenamed("name", "src"), "src", "left_semi").join(left.withColumnRenamed("name", "dst"), "dst", "left_semi"))
        return left.withColumn("component", F.col("name")) if done is None else done

    def find_cycles(self) -> DataFrame:
        """cycle (the smallest name on it), names (sorted): nodes that share cycles; no rows if there are none."""
        on = self.strong_components().where("on_cycle")
        return on.groupBy(F.col("component").alias("cycle")).agg(F.array_sort(F.collect_list("name")).alias("names"))

    def cyclic_core(self) -> DataFrame:
        """Names of nodes on cycles."""
        return self.strong_components().where("on_cycle").select("name")

    def cycle_through(self, name: str) -> list[str]:
        """A shortest cycle through a node, its first name again at the end; empty if there is none."""
        nxt = self.edges.where(F.col("src") == name).select("dst").distinct()
        if not nxt.where(F.col("dst") == name).isEmpty():
            return [name, name]
        back = fixpoint.reach(self._flipped(), self.spark.createDataFrame([(name,)], "name string"))
        near = nxt.join(back.withColumnRenamed("name", "dst"), "dst").agg(F.min(F.struct("hops", "dst")).alias("m")).select("m.dst").first()[0]
        return [] if near is None else [name, *self.shortest_path(near, name).first()["path"]]

    def closing_path(self, src: str, dst: str) -> list[str] | None:
        """The path from dst to src that an edge src -> dst would close to a cycle; None if there is none."""
        self._require([src, dst])
        if src == dst:
            return [src]
        row = self.shortest_path(dst, src).first()
        return row["path"] if row else None

    def would_create_cycle(self, src: str, dst: str) -> bool:
        return self.closing_path(src, dst) is not None

    def creating_cycles(self, pairs: DataFrame) -> DataFrame:
        """The rows (src, dst) of ``pairs`` that would each close a cycle."""
        p = pairs.select("src", "dst").distinct()
        down = self.reached(p.select(F.col("dst").alias("name")).distinct()).select(F.col("start").alias("dst"), F.col("name").alias("src"))
        return p.where("src = dst").unionByName(p.join(down, ["src", "dst"], "left_semi"))

    # ---- looking at nodes ----

    def has_node(self, name: str) -> bool:
        return not self.nodes.where(F.col("name") == name).isEmpty()

    def has_edge(self, src: str, dst: str) -> bool:
        self._require([src, dst])
        return not self.edges.where((F.col("src") == src) & (F.col("dst") == dst)).isEmpty()

    def node_count(self) -> int:
        return self.nodes.count()

    def edge_count(self) -> int:
        return self.edges.count()

    def __len__(self) -> int:
        return self.node_count()

    def __bool__(self) -> bool:
        return not self.nodes.isEmpty()

    def _require(self, names: list[str]) -> None:
        wanted = self.spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "name string")
        lost = wanted.join(self.nodes, "name", "left_anti").first()
        if lost:
            raise NodeNotFoundError(lost[0])

    def node_names(self) -> DataFrame:
        return self.nodes.select("name", "ord").orderBy("ord", "name").select("name")

    def edge_list(self) -> DataFrame:
        return self.edges.orderBy("edge_id", "src", "dst")

    def payload(self, name: str) -> str | None:
        row = self.nodes.where(F.col("name") == name).select("payload").first()
        if row is None:
            raise NodeNotFoundError(name)
        return row[0]

    def metadata(self, name: str) -> dict[str, str] | None:
        row = self.nodes.where(F.col("name") == name).select("metadata").first()
        if row is None:
            raise NodeNotFoundError(name)
        return row[0]

    def known_nodes(self, names: DataFrame) -> DataFrame:
        """name, known: whether each given name is a node."""
        here = self.nodes.select("name", F.lit(True).alias("__known"))
        return names.select("name").join(here, "name", "left").select("name", F.coalesce("__known", F.lit(False)).alias("known"))

    def known_edges(self, pairs: DataFrame) -> DataFrame:
        """src, dst, known: whether each given pair is an edge."""
        here = self.edges.select("src", "dst").distinct().withColumn("__known", F.lit(True))
        return pairs.select("src", "dst").join(here, ["src", "dst"], "left").select("src", "dst", F.coalesce("__known", F.lit(False)).alias("known"))

    def with_payloads(self, updates: DataFrame) -> Graph:
        """Payloads of ``updates`` (name, payload) replace the old ones."""
        u = updates.select("name", F.col("payload").alias("__new"), F.lit(True).alias("__hit"))
        n = self.nodes.join(u, "name", "left").withColumn("payload", F.when(F.col("__hit"), F.col("__new")).otherwise(F.col("payload")))
        return self._same(n.drop("__new", "__hit"), self.edges)

    def with_metadata(self, updates: DataFrame) -> Graph:
        u = updates.select("name", F.col("metadata").alias("__new"), F.lit(True).alias("__hit"))
        n = self.nodes.join(u, "name", "left").withColumn("metadata", F.when(F.col("__hit"), F.col("__new")).otherwise(F.col("metadata")))
        return self._same(n.drop("__new", "__hit"), self.edges)

    def resolve(self, refs: DataFrame) -> DataFrame:
        """Node references (name, epoch) joined to their nodes; raises on a stale one."""
        j = refs.select("name", F.col("epoch").alias("__epoch")).join(self.nodes, "name", "left")
        stale = j.where("epoch is null or epoch <> __epoch").select("name").first()
        if stale:
            raise StaleNodeRefError(stale[0])
        return j.drop("__epoch")

    def predecessors(self, name: str) -> DataFrame:
        return self.edges.where(F.col("dst") == name).select(F.col("src").alias("name"))

    def successors(self, name: str) -> DataFrame:
        return self.edges.where(F.col("src") == name).select(F.col("dst").alias("name"))

    def neighbours(self, names: DataFrame, forward: bool = True) -> DataFrame:
        """name, neighbour: what each given node leads to (or what leads to it); parallel edges give rows each."""
        near, far = ("src", "dst") if forward else ("dst", "src")
        e = self.edges.select(F.col(near).alias("name"), F.col(far).alias("neighbour"))
        return e.join(names.select("name").distinct(), "name", "left_semi")

    def degrees(self) -> DataFrame:
        """name, in_degree, out_degree; parallel edges count."""
        ends = self.edges.select(F.col("src").alias("name"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(
            self.edges.select(F.col("dst").alias("name"), F.lit(1).alias("i"), F.lit(0).alias("o"))
        )
        d = ends.groupBy("name").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
        return self.nodes.select("name").join(d, "name", "left").select("name", F.coalesce("i", F.lit(0)).alias("in_degree"), F.coalesce("o", F.lit(0)).alias("out_degree"))

    def roots(self) -> DataFrame:
        return self.nodes.select("name").join(self.edges.select(F.col("dst").alias("name")), "name", "left_anti")

    def leaves(self) -> DataFrame:
        return self.nodes.select("name").join(self.edges.select(F.col("src").alias("name")), "name", "left_anti")

    def matching_regex(self, pattern: str) -> DataFrame:
        """Unanchored match; look-around and back-references are refused."""
        if any(x in pattern for x in ("(?=", "(?!", "(?<=", "(?<!", "(?>")) or any(f"\\{d}" in pattern for d in range(1, 10)):
            raise GraphError(f"unsupported pattern: {pattern}")
        return self.nodes.select("name").where(F.col("name").rlike(pattern))

    def matching_glob(self, pattern: str) -> DataFrame:
        return self.nodes.select("name").where(F.col("name").rlike(glob_to_regex(pattern)))

    def effects(self) -> DataFrame:
        """name, effect: from metadata, pure by default and for unknown values."""
        from arbora.functions.effects import effect_column

        return self.nodes.select("name", effect_column(F.col("metadata")["effect"]).alias("effect"))

    @staticmethod
    def _stream(names: DataFrame):
        """Names one partition at a time."""
        return (r[0] for r in names.toLocalIterator(prefetchPartitions=True))

    def iter_names(self):
        return self._stream(self.nodes.select("name"))

    def iter_roots(self):
        return self._stream(self.roots().orderBy("name"))

    def iter_leaves(self):
        return self._stream(self.leaves().orderBy("name"))

    def iter_ancestors(self, name: str):
        return self._stream(self.ancestors(name).orderBy("name"))

    def iter_descendants(self, name: str):
        return self._stream(self.descendants(name).orderBy("name"))

    def iter_topological(self):
        return self._stream(self.topological_rank().orderBy("rank").select("name"))

    def iter_levels(self):
        """The names of each level, as lists, one level at a time."""
        rows = self.levels().orderBy("level", "name").toLocalIterator(prefetchPartitions=True)
        return ([r["name"] for r in level] for _, level in groupby(rows, key=lambda r: r["level"]))

    # ---- changes ----

    def add_nodes(self, more: DataFrame, check: bool = True) -> Graph:
        """With more nodes; a name twice or known already raises."""
        out = self._same(self.nodes.unionByName(_shaped(more, ["name"], NODE_COLUMNS, {"epoch": 0})), self.edges)
        if check:
            out._check_nodes()
        return out

    def add_edges(self, more: DataFrame, check: bool = True) -> Graph:
        """With more edges; an unknown end or a cycle raises."""
        out = self._same(self.nodes, self.edges.unionByName(_shaped(more, ["src", "dst"], EDGE_COLUMNS, {"weight": 1.0})))
        if check:
            out._check_ends(more)
            out._check_cycles()
        return out

    def remove_nodes(self, names: DataFrame) -> Graph:
        n = names.select("name").distinct()
        e = self.edges.join(n.withColumnRenamed("name", "src"), "src", "left_anti").join(n.withColumnRenamed("name", "dst"), "dst", "left_anti")
        return self._same(self.nodes.join(n, "name", "left_anti"), e)

    def remove_edge(self, src: str, dst: str) -> Graph:
        """Remove one of parallel edges, the first."""
        w = Window.partitionBy("src", "dst").orderBy("edge_id", "weight", "label")
        hit = (F.col("src") == src) & (F.col("dst") == dst)
        if self.edges.where(hit).isEmpty():
            raise EdgeNotFoundError(f"{src} -> {dst}")
        e = self.edges.where(~hit).unionByName(self.edges.where(hit).withColumn("__n", F.row_number().over(w)).where("__n > 1").drop("__n"))
        return self._same(self.nodes, e)

    def subgraph(self, names: list[str] | DataFrame) -> Graph:
        """Induced subgraph; a list with unknown or repeated names raises."""
        if not isinstance(names, DataFrame):
            if len(set(names)) < len(names):
                raise DuplicateNodeError(next(n for n in names if names.count(n) > 1))
            self._require(names)
            names = self.spark.createDataFrame([(n,) for n in names], "name string")
        n = names.select("name").distinct()
        e = self.edges.join(n.withColumnRenamed("name", "src"), "src", "left_semi").join(n.withColumnRenamed("name", "dst"), "dst", "left_semi")
        return self._same(self.nodes.join(n, "name", "left_semi"), e)

    def filter(self, predicate: Column | str) -> Graph:
        return self.subgraph(self.nodes.where(predicate).select("name"))

    def subgraph_by_depth(self, root: str, depth: int, direction: str = "forward") -> Graph:
        """Nodes within ``depth`` hops forward, backward or both, and their edges."""
        self._require([root])
        start = self.spark.createDataFrame([(root,)], "name string")
        parts = []
        if direction in ("forward", "both"):
            parts.append(fixpoint.reach(self.edges, start, depth, True).select("name"))
        if direction in ("backward", "both"):
            parts.append(fixpoint.reach(self._flipped(), start, depth, True).select("name"))
        names = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return self.subgraph(names)

    def _flipped(self) -> DataFrame:
        return self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "label", "edge_id")

    def reverse(self) -> Graph:
        return self._same(self.nodes, self._flipped())

    def snapshot(self) -> Graph:
        """The graph as it is now, its lineage cut."""
        return self._same(fixpoint.checkpoint(self.nodes), fixpoint.checkpoint(self.edges))

    def collapse(self, names: list[str], name: str, payload: str | None = None, check: bool = True) -> Graph:
        """Merge nodes into one; inner edges go, of edges that fall together the first stays."""
        self._require(names)
        inside = F.col("name").isin(names)
        if not self.nodes.where(~inside & (F.col("name") == name)).isEmpty():
            raise DuplicateNodeError(name)
        to = lambda c: F.when(F.col(c).isin(names), F.lit(name)).otherwise(F.col(c))
        w = Window.partitionBy("src", "dst").orderBy("edge_id", "weight", "label")
        touched = F.col("src").isin(names) | F.col("dst").isin(names)
        moved = self.edges.where(touched).withColumns({"src": to("src"), "dst": to("dst")}).where("src <> dst")
        moved = moved.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
        one = self.spark.createDataFrame([(name, payload)], "name string, payload string")
        out = self._same(self.nodes.where(~inside).unionByName(one, allowMissingColumns=True), self.edges.where(~touched).unionByName(moved))
        if check:  # a way out of the nodes and back into them is a cycle now
            out._check_cycles()
        return out

    def merge(self, other: Graph, conflict: str = "keep_first", resolver=None, check: bool = True) -> Graph:
        """Union of two graphs; conflict: keep_first, keep_second, error, or resolver(Column, Column) -> Column."""
        a = self.nodes.select("name", F.struct("payload", "metadata", "epoch", "ord").alias("__a"))
        b = other.nodes.select("name", F.struct("payload", "metadata", "epoch", "ord").alias("__b"))
        j = a.join(b, "name", "full_outer")
        if conflict == "error" and resolver is None:
            both = j.where("__a is not null and __b is not null").select("name").first()
            if both:
                raise DuplicateNodeError(both[0])
        pick = F.coalesce("__b", "__a") if conflict == "keep_second" else F.coalesce("__a", "__b")
        n = j.withColumn("__p", pick)
        payload = F.col("__p.payload")
        if resolver is not None:
            payload = F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), resolver(F.col("__a.payload"), F.col("__b.payload"))).otherwise(payload)
        n = n.select("name", payload.alias("payload"), "__p.metadata", "__p.epoch", "__p.ord")
        e = self.edges.unionByName(other.edges.join(self.edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti"))
        out = self._same(n, e)
        if check:
            out._check_cycles()
        return out

    # ---- reach ----

    def reached(self, names: list[str] | DataFrame, forward: bool = True, depth: int | None = None) -> DataFrame:
        """(start, name, hops) of what each start reaches, without itself."""
        if not isinstance(names, DataFrame):
            self._require(names)
            names = self.spark.createDataFrame([(n,) for n in names], "name string")
        return fixpoint.reach(self.edges if forward else self._flipped(), names, depth)

    def descendants(self, name: str) -> DataFrame:
        return self.reached([name]).select("name")

    def ancestors(self, name: str) -> DataFrame:
        return self.reached([name], forward=False).select("name")

    def is_ancestor(self, a: str, b: str) -> bool:
        self._require([a])
        return not fixpoint.reaches(self.edges, self.spark.createDataFrame([(a, b)], "src string, dst string")).isEmpty()

    def are_ancestors(self, pairs: DataFrame) -> DataFrame:
        """src, dst, reaches: whether src of each given pair is an ancestor of dst."""
        p = pairs.select("src", "dst")
        down = fixpoint.reaches(self.edges, p).withColumn("__hit", F.lit(True))
        return p.join(down, ["src", "dst"], "left").select("src", "dst", F.coalesce("__hit", F.lit(False)).alias("reaches"))

    def dirty_set(self, changed: DataFrame) -> DataFrame:
        """Changed nodes and everything downstream of them."""
        if self.strategy == "kernel":
            hit = self.nodes.select("name").join(changed.select("name").distinct().withColumn("hit", F.lit(1)), "name", "left").select("name", F.coalesce("hit", F.lit(0)).alias("hit"))

            def kernel(adj: Adjacency, cols: dict) -> dict[str, list]:
                starts = [i for i, h in enumerate(cols["hit"]) if h]
                return {"name": adj.label(sorted({*starts, *adj.reach(starts)}))}

            return fixpoint.by_component(hit, self.edges, self._components[0], kernel, "name string", ["hit"])
        return fixpoint.reach_set(self.edges, changed.select("name").join(self.nodes.select("name"), "name", "left_semi"))

    def change_provenance(self, changed: DataFrame) -> DataFrame:
        """(name, changed): every dirty node with the changed nodes that reach it, itself included."""
        known = changed.select("name").join(self.nodes.select("name"), "name", "left_semi")
        return fixpoint.reach(self.edges, known, None, True).select("name", F.col("start").alias("changed"))

    @cached_property
    def _components(self) -> tuple[DataFrame, int, int]:
        return fixpoint.component_sizes(self.nodes, self.edges)

    def _kernel(self) -> bool:
        """Whether whole components go into tasks."""
        if self.strategy == "auto":
            return self._components[1] <= fixpoint.KERNEL_EDGES
        return self.strategy == "kernel"

    def weak_components(self) -> DataFrame:
        """name, component (its smallest name)."""
        return self._components[0].select("name", F.col("root").alias("component"))

    def closure(self) -> DataFrame:
        """src, dst, hops_min, hops_max of all reachable pairs."""
        # a component of n nodes has fewer than n * n / 2 pairs
        if not self._kernel() or (self.strategy == "auto" and self._components[2] ** 2 > 2 * fixpoint.KERNEL_PAIRS):
            return fixpoint.closure_doubling(self.edges)

        def kernel(adj: Adjacency, cols: dict) -> dict[str, list]:
            order = adj.kahn()
            low: list[dict[int, int]] = [{} for _ in order]
            high: list[dict[int, int]] = [{} for _ in order]
            for i in reversed(order):
                for j in set(adj.out[i]):
                    low[i][j] = 1
                    high[i].setdefault(j, 1)
                    for k, h in low[j].items():
                        low[i][k] = min(low[i].get(k, 1 << 30), h + 1)
                    for k, h in high[j].items():
                        high[i][k] = max(high[i].get(k, 0), h + 1)
            # numbers in arrays, and names looked up at once: lists of four values a pair take most of the time
            size = list(map(len, low))
            flat = lambda of: np.fromiter(chain.from_iterable(of), np.int32, sum(size))
            names = pa.array(adj.names, pa.string())
            far = np.repeat(np.arange(len(size), dtype=np.int32), size)
            least = flat(x.values() for x in low)
            most = flat([high[i][j] for j in x] for i, x in enumerate(low))
            return {"src": names.take(pa.array(far)), "dst": names.take(pa.array(flat(low))), "hops_min": pa.array(least), "hops_max": pa.array(most)}

        return fixpoint.by_component(self.nodes, self.edges, self._components[0], kernel, "src string,dst string,hops_min int,hops_max int", per_edge=1 + self._components[2] // 100)

    @cached_property
    def _index(self):
        from arbora.operators.labels import ReachIndex

        return ReachIndex(self)

    def reachability_index(self):
        """Interval labels of all nodes (``ReachIndex``): can_reach, reachable_from and sizes without a closure."""
        return self._index

    def can_reach(self, pairs: DataFrame) -> DataFrame:
        """src, dst, reaches for each given pair of nodes, from the index."""
        return self._index.can_reach(pairs)

    def reachable_from(self, names: DataFrame) -> DataFrame:
        """(start, name): all descendants of each name, from the index."""
        return self._index.reachable_from(names)

    @cached_property
    def _reversed(self) -> Graph:
        g = self.reverse()
        if "_components" in self.__dict__:
            g.__dict__["_components"] = self._components  # the same without direction
        return g

    def ancestors_of(self, names: DataFrame) -> DataFrame:
        """(start, name): all ancestors of each name, from the index of the reversed graph."""
        return self._reversed._index.reachable_from(names)

    def ancestor_counts(self, names: DataFrame, of: DataFrame | None = None) -> DataFrame:
        """name, n: how many ancestors (of those named in ``of``) each name has, without listing them."""
        return self._reversed._index.sizes(names, of)

    # ---- orders ----

    def levels(self) -> DataFrame:
        """name, level: longest hops from a root."""
        if self._kernel():
            def kernel(adj: Adjacency, cols: dict) -> dict[str, list]:
                return {"name": adj.names, "level": adj.levels()}

            return fixpoint.by_component(self.nodes, self.edges, self._components[0], kernel, "name string,level int")
        v = contraction.longest_sums(self.nodes.withColumn("__one", F.lit(1.0)), self.edges, "__one")
        return v.select("name", (F.col("value") - 1).cast("int").alias("level"))

    def levels_priority(self, priorities: DataFrame) -> DataFrame:
        """name, level, place within it: priority descending, then name."""
        p = self.levels().join(priorities.select("name", "priority"), "name", "left").withColumn("priority", F.coalesce("priority", F.lit(0.0)))
        ranked, _ = fixpoint.global_rank(p.withColumn("__last", -F.col("priority")), ["level", "__last", "name"], "pos")
        first = ranked.groupBy("level").agg(F.min("pos").alias("first"))
        return ranked.join(first, "level").select("name", "level", (F.col("pos") - F.col("first") + 1).cast("int").alias("place"))

    def topological_rank(self) -> DataFrame:
        """name, rank in FIFO Kahn order: by level, within it by the last predecessor's rank, then name.

        That is the order of the names on the way down from a root, over each node's last predecessor of the level
        before.  Where no node has two of them these ways are known, and compared by doubling their length; the
        levels where some node has to choose cut the graph into such segments.
        """
        lvl = fixpoint.checkpoint(self.levels())
        at = lambda c: lvl.select(F.col("name").alias(c), F.col("level").alias(f"{c}_level"))
        e = self.edges.select("src", "dst").distinct().join(at("src"), "src").join(at("dst"), "dst").where("dst_level = src_level + 1")
        ups = fixpoint.checkpoint(e.select(F.col("dst").alias("name"), F.col("src").alias("up"), F.col("dst_level").alias("level")))
        one = ups.groupBy("name", "level").agg(F.count("*").alias("n"), F.min("up").alias("up"))
        cuts = [r[0] for r in one.where("n > 1").select("level").distinct().orderBy("level").collect()]  # a segment each
        names, _ = fixpoint.global_rank(lvl.join(one.select("name", "up"), "name", "left").select("name", "level", "up"), ["name"], "key")
        names = fixpoint.checkpoint(names)
        start = names.where("level = 0").withColumn("up", F.lit(None).cast("string"))
        done, low = None, 0
        for cut in [*cuts, None]:
            upper = F.lit(True) if cut is None else F.col("level") < cut
            part = self._compared(start.unionByName(names.where((F.col("level") > low) & upper)))
            done = part if done is None else done.unionByName(part)
            if cut is not None:
                last = ups.where(F.col("level") == cut).join(part.select(F.col("name").alias("up"), F.col("key").alias("last")), "up").groupBy("name", "level").agg(F.max("last").alias("last"))
                start, _ = fixpoint.global_rank(last, ["last", "name"], "key")
                start = fixpoint.checkpoint(start.select("name", "level", F.lit(None).cast("string").alias("up"), "key"))
                low = cut
        ranked, _ = fixpoint.global_rank(done.select("name", "level", "key"), ["level", "key"], "rank")
        return ranked.select("name", "rank")

    @staticmethod
    def _compared(part: DataFrame) -> DataFrame:
        """part (name, level, up, key) with keys that order each level by the whole way down to a node, the top of it first."""
        part = fixpoint.checkpoint(part)
        while not part.where("up is not null").isEmpty():
            above = part.select(F.col("name").alias("up"), F.col("key").alias("first"), F.col("up").alias("next"))
            twice = part.join(above, "up", "left").select("name", "level", F.coalesce("first", F.lit(-1)).alias("first"), F.col("key").alias("then"), F.col("next").alias("up"))
            part, _ = fixpoint.global_rank(twice, ["level", "first", "then"], "key")
            part = fixpoint.checkpoint(part.select("name", "level", "up", "key"))
        return part

    def _sequential(self, order, column: str, priorities: DataFrame | None = None) -> DataFrame:
        """Positions of a sequential order, in one task; refuses what doesn't fit one."""
        n = self.node_count()
        if n > SEQUENTIAL_NODES:
            raise TooLargeError(f"{n} nodes; a sequential order takes {SEQUENTIAL_NODES} at most")
        nodes = self.nodes.select("name").withColumn("priority", F.lit(0.0))
        if priorities is not None:
            p = priorities.select("name", F.col("priority").cast("double").alias("__p"))
            nodes = self.nodes.select("name").join(p, "name", "left").select("name", F.coalesce("__p", F.lit(0.0)).alias("priority"))
        one = self.nodes.select("name", F.lit("all").alias("root"))

        def kernel(adj: Adjacency, cols: dict) -> dict[str, list]:
            ids = order(adj, dict(zip(cols["name"], cols["priority"])))
            return {"name": adj.label(ids), column: list(range(len(ids)))}

        return fixpoint.by_component(nodes, self.edges, one, kernel, f"name string,{column} int", ["priority"])

    def topological_rank_dfs(self) -> DataFrame:
        return self._sequential(lambda a, _: a.depth_first(), "rank")

    def topological_rank_priority(self, priorities: DataFrame) -> DataFrame:
        return self._sequential(lambda a, p: a.by_priority(p), "rank", priorities)

    def all_topological_orders(self, limit: int | None = None) -> DataFrame:
        """order_id, rank, name of every topological order in the order of names, ``limit`` at most; in one task."""
        if self.node_count() > SEQUENTIAL_NODES:
            raise TooLargeError("orders are listed in one task")

        def kernel(adj: Adjacency, cols: dict) -> dict[str, list]:
            found = adj.all_orders(limit) if adj.names else []
            rows = [(k, r, adj.names[i]) for k, order in enumerate(found) for r, i in enumerate(order)]
            return dict(zip(("order_id", "rank", "name"), map(list, zip(*rows)) if rows else ([], [], [])))

        return fixpoint.by_component(self.nodes, self.edges, self.nodes.select("name", F.lit("all").alias("root")), kernel, "order_id int,rank int,name string")

    # ---- paths ----

    def all_paths(self, src: str, dst: str, limit: int | None = None) -> DataFrame:
        """path (array); with a limit the first by names.  Walks only nodes that lie between the two."""
        self._require([src, dst])
        spark = self.spark
        if src == dst:
            return spark.createDataFrame([([src],)], "path array<string>")
        up = fixpoint.reach(self._flipped(), spark.createDataFrame([(dst,)], "name string"), None, True).select("name")
        e = fixpoint.checkpoint(self.edges.join(up.withColumnRenamed("name", "dst"), "dst", "left_semi").select("src", "dst"))
        if limit is not None:
            return self._first_paths(src, dst, e, limit)
        front = spark.createDataFrame([([src],)], "path array<string>")
        done = front.limit(0)
        while True:
            step = front.join(e, F.element_at("path", -1) == F.col("src")).select(F.concat("path", F.array("dst")).alias("path"))
            step = fixpoint.checkpoint(step)
            done = done.unionByName(step.where(F.element_at("path", -1) == dst))
            front = step.where(F.element_at("path", -1) != dst)
            if front.isEmpty():
                return done

    def _first_paths(self, src: str, dst: str, edges: DataFrame, limit: int) -> DataFrame:
        """The first ``limit`` paths by names: ways from each node are counted, then path k is built from its number alone."""
        most = "1000000000000000000000000000000"  # counts stop here: no limit comes near it
        e = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
        inside = fixpoint.reach(e, self.spark.createDataFrame([(src,)], "name string"), None, True).select("name")
        e = fixpoint.checkpoint(e.join(inside.withColumnRenamed("name", "src"), "src", "left_semi"))
        if e.isEmpty():
            return self.spark.createDataFrame([], "path array<string>")
        back = Graph.from_edges(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), strategy=self.strategy)
        far = fixpoint.checkpoint(e.join(back.levels().withColumnRenamed("name", "src"), "src"))
        ways = self.spark.createDataFrame([(dst, 1)], "name string, ways int").select("name", F.col("ways").cast("decimal(38,0)").alias("ways"))
        for k in range(1, far.agg(F.max("level")).first()[0] + 1):
            sums = far.where(F.col("level") == k).join(ways.withColumnRenamed("name", "dst"), "dst").groupBy(F.col("src").alias("name"))
            now = sums.agg(F.least(F.sum((F.col("n") * F.col("ways")).cast("decimal(38,0)")), F.lit(most).cast("decimal(38,0)")).alias("ways"))
            ways = ways.unionByName(fixpoint.checkpoint(now))
        # of the paths from src, those over dst have the numbers lo to hi
        w = Window.partitionBy("src").orderBy("dst").rowsBetween(Window.unboundedPreceding, -1)
        size = (F.col("n") * F.col("ways")).cast("decimal(38,0)")
        spans = e.join(ways.withColumnRenamed("name", "dst"), "dst").withColumn("lo", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("decimal(38,0)")).withColumn("hi", F.col("lo") + size)
        spans = fixpoint.checkpoint(spans.select("src", "dst", "n", "lo", "hi"))
        total = ways.where(F.col("name") == src).first()["ways"]
        front = self.spark.range(int(min(limit, total))).select(F.col("id").cast("decimal(38,0)").alias("no"), F.array(F.lit(src)).alias("path"))
        while True:
            step = front.join(spans, (F.element_at("path", -1) == F.col("src")) & (F.col("no") >= F.col("lo")) & (F.col("no") < F.col("hi")))
            step = step.select(F.floor((F.col("no") - F.col("lo")) / F.col("n")).cast("decimal(38,0)").alias("no"), F.concat("path", F.array("dst")).alias("path"))
            step = fixpoint.checkpoint(front.where(F.element_at("path", -1) == dst).unionByName(step))
            if step.where(F.element_at("path", -1) != dst).isEmpty():
                return step.select("path")
            front = step

    def shortest_path(self, src: str, dst: str) -> DataFrame:
        """path, hops: fewest hops, smallest by names; no row if there is none."""
        self._require([src, dst])
        start = self.spark.createDataFrame([(src, [src])], "name string, path array<string>")
        front, seen = start, start.select("name")
        if src == dst:
            return start.select("path", F.lit(0).alias("hops"))
        e = self.edges.select("src", "dst").distinct()
        while True:
            new = front.join(e, F.col("name") == F.col("src")).select(F.col("dst").alias("name"), F.concat("path", F.array("dst")).alias("path"))
            new = new.join(seen, "name", "left_anti").groupBy("name").agg(F.min("path").alias("path"))
            front = fixpoint.checkpoint(new)
            hit = front.where(F.col("name") == dst)
            if front.isEmpty() or not hit.isEmpty():
                return hit.select("path", (F.size("path") - 1).alias("hops"))
            seen = fixpoint.checkpoint(seen.unionByName(front.select("name")))

    def longest_path(self, src: str, dst: str, costs: DataFrame | None = None) -> DataFrame:
        """path, cost (node costs, both ends included); ties by smaller path."""
        self._require([src, dst])
        c = self.costed(costs)
        between = self.reached([src]).select("name").unionByName(self.spark.createDataFrame([(src,)], "name string"))
        e = self.edges.select("src", "dst").distinct().join(between.withColumnRenamed("name", "src"), "src", "left_semi")
        e = fixpoint.checkpoint(e.join(c.withColumnRenamed("name", "dst"), "dst").select("src", "dst", "cost"))
        best = fixpoint.checkpoint(c.where(F.col("name") == src).select("name", F.col("cost").alias("value"), F.array("name").alias("path")))
        front = best
        order = lambda v, p: F.struct(-F.col(v), F.col(p))
        while True:
            sent = front.join(e, F.col("name") == F.col("src")).select(F.col("dst").alias("name"), (F.col("value") + F.col("cost")).alias("v"), F.concat("path", F.array("dst")).alias("p"))
            sent = sent.groupBy("name").agg(F.min(order("v", "p")).alias("m")).select("name", (-F.col("m.col1")).alias("v"), F.col("m.p").alias("p"))
            front = fixpoint.checkpoint(sent.join(best, "name", "left").where("value is null or v > value or (v = value and p < path)").select("name", F.col("v").alias("value"), F.col("p").alias("path")))
            if front.isEmpty():
                return best.where(F.col("name") == dst).select("path", F.col("value").alias("cost"))
            best = fixpoint.checkpoint(best.join(front.select("name"), "name", "left_anti").unionByName(front))

    # ---- weights and plans ----

    def costed(self, costs: DataFrame | None, default: float = 1.0) -> DataFrame:
        """name, cost of every node; unknown names in ``costs`` are ignored."""
        if costs is None:
            return self.nodes.select("name", F.lit(default).alias("cost"))
        c = costs.groupBy("name").agg(F.max(F.col("cost").cast("double")).alias("__c"))
        return self.nodes.select("name").join(c, "name", "left").select("name", F.coalesce("__c", F.lit(default)).alias("cost"))

    def bottom_levels(self, costs: DataFrame | None = None) -> DataFrame:
        """name, bottom_level: longest cost down to a leaf, own cost included."""
        c = self.costed(costs)
        if self._kernel():
            def kernel(adj: Adjacency, cols: dict) -> dict[str, list]:
                return {"name": adj.names, "bottom_level": adj.bottom_levels(cols["cost"].__getitem__)}

            return fixpoint.by_component(c, self.edges, self._components[0], kernel, "name string,bottom_level double", ["cost"])
        return contraction.longest_sums(c, self._flipped(), "cost").select("name", F.col("value").alias("bottom_level"))

    def critical_path(self, costs: DataFrame | None = None) -> DataFrame:
        """place, name, bottom_level: from the greatest bottom level always to the greatest successor."""
        if self._kernel():
            def kernel(adj: Adjacency, cols: dict) -> dict[str, list]:
                walk = []
                if adj.names:
                    down = adj.bottom_levels(cols["cost"].__getitem__)
                    key = lambda i: (-down[i], adj.place[i])
                    walk = [min(range(len(down)), key=key)]
                    while adj.out[walk[-1]]:
                        walk.append(min(adj.out[walk[-1]], key=key))
                n = len(walk)
                return {"most": [down[walk[0]]] * n if n else [], "head": adj.label(walk[:1] * n), "place": list(range(n)), "name": adj.label(walk), "bottom_level": [down[i] for i in walk]}

            found = fixpoint.by_component(self.costed(costs), self.edges, self._components[0], kernel, "most double,head string,place int,name string,bottom_level double", ["cost"])
            found = fixpoint.checkpoint(found)  # the best way of each task
            best = found.where("place = 0").agg(F.min(F.struct((-F.col("most")).alias("b"), "head")).alias("m")).select("m.head")
            return found.join(F.broadcast(best), "head").select("place", "name", "bottom_level")
        down = fixpoint.checkpoint(self.bottom_levels(costs))
        order = F.struct((-F.col("bottom_level")).alias("b"), F.col("name").alias("n"))
        nxt = self.edges.select("src", "dst").distinct().join(down.withColumnRenamed("name", "dst"), "dst").groupBy("src").agg(F.min(F.struct((-F.col("bottom_level")).alias("b"), F.col("dst").alias("n"))).alias("m"))
        nxt = fixpoint.checkpoint(nxt.select("src", F.col("m.n").alias("dst")))
        # along the chain of greatest successors by doubling: a round doubles what is known of the path
        path = fixpoint.checkpoint(down.agg(F.min(order).alias("m")).where("m is not null").select(F.lit(0).alias("place"), F.col("m.n").alias("name")))
        for k in count():
            more = path.join(nxt, F.col("name") == F.col("src")).select((F.col("place") + (1 << k)).alias("place"), F.col("dst").alias("name"))
            more = fixpoint.checkpoint(more)
            if more.isEmpty():
                return path.join(down, "name").select(F.col("place").cast("int").alias("place"), "name", "bottom_level")
            path = fixpoint.checkpoint(path.unionByName(more))
            nxt = fixpoint.checkpoint(nxt.alias("a").join(nxt.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst")))

    def execution_plan(self, costs: DataFrame | None = None) -> DataFrame:
        """step_index, name, start_time, duration: a step a level, starting when the longest of each step before is done."""
        p = self.levels().join(self.costed(costs), "name")
        per = p.groupBy("level").agg(F.max("cost").alias("longest"))
        starts = fixpoint.running_total(per, ["level"], "longest", "start_time").select("level", "start_time")
        return p.join(starts, "level").select(F.col("level").alias("step_index"), "name", "start_time", F.col("cost").alias("duration"))

    def execution_plan_constrained(self, workers: int, costs: DataFrame | None = None) -> DataFrame:
        """step_index, name, start_time, duration under ``workers`` slots; sequential, in one task.

        Steps start together; a node never shares a step with one it depends on, even a free one.
        """
        c = self.costed(costs)
        one = self.nodes.select("name", F.lit("all").alias("root"))
        if self.node_count() > SEQUENTIAL_NODES:
            raise TooLargeError("constrained plans are made in one task")

        def kernel(adj: Adjacency, cols: dict) -> dict[str, list]:
            cost = cols["cost"].__getitem__
            starts, _ = adj.list_schedule(workers, cost)
            keys = adj.step_keys(starts, cost)
            step = {k: n for n, k in enumerate(sorted(set(keys)))}
            at = [step[k] for k in keys]
            return {"step_index": at, "name": [adj.names[i] for _, i in starts], "start_time": [s for s, _ in starts], "duration": [cost(i) for _, i in starts]}

        return fixpoint.by_component(c, self.edges, one, kernel, "step_index int,name string,start_time double,duration double", ["cost"])

    # ---- partitions ----

    def partition_levels(self, k: int) -> DataFrame:
        """name, partition_id: consecutive levels, ceil(levels / k) to a part."""
        lvl = fixpoint.checkpoint(self.levels())
        one = F.broadcast(lvl.agg((F.max("level") + 1).alias("n")))  # one row
        return lvl.crossJoin(one).withColumn("k", F.least(F.lit(k), F.col("n"))).select(
            "name", F.least(F.col("k") - 1, F.floor(F.col("level") / F.ceil(F.col("n") / F.col("k")))).cast("int").alias("partition_id")
        )

    def partition_balanced(self, k: int, costs: DataFrame | None = None) -> DataFrame:
        """name, partition_id: a walk in order of level and name; a part ends once it has total / k of the cost.

        Costs are summed in ranges of the order; the at most k - 1 ends are looked up one after the other.
        """
        p = self.levels().join(self.costed(costs), "name")
        ranked, n = fixpoint.global_rank(p, ["level", "name"], "pos")
        ranked = fixpoint.checkpoint(fixpoint.running_total(ranked.select("name", "pos", "cost"), ["pos"], "cost", "sum"))
        k = max(1, min(k, n))
        share = (ranked.agg(F.sum("cost")).first()[0] or 0.0) / k
        part, start, least = F.lit(0), 0.0, 1
        for _ in range(k - 1):
            end = ranked.where((F.col("pos") >= least) & (F.col("sum") - start >= share)).agg(F.min(F.struct("pos", "sum")).alias("m")).select("m.pos", "m.sum").first()
            if end[0] is None:
                break
            part = part + F.when(F.col("pos") >= end[0], 1).otherwise(0)
            least, start = end[0] + 1, end[1]
        return ranked.select("name", part.cast("int").alias("partition_id"))

    def partition_low_cut(self, k: int, costs: DataFrame | None = None, rounds: int = 10, imbalance: float = 0.3) -> DataFrame:
        return self._partition(lambda a, cost: a.part_low_cut(k, cost, rounds, imbalance), costs)

    def _partition(self, make, costs: DataFrame | None) -> DataFrame:
        if self.node_count() > SEQUENTIAL_NODES:
            raise TooLargeError("this partition is made in one task; partition_levels is not")
        one = self.nodes.select("name", F.lit("all").alias("root"))

        def kernel(adj: Adjacency, cols: dict) -> dict[str, list]:
            return {"name": adj.names, "partition_id": make(adj, cols["cost"].__getitem__)}

        return fixpoint.by_component(self.costed(costs), self.edges, one, kernel, "name string,partition_id int", ["cost"])

    def partition_stats(self, assignment: DataFrame, costs: DataFrame | None = None) -> DataFrame:
        """partition_id, nodes, total_cost, incoming, outgoing (edges that cross)."""
        a = assignment.select("name", "partition_id")
        size = a.join(self.costed(costs), "name").groupBy("partition_id").agg(F.count("*").alias("nodes"), F.sum("cost").alias("total_cost"))
        e = self.edges.join(a.select(F.col("name").alias("src"), F.col("partition_id").alias("p")), "src").join(a.select(F.col("name").alias("dst"), F.col("partition_id").alias("q")), "dst").where("p <> q")
        cross = e.select(F.col("p").alias("partition_id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(e.select(F.col("q").alias("partition_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
        cross = cross.groupBy("partition_id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
        return size.join(cross, "partition_id", "left").select("partition_id", "nodes", "total_cost", F.coalesce("i", F.lit(0)).alias("incoming"), F.coalesce("o", F.lit(0)).alias("outgoing"))

    def cross_edges(self, assignment: DataFrame) -> DataFrame:
        """src_part, dst_part, n: edges between each two different parts."""
        a = assignment.select("name", "partition_id")
        e = self.edges.join(a.select(F.col("name").alias("src"), F.col("partition_id").alias("src_part")), "src")
        e = e.join(a.select(F.col("name").alias("dst"), F.col("partition_id").alias("dst_part")), "dst")
        return e.where("src_part <> dst_part").groupBy("src_part", "dst_part").agg(F.count("*").alias("n"))

    def partition_order(self, assignment: DataFrame) -> DataFrame:
        """partition_id, level in the graph of partitions."""
        a = assignment.select("name", F.col("partition_id").cast("string").alias("p"))
        e = self.edges.join(a.select(F.col("name").alias("src"), F.col("p").alias("a")), "src").join(a.select(F.col("name").alias("dst"), F.col("p").alias("b")), "dst")
        e = e.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
        q = Graph(a.select(F.col("p").alias("name")).distinct(), e, self.strategy)
        return q.levels().select(F.col("name").cast("int").alias("partition_id"), "level")

    def extract_partition(self, assignment: DataFrame, partition_id: int) -> Graph:
        return self.subgraph(assignment.where(F.col("partition_id") == partition_id).select("name"))

    # ---- structure ----

    def transitive_reduction(self) -> Graph:
        """Without the edges that a way of two hops or more makes redundant.

        Such an edge spans two levels at least.  The starts of these edges gather the labels of what their other
        successors reach; an edge whose end lies in one of them is redundant.  Small components are looked at in tasks.
        """
        from arbora.operators.labels import covered

        if self._kernel() and self._components[2] ** 2 <= 2 * fixpoint.KERNEL_PAIRS:
            def kernel(adj: Adjacency, cols: dict) -> dict[str, list]:
                drop = sorted(adj.redundant())
                return {"src": adj.label(a for a, _ in drop), "dst": adj.label(b for _, b in drop)}

            long = fixpoint.by_component(self.nodes, self.edges, self._components[0], kernel, "src string,dst string")
            return self._same(self.nodes, self.edges.join(fixpoint.checkpoint(long), ["src", "dst"], "left_anti"))
        lvl = fixpoint.checkpoint(self.levels())
        e = self.edges.select("src", "dst").distinct()
        at = lambda c: lvl.select(F.col("name").alias(c), F.col("level").alias(f"{c}_level"))
        e = fixpoint.checkpoint(e.join(at("src"), "src").join(at("dst"), "dst").select("src", "dst", (F.col("dst_level") - F.col("src_level")).alias("gap")))
        wide = e.where("gap > 1").select("src", "dst")
        if wide.isEmpty():
            return self._same(self.nodes, self.edges)
        beside = e.select("src", "dst").join(wide.select("src").distinct(), "src", "left_semi")
        reach = self._index.intervals(beside.select(F.col("dst").alias("name"))).withColumnRenamed("key", "dst")
        below = beside.join(reach, "dst").select(F.col("src").alias("key"), "lo", "hi")
        points = wide.join(self._index.nodes.select(F.col("name").alias("dst"), F.col("lo").alias("at")), "dst").select(F.col("src").alias("key"), "at", "dst")
        long = covered(points, below).where("hit").select(F.col("key").alias("src"), "dst")
        return self._same(self.nodes, self.edges.join(fixpoint.checkpoint(long), ["src", "dst"], "left_anti"))

    def transitive_closure(self) -> Graph:
        """With an edge of weight 1 for every reachable pair that has none."""
        new = self.closure().select("src", "dst").join(self.edges.select("src", "dst"), ["src", "dst"], "left_anti")
        return self.add_edges(new, check=False)

    def dominator_tree(self, root: str) -> DataFrame:
        """name, idom of every node reachable from root; root is its own.

        A node's immediate dominator is the lowest common ancestor, in the tree of dominators so far, of all its
        predecessors.  Ancestors 1, 2, 4, ... steps up are kept for each node, so that sets of predecessors are lifted
        by joins; nodes with one predecessor need none.  A kernel does the same where the nodes fit a task.
        """
        self._require([root])
        inside = fixpoint.checkpoint(fixpoint.reach_set(self.edges, self.spark.createDataFrame([(root,)], "name string")))
        sub = self.subgraph(inside)
        sub = Graph(sub.nodes.select("name"), fixpoint.checkpoint(sub.edges.select("src", "dst")), self.strategy)
        if self.strategy == "kernel" or (self.strategy == "auto" and sub.edge_count() <= fixpoint.KERNEL_EDGES):
            def kernel(adj: Adjacency, cols: dict) -> dict[str, list]:
                if root not in adj.index:
                    return {"name": [], "idom": []}
                got = adj.dominators(adj.at(root))
                return {"name": adj.label(got), "idom": adj.label(got.values())}

            one = inside.withColumn("root", F.lit(root))  # all are below the root: one component
            return fixpoint.by_component(sub.nodes, sub.edges, one, kernel, "name string,idom string")
        return self._dominators_by_lifting(sub, root)

    def _dominators_by_lifting(self, sub: Graph, root: str) -> DataFrame:
        # leaves with one predecessor are dominated by it and dominate nothing: they go first, while they are many
        names, e = fixpoint.checkpoint(sub.nodes.select("name")), fixpoint.checkpoint(sub.edges.select("src", "dst").distinct())
        n, off = names.count(), []
        while True:
            one = e.groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("n"), F.min("src").alias("up")).where("n = 1").drop("n")
            one = fixpoint.checkpoint(one.join(e.select(F.col("src").alias("name")).distinct(), "name", "left_anti"))
            gone = one.count()
            if gone < 0.3 * n:
                break
            off.append(one.withColumnRenamed("up", "idom"))
            n -= gone
            names = fixpoint.checkpoint(names.join(one.select("name"), "name", "left_anti"))
            e = fixpoint.checkpoint(e.join(one.select(F.col("name").alias("dst")), "dst", "left_anti"))
        out = self._lifted(Graph(names, e, self.strategy), root)
        for one in off:
            out = out.unionByName(one)
        return out

    def _lifted(self, sub: Graph, root: str) -> DataFrame:
        lvl = fixpoint.checkpoint(sub.levels())
        e = fixpoint.checkpoint(sub.edges.select("src", "dst").distinct().join(lvl.withColumnRenamed("name", "dst"), "dst"))
        one = fixpoint.checkpoint(e.groupBy(F.col("dst").alias("name"), "level").agg(F.count("*").alias("n"), F.min("src").alias("up")))
        cuts = [r[0] for r in one.where("n > 1").select("level").distinct().orderBy("level").collect()]
        tree = self.spark.createDataFrame([(root, None, 0)], "name string, up string, depth int")
        lift: dict[int, DataFrame] = {}  # power -> (name, up)
        found: DataFrame | None = None
        for low, cut in zip([0, *cuts], [*cuts, None]):
            # single predecessors between the cuts, under the nodes decided at the lower one
            upper = F.lit(True) if cut is None else F.col("level") < cut
            new = one.where((F.col("n") == 1) & (F.col("level") >= low) & upper).select("name", "up")
            if found is not None:
                new = new.unionByName(found)
            new = fixpoint.checkpoint(new)
            walk = fixpoint.checkpoint(new.select("name", "up", F.lit(1).alias("steps")))
            while True:  # how far below the nodes known before
                ahead = walk.select(F.col("name").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("more"), F.lit(True).alias("on"))
                walk = fixpoint.checkpoint(walk.join(ahead, "up", "left").select("name", F.coalesce("up2", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("on", F.lit(False)).alias("on")))
                if walk.where("on").isEmpty():
                    break
                walk = walk.drop("on")
            deep = walk.join(tree.select(F.col("name").alias("up"), "depth"), "up").select("name", (F.col("depth") + F.col("steps")).alias("depth"))
            tree = fixpoint.checkpoint(tree.unionByName(new.join(deep, "name").select("name", "up", "depth")))
            if cut is None:
                break
            step, k = new, 0
            while not step.isEmpty():
                lift[k] = fixpoint.checkpoint(lift[k].unionByName(step) if k in lift else step)
                step = fixpoint.checkpoint(step.join(lift[k].select(F.col("name").alias("up"), F.col("up").alias("up2")), "up").select("name", F.col("up2").alias("up")))
                k += 1
            at = e.where(F.col("level") == cut).join(one.where("n > 1").select(F.col("name").alias("dst")), "dst", "left_semi").select("dst", F.col("src").alias("x"))
            found = self._meeting(at, tree, lift)
        return tree.select("name", F.coalesce("up", "name").alias("idom"))

    @staticmethod
    def _meeting(at: DataFrame, tree: DataFrame, lift: dict[int, DataFrame]) -> DataFrame:
        """(name, up): the lowest common ancestor of each dst's nodes x."""
        at = at.join(tree.select(F.col("name").alias("x"), "depth"), "x")
        least = at.groupBy("dst").agg(F.min("depth").alias("least"))
        at = at.join(least, "dst").select("dst", "x", (F.col("depth") - F.col("least")).alias("over"))
        power = lambda k: lift[k].select(F.col("name").alias("x"), F.col("up").alias("y"))
        for k in sorted(lift):  # all to the depth of the highest
            moved = at.join(power(k), "x", "left")
            at = moved.select("dst", F.when(F.col("over").bitwiseAND(1 << k) > 0, F.col("y")).otherwise(F.col("x")).alias("x"), "over")
        at = fixpoint.checkpoint(at.select("dst", "x").distinct())
        ways = Window.partitionBy("dst")  # no more rows than the node has predecessors
        for k in sorted(lift, reverse=True):  # up together while they stay apart
            moved = at.join(power(k), "x", "left").withColumn("apart", F.min("y").over(ways) != F.max("y").over(ways))
            at = moved.select("dst", F.when(F.col("apart"), F.col("y")).otherwise(F.col("x")).alias("x"))
            if k % 8 == 0:
                at = fixpoint.checkpoint(at.distinct())
        last = at.join(power(0), "x", "left").groupBy("dst").agg(F.count("*").alias("n"), F.min("x").alias("x"), F.min("y").alias("y"))
        return last.select(F.col("dst").alias("name"), F.when(F.col("n") > 1, F.col("y")).otherwise(F.col("x")).alias("up"))
