"""Statistics, diffs, composition, lineage, explanation, lint and profiles: one-pass relational programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.errors import EdgeNotFoundError, GraphError
from arbora.graph import Graph
from arbora.kernels import Adjacency
from arbora.operators import contraction, fixpoint


def stats(g: Graph) -> DataFrame:
    """One row of 14 figures."""
    lvl = g.levels()
    shape = lvl.groupBy("level").count().agg(F.count("*").alias("depth"), F.max("count").alias("width"))
    deg = g.degrees().agg(
        F.count("*").alias("node_count"), F.sum("in_degree").alias("edge_count"),
        F.avg("in_degree").alias("avg_in_degree"), F.max("in_degree").alias("max_in_degree"),
        F.avg("out_degree").alias("avg_out_degree"), F.max("out_degree").alias("max_out_degree"),
        F.count_if(F.col("in_degree") == 0).alias("root_count"), F.count_if(F.col("out_degree") == 0).alias("leaf_count"),
    )
    comp = g.weak_components().agg(F.countDistinct("component").alias("component_count"))
    one = deg.crossJoin(F.broadcast(shape)).crossJoin(F.broadcast(comp))  # one row each
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    n, e = F.col("node_count"), zero("edge_count")
    return one.select(
        "node_count", e.alias("edge_count"), zero("depth").alias("depth"), zero("width").alias("width"),
        F.when(n > 1, e / (n * (n - 1))).otherwise(0.0).alias("density"), F.greatest(F.lit(0), zero("depth") - 1).alias("longest_path_length"),
        zero("avg_in_degree").cast("double").alias("avg_in_degree"), zero("max_in_degree").alias("max_in_degree"),
        zero("avg_out_degree").cast("double").alias("avg_out_degree"), zero("max_out_degree").alias("max_out_degree"),
        "root_count", "leaf_count", (F.col("component_count") <= 1).alias("is_weakly_connected"), "component_count",
    )


def diff(a: Graph, b: Graph) -> DataFrame:
    """kind (node, edge), change (added, removed, changed), src (the name of a node), dst."""
    n = a.nodes.select("name", F.col("payload").alias("p"), F.lit(1).alias("x")).join(b.nodes.select("name", F.col("payload").alias("q"), F.lit(1).alias("y")), "name", "full_outer")
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(~F.col("p").eqNullSafe(F.col("q")), "changed")
    nodes = n.select(F.lit("node").alias("kind"), change.alias("change"), F.col("name").alias("src"), F.lit(None).cast("string").alias("dst"))
    side = lambda g, v: g.edges.groupBy("src", "dst").agg(F.min_by(F.struct("weight", "label"), F.struct("edge_id", "weight", "label")).alias(v))
    e = side(a, "p").join(side(b, "q"), ["src", "dst"], "full_outer")
    differs = (F.abs(F.col("p.weight") - F.col("q.weight")) > 2.220446049250313e-16) | ~F.col("p.label").eqNullSafe(F.col("q.label"))
    change = F.when(F.col("p").isNull(), "added").when(F.col("q").isNull(), "removed").when(differs, "changed")
    edges = e.select(F.lit("edge").alias("kind"), change.alias("change"), "src", "dst")
    return nodes.unionByName(edges).where("change is not null")


def compose(parts: dict[str, Graph], connections: list[tuple[str, str]], separator: str = "/") -> Graph:
    """Disjoint union under namespaces plus cross edges; weights and labels are dropped."""
    nodes = edges = None
    for space, g in parts.items():
        named = lambda c: F.concat_ws(separator, F.lit(space), F.col(c))  # noqa: B023, E731
        n = g.nodes.withColumn("name", named("name"))
        e = g.edges.select(named("src").alias("src"), named("dst").alias("dst"))
        nodes = n if nodes is None else nodes.unionByName(n)
        edges = e if edges is None else edges.unionByName(e)
    if nodes is None:
        raise GraphError("nothing to compose")
    if connections:
        edges = edges.unionByName(nodes.sparkSession.createDataFrame(connections, "src string, dst string"))
    return Graph(nodes, edges)


# ---- lineage over run results: (name, status) ----


def lineage(g: Graph, results: DataFrame, names: DataFrame) -> DataFrame:
    """name, inputs (direct, completed), ancestors (completed), depth: what went into each name."""
    done = results.where("status = 'completed'").select("name")
    starts = names.select("name")
    if g._kernel() and g._components[2] ** 2 <= 2 * fixpoint.KERNEL_PAIRS:
        return _lineage_in_tasks(g, done, starts)
    up = fixpoint.checkpoint(_above(g, starts))
    got = up.join(done, "name", "left_semi").groupBy(F.col("start").alias("name")).agg(F.array_sort(F.collect_set("name")).alias("ancestors"), F.max("hops").alias("depth"))
    direct = up.where("hops = 1").join(done, "name", "left_semi").groupBy(F.col("start").alias("name")).agg(F.array_sort(F.collect_set("name")).alias("inputs"))
    empty = F.array().cast("array<string>")
    return starts.join(direct, "name", "left").join(got, "name", "left").select("name", F.coalesce("inputs", empty).alias("inputs"), F.coalesce("ancestors", empty).alias("ancestors"), F.coalesce("depth", F.lit(0)).alias("depth"))


def _lineage_in_tasks(g: Graph, done: DataFrame, starts: DataFrame) -> DataFrame:
    """``lineage`` where components fit tasks: each makes the rows of its names, so no pair of nodes is shuffled."""
    asked = starts.groupBy("name").agg(F.count("*").cast("int").alias("hit"))
    known = g.nodes.select("name").join(asked, "name", "left").join(done.distinct().withColumn("ok", F.lit(1)), "name", "left")
    known = known.select("name", F.coalesce("hit", F.lit(0)).alias("hit"), F.coalesce("ok", F.lit(0)).alias("ok"))

    def kernel(adj: Adjacency, cols: dict) -> dict[str, list]:
        out: dict[str, list] = {"name": [], "inputs": [], "ancestors": [], "depth": []}
        ok = cols["ok"]
        for i, hit in enumerate(cols["hit"]):
            seen, edge, step, found, depth, near = {i}, [i] if hit else [], 0, [], 0, []
            while edge:
                step += 1
                edge = list(dict.fromkeys(j for k in edge for j in adj.inc[k] if j not in seen))
                seen.update(edge)
                got = [j for j in edge if ok[j]]
                if got:
                    found += got
                    depth = step
                if step == 1:
                    near = got
            if hit:
                row = adj.names[i], *(adj.label(sorted(x, key=adj.place.__getitem__)) for x in (near, found)), depth
                for c, v in zip(out, row):
                    out[c] += [v] * hit
        return out

    got = fixpoint.by_component(known, g.edges, g._components[0], kernel, "name string,inputs array<string>,ancestors array<string>,depth int", ["hit", "ok"], 1 + g._components[2] // 100)
    empty = F.array().cast("array<string>")
    other = starts.join(g.nodes.select("name"), "name", "left_anti").select("name", empty.alias("inputs"), empty.alias("ancestors"), F.lit(0).alias("depth"))
    return got.unionByName(other)


def _above(g: Graph, starts: DataFrame) -> DataFrame:
    """(start, name, hops): the ancestors of each start, fewest hops; of the starts only."""
    if not g._kernel():
        return fixpoint.reach(g.reverse().edges, starts)
    asked = g.nodes.select("name").join(starts.select("name").distinct().withColumn("hit", F.lit(1)), "name", "left").select("name", F.coalesce("hit", F.lit(0)).alias("hit"))

    def kernel(adj: Adjacency, cols: dict) -> dict[str, list]:
        out: dict[str, list] = {"start": [], "name": [], "hops": []}
        for i, hit in enumerate(cols["hit"]):
            seen, edge, step = {i}, [i] if hit else [], 0
            while edge:
                step += 1
                edge = list(dict.fromkeys(j for k in edge for j in adj.inc[k] if j not in seen))
                seen.update(edge)
                for c, v in (("start", [adj.names[i]] * len(edge)), ("name", adj.label(edge)), ("hops", [step] * len(edge))):
                    out[c] += v
        return out

    return fixpoint.by_component(asked, g.edges, g._components[0], kernel, "start string,name string,hops int", ["hit"])


def impact(g: Graph, results: DataFrame, names: DataFrame) -> DataFrame:
    """name, affected (completed descendants), affected_leaves: how far each name reaches."""
    done = results.where("status = 'completed'").select("name")
    down = fixpoint.reach(g.edges, names.select("name")).join(done, "name", "left_semi")
    leaf = g.leaves().withColumn("leaf", F.lit(1))
    d = down.join(leaf, "name", "left").groupBy(F.col("start").alias("name")).agg(F.count("*").alias("affected"), F.count("leaf").alias("affected_leaves"))
    return names.select("name").join(d, "name", "left").select("name", F.coalesce("affected", F.lit(0)).alias("affected"), F.coalesce("affected_leaves", F.lit(0)).alias("affected_leaves"))


def broken_lineage(g: Graph, results: DataFrame) -> DataFrame:
    """src, dst of edges where the target completed though its source did not."""
    done = results.where("status = 'completed'").select("name").distinct()
    e = g.edges.select("src", "dst").distinct().join(done.withColumnRenamed("name", "dst"), "dst", "left_semi")
    return e.join(done.withColumnRenamed("name", "src"), "src", "left_anti").select("src", "dst")


def data_flow_path(g: Graph, results: DataFrame, src: str, dst: str) -> DataFrame:
    """Shortest path whose inner nodes all completed."""
    ok = results.where("status = 'completed'").select("name").distinct()
    ends = g.spark.createDataFrame([(src,), (dst,)], "name string")
    return g.subgraph(g.nodes.select("name").join(ok.unionByName(ends), "name", "left_semi")).shortest_path(src, dst)


def lineage_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n"))


# ---- explanation ----


def _in_tasks(g: Graph) -> bool:
    return g._kernel() and g._components[2] ** 2 <= 2 * fixpoint.KERNEL_PAIRS


def _around(g: Graph, listed: bool = True) -> DataFrame:
    """name, level, ins, outs, ancestors, descendants and dominates (``listed``) or dominated, their number, all from one pass in tasks.

    What is above and below a node is a bitmap over the nodes of its own component.  A node that all others of its
    component lie above or below dominates all that is below it, and nothing needs to be looked at.
    """

    def kernel(adj: Adjacency, cols: dict) -> dict[str, list]:
        order, comp = adj.kahn(), adj.weak_components()
        n = len(order)
        members: dict[int, list[int]] = {}
        bit, above, below = [0] * n, [0] * n, [0] * n
        level = [0] * n
        for i in order:
            of = members.setdefault(comp[i], [])
            bit[i] = 1 << len(of)
            of.append(i)
            for j in adj.inc[i]:
                above[i] |= above[j] | bit[j]
                level[i] = max(level[i], level[j] + 1)
        for i in reversed(order):
            for j in adj.out[i]:
                below[i] |= below[j] | bit[j]
        hits: list = []
        for i in range(n):
            of = members[comp[i]]
            line = above[i] | below[i] | bit[i]
            hit = below[i]
            if line + 1 != 1 << len(of):
                left, hit = hit, 0
                while left:
                    low = left & -left
                    left ^= low
                    if not above[of[low.bit_length() - 1]] & ~line:
                        hit |= low
            if not listed:
                hits.append(hit.bit_count())
                continue
            ids = []
            while hit:
                low = hit & -hit
                hit ^= low
                ids.append(of[low.bit_length() - 1])
            hits.append(adj.label(sorted(ids, key=adj.place.__getitem__)))
        return {
            "name": adj.names, "level": level, "ins": [len(x) for x in adj.inc], "outs": [len(x) for x in adj.out],
            "ancestors": [x.bit_count() for x in above], "descendants": [x.bit_count() for x in below], "dominates" if listed else "dominated": hits,
        }

    last = "dominates array<string>" if listed else "dominated long"
    schema = f"name string,level int,ins long,outs long,ancestors long,descendants long,{last}"
    return fixpoint.by_component(g.nodes, g.edges, g._components[0], kernel, schema, per_edge=1 + g._components[2] // 100)


def dominated(g: Graph) -> DataFrame:
    """name, dominates (sorted): the descendants whose other ancestors all lie above or below the node.

    A descendant isn't dominated if one of its predecessors lies beside the node, or if it is below such a
    descendant.  In components that fit a task ancestors are bitmaps; else the pairs with a predecessor beside the node
    are passed on downward, and all other pairs are left.
    """
    if _in_tasks(g):
        return _around(g).select("name", "dominates")
    else:
        pairs = fixpoint.checkpoint(g.closure().select("src", "dst"))
        e = fixpoint.checkpoint(g.edges.select(F.col("src").alias("p"), "dst").distinct())
        ways = pairs.join(e, "dst").where("p <> src")
        line = pairs.select("src", F.col("dst").alias("p")).unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("p")))
        off = fixpoint.checkpoint(ways.join(line, ["src", "p"], "left_anti").select("src", "dst").distinct())
        front = off
        while not front.isEmpty():
            front = front.select("src", F.col("dst").alias("p")).join(e, "p").select("src", "dst").distinct()
            front = fixpoint.checkpoint(front.join(off, ["src", "dst"], "left_anti"))
            off = fixpoint.checkpoint(off.unionByName(front))
        hit = pairs.join(off, ["src", "dst"], "left_anti").withColumnRenamed("src", "name")
    got = hit.groupBy("name").agg(F.array_sort(F.collect_list("dst")).alias("dominates"))
    return g.nodes.select("name").join(got, "name", "left").select("name", F.coalesce("dominates", F.array().cast("array<string>")).alias("dominates"))


def explain(g: Graph, costs: DataFrame | None = None, listed: bool = True) -> DataFrame:
    """For every node: depth, on_critical_path, bottleneck, counts around it, is_root, is_leaf, dominates.

    Without ``listed`` the last is dominated, the number of nodes it dominates; they aren't listed where tasks can count them.

    bottleneck = descendants / total, halved off the critical path, two decimals.  What is above and below a node is
    counted from interval labels, without listing it.
    """
    n = g.node_count()
    cp = g.critical_path(costs).select("name", F.lit(True).alias("on_critical_path"))
    last = "dominates" if listed else "dominated"
    if _in_tasks(g):
        j = _around(g, listed).withColumnsRenamed({"ins": "in_degree", "outs": "out_degree"}).join(cp, "name", "left")
    else:
        down = g.reachability_index().sizes().withColumnRenamed("n", "descendants")
        up = g._reversed.reachability_index().sizes().withColumnRenamed("n", "ancestors")
        j = g.levels().join(g.degrees(), "name").join(down, "name").join(up, "name").join(cp, "name", "left").join(dominated(g), "name")
        if not listed:
            j = j.withColumn("dominated", F.size("dominates").cast("long"))
    on = F.coalesce("on_critical_path", F.lit(False))
    return j.select(
        "name", F.col("level").alias("depth"), on.alias("on_critical_path"), F.round(F.col("descendants") / max(1, n) * F.when(on, 1.0).otherwise(0.5), 2).alias("bottleneck"),
        "in_degree", "out_degree", "ancestors", "descendants", (F.col("in_degree") == 0).alias("is_root"), (F.col("out_degree") == 0).alias("is_leaf"), last,
    )


def changed(g: Graph, add_nodes: DataFrame | None = None, add_edges: DataFrame | None = None, remove_nodes: DataFrame | None = None, remove_edges: DataFrame | None = None) -> Graph:
    """A copy with edges (src, dst; unknown ends become nodes) and nodes added, then one edge of each given pair and nodes removed."""
    h = g
    if add_edges is not None:
        ends = add_edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct().join(h.nodes, "name", "left_anti")
        h = h.add_nodes(ends, check=False).add_edges(add_edges, check=False)
    if add_nodes is not None:
        h = h.add_nodes(add_nodes.select("name").distinct().join(h.nodes, "name", "left_anti"), check=False)
    if remove_edges is not None:
        w = Window.partitionBy("src", "dst").orderBy("edge_id", "weight", "label")  # as many rows as there are parallel edges
        gone = remove_edges.groupBy("src", "dst").agg(F.count("*").alias("__gone"))
        lost = gone.join(h.edges, ["src", "dst"], "left_anti").first()
        if lost:
            raise EdgeNotFoundError(f"{lost['src']} -> {lost['dst']}")
        e = h.edges.withColumn("__n", F.row_number().over(w)).join(gone, ["src", "dst"], "left").where("__n > coalesce(__gone, 0)").drop("__n", "__gone")
        h = h._same(h.nodes, e)
    return h.remove_nodes(remove_nodes) if remove_nodes is not None else h


def relevelled(g: Graph, before: DataFrame, h: Graph) -> DataFrame:
    """name, level of the changed graph ``h`` from the levels ``before`` of ``g``: only the cone of the change is relaxed again.

    The cone is what new, changed and cut edges lead to and all below; a node of it starts from the levels of its
    predecessors outside.  Where components fit tasks, the levels of the changed graph are made at once.
    """
    if h._kernel():  # a task goes through whole components anyway
        return h.levels()
    was, now = g.edges.select("src", "dst").distinct(), h.edges.select("src", "dst").distinct()
    ends = now.join(was, ["src", "dst"], "left_anti").unionByName(was.join(now, ["src", "dst"], "left_anti")).select(F.col("dst").alias("name"))
    fresh = h.nodes.select("name").join(g.nodes.select("name"), "name", "left_anti")
    touched = ends.unionByName(fresh).distinct().join(h.nodes.select("name"), "name", "left_semi")
    cone = fixpoint.checkpoint(h.dirty_set(touched))
    into = fixpoint.checkpoint(now.join(cone.withColumnRenamed("name", "dst"), "dst", "left_semi"))
    outer = into.join(cone.withColumnRenamed("name", "src"), "src", "left_anti").join(before.select(F.col("name").alias("src"), "level"), "src")
    base = cone.join(outer.groupBy(F.col("dst").alias("name")).agg(F.max(F.col("level") + 1.0).alias("b")), "name", "left").select("name", F.coalesce("b", F.lit(0.0)).alias("b"))
    inner = into.join(cone.withColumnRenamed("name", "src"), "src", "left_semi").select("src", "dst", F.lit(1.0).alias("w"))
    again = contraction.weighted_sums(base, inner).select("name", F.col("value").cast("int").alias("level"))
    same = before.join(h.nodes.select("name"), "name", "left_semi").join(cone, "name", "left_anti").select("name", "level")
    return same.unionByName(again)


def what_if(g: Graph, add_nodes: list[str] = (), add_edges: list[tuple[str, str]] = (), remove_nodes: list[str] = (), remove_edges: list[tuple[str, str]] = (), costs: DataFrame | None = None) -> DataFrame:
    """figure, place, name, value: the effect of a change on a copy.

    Rows: node_count, edge_count and width_delta with their value; orphaned with the name of each node that has become a root;
    critical_path with place and name; or only cycle with place and name if new edges would close one.
    """
    spark = g.spark
    frame = lambda rows, kind: spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], kind) if rows else None
    new, e, gone = frame(list(add_nodes), "name string"), frame(list(add_edges), "src string, dst string"), frame(list(remove_nodes), "name string")
    h = changed(g, new, e, gone, frame(list(remove_edges), "src string, dst string"))
    row = lambda df, figure, place, name, value: df.select(F.lit(figure).alias("figure"), place.cast("int").alias("place"), name.cast("string").alias("name"), value.cast("long").alias("value"))
    none = F.lit(None)
    if e is not None:
        after = changed(g, None, e)
        closing = after.creating_cycles(e)  # of the new edges, those whose end reaches their start
        at = closing.agg(F.min("src")).first()[0]
        if at is not None:
            walk = after.cycle_through(at)  # one cycle
            return row(spark.createDataFrame(list(enumerate(walk)), "place int, name string"), "cycle", F.col("place"), F.col("name"), none)
    return effects(g, h, costs)


def effects(g: Graph, h: Graph, costs: DataFrame | None = None) -> DataFrame:
    """figure, place, name, value: what sets the changed graph ``h`` apart from ``g``, see ``what_if``."""
    row = lambda df, figure, place, name, value: df.select(F.lit(figure).alias("figure"), place.cast("int").alias("place"), name.cast("string").alias("name"), value.cast("long").alias("value"))
    none = F.lit(None)
    h = h.snapshot()
    before = fixpoint.checkpoint(g.levels())
    width = lambda lvl, sign: lvl.groupBy("level").count().agg((F.coalesce(F.max("count"), F.lit(0)) * sign).alias("n"))
    delta = width(relevelled(g, before, h), 1).unionByName(width(before, -1)).agg(F.sum("n").alias("n"))
    roots = h.roots().join(g.roots(), "name", "left_anti")
    roots = roots.join(g.nodes.select("name"), "name", "left_semi")  # new nodes aren't orphans
    out = row(h.nodes.agg(F.count("*").alias("n")), "node_count", none, none, F.col("n")).unionByName(row(h.edges.agg(F.count("*").alias("n")), "edge_count", none, none, F.col("n")))
    out = out.unionByName(row(delta, "width_delta", none, none, F.col("n"))).unionByName(row(roots, "orphaned", none, F.col("name"), none))
    return out.unionByName(row(h.critical_path(costs), "critical_path", F.col("place"), F.col("name"), none))


# ---- lint and shape rules ----


def lint(g: Graph, max_fan_in: int = 10, max_fan_out: int = 10, max_depth: int = 50) -> DataFrame:
    """code, severity, subject, value."""
    d = g.degrees()
    lvl = g.levels()
    row = lambda df, code, severity, subject, value: df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"), value.cast("long").alias("value"))
    none = F.lit(None)
    total = g.nodes.agg(F.count("*").alias("n"))
    reduced = g.edges.select("src", "dst").distinct().join(g.transitive_reduction().edges.select("src", "dst"), ["src", "dst"], "left_anti").agg(F.count("*").alias("n"))
    parts = g.weak_components().agg(F.countDistinct("component").alias("n"))
    several = total.where("n > 1")
    out = [
        row(total.where("n = 0"), "EMPTY_GRAPH", "warning", none, F.col("n")),
        row(d.where(F.col("in_degree") > max_fan_in), "HIGH_FAN_IN", "warning", F.col("name"), F.col("in_degree")),
        row(d.where(F.col("out_degree") > max_fan_out), "HIGH_FAN_OUT", "warning", F.col("name"), F.col("out_degree")),
        row(parts.where("n > 1"), "DISCONNECTED", "info", none, F.col("n")),
        row(lvl.agg((F.max("level") + 1).alias("n")).where(F.col("n") > max_depth), "EXCESSIVE_DEPTH", "warning", none, F.col("n")),
        row(reduced.where("n > 0"), "REDUNDANT_EDGES", "info", none, F.col("n")),
        row(d.where("in_degree = 0 and out_degree = 0").join(several.select(F.lit(1)), how="left_semi"), "ISOLATED_NODES", "info", F.col("name"), F.lit(0)),
    ]
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


class GraphRules:
    """Shape constraints; ``validate`` gives (rule, detail) rows of what is broken."""

    def __init__(self, single_root: bool = False, single_leaf: bool = False, max_depth: int | None = None, min_nodes: int | None = None, max_nodes: int | None = None, max_in_degree: int | None = None, max_out_degree: int | None = None, connected: bool = False, root_pattern: str | None = None, leaf_pattern: str | None = None, required: list[str] = (), forbidden: list[str] = ()):
        self.__dict__.update({k: v for k, v in locals().items() if k != "self"})

    def validate(self, g: Graph) -> DataFrame:
        from arbora.functions.patterns import glob_to_regex

        rows = []
        add = lambda df, rule, detail: rows.append(df.select(F.lit(rule).alias("rule"), detail.cast("string").alias("detail")))
        n = F.col("n")
        count = lambda df: df.agg(F.count("*").alias("n"))
        if self.single_root:
            add(count(g.roots()).where(n != 1), "single_root", n)
        if self.single_leaf:
            add(count(g.leaves()).where(n != 1), "single_leaf", n)
        if self.max_depth is not None:
            add(g.levels().agg((F.max("level") + 1).alias("n")).where(n > self.max_depth), "max_depth", n)
        if self.min_nodes is not None:
            add(count(g.nodes).where(n < self.min_nodes), "min_nodes", n)
        if self.max_nodes is not None:
            add(count(g.nodes).where(n > self.max_nodes), "max_nodes", n)
        if self.max_in_degree is not None:
            add(g.degrees().where(F.col("in_degree") > self.max_in_degree), "max_in_degree", F.col("name"))
        if self.max_out_degree is not None:
            add(g.degrees().where(F.col("out_degree") > self.max_out_degree), "max_out_degree", F.col("name"))
        if self.connected:
            add(g.weak_components().agg(F.countDistinct("component").alias("n")).where(n > 1), "connected", n)
        if self.root_pattern:
            add(g.roots().where(~F.col("name").rlike(glob_to_regex(self.root_pattern))), "root_pattern", F.col("name"))
        if self.leaf_pattern:
            add(g.leaves().where(~F.col("name").rlike(glob_to_regex(self.leaf_pattern))), "leaf_pattern", F.col("name"))
        if self.required:
            want = g.spark.createDataFrame([(x,) for x in self.required], "name string")
            add(want.join(g.nodes, "name", "left_anti"), "required", F.col("name"))
        if self.forbidden:
            add(g.nodes.where(F.col("name").isin(list(self.forbidden))), "forbidden", F.col("name"))
        out = g.spark.createDataFrame([], "rule string, detail string")
        for r in rows:
            out = out.unionByName(r)
        return out


# ---- profiles and logs ----


def profile(g: Graph, results: DataFrame) -> DataFrame:
    """name, duration, earliest_start, latest_start, slack, critical, of completed nodes by measured durations."""
    done = fixpoint.checkpoint(results.where("status = 'completed'").groupBy("name").agg(F.max("duration_seconds").alias("cost")))
    sub = g.subgraph(done)
    sub = Graph(fixpoint.checkpoint(sub.nodes.select("name")), fixpoint.checkpoint(sub.edges.select("src", "dst")), g.strategy)
    down = sub.bottom_levels(done)
    top = sub._reversed.bottom_levels(done).withColumnRenamed("bottom_level", "head")  # its components are the same
    j = fixpoint.checkpoint(done.join(down, "name").join(top, "name"))
    j = j.crossJoin(F.broadcast(j.agg(F.max("bottom_level").alias("whole"))))  # one row
    p = j.select("name", F.col("cost").alias("duration"), (F.col("head") - F.col("cost")).alias("earliest_start"), (F.col("whole") - F.col("bottom_level")).alias("latest_start"))
    slack = F.round(F.col("latest_start") - F.col("earliest_start"), 9)
    return p.withColumn("slack", slack).withColumn("critical", F.col("slack") <= 0)


def profile_summary(g: Graph, results: DataFrame) -> DataFrame:
    """total, makespan, efficiency and greatest number of nodes that run at once at their earliest starts."""
    p = fixpoint.checkpoint(profile(g, results))
    edge = p.where("duration > 0").select(F.explode(F.array(F.struct(F.col("earliest_start").alias("t"), F.lit(1).alias("d")), F.struct((F.col("earliest_start") + F.col("duration")).alias("t"), F.lit(-1).alias("d")))).alias("x")).select("x.*")
    steps = edge.groupBy("t").agg(F.sum("d").alias("d"))
    busy = fixpoint.running_total(steps, ["t"], "d", "before").agg(F.max(F.col("before") + F.col("d")).alias("max_parallelism"))
    total = p.agg(F.sum("duration").alias("total"), F.max(F.col("earliest_start") + F.col("duration")).alias("makespan"))
    return total.crossJoin(F.broadcast(busy)).select("total", "makespan", F.when(F.col("makespan") > 0, F.col("total") / F.col("makespan")).otherwise(0.0).alias("efficiency"), "max_parallelism")


def bottlenecks(g: Graph, results: DataFrame, k: int = 5) -> DataFrame:
    """The k nodes of greatest duration x (1 + descendants)."""
    done = results.where("status = 'completed'").groupBy("name").agg(F.max("duration_seconds").alias("duration"))
    down = g.reachability_index().sizes().withColumnRenamed("n", "descendants")
    s = done.join(down, "name", "left").withColumn("descendants", F.coalesce("descendants", F.lit(0))).withColumn("impact", F.col("duration") * (1 + F.col("descendants")))
    return s.orderBy(F.desc("impact"), "name").limit(k)


def peak_utilization(snapshots: DataFrame) -> DataFrame:
    """resource, peak: largest allocation of each resource in a timeline (allocated map)."""
    return snapshots.select(F.explode("allocated").alias("resource", "amount")).groupBy("resource").agg(F.max("amount").alias("peak"))


def hit_rate(cache_events: DataFrame) -> DataFrame:
    """hits, misses, hit_rate of (hit boolean) rows."""
    c = cache_events.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return c.withColumn("hit_rate", F.when(F.col("hits") + F.col("misses") > 0, F.col("hits") / (F.col("hits") + F.col("misses"))).otherwise(0.0))
