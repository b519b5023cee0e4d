"""Interval labels: which node reaches which, without a table of all pairs.

A spanning forest (each node under the first of its predecessors) is numbered in preorder, so what lies below a node in
it is one interval of positions.  An edge outside the forest adds the interval of its end to whatever reaches its start;
such links are closed over each other, by rounds that carry only new intervals.  A node reaches its own interval and
those of the links that start inside it.  Memory follows intervals: one for each node, and for each start of a link what
it adds.

Where all components are small, tasks list the merged intervals of every node, and there are no links to close: each node
stands under its deepest predecessor, so a chain with shortcuts keeps one interval a node.

In large graphs leaves of the forest are taken off layer by layer while that takes a good share of it, and only the rest
is numbered by its Euler tour.

Positions inside intervals are found by equal keys: an interval is a few blocks of powers of two, and every position lies
in one block of each power.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.kernels import Adjacency
from arbora.operators import fixpoint
from arbora.operators.fixpoint import checkpoint, running

#: Tasks list the intervals of each node where no component has more nodes than this.
LISTED_NODES = 1000
#: Leaves are taken off a forest while they are at least this share of it.
SHARE = 0.3


def _blocks(df: DataFrame, lo: str, hi: str, bits: int) -> DataFrame:
    """df with a row for each block (power, block) of its interval [lo, hi)."""
    k = F.explode(F.sequence(F.lit(0), F.lit(bits)))
    low, high = F.expr(f"shiftright({lo} + shiftleft(1L, power) - 1, power)"), F.expr(f"shiftright({hi}, power)")
    cut = df.withColumn("power", k).withColumns({"__l": low, "__r": high}).where("__l < __r")
    ends = F.array_compact(F.array(F.when(F.col("__l") % 2 == 1, F.col("__l")), F.when(F.col("__r") % 2 == 1, F.col("__r") - 1)))
    return cut.withColumn("block", F.explode(ends)).drop("__l", "__r")


def inside(points: DataFrame, at: str, intervals: DataFrame, lo: str, hi: str, bits: int) -> DataFrame:
    """Rows of both where lo <= at < hi, each pair once."""
    of = points.withColumn("power", F.explode(F.sequence(F.lit(0), F.lit(bits)))).withColumn("block", F.expr(f"shiftright({at}, power)"))
    return of.join(_blocks(intervals, lo, hi, bits), ["power", "block"]).drop("power", "block")


def values_inside(points: DataFrame, at: str, intervals: DataFrame, lo: str, hi: str, bits: int) -> DataFrame:
    """As ``inside``, without ``at``: points of a block that are equal but for their place count once, whatever their number."""
    of = points.withColumn("power", F.explode(F.sequence(F.lit(0), F.lit(bits)))).withColumn("block", F.expr(f"shiftright({at}, power)")).drop(at).distinct()
    return of.join(_blocks(intervals, lo, hi, bits), ["power", "block"]).drop("power", "block")


def covered(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """points (key, at, ...) with ``hit``: whether an interval [lo, hi) of the same key contains ``at``.

    One running maximum over all in the order of key and position; no key's rows need to fit a task.
    """
    more = [c for c in points.columns if c not in ("key", "at")]
    null = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in more]
    rows = intervals.select("key", F.col("lo").alias("at"), F.lit(0).alias("kind"), "hi", *null).unionByName(points.select("key", "at", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("hi"), *more))
    rows = rows.withColumn("end", F.when(F.col("kind") == 0, F.struct("key", "hi")))
    seen = running(rows, ["key", "at", "kind"], "end", "most", F.max)
    hit = (F.col("most.key") == F.col("key")) & (F.col("most.hi") > F.col("at"))
    return seen.where("kind = 1").select("key", "at", *more, F.coalesce(hit, F.lit(False)).alias("hit"))


def lengths(intervals: DataFrame) -> DataFrame:
    """(key, n): how many positions the intervals (key, lo, hi) of each key cover."""
    seen = running(intervals.withColumn("end", F.struct("key", "hi")), ["key", "lo", "hi"], "end", "most", F.max)
    before = F.when(F.col("most.key") == F.col("key"), F.greatest("lo", "most.hi")).otherwise(F.col("lo"))
    return seen.groupBy("key").agg(F.sum(F.greatest(F.lit(0), F.col("hi") - before)).alias("n"))


def _numbered(nodes: DataFrame, forest: DataFrame) -> DataFrame:
    """(name, lo, hi) of a forest (src, dst): layers of leaves taken off, the rest by its tour, then the layers again."""
    left = checkpoint(nodes.select("name").join(forest.select(F.col("dst").alias("name"), F.col("src").alias("up")), "name", "left").withColumn("size", F.lit(1).cast("long")))
    n, layers, tops = left.count(), [], []
    while n:
        inner = left.where("up is not null").select(F.col("up").alias("name")).distinct()
        free = checkpoint(left.join(inner, "name", "left_anti"))  # leaves, and roots with nothing below any more
        gone = free.count()
        if gone < SHARE * n:
            break
        leaves = free.where("up is not null")
        layers.append(leaves)
        tops.append(free.where("up is null").select("name", "size"))
        more = leaves.groupBy(F.col("up").alias("name")).agg(F.sum("size").alias("more"))
        left = checkpoint(left.join(free.select("name"), "name", "left_anti").join(more, "name", "left").select("name", "up", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
        n -= gone
    known = _tour(left, left.where("up is not null").select(F.col("up").alias("src"), F.col("name").alias("dst"))) if n else left.select("name", F.col("size").alias("lo"), F.col("size").alias("hi"))
    if tops:
        begin = left.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        alone = tops[0]
        for x in tops[1:]:
            alone = alone.unionByName(x)
        lo = F.col("before") + begin
        known = known.unionByName(fixpoint.running_total(alone, ["name"], "size", "before").select("name", lo.alias("lo"), (lo + F.col("size")).alias("hi")))
    known = checkpoint(known)
    if not layers:
        return known
    off = layers[0].withColumn("layer", F.lit(0))
    for k, x in enumerate(layers[1:], 1):
        off = off.unionByName(x.withColumn("layer", F.lit(k)))
    off = checkpoint(running(off, ["up", "name"], "size", "before").withColumn("before", F.coalesce("before", F.lit(0))))
    first = off.groupBy("up").agg(F.min("before").alias("first"))
    off = checkpoint(off.join(first, "up").select("name", "up", "size", "layer", (F.col("before") - F.col("first") + 1).alias("behind")))
    for k in reversed(range(len(layers))):
        at = known.select(F.col("name").alias("up"), F.col("lo").alias("up_lo"))
        lo = F.col("up_lo") + F.col("behind")
        known = checkpoint(known.unionByName(off.where(F.col("layer") == k).join(at, "up").select("name", lo.alias("lo"), (lo + F.col("size")).alias("hi"))))
    return known


def _tour(nodes: DataFrame, forest: DataFrame) -> DataFrame:
    """(name, lo, hi) of a forest (src, dst) by its Euler tour: a list of entries and exits, ranked by doubling.

    ``nodes`` have name and size: the positions that a node takes, itself and what was taken off below it.
    """
    n = nodes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tree = nodes.select("name").join(forest.select(F.col("dst").alias("name"), F.col("src").alias("up")), "name", "left")
    order = Window.partitionBy("up").orderBy("name")
    roots, _ = fixpoint.global_rank(tree.where("up is null").select("name"), ["name"], "no")
    after = roots.select((F.col("no") - 1).alias("no"), F.col("name").alias("next"))
    side = tree.where("up is not null").select("name", "up", F.lead("name").over(order).alias("next")).unionByName(roots.join(after, "no", "left").select("name", F.lit(None).cast("string").alias("up"), "next"))
    first = forest.groupBy(F.col("src").alias("name")).agg(F.min("dst").alias("child"))
    # entry (0) goes to the first child's entry or its own exit; exit (1) to the next sibling's entry or the parent's exit
    enter = nodes.select("name", "size").join(first, "name", "left").select("name", F.lit(0).alias("way"), F.coalesce("child", "name").alias("to"), F.when(F.col("child").isNull(), 1).otherwise(0).alias("to_way"), F.col("size").alias("n"))
    leave = side.select("name", F.lit(1).alias("way"), F.coalesce("next", "up").alias("to"), F.when(F.col("next").isNull(), 1).otherwise(0).alias("to_way"), F.lit(0).cast("long").alias("n"))
    walk = checkpoint(enter.unionByName(leave))
    while not walk.where("to is not null").isEmpty():
        ahead = walk.select(F.col("name").alias("to"), F.col("way").alias("to_way"), F.col("to").alias("to2"), F.col("to_way").alias("way2"), F.col("n").alias("n2"))
        walk = checkpoint(walk.join(ahead, ["to", "to_way"], "left").select("name", "way", F.col("to2").alias("to"), F.col("way2").alias("to_way"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n")))
    return walk.groupBy("name").agg((n - F.max(F.when(F.col("way") == 0, F.col("n")))).alias("lo"), (n - F.max(F.when(F.col("way") == 1, F.col("n")))).alias("hi"))


def _dealt(g, forest: DataFrame) -> DataFrame:
    """The same where components go into tasks: numbered in each, then shifted by the components before."""

    def kernel(adj: Adjacency, cols: dict) -> dict[str, list]:
        lo, hi, n = [0] * len(adj.names), [0] * len(adj.names), 0
        for root in adj.by_name:
            if adj.inc[root]:
                continue
            stack = [(root, False)]
            while stack:
                i, over = stack.pop()
                if over:
                    hi[i] = n
                    continue
                lo[i], n = n, n + 1
                stack.append((i, True))
                stack += [(j, False) for j in sorted(adj.out[i], key=adj.place.__getitem__, reverse=True)]
        return {"name": adj.names, "bucket": [min(adj.names)] * len(adj.names) if adj.names else [], "lo": lo, "hi": hi}

    part = checkpoint(fixpoint.by_component(g.nodes, forest, g._components[0], kernel, "name string,bucket string,lo long,hi long"))
    sizes = part.groupBy("bucket").agg(F.count("*").alias("n"))
    begin = running(sizes, ["bucket"], "n", "before").select("bucket", F.coalesce("before", F.lit(0)).alias("before"))
    return part.join(begin, "bucket").select("name", (F.col("lo") + F.col("before")).alias("lo"), (F.col("hi") + F.col("before")).alias("hi"))


def _listed(g) -> DataFrame:
    """(name, lo, hi, n, los, his) where all components are small: a node's interval, and number and merged intervals of what it reaches."""

    def kernel(adj: Adjacency, cols: dict) -> dict[str, list]:
        order, size = adj.kahn(), len(adj.names)
        level = [0] * size
        for i in order:
            for j in adj.out[i]:
                level[j] = max(level[j], level[i] + 1)
        below: list[list[int]] = [[] for _ in order]
        for i in adj.by_name:
            if adj.inc[i]:
                below[min(adj.inc[i], key=lambda j: (-level[j], adj.place[j]))].append(i)
        lo, hi, n = [0] * size, [0] * size, 0
        for root in adj.by_name:
            stack = [] if adj.inc[root] else [(root, False)]
            while stack:
                i, over = stack.pop()
                if over:
                    hi[i] = n
                    continue
                lo[i], n = n, n + 1
                stack.append((i, True))
                stack += [(j, False) for j in reversed(below[i])]
        los: list[list[int]] = [[] for _ in order]
        his: list[list[int]] = [[] for _ in order]
        for i in reversed(order):
            spans = {(lo[i] + 1, hi[i])} if hi[i] > lo[i] + 1 else set()
            for j in adj.out[i]:
                spans.add((lo[j], lo[j] + 1))
                spans.update(zip(los[j], his[j]))
            a, b = los[i], his[i]
            for x, y in sorted(spans):
                if b and x <= b[-1]:
                    b[-1] = max(b[-1], y)
                else:
                    a.append(x)
                    b.append(y)
        return {"name": adj.names, "bucket": [min(adj.names)] * size if size else [], "lo": lo, "hi": hi, "n": [sum(b) - sum(a) for a, b in zip(los, his)], "los": los, "his": his}

    part = fixpoint.by_component(g.nodes, g.edges, g._components[0], kernel, "name string,bucket string,lo long,hi long,n long,los array<long>,his array<long>", per_edge=1 + g._components[2] // 100)
    part = checkpoint(part)
    sizes = part.groupBy("bucket").agg(F.count("*").alias("n"))
    begin = running(sizes, ["bucket"], "n", "before").select("bucket", F.coalesce("before", F.lit(0)).alias("before"))
    moved = lambda c: F.expr(f"transform({c}, x -> x + before)").alias(c)
    return part.join(begin, "bucket").select("name", (F.col("lo") + F.col("before")).alias("lo"), (F.col("hi") + F.col("before")).alias("hi"), "n", moved("los"), moved("his"))


class ReachIndex:
    """``nodes`` (name, lo, hi): position and tree interval; ``links`` (x, lo, hi): what position x adds.

    Where components are small, ``nodes`` have all intervals (los, his) and their length n, and there are no links.
    """

    def __init__(self, g):
        self.listed = g._kernel() and g._components[2] <= LISTED_NODES
        if self.listed:
            self.nodes = checkpoint(_listed(g))
            return
        e = g.edges.select("src", "dst").distinct()
        forest = checkpoint(e.groupBy("dst").agg(F.min("src").alias("src")))
        self.nodes = checkpoint(_dealt(g, forest) if g._kernel() else _numbered(g.nodes, forest))
        n = self.nodes.count()
        self.bits = max(1, n).bit_length()
        at = lambda c: self.nodes.select(F.col("name").alias(c), F.col("lo").alias(f"{c}_lo"), F.col("hi").alias(f"{c}_hi"))
        rest = e.join(forest, ["src", "dst"], "left_anti").join(at("src"), "src").join(at("dst"), "dst").where("not (src_lo <= dst_lo and dst_lo < src_hi)")
        base = checkpoint(rest.select(F.col("src_lo").alias("x"), F.col("dst_lo").alias("lo"), F.col("dst_hi").alias("hi")).distinct())
        self.links, new = base, base
        # no interval but its own holds a root of the forest
        held = base.join(self.nodes.select(F.col("name").alias("dst"), F.col("lo").alias("x")).join(forest.select("dst"), "dst", "left_semi").select("x"), "x", "left_semi")
        held = checkpoint(held)
        self.forest = forest
        for step in count(1):
            if new.isEmpty():
                break
            ahead = values_inside(held.select(F.col("x").alias("y"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2")), "y", new, "lo", "hi", self.bits)
            new = checkpoint(ahead.select("x", F.col("lo2").alias("lo"), F.col("hi2").alias("hi")).distinct().join(self.links, ["x", "lo", "hi"], "left_anti"))
            self.links = self.links.unionByName(new)
            if step % 8 == 0:
                self.links = checkpoint(self.links)

    def intervals(self, names: DataFrame, strict: bool = True) -> DataFrame:
        """(key, lo, hi): what each name reaches, itself left out if ``strict``."""
        own = names.select("name").distinct().join(self.nodes, "name").withColumnRenamed("name", "key")
        if self.listed:
            listed = own.select("key", F.explode(F.arrays_zip("los", "his")).alias("s")).select("key", F.col("s.los").alias("lo"), F.col("s.his").alias("hi"))
            return listed if strict else listed.unionByName(own.select("key", "lo", (F.col("lo") + 1).alias("hi")))
        own = own.select("key", "lo", "hi")
        links = self.links.select("x", F.col("lo").alias("a"), F.col("hi").alias("b"))
        inner = own.withColumn("lo", F.col("lo") + 1).where("lo < hi")
        held = links.join(self.nodes.select(F.col("name").alias("dst"), F.col("lo").alias("x")).join(self.forest.select("dst"), "dst", "left_semi").select("x"), "x", "left_semi")
        linked = values_inside(held, "x", inner, "lo", "hi", self.bits).select("key", "a", "b").unionByName(links.join(own.select("key", F.col("lo").alias("x")), "x").select("key", "a", "b"))
        linked = linked.select("key", F.col("a").alias("lo"), F.col("b").alias("hi")).distinct()
        tree = own.withColumn("lo", F.col("lo") + 1).where("lo < hi") if strict else own
        return tree.unionByName(linked)

    def can_reach(self, pairs: DataFrame) -> DataFrame:
        """src, dst, reaches for pairs of known names; no node reaches itself."""
        if self.listed:
            at = self.nodes.select(F.col("name").alias("dst"), F.col("lo").alias("at"))
            spans = self.nodes.select(F.col("name").alias("src"), "los", "his")
            hit = F.exists(F.zip_with("los", "his", lambda a, b: (a <= F.col("at")) & (F.col("at") < b)), lambda x: x)
            return pairs.select("src", "dst").join(at, "dst", "left").join(spans, "src", "left").select("src", "dst", F.coalesce(hit, F.lit(False)).alias("reaches"))
        p = pairs.select("src", "dst").distinct().join(self.nodes.select(F.col("name").alias("dst"), F.col("lo").alias("at")), "dst")
        got = covered(p.select(F.col("src").alias("key"), "at", "dst"), self.intervals(p.select(F.col("src").alias("name"))))
        return pairs.select("src", "dst").join(got.select(F.col("key").alias("src"), "dst", "hit"), ["src", "dst"], "left").select("src", "dst", F.coalesce("hit", F.lit(False)).alias("reaches"))

    def reachable_from(self, names: DataFrame) -> DataFrame:
        """(start, name): everything that each name reaches."""
        at = self.intervals(names).select(F.col("key").alias("start"), F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("lo")).distinct()
        return at.join(self.nodes.select("lo", "name"), "lo").select("start", "name")

    def sizes(self, names: DataFrame | None = None, of: DataFrame | None = None) -> DataFrame:
        """name, n: how many nodes (of those named in ``of``) each name reaches, without listing them."""
        names = self.nodes.select("name") if names is None else names.select("name").distinct()
        if of is not None:
            found = self.intervals(names)
            counts = self.nodes.select("lo", "name").join(of.select("name").distinct().withColumn("one", F.lit(1)), "name", "left").select(F.col("lo").alias("at"), F.coalesce("one", F.lit(0)).alias("one"))
            before = checkpoint(fixpoint.running_total(counts, ["at"], "one", "before"))
            n = before.agg(F.coalesce(F.sum("one"), F.lit(0))).first()[0]
            for c in ("lo", "hi"):  # positions become numbers of counted nodes before them
                found = found.join(before.select(F.col("at").alias(c), F.col("before").alias(f"{c}2")), c, "left").withColumn(f"{c}2", F.coalesce(f"{c}2", F.lit(n)))
            got = lengths(found.select("key", F.col("lo2").alias("lo"), F.col("hi2").alias("hi"))).select(F.col("key").alias("name"), "n")
        elif self.listed:
            got = self.nodes.select("name", "n")
        else:
            got = lengths(self.intervals(names)).select(F.col("key").alias("name"), "n")
        return names.join(got, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))
