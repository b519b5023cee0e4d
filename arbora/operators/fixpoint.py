"""Iteration on DataFrames: checkpoints, reach, components, closure, relaxation, component kernels."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.errors import CycleError
from arbora.kernels import Adjacency

#: Components of at most so many edges may be solved inside one task.
KERNEL_EDGES = 1_000_000
#: Closures are made inside tasks only where no component can have more pairs than this.
KERNEL_PAIRS = 20_000_000
BUCKET_EDGES = 100_000
#: Edges that lie together are linked in pieces of so many, before any shuffle; so many that are left are linked in one task.
PIECE_EDGES = 100_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of ``spark.checkpoint.dir``; only a local session without one gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    given = sc.getConf().get("spark.checkpoint.dir")
    if given:
        sc.setCheckpointDir(given)
    elif sc.master == "local" or sc.master.startswith("local["):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    else:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _stars(most: int | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every node of the pairs (a, b) with the smallest node that they link it to, for each ``most`` pairs (all, if none is given)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}
        kind, held = None, 0

        def find(x):
            top = x
            while root[top] != top:
                top = root[top]
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        def linked() -> pa.RecordBatch:
            nodes = list(root)
            return pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], ["a", "b"])

        for whole in batches:
            kind = whole.schema.field(0).type
            for at in range(0, whole.num_rows, most or max(1, whole.num_rows)):
                batch = whole.slice(at, most or whole.num_rows)
                if most and held + batch.num_rows > most:
                    yield linked()
                    root.clear()
                    held = 0
                held += batch.num_rows
                for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    root.setdefault(a, a)
                    root.setdefault(b, b)
                    a, b = find(a), find(b)
                    if a != b:
                        root[max(a, b)] = min(a, b)
        if root:
            yield linked()

    return run


def components(edges: DataFrame, max_rounds: int = 60, whole: int = PIECE_EDGES) -> DataFrame:
    """Smallest node of each weak component: (a, b) -> (node, root); nodes without an edge don't appear.

    Edges are first linked where they lie, in pieces, and each node goes to the least of the smallest nodes of its pieces;
    what its other pieces have as smallest is linked with that.  Where edges of a component lie together (chains made by
    a window, say) few such links are left.  They are contracted: every node moves to the least of itself and its
    neighbours, by an order drawn anew each round, and edges between the places reached stay.  Nodes and edges shrink by a
    share each round, so all rounds together cost a few times the first.  At most ``whole`` edges that are left are
    linked in one task.  At the end the smallest names are handed back, last round first.
    """
    e = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    kind = e.schema["a"].dataType.simpleString()
    pieces = e.mapInArrow(_stars(PIECE_EDGES), f"a {kind}, b {kind}").repartition("a").distinct()
    pieces = checkpoint(pieces.withColumn("low", F.min("b").over(Window.partitionBy("a"))))
    own = pieces.where("b = low").select(F.col("a").alias("node"), F.col("low").alias("to"))
    links = pieces.where("b <> low")
    if links.isEmpty():
        return own.withColumnRenamed("to", "root")
    links = _contracted(checkpoint(links.select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()), max_rounds, whole)
    return checkpoint(own.join(links.withColumnRenamed("node", "to"), "to", "left").select("node", F.coalesce("root", "to").alias("root")))


def _contracted(e: DataFrame, max_rounds: int, whole: int) -> DataFrame:
    """(node, root) of distinct edges (a, b), a > b."""
    layers: list[tuple[DataFrame, DataFrame]] = []  # (node, to) and, of what was moved to, (to, low)
    for k in range(max_rounds):
        n = e.count()
        if n <= whole:
            break
        both = e.select(F.col("a").alias("node"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("node"), F.col("a").alias("v")))
        drawn = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("x"))  # noqa: B023, E731
        moved = both.groupBy("node").agg(F.min(drawn("v")).alias("m")).select("node", F.least("m", drawn("node"))["x"].alias("to"))
        named = moved.withColumn("low", F.col("node")) if not layers else moved.join(layers[-1][1].withColumnRenamed("to", "node"), "node")
        named = checkpoint(named)
        moved = named.select("node", "to")
        layers.append((moved, checkpoint(named.groupBy("to").agg(F.min("low").alias("low")))))
        at = e.join(moved.select(F.col("node").alias("a"), F.col("to").alias("p")), "a").join(moved.select(F.col("node").alias("b"), F.col("to").alias("q")), "b").where("p <> q")
        e = checkpoint(at.select(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b")).distinct())
    else:
        raise RuntimeError("components did not settle")
    kind = e.schema["a"].dataType.simpleString()
    found = e.coalesce(1).mapInArrow(_stars(), f"a {kind}, b {kind}").select(F.col("a").alias("node"), F.col("b").alias("root"))
    if not layers:
        return found
    # the last nodes' smallest names are of nodes of the first round
    if n:
        last = found.join(layers[-1][1].withColumnRenamed("to", "node"), "node")
        found = last.select("node", "root").join(last.groupBy("root").agg(F.min("low").alias("low")), "root").select("node", F.col("low").alias("root"))
    for moved, low in reversed(layers):
        top = low.join(found.withColumnRenamed("node", "to"), "to", "left").select("to", F.coalesce("root", "low").alias("root"))
        found = checkpoint(moved.join(top, "to").select("node", "root"))
    return found


def reach(edges: DataFrame, starts: DataFrame, depth: int | None = None, keep_start: bool = False) -> DataFrame:
    """(start, name, hops): nodes reached from each start over ``edges`` (src, dst), fewest hops.

    Semi-naive frontier: every round joins only what is new and drops what was seen.
    """
    e = edges.select("src", "dst")  # parallel edges fall together in each round's distinct
    front = checkpoint(starts.select(F.col("name").alias("start"), "name").distinct().withColumn("hops", F.lit(0)))
    seen = front
    for step in count(1):
        if depth is not None and step > depth:
            break
        new = front.join(e, front["name"] == e["src"]).select("start", F.col("dst").alias("name")).distinct()
        front = checkpoint(new.join(seen.select("start", "name"), ["start", "name"], "left_anti").withColumn("hops", F.lit(step)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if step % 8 == 0:
            seen = checkpoint(seen)
    return seen if keep_start else seen.where("hops > 0")


def reach_set(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """name: the given names and all that any of them reaches; a row per node, whichever start came first.

    A node with one way in is reached if what is before it is, so pointers over all such nodes are doubled at once and
    stop where the answer is known: chains and trees need rounds by the logarithm of the longest stretch without a
    start.  What has several ways in keeps them, from the ends of such stretches; then it is the same again over these edges,
    which a round also cuts by those into nodes that it reached.  Edges that can't be reached go.
    """
    seen = checkpoint(starts.select("name").distinct())
    e = edges.select("src", "dst").where("src is not null and dst is not null")  # parallel edges fall together in the ways
    layers: list[DataFrame] = []  # (name, up): reached if up is
    before = None
    for step in count(1):
        reached = seen.select(F.col("name").alias("dst"))
        ways = checkpoint(e.join(reached, "dst", "left_anti").groupBy(F.col("dst").alias("name")).agg(F.min("src").alias("up"), F.max("src").alias("other")))
        several = ways.where("up <> other").select("name")
        more = not several.isEmpty()
        seen, ended = _followed(ways.where("up = other").select("name", "up"), several, seen, more)
        if not more:
            break
        layers.append(ended)
        known = ended.select("name", "up", F.lit("ended").alias("state")).unionByName(several.select("name", F.col("name").alias("up"), F.lit("ended").alias("state")))
        known = known.unionByName(seen.select("name", F.lit(None).cast("string").alias("up"), F.lit("reached").alias("state")))
        into = e.join(several.withColumnRenamed("name", "dst"), "dst", "left_semi").join(known.withColumnRenamed("name", "src"), "src")
        into = checkpoint(into.select(F.col("up").alias("src"), "dst").distinct())  # src null: reached
        hit = into.where("src is null").select(F.col("dst").alias("name"))
        e = into.where("src is not null and src <> dst").join(hit.withColumnRenamed("name", "dst"), "dst", "left_anti")
        e = checkpoint(e)
        left = e.count()
        seen = seen.unionByName(hit)
        if not left:
            break
        if step % 8 == 0:
            seen = checkpoint(seen)
        if left == before and hit.isEmpty():
            break
        before = left
    for ended in reversed(layers):
        seen = seen.unionByName(checkpoint(ended.join(seen.withColumnRenamed("name", "up"), "up", "left_semi").select("name")))
    return seen


def _followed(single: DataFrame, several: DataFrame, seen: DataFrame, more: bool) -> tuple[DataFrame, DataFrame]:
    """``single`` (name, up) followed upwards: (seen and those that end there, (name, up) of those that end at one of ``several``)."""
    state = lambda df, up, x: df.select("name", up.cast("string").alias("up"), F.lit(x).alias("state"))
    ended = single.limit(0)
    n, steps = single.count(), 0
    rest = single
    while n and 1 << steps <= 2 * n:  # those that go on for longer are in or below a cycle of their own
        to = state(rest, F.col("up"), "open").unionByName(state(seen, F.lit(None), "reached"))
        if more:
            to = to.unionByName(state(ended, F.col("up"), "ended")).unionByName(state(several, F.col("name"), "ended"))
        to = to.select(F.col("name").alias("up"), F.col("up").alias("next"), "state")
        moved = checkpoint(rest.join(to, "up").select("name", F.col("next").alias("up"), "state"))
        seen = seen.unionByName(moved.where("state = 'reached'").select("name"))
        if more:
            ended = ended.unionByName(moved.where("state = 'ended'").select("name", "up"))
        rest = moved.where("state = 'open'").select("name", "up")
        steps += 1
        if rest.isEmpty():
            break
    return seen, ended


def reaches(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst): those of the given pairs whose src reaches dst.

    A start is followed only while some pair of its own is open, so a near answer ends its search.
    """
    e = edges.select("src", "dst").distinct()
    left = checkpoint(pairs.select("src", "dst").distinct())
    front = checkpoint(left.select(F.col("src").alias("start"), F.col("src").alias("name")).distinct())
    seen, found = front, left.limit(0)
    for step in count(1):
        new = front.join(e, front["name"] == e["src"]).select("start", F.col("dst").alias("name")).distinct()
        front = checkpoint(new.join(seen, ["start", "name"], "left_anti"))
        if front.isEmpty():
            return found
        hit = checkpoint(left.join(front.select(F.col("start").alias("src"), F.col("name").alias("dst")), ["src", "dst"], "left_semi"))
        if not hit.isEmpty():
            found = found.unionByName(hit)
            left = checkpoint(left.join(hit, ["src", "dst"], "left_anti"))
            front = checkpoint(front.join(left.select(F.col("src").alias("start")).distinct(), "start", "left_semi"))
        seen = seen.unionByName(front)
        if step % 8 == 0:
            seen = checkpoint(seen)


def closure_doubling(edges: DataFrame) -> DataFrame:
    """(src, dst, hops_min, hops_max) of all reachable pairs by path doubling; raises on a cycle."""
    p = edges.groupBy("src", "dst").agg(F.lit(1).alias("hops_min"), F.lit(1).alias("hops_max"))
    p = checkpoint(p)
    signature = None
    while True:
        a, b = p.alias("a"), p.alias("b")
        twice = a.join(b, F.col("a.dst") == F.col("b.src")).select(
            F.col("a.src").alias("src"), F.col("b.dst").alias("dst"),
            (F.col("a.hops_min") + F.col("b.hops_min")).alias("hops_min"), (F.col("a.hops_max") + F.col("b.hops_max")).alias("hops_max"),
        )
        p = checkpoint(p.unionByName(twice).groupBy("src", "dst").agg(F.min("hops_min").alias("hops_min"), F.max("hops_max").alias("hops_max")))
        loop = p.where("src = dst").select("src").first()
        if loop:
            raise CycleError([loop[0], loop[0]])
        row = tuple(p.agg(F.count("*"), F.sum("hops_min"), F.sum("hops_max")).first())
        if row == signature:
            return p
        signature = row


def relax(nodes: DataFrame, edges: DataFrame, own: str, n_nodes: int | None = None) -> DataFrame:
    """(name, value): longest sum of ``own`` (a column of nodes, not below 0 upstream) along edges into a node.

    value(v) = own(v) + max(0, value(u) for u -> v).  Only nodes whose value rose are sent on, a round a
    hop of depth; more rounds than nodes mean a cycle.
    """
    e = edges.select("src", "dst").distinct()
    cost = nodes.select("name", F.col(own).cast("double").alias("own"))
    now = checkpoint(cost.withColumn("value", F.col("own")))
    front = now
    n = n_nodes if n_nodes is not None else now.count()
    for _ in range(n + 1):
        sent = front.where("value > 0").join(e, F.col("name") == F.col("src")).groupBy("dst").agg(F.max("value").alias("in"))
        better = now.join(sent, F.col("name") == F.col("dst")).where(F.col("own") + F.col("in") > F.col("value"))
        front = checkpoint(better.select("name", "own", (F.col("own") + F.col("in")).alias("value")))
        if front.isEmpty():
            return now.select("name", "value")
        up = front.select("name", F.col("value").alias("up"))
        now = checkpoint(now.join(up, "name", "left").select("name", "own", F.coalesce("up", "value").alias("value")))
    raise CycleError(["?"])


def global_rank(df: DataFrame, by: list[str], column: str, offset: int = 0, small: int = 100_000) -> tuple[DataFrame, int]:
    """(df with 0-based positions in the order of ``by``, number of rows).

    Large frames are dealt into ranges, numbered within each and shifted by the sizes of those before, so no
    task sees all rows.
    """
    df = checkpoint(df)
    n = df.count()
    number = lambda *part: F.row_number().over(Window.partitionBy(*part).orderBy(*by)) - 1
    if n <= small:
        return df.withColumn(column, (number() + offset).cast("int")), n
    dealt = checkpoint(df.repartitionByRange(max(2, n // small), *by).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy("__range").count()
    before = sizes.select("__range", F.coalesce(F.sum("count").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return dealt.join(before, "__range").withColumn(column, (number("__range") + F.col("__before") + offset).cast("int")).drop("__range", "__before"), n


def running(df: DataFrame, by: list[str], value: str, column: str, agg: Callable[[str], Column] = F.sum, small: int = 100_000) -> DataFrame:
    """df with ``column``: ``agg`` (a sum, maximum or minimum) of ``value`` over all rows before, in the order of ``by``; null before the first.

    Rows are dealt into ranges and summed within each; the ranges' sums are carried on by the same means, so no
    task sees all rows, nor all ranges, whatever their number.  Rows that are equal in ``by`` may come in any order.
    """
    df = checkpoint(df)
    n = df.count()
    before = lambda part: agg(value).over(Window.partitionBy(part).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))
    if n <= small:
        return df.withColumn("__one", F.lit(0)).withColumn(column, before("__one")).drop("__one")
    dealt = checkpoint(df.repartitionByRange(-(-n // small), *by).withColumn("__range", F.spark_partition_id()))
    sums = dealt.groupBy(F.col("__range").alias("part")).agg(agg(value).alias("held"))
    carried = running(sums, ["part"], "held", "carried", agg, small).select(F.col("part").alias("__range"), F.col("carried").alias("__carried"))
    inner = dealt.join(carried, "__range").withColumn("__inner", before("__range"))
    both = F.coalesce(F.col("__carried") + F.col("__inner"), "__carried", "__inner") if agg is F.sum else (F.greatest if agg is F.max else F.least)("__carried", "__inner")
    return inner.withColumn(column, both).drop("__range", "__carried", "__inner")


def running_total(df: DataFrame, by: list[str], value: str, column: str, small: int = 100_000) -> DataFrame:
    """df with ``column``: the sum of ``value`` over all rows before, in the order of ``by``; 0 before the first."""
    out = running(df, by, value, column, F.sum, small)
    return out.withColumn(column, F.coalesce(column, F.lit(0)))


def component_sizes(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, int, int]:
    """(name, root) for every node, and the edges and the nodes of the largest components."""
    found = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), whole=KERNEL_EDGES)
    named = checkpoint(nodes.select("name").join(found.withColumnRenamed("node", "name"), "name", "left").select("name", F.coalesce("root", "name").alias("root")))
    per = edges.join(named, edges["src"] == named["name"]).groupBy("root").agg(F.count("*").alias("e"), F.lit(0).alias("n"))
    per = per.unionByName(named.groupBy("root").agg(F.lit(0).alias("e"), F.count("*").alias("n")))
    most = per.agg(F.max("e"), F.max("n")).first()
    return named, int(most[0] or 0), int(most[1] or 0)


def by_component(nodes: DataFrame, edges: DataFrame, named: DataFrame, kernel: Callable[[Adjacency, dict], dict[str, list]], schema: str, extra: list[str] | None = None, per_edge: int = 1) -> DataFrame:
    """Run a sequential kernel on whole components, several to a task.

    ``kernel(adjacency, columns)`` gets the node columns as lists (name first, then ``extra``) and gives
    the columns of ``schema`` by name.  Components are dealt to buckets by hash of their root, fewer to each
    where a kernel gives some ``per_edge`` values for an edge.
    """
    extra = extra or []
    buckets = max(1, edges.count() * per_edge // BUCKET_EDGES, nodes.sparkSession.sparkContext.defaultParallelism)
    at = F.pmod(F.xxhash64("root"), F.lit(buckets)).cast("int").alias("bucket")
    n = nodes.select("name", *extra).join(named, "name").select(at, "name", *extra)
    e = edges.join(named, edges["src"] == named["name"]).select(at, "src", "dst")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        cols = {c: left[c].to_pylist() for c in ("name", *extra)}
        adj = Adjacency(cols["name"], zip(right["src"].to_pylist(), right["dst"].to_pylist()))
        return pa.table(kernel(adj, cols), schema=_arrow(schema))

    return n.groupBy("bucket").cogroup(e.groupBy("bucket")).applyInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (part.split() for part in schema.split(","))])
