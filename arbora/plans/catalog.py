"""The registered graph queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.graph import Graph
from arbora.operators import analysis
from arbora.operators.fixpoint import checkpoint
from arbora.plans import derived as d
from arbora.plans.derived import BASKETS, CHAINS, DIVISORS, HIERARCHY, REDUCED, RESULTS, SHORTCUTS, TURNS
from arbora.plans.selection import select

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


# ---- reach ----

_REACH = "r AS (SELECT src AS start, dst AS name, 1 AS hops FROM {e} UNION SELECT r.start, e.dst, r.hops + 1 FROM r JOIN {e} e ON e.src = r.name)"


@query("descendants_of_regions", f"WITH RECURSIVE {HIERARCHY}, s AS (SELECT name AS start, name, 0 AS hops FROM hn WHERE name LIKE 'region:%' UNION ALL SELECT s.start, he.dst, hops + 1 FROM s JOIN he ON he.src = s.name) SELECT start, CAST(count(*) AS BIGINT) AS n, CAST(max(hops) AS INTEGER) AS depth FROM s WHERE hops > 0 GROUP BY start")
def descendants_of_regions(spark, sf):
    g = d.hierarchy(spark, sf)
    regions = g.matching_glob("region:*")
    return g.reached(regions).groupBy("start").agg(F.count("*").alias("n"), F.max("hops").alias("depth"))


@query("ancestors_of_orders", f"WITH {HIERARCHY} SELECT o.dst AS start, CAST(3 AS BIGINT) AS n FROM he o WHERE o.dst LIKE 'order:%'")
def ancestors_of_orders(spark, sf):
    g = d.hierarchy(spark, sf)
    return g.reached(g.matching_glob("order:*"), forward=False).groupBy("start").agg(F.count("*").alias("n"))


@query("closure_divisors", f"WITH {DIVISORS} SELECT src, dst FROM de")
def closure_divisors(spark, sf):
    return d.divisors(spark, sf).transitive_reduction().closure().select("src", "dst")


@query("closure_chains", f"WITH {CHAINS} SELECT a.name AS src, b.name AS dst, CAST(b.lvl - a.lvl AS INTEGER) AS hops FROM ck a JOIN ck b ON a.user_id = b.user_id AND a.lvl < b.lvl")
def closure_chains(spark, sf):
    return d.chains(spark, sf).closure().select("src", "dst", F.col("hops_max").alias("hops"))


@query("closure_doubling_divisors", f"WITH RECURSIVE {DIVISORS}, h AS (SELECT src, dst, 1 AS hops FROM de UNION SELECT h.src, de.dst, hops + 1 FROM h JOIN de ON de.src = h.dst) SELECT src, dst, CAST(min(hops) AS INTEGER) AS hops_min, CAST(max(hops) AS INTEGER) AS hops_max FROM h GROUP BY src, dst")
def closure_doubling_divisors(spark, sf):
    g = d.divisors(spark, sf)
    g.strategy = "rounds"
    return g.closure()


@query("reachability_index_divisors", f"WITH {DIVISORS} SELECT name, CAST(1 + (SELECT count(*) FROM de WHERE src = dn.name) AS BIGINT) AS reach FROM dn")
def reachability_index_divisors(spark, sf):
    return d.divisors(spark, sf).reachability_index().sizes().select("name", (F.col("n") + 1).alias("reach"))


@query("dirty_set_errors", f"WITH {CHAINS}, f AS (SELECT ck.user_id, min(ck.lvl) AS lvl FROM ck JOIN events e ON ck.name = 'event:' || e.event_id WHERE e.event_type = 'error' GROUP BY ck.user_id) SELECT name FROM ck JOIN f USING (user_id) WHERE ck.lvl >= f.lvl")
def dirty_set_errors(spark, sf):
    g = d.chains(spark, sf)
    return g.dirty_set(d.event_results(spark, sf).where("status = 'failed'"))


@query("dirty_set_nations", f"WITH {HIERARCHY} SELECT name FROM hn WHERE name LIKE 'nation:%' OR name LIKE 'customer:%' OR name LIKE 'supplier:%' OR name LIKE 'order:%'")
def dirty_set_nations(spark, sf):
    g = d.hierarchy(spark, sf)
    return g.dirty_set(g.matching_glob("nation:*"))


@query("change_provenance", f"WITH {DIVISORS}, c AS (SELECT name FROM dn) SELECT name, list_aggregate(list_sort(list(changed)), 'string_agg', ',') AS changed FROM (SELECT dst AS name, src AS changed FROM de UNION ALL SELECT name, name FROM c) GROUP BY name")
def change_provenance(spark, sf):
    g = d.divisors(spark, sf)
    p = g.change_provenance(g.nodes.select("name"))
    return p.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("changed")), ",").alias("changed"))


# ---- looking at nodes ----


@query("roots", f"WITH {HIERARCHY} SELECT name FROM hn WHERE name LIKE 'region:%'")
def roots(spark, sf):
    return d.hierarchy(spark, sf).roots()


@query("leaves", f"WITH {HIERARCHY} SELECT name FROM hn WHERE name NOT IN (SELECT src FROM he)")
def leaves(spark, sf):
    return d.hierarchy(spark, sf).leaves()


@query("degrees", f"WITH {HIERARCHY} SELECT name, CAST((SELECT count(*) FROM he WHERE dst = name) AS BIGINT) AS in_degree, CAST((SELECT count(*) FROM he WHERE src = name) AS BIGINT) AS out_degree FROM hn")
def degrees(spark, sf):
    return d.hierarchy(spark, sf).degrees().select("name", F.col("in_degree").cast("long").alias("in_degree"), F.col("out_degree").cast("long").alias("out_degree"))


@query("parallel_edge_degrees", f"WITH {BASKETS} SELECT name, CAST((SELECT count(*) FROM be WHERE dst = name) AS BIGINT) AS in_degree, CAST((SELECT count(*) FROM be WHERE src = name) AS BIGINT) AS out_degree FROM bn")
def parallel_edge_degrees(spark, sf):
    return d.baskets(spark, sf).degrees().select("name", F.col("in_degree").cast("long").alias("in_degree"), F.col("out_degree").cast("long").alias("out_degree"))


@query("predecessors_of_each", f"WITH {DIVISORS} SELECT dst AS name, CAST(count(*) AS BIGINT) AS n, string_agg(src, ',' ORDER BY src) AS names FROM de GROUP BY dst")
def predecessors_of_each(spark, sf):
    g = d.divisors(spark, sf)
    up = g.neighbours(g.nodes, forward=False)
    return up.groupBy("name").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("neighbour")), ",").alias("names"))


@query("matching_glob", f"WITH {HIERARCHY} SELECT name FROM hn WHERE name LIKE 'customer:_0%'")
def matching_glob(spark, sf):
    return d.hierarchy(spark, sf).matching_glob("customer:?0*")


@query("matching_regex", f"WITH {HIERARCHY} SELECT name FROM hn WHERE regexp_matches(name, '(nation|supplier):[0-9]*7$')")
def matching_regex(spark, sf):
    return d.hierarchy(spark, sf).matching_regex("(nation|supplier):[0-9]*7$")


@query("effects_of", "SELECT 'event:' || event_id AS name, CASE event_type WHEN 'click' THEN 'network' WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'write' ELSE 'pure' END AS effect FROM events")
def effects_of(spark, sf):
    ev = d.table(spark, sf, "events")
    tag = F.when(F.col("event_type") == "click", "NETWORK").when(F.col("event_type") == "view", "read").when(F.col("event_type") == "purchase", "Write").when(F.col("event_type") == "error", "bogus")
    nodes = ev.select(d._key("event", "event_id").alias("name"), F.create_map(F.lit("effect"), tag).alias("metadata"))
    return Graph(nodes, d.chains(spark, sf).edges).effects()


@query("counts", f"WITH {BASKETS} SELECT (SELECT CAST(count(*) AS BIGINT) FROM bn) AS nodes, (SELECT CAST(count(*) AS BIGINT) FROM be) AS edges")
def counts(spark, sf):
    g = d.baskets(spark, sf)
    n = g.nodes.agg(F.count("*").alias("nodes"))
    return n.crossJoin(F.broadcast(g.edges.agg(F.count("*").alias("edges"))))


# ---- orders ----


@query("levels_chains", f"WITH {CHAINS} SELECT name, CAST(lvl AS INTEGER) AS level FROM ck")
def levels_chains(spark, sf):
    return d.chains(spark, sf).levels()


@query("levels_hierarchy", f"WITH {HIERARCHY} SELECT name, CAST(CASE split_part(name, ':', 1) WHEN 'region' THEN 0 WHEN 'nation' THEN 1 WHEN 'order' THEN 3 ELSE 2 END AS INTEGER) AS level FROM hn")
def levels_hierarchy(spark, sf):
    g = d.hierarchy(spark, sf)
    g.strategy = "rounds"  # few hops, few large components
    return g.levels()


_DLEVEL = "dl AS (SELECT name, 0 AS lvl FROM dn UNION SELECT de.dst, dl.lvl + 1 FROM dl JOIN de ON de.src = dl.name), dv AS (SELECT name, max(lvl) AS lvl FROM dl GROUP BY name)"


@query("levels_divisors", f"WITH RECURSIVE {DIVISORS}, {_DLEVEL} SELECT name, CAST(lvl AS INTEGER) AS level FROM dv")
def levels_divisors(spark, sf):
    return d.divisors(spark, sf).levels()


@query("topological_rank", f"WITH {TURNS}, r AS (SELECT name, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS lvl, first_value(name) OVER (PARTITION BY conv_id ORDER BY turn) AS head FROM tn) SELECT name, CAST(row_number() OVER (ORDER BY lvl, head) - 1 AS INTEGER) AS rank FROM r")
def topological_rank(spark, sf):
    return d.turns(spark, sf).topological_rank()


#: FIFO order: by level, within it by the last predecessor's rank, then by name; one step of the query per level.
_KAHN = "q0 AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS rank FROM dv WHERE lvl = 0)" + "".join(
    f", u{k} AS (SELECT dv.name, max(q{k - 1}.rank) AS up FROM dv JOIN de ON de.dst = dv.name JOIN q{k - 1} ON q{k - 1}.name = de.src WHERE dv.lvl = {k} GROUP BY dv.name)"
    f", q{k} AS (SELECT * FROM q{k - 1} UNION ALL SELECT name, (SELECT count(*) FROM q{k - 1}) + row_number() OVER (ORDER BY up, name) - 1 FROM u{k})"
    for k in range(1, 12)
)


@query("topological_rank_divisors", f"WITH RECURSIVE {DIVISORS}, {_DLEVEL}, {_KAHN} SELECT CAST(rank AS INTEGER) AS rank, name FROM q11")
def topological_rank_divisors(spark, sf):
    return d.divisors(spark, sf).topological_rank()


@query("topological_rank_dfs", f"WITH {TURNS}, h AS (SELECT conv_id, 'turn:' || conv_id || '/' || min(turn) AS first FROM tt GROUP BY conv_id) SELECT name, CAST(row_number() OVER (ORDER BY first DESC, turn) - 1 AS INTEGER) AS rank FROM tn JOIN h USING (conv_id)")
def topological_rank_dfs(spark, sf):
    return d.turns(spark, sf).topological_rank_dfs()


@query("topological_rank_priority", f"WITH RECURSIVE {DIVISORS}, u AS (SELECT dn.name, dn.k, list(de.src) FILTER (de.src IS NOT NULL) AS ups FROM dn LEFT JOIN de ON de.dst = dn.name GROUP BY ALL), w AS (SELECT -1 AS rank, CAST([] AS VARCHAR[]) AS done UNION ALL SELECT rank + 1, list_append(done, (SELECT u.name FROM u WHERE NOT list_contains(done, u.name) AND (u.ups IS NULL OR list_has_all(done, u.ups)) ORDER BY u.k DESC, u.name LIMIT 1)) FROM w WHERE rank + 1 < (SELECT count(*) FROM dn)) SELECT CAST(rank AS INTEGER) AS rank, done[-1] AS name FROM w WHERE rank >= 0")
def topological_rank_priority(spark, sf):
    g = d.divisors(spark, sf)
    return g.topological_rank_priority(g.nodes.select("name", F.substring("name", 2, 3).cast("double").alias("priority")))


@query("levels_priority", f"WITH RECURSIVE {DIVISORS}, {_DLEVEL} SELECT dv.name, CAST(lvl AS INTEGER) AS level, CAST(row_number() OVER (PARTITION BY lvl ORDER BY k DESC, dv.name) AS INTEGER) AS place FROM dv JOIN dn ON dn.name = dv.name")
def levels_priority(spark, sf):
    g = d.divisors(spark, sf)
    return g.levels_priority(g.nodes.select("name", F.substring("name", 2, 3).cast("double").alias("priority")))


# ---- paths ----


@query("all_paths", f"WITH RECURSIVE {DIVISORS}, w AS (SELECT 's001' AS cur, 's001' AS path UNION ALL SELECT de.dst, path || '>' || de.dst FROM w JOIN de ON de.src = w.cur) SELECT path FROM w WHERE cur = 's048'")
def all_paths(spark, sf):
    return d.divisors(spark, sf).all_paths("s001", "s048").select(F.array_join("path", ">").alias("path"))


@query("shortest_path", f"WITH RECURSIVE {DIVISORS}, {REDUCED}, w AS (SELECT 's001' AS cur, 's001' AS path, 0 AS hops UNION ALL SELECT dr.dst, path || '>' || dr.dst, hops + 1 FROM w JOIN dr ON dr.src = w.cur) SELECT path, CAST(hops AS INTEGER) AS hops FROM w WHERE cur = 's048' ORDER BY hops, path LIMIT 1")
def shortest_path(spark, sf):
    return d.divisors(spark, sf).transitive_reduction().shortest_path("s001", "s048").select(F.array_join("path", ">").alias("path"), "hops")


@query("longest_path", f"WITH RECURSIVE {DIVISORS}, w AS (SELECT 's001' AS cur, 's001' AS path, 1 AS cost UNION ALL SELECT de.dst, path || '>' || de.dst, cost + b FROM w JOIN de ON de.src = w.cur) SELECT path, CAST(cost AS DOUBLE) AS cost FROM w WHERE cur = 's048' ORDER BY cost DESC, path LIMIT 1")
def longest_path(spark, sf):
    g = d.divisors(spark, sf)
    return g.longest_path("s001", "s048", g.nodes.select("name", F.substring("name", 2, 3).cast("double").alias("cost"))).select(F.array_join("path", ">").alias("path"), "cost")


# ---- transforms ----


@query("reduction_divisors", f"WITH {DIVISORS}, {REDUCED} SELECT src, dst FROM dr")
def reduction_divisors(spark, sf):
    return d.divisors(spark, sf).transitive_reduction().edges.select("src", "dst")


@query("transitive_closure_graph", f"WITH {DIVISORS} SELECT src, dst, CAST(1 AS DOUBLE) AS weight FROM de")
def transitive_closure_graph(spark, sf):
    return d.divisors(spark, sf).transitive_reduction().transitive_closure().edges.select("src", "dst", "weight")


@query("reverse", f"WITH {BASKETS} SELECT dst AS src, CAST(count(*) AS BIGINT) AS n, CAST(sum(weight) AS BIGINT) AS weight FROM be GROUP BY dst")
def reverse(spark, sf):
    return d.baskets(spark, sf).reverse().edges.groupBy("src").agg(F.count("*").alias("n"), F.sum("weight").cast("long").alias("weight"))


@query("subgraph_filter", f"WITH {HIERARCHY} SELECT src, dst FROM he WHERE src NOT LIKE 'region:%' AND dst NOT LIKE 'supplier:%'")
def subgraph_filter(spark, sf):
    return d.hierarchy(spark, sf).filter("name not like 'region:%' and name not like 'supplier:%'").edges.select("src", "dst")


@query("subgraph_depth2", f"WITH {HIERARCHY} SELECT name FROM hn WHERE name = 'region:1' OR name IN (SELECT dst FROM he WHERE src = 'region:1') OR name IN (SELECT b.dst FROM he a JOIN he b ON a.dst = b.src WHERE a.src = 'region:1')")
def subgraph_depth2(spark, sf):
    return d.hierarchy(spark, sf).subgraph_by_depth("region:1", 2).nodes.select("name")


@query("collapse", f"WITH {HIERARCHY}, m AS (SELECT CASE WHEN src LIKE 'region:%' THEN 'world' ELSE src END AS src, CASE WHEN dst LIKE 'region:%' THEN 'world' ELSE dst END AS dst FROM he) SELECT DISTINCT src, dst FROM m WHERE src <> dst")
def collapse(spark, sf):
    g = d.hierarchy(spark, sf)
    return g.collapse([f"region:{k}" for k in range(5)], "world").edges.select("src", "dst")


@query("dominators", f"WITH RECURSIVE {DIVISORS}, {REDUCED}, av AS (SELECT x.name AS cut, 's001' AS name FROM dn x WHERE x.name <> 's001' UNION SELECT av.cut, dr.dst FROM av JOIN dr ON dr.src = av.name AND dr.dst <> av.cut), dm AS (SELECT x.name AS dom, y.name FROM dn x, dn y WHERE x.name <> 's001' AND x.name <> y.name AND y.name <> 's001' AND NOT EXISTS (SELECT 1 FROM av WHERE av.cut = x.name AND av.name = y.name)), nd AS (SELECT name, count(*) AS n FROM dm GROUP BY name) SELECT dn.name, coalesce((SELECT dom FROM dm LEFT JOIN nd ON nd.name = dm.dom WHERE dm.name = dn.name ORDER BY coalesce(nd.n, 0) DESC LIMIT 1), 's001') AS idom FROM dn")
def dominators(spark, sf):
    return d.divisors(spark, sf).transitive_reduction().dominator_tree("s001")


@query("merge_keep_second", f"WITH {HIERARCHY}, {TURNS}, a AS (SELECT name, 'first' AS payload FROM hn WHERE name NOT LIKE 'order:%'), b AS (SELECT name, 'second' AS payload FROM hn WHERE name LIKE 'nation:%' UNION ALL SELECT name, 'second' FROM tn) SELECT coalesce(b.name, a.name) AS name, coalesce(b.payload, a.payload) AS payload FROM a FULL OUTER JOIN b ON a.name = b.name")
def merge_keep_second(spark, sf):
    h, t = d.hierarchy(spark, sf), d.turns(spark, sf)
    a = Graph(h.nodes.where("name not like 'order:%'").withColumn("payload", F.lit("first")), h.edges.where("dst not like 'order:%'"))
    b = Graph(h.nodes.where("name like 'nation:%'").unionByName(t.nodes).withColumn("payload", F.lit("second")), t.edges)
    return a.merge(b, "keep_second").nodes.select("name", "payload")


@query("diff", f"WITH {DIVISORS}, {REDUCED} SELECT 'edge' AS kind, 'removed' AS change, src, dst FROM de WHERE (src, dst) NOT IN (SELECT src, dst FROM dr) UNION ALL SELECT 'node', 'added', 'extra', NULL UNION ALL SELECT 'edge', 'changed', src, dst FROM dr WHERE src = 's001'")
def diff(spark, sf):
    g = d.divisors(spark, sf)
    h = g.transitive_reduction()
    e = h.edges.withColumn("weight", F.when(F.col("src") == "s001", 2.0).otherwise(F.col("weight")))
    h = Graph(h.nodes, e).add_nodes(spark.range(1).select(F.lit("extra").alias("name")))
    return analysis.diff(g, h)


@query("compose", f"WITH {DIVISORS}, {TURNS} SELECT 'num/' || src AS src, 'num/' || dst AS dst FROM de UNION ALL SELECT 'talk/' || src, 'talk/' || dst FROM te UNION ALL SELECT 'num/s001', 'talk/turn:0/0'")
def compose(spark, sf):
    g = analysis.compose({"num": d.divisors(spark, sf), "talk": d.turns(spark, sf)}, [("num/s001", "talk/turn:0/0")])
    return g.edges.select("src", "dst")


# ---- weights and plans ----

_BOTTOM = "bl AS (SELECT name, k AS v FROM dn UNION SELECT de.src, bl.v + de.a FROM bl JOIN de ON de.dst = bl.name), bv AS (SELECT name, max(v) AS v FROM bl GROUP BY name)"

_UNIT_BOTTOM = "ul AS (SELECT name, 1 AS v FROM dn UNION SELECT de.src, ul.v + 1 FROM ul JOIN de ON de.dst = ul.name), uv AS (SELECT name, max(v) AS v FROM ul GROUP BY name)"


def _sizes(g: Graph) -> DataFrame:
    return g.nodes.select("name", F.substring("name", 2, 3).cast("double").alias("cost"))


@query("bottom_levels", f"WITH RECURSIVE {DIVISORS}, {_BOTTOM} SELECT name, CAST(v AS DOUBLE) AS bottom_level FROM bv")
def bottom_levels(spark, sf):
    g = d.divisors(spark, sf)
    return g.bottom_levels(_sizes(g))


@query("bottom_levels_rounds", f"WITH RECURSIVE {DIVISORS}, {_BOTTOM} SELECT name, CAST(v AS DOUBLE) AS bottom_level FROM bv")
def bottom_levels_rounds(spark, sf):
    g = d.divisors(spark, sf)
    g.strategy = "rounds"
    return g.bottom_levels(_sizes(g))


@query("critical_path", f"WITH RECURSIVE {DIVISORS}, {_BOTTOM}, cp AS (SELECT * FROM (SELECT 0 AS place, name, v FROM bv ORDER BY v DESC, name LIMIT 1) UNION ALL SELECT place + 1, n.name, n.v FROM cp, LATERAL (SELECT bv.name, bv.v FROM de JOIN bv ON bv.name = de.dst WHERE de.src = cp.name ORDER BY bv.v DESC, bv.name LIMIT 1) n) SELECT CAST(place AS INTEGER) AS place, name, CAST(v AS DOUBLE) AS bottom_level FROM cp")
def critical_path(spark, sf):
    g = d.divisors(spark, sf)
    return g.critical_path(_sizes(g))


@query("execution_plan", f"WITH RECURSIVE {DIVISORS}, {_DLEVEL}, m AS (SELECT lvl, max(k) AS longest FROM dv JOIN dn USING (name) GROUP BY lvl), st AS (SELECT lvl, coalesce(sum(longest) OVER (ORDER BY lvl ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_time FROM m) SELECT CAST(lvl AS INTEGER) AS step_index, name, CAST(start_time AS DOUBLE) AS start_time, CAST(k AS DOUBLE) AS duration FROM dv JOIN dn USING (name) JOIN st USING (lvl)")
def execution_plan(spark, sf):
    g = d.divisors(spark, sf)
    return g.execution_plan(_sizes(g))


@query("execution_plan_constrained")
def execution_plan_constrained(spark, sf):
    g = d.divisors(spark, sf)
    return g.execution_plan_constrained(4, _sizes(g))


@query("partition_level_based", f"WITH {CHAINS}, m AS (SELECT max(lvl) + 1 AS depth FROM ck) SELECT name, CAST(least(3, floor(lvl / ceil(depth / 4.0))) AS INTEGER) AS partition_id FROM ck, m")
def partition_level_based(spark, sf):
    return d.chains(spark, sf).partition_levels(4)


@query("partition_balanced", f"WITH RECURSIVE {DIVISORS}, {_DLEVEL}, o AS (SELECT name, row_number() OVER (ORDER BY lvl, name) - 1 AS pos, count(*) OVER () AS n FROM dv) SELECT name, CAST(least(3, floor(pos / ceil(n / 4.0))) AS INTEGER) AS partition_id FROM o")
def partition_balanced(spark, sf):
    return d.divisors(spark, sf).partition_balanced(4)


@query("partition_low_cut")
def partition_low_cut(spark, sf):
    return d.divisors(spark, sf).partition_low_cut(3)


@query("cross_edges", f"WITH RECURSIVE {DIVISORS}, {_DLEVEL}, m AS (SELECT max(lvl) + 1 AS n FROM dv), p AS (SELECT name, least(2, floor(lvl / ceil(n / 3.0))) AS q FROM dv, m) SELECT CAST(a.q AS INTEGER) AS src_part, CAST(b.q AS INTEGER) AS dst_part, CAST(count(*) AS BIGINT) AS n FROM de JOIN p a ON a.name = src JOIN p b ON b.name = dst WHERE a.q <> b.q GROUP BY ALL")
def cross_edges(spark, sf):
    g = d.divisors(spark, sf)
    return g.cross_edges(g.partition_levels(3))


@query("partition_stats", f"WITH RECURSIVE {DIVISORS}, {_DLEVEL}, m AS (SELECT max(lvl) + 1 AS n FROM dv), p AS (SELECT name, CAST(least(2, floor(lvl / ceil(n / 3.0))) AS INTEGER) AS q FROM dv, m), x AS (SELECT a.q AS s, b.q AS t FROM de JOIN p a ON a.name = src JOIN p b ON b.name = dst WHERE a.q <> b.q) SELECT q AS partition_id, CAST(count(*) AS BIGINT) AS nodes, count(*)::DOUBLE AS total_cost, CAST((SELECT count(*) FROM x WHERE t = q) AS BIGINT) AS incoming, CAST((SELECT count(*) FROM x WHERE s = q) AS BIGINT) AS outgoing FROM p GROUP BY q")
def partition_stats(spark, sf):
    g = d.divisors(spark, sf)
    p = g.partition_stats(g.partition_levels(3))
    return p.withColumns({"incoming": F.col("incoming").cast("long"), "outgoing": F.col("outgoing").cast("long")})


@query("partition_order", f"WITH RECURSIVE {CHAINS}, m AS (SELECT max(lvl) + 1 AS depth FROM ck), p AS (SELECT name, CAST(least(3, floor(lvl / ceil(depth / 4.0))) AS INTEGER) AS q FROM ck, m), pe AS (SELECT DISTINCT a.q AS s, b.q AS t FROM ce JOIN p a ON a.name = src JOIN p b ON b.name = dst WHERE a.q <> b.q), l AS (SELECT DISTINCT q, 0 AS lev FROM p UNION SELECT pe.t, l.lev + 1 FROM l JOIN pe ON pe.s = l.q) SELECT q AS partition_id, CAST(max(lev) AS INTEGER) AS level FROM l GROUP BY q")
def partition_order(spark, sf):
    g = d.chains(spark, sf)
    return g.partition_order(g.partition_levels(4))


@query("weak_components", f"WITH {CHAINS} SELECT name, min(name) OVER (PARTITION BY user_id) AS component FROM ck")
def weak_components(spark, sf):
    return d.chains(spark, sf).weak_components()


@query("graph_stats", f"WITH {CHAINS}, n AS (SELECT count(*) AS n, max(lvl) + 1 AS depth, count(DISTINCT user_id) AS c FROM ck), w AS (SELECT max(x) AS width FROM (SELECT count(*) AS x FROM ck GROUP BY lvl)) SELECT CAST(n AS BIGINT) AS node_count, CAST(n - c AS BIGINT) AS edge_count, CAST(depth AS BIGINT) AS depth, CAST(width AS BIGINT) AS width, (n - c)::DOUBLE / (n * (n - 1)) AS density, CAST(depth - 1 AS BIGINT) AS longest_path_length, (n - c)::DOUBLE / n AS avg_in_degree, CAST(1 AS BIGINT) AS max_in_degree, (n - c)::DOUBLE / n AS avg_out_degree, CAST(1 AS BIGINT) AS max_out_degree, CAST(c AS BIGINT) AS root_count, CAST(c AS BIGINT) AS leaf_count, c <= 1 AS is_weakly_connected, CAST(c AS BIGINT) AS component_count FROM n, w")
def graph_stats(spark, sf):
    s = analysis.stats(d.chains(spark, sf))
    whole = ["edge_count", "depth", "width", "longest_path_length", "max_in_degree", "max_out_degree"]
    return s.withColumns({c: F.col(c).cast("long") for c in whole})


# ---- runs ----


@query("lineage", f"WITH {CHAINS}, {RESULTS} SELECT a.name, coalesce(CAST(max(CASE WHEN b.status = 'completed' THEN a.lvl - b.lvl END) AS INTEGER), 0) AS depth, CAST(count(CASE WHEN b.status = 'completed' THEN 1 END) AS BIGINT) AS n FROM (SELECT ck.*, rs.status FROM ck JOIN rs USING (name)) a LEFT JOIN (SELECT ck.*, rs.status FROM ck JOIN rs USING (name)) b ON a.user_id = b.user_id AND b.lvl < a.lvl GROUP BY a.name")
def lineage(spark, sf):
    g, r = d.chains(spark, sf), d.event_results(spark, sf)
    return analysis.lineage(g, r, g.nodes).select("name", "depth", F.size("ancestors").cast("long").alias("n"))


@query("impact", f"WITH {HIERARCHY} SELECT a.name, CAST((SELECT count(*) FROM he JOIN he h2 ON he.dst = h2.src WHERE he.src = a.name) + (SELECT count(*) FROM he WHERE src = a.name) AS BIGINT) AS affected, CAST((SELECT count(*) FROM he WHERE src = a.name AND dst NOT IN (SELECT src FROM he)) + (SELECT count(*) FROM he JOIN he h2 ON he.dst = h2.src WHERE he.src = a.name) AS BIGINT) AS affected_leaves FROM hn a WHERE a.name LIKE 'nation:%'")
def impact(spark, sf):
    g = d.hierarchy(spark, sf)
    done = g.nodes.select("name", F.lit("completed").alias("status"))
    return analysis.impact(g, done, g.matching_glob("nation:*"))


@query("broken_lineage", f"WITH {CHAINS}, {RESULTS} SELECT src, dst FROM ce JOIN rs a ON a.name = src JOIN rs b ON b.name = dst WHERE a.status <> 'completed' AND b.status = 'completed'")
def broken_lineage(spark, sf):
    return analysis.broken_lineage(d.chains(spark, sf), d.event_results(spark, sf))


@query("data_flow_path", f"WITH RECURSIVE {DIVISORS}, {REDUCED}, w AS (SELECT 's001' AS cur, 's001' AS path, 0 AS hops UNION ALL SELECT dr.dst, path || '>' || dr.dst, hops + 1 FROM w JOIN dr ON dr.src = w.cur WHERE dr.dst <> 's002') SELECT path, CAST(hops AS INTEGER) AS hops FROM w WHERE cur = 's048' ORDER BY hops, path LIMIT 1")
def data_flow_path(spark, sf):
    g = d.divisors(spark, sf).transitive_reduction()
    done = g.nodes.select("name", F.when(F.col("name") == "s002", "failed").otherwise("completed").alias("status"))
    return analysis.data_flow_path(g, done, "s001", "s048").select(F.array_join("path", ">").alias("path"), "hops")


@query("profile", f"WITH {CHAINS}, {RESULTS}, done AS (SELECT ck.name, user_id, lvl, duration_seconds AS c FROM ck JOIN rs USING (name) WHERE status = 'completed'), seg AS (SELECT *, lvl - row_number() OVER (PARTITION BY user_id ORDER BY lvl) AS s FROM done), t AS (SELECT *, sum(c) OVER (PARTITION BY user_id, s ORDER BY lvl) - c AS es, sum(c) OVER (PARTITION BY user_id, s ORDER BY lvl DESC) AS tail FROM seg), w AS (SELECT max(tail) AS m FROM t) SELECT name, c AS duration, es AS earliest_start, m - tail AS latest_start, m - tail - es AS slack, m - tail - es <= 0 AS critical FROM t, w")
def profile(spark, sf):
    return analysis.profile(d.chains(spark, sf), d.event_results(spark, sf))


@query("profile_summary", f"WITH {CHAINS}, {RESULTS}, done AS (SELECT ck.name, user_id, lvl, duration_seconds AS c FROM ck JOIN rs USING (name) WHERE status = 'completed'), seg AS (SELECT *, lvl - row_number() OVER (PARTITION BY user_id ORDER BY lvl) AS s FROM done), t AS (SELECT c, sum(c) OVER (PARTITION BY user_id, s ORDER BY lvl) - c AS es FROM seg), e AS (SELECT es AS z, 1 AS x FROM t WHERE c > 0 UNION ALL SELECT es + c, -1 FROM t WHERE c > 0), b AS (SELECT z, sum(sum(x)) OVER (ORDER BY z) AS n FROM e GROUP BY z) SELECT sum(c) AS total, max(es + c) AS makespan, sum(c) / max(es + c) AS efficiency, CAST((SELECT max(n) FROM b) AS BIGINT) AS max_parallelism FROM t")
def profile_summary(spark, sf):
    return analysis.profile_summary(d.chains(spark, sf), d.event_results(spark, sf))


@query("bottlenecks", f"WITH {CHAINS}, {RESULTS} SELECT name, duration_seconds AS duration, CAST(n - 1 - lvl AS BIGINT) AS descendants, duration_seconds * (n - lvl) AS impact FROM ck JOIN rs USING (name) WHERE status = 'completed' ORDER BY impact DESC, name LIMIT 5")
def bottlenecks(spark, sf):
    return analysis.bottlenecks(d.chains(spark, sf), d.event_results(spark, sf))


@query("peak_utilization", "SELECT event_type AS resource, max(CAST(floor(abs(value)) AS INTEGER)) AS peak FROM events GROUP BY event_type")
def peak_utilization(spark, sf):
    ev = d.table(spark, sf, "events")
    return analysis.peak_utilization(ev.select(F.create_map(F.col("event_type"), F.floor(F.abs("value")).cast("int")).alias("allocated")))


@query("hit_rate", "SELECT CAST(count(*) FILTER (event_type = 'view') AS BIGINT) AS hits, CAST(count(*) FILTER (event_type <> 'view') AS BIGINT) AS misses, count(*) FILTER (event_type = 'view')::DOUBLE / count(*) AS hit_rate FROM events")
def hit_rate(spark, sf):
    return analysis.hit_rate(d.table(spark, sf, "events").select((F.col("event_type") == "view").alias("hit")))


@query("explain", f"WITH RECURSIVE {DIVISORS}, {_DLEVEL}, x AS (SELECT dn.name, lvl, (SELECT count(*) FROM de WHERE dst = dn.name) AS i, (SELECT count(*) FROM de WHERE src = dn.name) AS o, count(*) OVER () AS n FROM dn JOIN dv USING (name)) SELECT name, CAST(lvl AS INTEGER) AS depth, CAST(i AS BIGINT) AS ancestors, CAST(o AS BIGINT) AS descendants, i = 0 AS is_root, o = 0 AS is_leaf FROM x")
def explain(spark, sf):
    e = analysis.explain(d.divisors(spark, sf))
    return e.select("name", "depth", F.col("ancestors").cast("long").alias("ancestors"), F.col("descendants").cast("long").alias("descendants"), "is_root", "is_leaf")


@query("lint", f"WITH {HIERARCHY}, o AS (SELECT src, count(*) AS n FROM he GROUP BY src HAVING count(*) > 10), c AS (SELECT count(*) AS n FROM hn WHERE name LIKE 'region:%') SELECT 'HIGH_FAN_OUT' AS code, 'warning' AS severity, src AS subject, CAST(n AS BIGINT) AS value FROM o UNION ALL SELECT 'DISCONNECTED', 'info', NULL, CAST(n AS BIGINT) FROM c WHERE n > 1 UNION ALL SELECT 'ISOLATED_NODES', 'info', name, 0 FROM hn WHERE name NOT IN (SELECT src FROM he) AND name NOT IN (SELECT dst FROM he)")
def lint(spark, sf):
    return analysis.lint(d.hierarchy(spark, sf))


@query("graph_rules", f"WITH {HIERARCHY} SELECT 'single_root' AS rule, CAST(count(*) AS VARCHAR) AS detail FROM hn WHERE name LIKE 'region:%' UNION ALL SELECT 'max_depth', '4' UNION ALL SELECT 'leaf_pattern', name FROM hn WHERE name NOT IN (SELECT src FROM he) AND name NOT LIKE 'order:%' UNION ALL SELECT 'required', 'region:99'")
def graph_rules(spark, sf):
    rules = analysis.GraphRules(single_root=True, max_depth=3, leaf_pattern="order:*", required=["region:0", "region:99"])
    return rules.validate(d.hierarchy(spark, sf))


@query("what_if", f"WITH {CHAINS}, p AS (SELECT name AS gone FROM ck WHERE lvl = 1), cut AS (SELECT ck.*, lvl AS old, CASE WHEN lvl >= 2 THEN lvl - 2 ELSE lvl END AS lev FROM ck WHERE lvl <> 1), last AS (SELECT user_id, max(n) AS n, max(name) FILTER (lvl = 0) AS first FROM ck GROUP BY user_id), w AS (SELECT (SELECT max(c) FROM (SELECT count(*) AS c FROM cut GROUP BY lev)) - (SELECT max(c) FROM (SELECT count(*) AS c FROM ck GROUP BY lvl)) AS d), top AS (SELECT max(n) AS n FROM ck), tail AS (SELECT name, user_id, lev, n, count(*) FILTER (old >= 2) OVER (PARTITION BY user_id) AS len FROM cut WHERE old >= 2), best AS (SELECT name AS head, user_id FROM tail WHERE lev = 0 AND len = (SELECT max(len) FROM tail) ORDER BY name LIMIT 1) SELECT 'node_count' AS figure, CAST(NULL AS INTEGER) AS place, CAST(NULL AS VARCHAR) AS name, CAST((SELECT count(*) FROM cut) AS BIGINT) AS value UNION ALL SELECT 'edge_count', NULL, NULL, CAST((SELECT count(*) FROM ce WHERE src NOT IN (SELECT gone FROM p) AND dst NOT IN (SELECT gone FROM p)) AS BIGINT) UNION ALL SELECT 'width_delta', NULL, NULL, CAST(d AS BIGINT) FROM w UNION ALL SELECT 'orphaned', NULL, name, NULL FROM cut WHERE old = 2 UNION ALL SELECT 'critical_path', CAST(lev AS INTEGER), name, NULL FROM tail WHERE user_id = (SELECT user_id FROM best)")
def what_if(spark, sf):
    """The second event of every user removed."""
    g = d.chains(spark, sf)
    second = checkpoint(g.levels().where("level = 1").select("name"))
    h = analysis.changed(g, remove_nodes=second)
    return analysis.effects(g, h)


# ---- single nodes, cycles, changes ----


@query("known_nodes", f"WITH {HIERARCHY} SELECT x.name, x.name IN (SELECT name FROM hn) AS known FROM (SELECT 'customer:' || o_orderkey AS name FROM orders) x")
def known_nodes(spark, sf):
    return d.hierarchy(spark, sf).known_nodes(d.table(spark, sf, "orders").select(d._key("customer", "o_orderkey").alias("name")))


@query("known_edges", f"WITH {DIVISORS} SELECT a.name AS src, b.name AS dst, b.k % a.k = 0 AND a.k < b.k AS known FROM dn a JOIN dn b ON b.k = a.k + 2 OR b.k = 2 * a.k")
def known_edges(spark, sf):
    g = d.divisors(spark, sf)
    n = g.nodes.select("name", F.substring("name", 2, 3).cast("int").alias("k"))
    wanted = n.select(F.col("name").alias("src"), F.explode(F.array_distinct(F.array(F.col("k") + 2, F.col("k") * 2))).alias("k"))
    return g.known_edges(wanted.join(n.select("k", F.col("name").alias("dst")), "k"))


@query("node_names", f"WITH {BASKETS} SELECT name FROM bn")
def node_names(spark, sf):
    return d.baskets(spark, sf).node_names()


@query("edge_list", f"WITH {BASKETS} SELECT src, dst, weight FROM be")
def edge_list(spark, sf):
    return d.baskets(spark, sf).edge_list().select("src", "dst", "weight")


@query("payloads_and_metadata", f"WITH {HIERARCHY} SELECT name, CASE WHEN name LIKE 'order:%' THEN 'o' || length(name) END AS payload, CASE WHEN name LIKE 'nation:%' THEN 'nation' END AS kind FROM hn")
def payloads_and_metadata(spark, sf):
    g = d.hierarchy(spark, sf)
    g = g.with_payloads(g.matching_glob("order:*").select("name", F.concat(F.lit("o"), F.length("name").cast("string")).alias("payload")))
    g = g.with_metadata(g.matching_glob("nation:*").select("name", F.create_map(F.lit("kind"), F.lit("nation")).alias("metadata")))
    return g.nodes.select("name", "payload", F.col("metadata")["kind"].alias("kind"))


@query("successors_of_each", f"WITH {HIERARCHY} SELECT src AS name, dst AS neighbour FROM he WHERE src LIKE 'nation:%'")
def successors_of_each(spark, sf):
    g = d.hierarchy(spark, sf)
    return g.neighbours(g.matching_glob("nation:*"))


@query("are_ancestors", f"WITH {DIVISORS} SELECT a.name AS src, b.name AS dst, b.k % a.k = 0 AS reaches FROM dn a JOIN dn b ON b.k > a.k")
def are_ancestors(spark, sf):
    g = d.divisors(spark, sf)
    a, b = g.nodes.select(F.col("name").alias("src")), g.nodes.select(F.col("name").alias("dst"))
    return g.are_ancestors(a.join(b, F.col("src") < F.col("dst")))


@query("creating_cycles", f"WITH {TURNS} SELECT a.name AS src, b.name AS dst FROM tn a JOIN tn b ON a.conv_id = b.conv_id AND b.turn <= a.turn")
def creating_cycles(spark, sf):
    g = d.turns(spark, sf)
    n = g.nodes.select("name", F.substring_index("name", "/", 1).alias("c"))
    return g.creating_cycles(n.alias("a").join(n.alias("b"), "c").select(F.col("a.name").alias("src"), F.col("b.name").alias("dst")))


@query("find_cycles", f"WITH {TURNS} SELECT min(name) AS cycle, list_aggregate(list_sort(list(name)), 'string_agg', ',') AS names FROM tn GROUP BY conv_id HAVING count(*) > 1 AND conv_id % 2 = 0")
def find_cycles(spark, sf):
    t = d.turns(spark, sf)
    first = t.nodes.select("name", F.regexp_extract("name", r"turn:(\d+)/", 1).alias("c"), F.regexp_extract("name", r"/(\d+)$", 1).cast("long").alias("turn"))
    ends = first.where("c % 2 = 0").groupBy("c").agg(F.max_by("name", "turn").alias("src"), F.min_by("name", "turn").alias("dst")).where("src <> dst").select("src", "dst")
    found = t.add_edges(ends, check=False).find_cycles()
    return found.select("cycle", F.array_join("names", ",").alias("names"))


@query("explain_dominates", f"WITH {DIVISORS} SELECT a.name, coalesce(list_aggregate(list_sort(list(b.name) FILTER (b.name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM de x WHERE x.dst = b.name AND x.src <> a.name AND NOT EXISTS (SELECT 1 FROM de y WHERE y.src = x.src AND y.dst = a.name) AND NOT EXISTS (SELECT 1 FROM de y WHERE y.src = a.name AND y.dst = x.src)))), 'string_agg', ','), '') AS dominates FROM dn a LEFT JOIN de e ON e.src = a.name LEFT JOIN dn b ON b.name = e.dst GROUP BY a.name")
def explain_dominates(spark, sf):
    return analysis.explain(d.divisors(spark, sf)).select("name", F.array_join("dominates", ",").alias("dominates"))


@query("all_topological_orders", f"WITH {DIVISORS}, s AS (SELECT name, k FROM dn WHERE k IN (1, 2, 3, 4)), p AS (SELECT a.name AS a, b.name AS b, c.name AS c, d.name AS d FROM s a, s b, s c, s d WHERE a.k = 1 AND b.k <> 1 AND c.k NOT IN (1, b.k) AND d.k NOT IN (1, b.k, c.k) AND NOT (b.k = 4 OR (c.k = 4 AND b.k <> 2))), o AS (SELECT *, row_number() OVER (ORDER BY a, b, c, d) - 1 AS i FROM p) SELECT CAST(i AS INTEGER) AS order_id, CAST(r AS INTEGER) AS rank, name FROM (SELECT i, 0 AS r, a AS name FROM o UNION ALL SELECT i, 1, b FROM o UNION ALL SELECT i, 2, c FROM o UNION ALL SELECT i, 3, d FROM o)")
def all_topological_orders(spark, sf):
    g = d.divisors(spark, sf)
    return g.subgraph(g.nodes.where("name in ('s001', 's002', 's003', 's004')")).all_topological_orders()


@query("merge_keep_first", f"WITH {TURNS} SELECT name, CASE WHEN turn % 2 = 0 THEN 'even' WHEN turn % 3 = 0 THEN 'third' ELSE 'first' END AS payload FROM (SELECT name, turn FROM tn WHERE turn % 2 = 0 OR turn % 3 = 0)")
def merge_keep_first(spark, sf):
    turn = F.regexp_extract("name", r"/(\d+)$", 1).cast("int")
    n = d.turns(spark, sf).nodes.select("name", turn.alias("turn"))
    none = d.turns(spark, sf).edges.limit(0)
    a = Graph(n.where("turn % 2 = 0").select("name", F.lit("even").alias("payload")), none)
    b = Graph(n.where("turn % 3 = 0").select("name", F.lit("third").alias("payload")), none)
    return a.merge(b).nodes.select("name", "payload")


@query("subgraph_backward", f"WITH {HIERARCHY} SELECT 'order:' || o_orderkey AS name FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders) UNION ALL SELECT 'customer:' || o_custkey FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders) UNION ALL SELECT 'nation:' || c_nationkey FROM customer WHERE c_custkey = (SELECT o_custkey FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders))")
def subgraph_backward(spark, sf):
    first = d.table(spark, sf, "orders").agg(F.min("o_orderkey")).first()[0]
    return d.hierarchy(spark, sf).subgraph_by_depth(f"order:{first}", 2, "backward").nodes.select("name")


@query("extract_partition", f"WITH {CHAINS}, m AS (SELECT max(lvl) + 1 AS depth FROM ck), p AS (SELECT name, least(3, floor(lvl / ceil(depth / 4.0))) AS q FROM ck, m) SELECT src, dst FROM ce JOIN p a ON a.name = src JOIN p b ON b.name = dst WHERE a.q = 1 AND b.q = 1")
def extract_partition(spark, sf):
    g = d.chains(spark, sf)
    return g.extract_partition(g.partition_levels(4), 1).edges.select("src", "dst")


@query("changed_graph", f"WITH {HIERARCHY} SELECT src, dst FROM he WHERE src <> 'nation:1' AND dst <> 'nation:1' AND NOT (src = 'region:0' AND dst IN (SELECT 'nation:' || min(n_nationkey) FROM nation WHERE n_regionkey = 0)) UNION ALL SELECT 'region:0', 'extra'")
def changed_graph(spark, sf):
    g = d.hierarchy(spark, sf)
    least = d.table(spark, sf, "nation").where("n_regionkey = 0").agg(F.min("n_nationkey")).first()[0]
    g = g.remove_edge("region:0", f"nation:{least}").remove_nodes(spark.createDataFrame([("nation:1",)], "name string"))
    g = g.add_nodes(spark.createDataFrame([("extra",)], "name string")).add_edges(spark.createDataFrame([("region:0", "extra")], "src string, dst string"))
    return g.snapshot().edges.select("src", "dst")


@query("chrome_trace", "SELECT 'user:' || user_id AS name, CASE event_type WHEN 'view' THEN 'B' ELSE 'E' END AS ph, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type IN ('view', 'purchase', 'error') GROUP BY ALL")
def chrome_trace(spark, sf):
    from arbora.streaming.replay import chrome_trace as lines

    ev = d.table(spark, sf, "events").where("event_type in ('view', 'purchase', 'error')")
    kind = F.when(F.col("event_type") == "view", "node_started").when(F.col("event_type") == "purchase", "node_completed").otherwise("node_failed")
    made = lines(ev.select(kind.alias("event_type"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"), d._key("user", "user_id").alias("node_name")))
    return made.select(F.from_json("line", "name string, ph string").alias("x")).groupBy("x.name", "x.ph").agg(F.count("*").alias("n"))


# ---- large graphs: work that grows with the tables ----


@query("can_reach_chains", f"WITH {CHAINS} SELECT a.name AS src, b.name AS dst, a.user_id = b.user_id AND a.lvl < b.lvl AS reaches FROM ck a, (VALUES (1), (150), (-7)) s(k), ck b WHERE b.name = 'event:' || (split_part(a.name, ':', 2)::BIGINT + k)")
def can_reach_chains(spark, sf):
    g = d.chains(spark, sf)
    at = d.table(spark, sf, "events").select("event_id", F.explode(F.array(F.lit(1), F.lit(150), F.lit(-7))).alias("k"))
    pairs = at.select(d._key("event", "event_id").alias("src"), F.concat(F.lit("event:"), (F.col("event_id") + F.col("k")).cast("string")).alias("dst"))
    return g.can_reach(pairs.join(g.nodes.select(F.col("name").alias("dst")), "dst", "left_semi"))


@query("reachable_from_world", f"WITH {HIERARCHY}, o AS (SELECT c_nationkey AS k, count(DISTINCT c_custkey) AS c, count(o_orderkey) AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey), s AS (SELECT s_nationkey AS k, count(*) AS s FROM supplier GROUP BY s_nationkey), n AS (SELECT n_nationkey AS k, n_regionkey AS r, coalesce(c, 0) + coalesce(o, 0) + coalesce(s, 0) AS n FROM nation LEFT JOIN o ON o.k = n_nationkey LEFT JOIN s ON s.k = n_nationkey) SELECT 'region:' || r AS start, CAST(sum(n + 1) AS BIGINT) AS n FROM n GROUP BY r UNION ALL SELECT 'nation:' || k, CAST(n AS BIGINT) FROM n WHERE n > 0")
def reachable_from_world(spark, sf):
    """Descendants where suppliers and regions lead to customers too: listed from interval labels."""
    g = d.world_by_groups(spark, sf)
    found = g.reachable_from(g.nodes.where("name like 'region:%' or name like 'nation:%'"))
    return found.where("name not like 'group:%'").groupBy("start").agg(F.count("*").alias("n"))


@query("ancestors_of_world", f"WITH {HIERARCHY}, sc AS (SELECT c_custkey AS c, count(s_suppkey) AS n FROM customer LEFT JOIN supplier ON s_nationkey = c_nationkey AND s_suppkey % 10 = c_custkey % 10 GROUP BY c_custkey) SELECT 'order:' || o_orderkey AS start, CAST(4 + n AS BIGINT) AS n FROM orders JOIN sc ON c = o_custkey WHERE o_orderkey % 3 = 0")
def ancestors_of_world(spark, sf):
    """Counted from interval labels of the reversed graph, without a row for each ancestor."""
    g = d.world_by_groups(spark, sf)
    orders = g.nodes.where("name like 'order:%' and cast(substring(name, 7) as long) % 3 = 0")
    return g.ancestor_counts(orders, g.nodes.where("name not like 'group:%'")).where("n > 0").withColumnRenamed("name", "start")


@query("reach_sizes_chains", f"WITH {CHAINS} SELECT name, CAST(n - 1 - lvl AS BIGINT) AS n FROM ck")
def reach_sizes_chains(spark, sf):
    return d.shortcut_chains(spark, sf).reachability_index().sizes()


@query("reduction_chains", f"WITH {CHAINS} SELECT src, dst FROM ce")
def reduction_chains(spark, sf):
    return d.shortcut_chains(spark, sf).transitive_reduction().edges.select("src", "dst")


@query("dominators_world", "SELECT 'world' AS name, 'world' AS idom UNION ALL SELECT 'region:' || r_regionkey, 'world' FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION ALL SELECT 'customer:' || c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'region:' || n_regionkey ELSE 'nation:' || c_nationkey END FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey FROM orders")
def dominators_world(spark, sf):
    tree = checkpoint(d.world_by_groups(spark, sf).dominator_tree("world"))
    over = tree.where("name like 'group:%'").select(F.col("name").alias("idom"), F.col("idom").alias("over"))
    return tree.where("name not like 'group:%'").join(over, "idom", "left").select("name", F.coalesce("over", "idom").alias("idom"))


@query("bottom_levels_chains", f"WITH {CHAINS}, {RESULTS} SELECT name, sum(duration_seconds + 1) OVER (PARTITION BY user_id ORDER BY lvl DESC) AS bottom_level FROM ck JOIN rs USING (name)")
def bottom_levels_chains(spark, sf):
    g = d.chains(spark, sf)
    g.strategy = "rounds"  # contraction
    return g.bottom_levels(d.event_results(spark, sf).select("name", (F.col("duration_seconds") + 1).alias("cost")))


@query("execution_plan_chains", f"WITH {CHAINS}, {RESULTS}, x AS (SELECT name, lvl, duration_seconds + 1 AS c FROM ck JOIN rs USING (name)), m AS (SELECT lvl, max(c) AS longest FROM x GROUP BY lvl), st AS (SELECT lvl, coalesce(sum(longest) OVER (ORDER BY lvl ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM m) SELECT CAST(lvl AS INTEGER) AS step_index, name, CAST(s AS DOUBLE) AS start_time, c AS duration FROM x JOIN st USING (lvl)")
def execution_plan_chains(spark, sf):
    return d.chains(spark, sf).execution_plan(d.event_results(spark, sf).select("name", (F.col("duration_seconds") + 1).alias("cost")))


_LONGEST = "lg AS (SELECT user_id FROM ck WHERE lvl = 0 AND n = (SELECT max(n) FROM ck) ORDER BY name LIMIT 1)"


@query("critical_path_chains", f"WITH {CHAINS}, {_LONGEST} SELECT CAST(lvl AS INTEGER) AS place, name, CAST(n - lvl AS DOUBLE) AS bottom_level FROM ck WHERE user_id = (SELECT user_id FROM lg)")
def critical_path_chains(spark, sf):
    return d.chains(spark, sf).critical_path()


@query("explain_chains", f"WITH {CHAINS}, {_LONGEST}, t AS (SELECT count(*) AS t FROM ck) SELECT name, CAST(lvl AS INTEGER) AS depth, user_id = (SELECT user_id FROM lg) AS on_critical_path, round((n - 1 - lvl)::DOUBLE / t * CASE WHEN user_id = (SELECT user_id FROM lg) THEN 1.0 ELSE 0.5 END, 2) AS bottleneck, CAST(lvl AS BIGINT) AS ancestors, CAST(n - 1 - lvl AS BIGINT) AS descendants, lvl = 0 AS is_root, lvl = n - 1 AS is_leaf, CAST(n - 1 - lvl AS BIGINT) AS dominated FROM ck, t")
def explain_chains(spark, sf):
    e = analysis.explain(d.chains(spark, sf), listed=False)
    return e.select("name", "depth", "on_critical_path", "bottleneck", "ancestors", "descendants", "is_root", "is_leaf", "dominated")


@query("first_paths_chains", f"WITH RECURSIVE {CHAINS}, {SHORTCUTS}, f AS (SELECT name, lvl FROM ck WHERE user_id = (SELECT min(user_id) FROM ck WHERE n > 12) AND lvl IN (0, 12)), w AS (SELECT [name] AS path, name AS cur FROM f WHERE lvl = 0 UNION ALL SELECT list_append(path, dst), dst FROM w JOIN cs ON src = cur WHERE len(path) < 13) SELECT array_to_string(path, '>') AS path FROM (SELECT path FROM w WHERE cur = (SELECT name FROM f WHERE lvl = 12) ORDER BY path LIMIT 100)")
def first_paths_chains(spark, sf):
    """Of the many ways from a user's first event to the 13th the first hundred, each built from its number."""
    g, ev = d.shortcut_chains(spark, sf), d.table(spark, sf, "events")
    user = ev.groupBy("user_id").agg(F.count("*").alias("n")).where("n > 12").agg(F.min("user_id")).first()[0]
    mine = [r[0] for r in ev.where(F.col("user_id") == user).orderBy("ts", "event_id").limit(13).select(d._key("event", "event_id")).collect()]  # 13 rows
    return g.all_paths(mine[0], mine[12], 100).select(F.array_join("path", ">").alias("path"))


# ---- selection language ----

for _n, (_text, _sql) in {
    "dsl_ancestors_depth": ("ancestors(s048) & depth <= 2", f"WITH RECURSIVE {DIVISORS}, {_DLEVEL} SELECT name FROM dv WHERE lvl <= 2 AND name IN (SELECT src FROM de WHERE dst = 's048')"),
    "dsl_union_leaves": ("roots | leaves", f"WITH {DIVISORS} SELECT name FROM dn WHERE name NOT IN (SELECT src FROM de) OR name NOT IN (SELECT dst FROM de)"),
    "dsl_difference": ("descendants(s002) - descendants(s003)", f"WITH {DIVISORS} SELECT name FROM dn WHERE name IN (SELECT dst FROM de WHERE src = 's002') AND name NOT IN (SELECT dst FROM de WHERE src = 's003')"),
    "dsl_degree": ("in_degree >= 3 & out_degree > 0", f"WITH {DIVISORS} SELECT name FROM dn WHERE (SELECT count(*) FROM de WHERE dst = name) >= 3 AND (SELECT count(*) FROM de WHERE src = name) > 0"),
    "dsl_glob_parentheses": ("(name:s01* | name:s02*) & successors(s002)", f"WITH {DIVISORS} SELECT name FROM dn WHERE (name LIKE 's01%' OR name LIKE 's02%') AND name IN (SELECT dst FROM de WHERE src = 's002')"),
    "dsl_precedence": ("leaves - name:s03* & in_degree > 1", f"WITH {DIVISORS} SELECT name FROM dn WHERE name NOT IN (SELECT src FROM de) AND NOT (name LIKE 's03%' AND (SELECT count(*) FROM de WHERE dst = name) > 1)"),
}.items():
    query(_n, _sql)(lambda spark, sf, text=_text: select(d.divisors(spark, sf), text))


@query("dsl_critical_path", f"WITH RECURSIVE {DIVISORS}, {_UNIT_BOTTOM}, {_DLEVEL}, {_KAHN}, cp AS (SELECT * FROM (SELECT 0 AS place, name, v FROM uv ORDER BY v DESC, name LIMIT 1) UNION ALL SELECT place + 1, n.name, n.v FROM cp, LATERAL (SELECT uv.name, uv.v FROM de JOIN uv ON uv.name = de.dst WHERE de.src = cp.name ORDER BY uv.v DESC, uv.name LIMIT 1) n) SELECT name, CAST(rank AS INTEGER) AS rank FROM cp JOIN q11 USING (name)")
def dsl_critical_path(spark, sf):
    return select(d.divisors(spark, sf), "critical_path", ranked=True)


# ---- sources, logs, quality ----


@query("from_records", "SELECT 'nation:' || n_nationkey AS name, 'region:' || n_regionkey AS dep FROM nation")
def from_records(spark, sf):
    from arbora.sources.records import from_frame

    rows = d.table(spark, sf, "nation").select(d._key("nation", "n_nationkey").alias("name"), F.array(d._key("region", "n_regionkey")).alias("deps"), "n_name")
    regions = d.table(spark, sf, "region").select(d._key("region", "r_regionkey").alias("name"))
    g = from_frame(rows.unionByName(regions, allowMissingColumns=True), deps="deps")
    return g.edges.select(F.col("dst").alias("name"), F.col("src").alias("dep"))


@query("json_round_trip", f"WITH {DIVISORS} SELECT src, dst FROM de")
def json_round_trip(spark, sf):
    from arbora.sources.text import from_json, to_json

    return from_json(spark, to_json(d.divisors(spark, sf))).edges.select("src", "dst")


for _form in ("json", "bytes"):

    @query(f"files_{_form}", f"WITH {HIERARCHY} SELECT name AS src, NULL AS dst FROM hn UNION ALL SELECT src, dst FROM he")
    def _files(spark, sf, form=_form):
        """The hierarchy written in parts in the shared checkpoint folder and read back."""
        import uuid

        from arbora.operators.fixpoint import ensure_checkpoint_dir
        from arbora.sources.files import read_graph, write_graph

        ensure_checkpoint_dir(spark)
        folder = f"{spark.sparkContext.getCheckpointDir()}/graph-{uuid.uuid4().hex}"
        write_graph(d.hierarchy(spark, sf), folder, form)
        g = read_graph(spark, folder)
        return g.nodes.select(F.col("name").alias("src"), F.lit(None).cast("string").alias("dst")).unionByName(g.edges.select("src", "dst"))


@query("to_dot", f"WITH {DIVISORS} SELECT '  \"' || src || '\" -> \"' || dst || '\";' AS line FROM de")
def to_dot(spark, sf):
    from arbora.sources.text import dot_lines

    return dot_lines(d.divisors(spark, sf)).where("kind = 'edge'").select("line")


@query("to_mermaid", f"WITH {DIVISORS} SELECT '    ' || src || ' --> ' || dst AS line FROM de")
def to_mermaid(spark, sf):
    from arbora.sources.text import mermaid_lines

    return mermaid_lines(d.divisors(spark, sf)).where("kind = 'edge'").select("line")


@query("template_render", "SELECT 'load ' || r_name || ' into t' || r_regionkey || ' by {{unknown}}' AS text FROM region")
def template_render(spark, sf):
    from arbora.functions.template import render_column

    r = d.table(spark, sf, "region")
    return r.select(render_column("load {{name}} into t{{key}} by {{unknown}}", {"name": F.col("r_name"), "key": F.col("r_regionkey")}).alias("text"))


@query("replay_at", "WITH l AS (SELECT user_id::VARCHAR AS name, event_type AS value, epoch(ts) AS t, event_id AS seq FROM events), c AS (SELECT min(seq) AS stop FROM l WHERE t > (SELECT avg(t) FROM l)), k AS (SELECT l.* FROM l, c WHERE stop IS NULL OR seq < stop) SELECT name, value FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq DESC) AS n FROM k) WHERE n = 1")
def replay_at(spark, sf):
    from arbora.streaming.replay import replay

    ev = d.table(spark, sf, "events")
    log = ev.select(F.col("user_id").cast("string").alias("name"), F.col("event_type").alias("value"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("seq"))
    at = log.agg(F.avg("t")).first()[0]
    return replay(log, at).select("name", "value")


@query("trace_summary", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def trace_summary(spark, sf):
    from arbora.streaming.replay import summary

    return summary(d.table(spark, sf, "events"))


@query("version_at", "WITH m AS (SELECT event_id AS version, event_type, user_id FROM events), a AS (SELECT user_id::VARCHAR AS name, max(version) FILTER (event_type IN ('view', 'click', 'purchase')) AS added, max(version) FILTER (event_type = 'error') AS gone FROM m WHERE version <= (SELECT max(version) // 2 FROM m) GROUP BY user_id) SELECT name FROM a WHERE added IS NOT NULL AND (gone IS NULL OR added > gone)")
def version_at(spark, sf):
    from arbora.streaming.versions import at_version

    ev = d.table(spark, sf, "events")
    kind = F.when(F.col("event_type").isin("view", "click", "purchase"), "add_node").when(F.col("event_type") == "error", "remove_node")
    log = ev.select(F.col("event_id").alias("version"), kind.alias("mutation_type"), F.col("user_id").cast("string").alias("name")).where("mutation_type is not null")
    half = ev.agg(F.expr("max(event_id) div 2")).first()[0]
    return at_version(log, half).nodes.select("name")


#: Events as changes: users come, go and are changed, and each event links its user to the next number's.
_CHANGES = "ch AS (SELECT event_id AS v, user_id::VARCHAR AS u, (user_id + 1)::VARCHAR AS t, event_type AS k FROM events), hf AS (SELECT max(event_id) // 2 AS h FROM events), cv AS (SELECT ch.* FROM ch, hf WHERE v <= h)"


def _changes(spark, sf):
    ev = d.table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "view", "add_node").when(F.col("event_type") == "click", "set_payload").when(F.col("event_type") == "error", "remove_node").when(F.col("event_type") == "purchase", "add_edge").otherwise("remove_edge")
    user, then = F.col("user_id").cast("string"), (F.col("user_id") + 1).cast("string")
    of_edge = F.col("event_type").isin("purchase", "signup")
    return ev.select(
        F.col("event_id").alias("version"), kind.alias("mutation_type"), F.when(~of_edge, user).alias("name"), F.when(of_edge, user).alias("src"), F.when(of_edge, then).alias("dst"),
        F.when(of_edge, F.lit(1.0)).alias("weight"), F.when(~of_edge, F.concat(F.lit("p"), "event_id")).alias("payload"),
    ), ev.agg(F.expr("max(event_id) div 2")).first()[0]


@query("version_nodes", f"WITH {_CHANGES}, a AS (SELECT u, max(v) FILTER (k = 'error') AS gone FROM cv GROUP BY u), l AS (SELECT cv.u, min(v) FILTER (k = 'view') AS born FROM cv JOIN a USING (u) WHERE v > coalesce(gone, -1) GROUP BY cv.u) SELECT l.u AS name, 'p' || max(v) AS payload FROM l JOIN cv ON cv.u = l.u AND v >= born WHERE k IN ('view', 'click') GROUP BY l.u")
def version_nodes(spark, sf):
    """Nodes with their payloads at half of all versions, from the table of intervals."""
    from arbora.streaming.intervals import as_of, edge_intervals, node_intervals

    log, half = _changes(spark, sf)
    return as_of(node_intervals(log), edge_intervals(log), half).nodes.select("name", "payload")


@query("version_edges", f"WITH {_CHANGES}, e AS (SELECT v, u, t, k, greatest(coalesce((SELECT max(v) FROM cv x WHERE x.k = 'error' AND x.u = cv.u), -1), coalesce((SELECT max(v) FROM cv x WHERE x.k = 'error' AND x.u = cv.t), -1)) AS cut FROM cv WHERE k IN ('purchase', 'signup')), s AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY v) AS no FROM e WHERE k = 'purchase' AND v > cut), r AS (SELECT u, count(*) AS n FROM e WHERE k = 'signup' AND v > cut GROUP BY u) SELECT u AS src, t AS dst, v AS valid_from FROM s LEFT JOIN r USING (u) WHERE no > coalesce(n, 0)")
def version_edges(spark, sf):
    from arbora.streaming.intervals import as_of, edge_intervals, node_intervals

    log, half = _changes(spark, sf)
    return as_of(node_intervals(log), edge_intervals(log), half).edges.select("src", "dst", F.col("edge_id").alias("valid_from"))


@query("schema_violations", "SELECT 'c_acctbal' AS column, 'null_values' AS kind, CAST(0 AS BIGINT) AS n WHERE false UNION ALL SELECT 'c_phone', 'missing', 0 UNION ALL SELECT 'c_name', 'dtype', 0 UNION ALL SELECT NULL, 'max_rows', (SELECT count(*) FROM customer)")
def schema_violations(spark, sf):
    from arbora.quality.schema import ColumnRule, FrameRules, violations

    rules = FrameRules([ColumnRule("c_acctbal", "double", nullable=False), ColumnRule("c_phone", required=True), ColumnRule("c_name", "bigint")], max_rows=10)
    return violations(d.table(spark, sf, "customer"), rules)
