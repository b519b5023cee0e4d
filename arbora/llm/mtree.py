"""Exact top-k inner products by best-first search in M-trees.

Vectors become integers floor(scale * x).  With M the largest norm, x' = (x, sqrt(M^2 - |x|^2)) and
q' = (q, 0) turn the inner product into a metric: |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so nearest in x'
is best in q.x, and the triangle inequality holds.

Rows are dealt to pages by the nearest of some pivots (from a sample of rows; their number follows the rows,
beyond ``MAX_PIVOTS`` as the square root, and so do the pages' sizes);
every page keeps its covering radius, large pages are split by hash.  A page is an M-tree: routing
objects with covering radii and parent distances.  Each query first searches its nearest page, then
every other page that its k-th best score so far doesn't exclude, so the result is exact whatever the
pivots.  In a tree, |d(q, parent) - d(o, parent)| skips routing objects and leaf entries without
computing their distance.  Leaf scores are integers.

Defined cases: vectors that are null or hold null or non-finite components, and rows with a null
vec_id, take no part; vectors of different lengths are compared as if the shorter had zeros behind it;
equal vec_ids in several rows are candidates each (a query never meets rows of its own id; rows that
repeat a query's id and vector ask once, those with its id and another vector ask with it, for one list of
the k best); where the product of two norms passes 2^52, and with it what sums in floating point hold
exactly, scores are made in whole numbers without pruning, cut off at the range of a long; an empty
table gives no rows; columns other than vec_id and embedding are not read and may have any name.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm.common import checkpoint

SCALE = 256
K = 5
SAMPLE = 4096
PAGE = 4096
MAX_PIVOTS = 1024
SPLIT = 2048
QUERY_CHUNK = 20_000
#: Rows of a leaf and children of a node; a leaf is answered by one product, so small ones cost more than they save.
LEAF, FANOUT = 256, 16
EXACT = 2.0**52
LONG_MAX = (1 << 63) - 1


def quantised(values: list | None, scale: int = SCALE) -> list[int] | None:
    """floor(scale * x) of every component; None if the vector takes no part."""
    if values is None or any(v is None for v in values):
        return None
    a = np.asarray(values, np.float64)
    if not np.isfinite(a).all():
        return None
    with np.errstate(over="ignore"):
        b = np.floor(scale * a)
    if not np.isfinite(b).all():
        return None
    return b.astype(np.int64).tolist() if (np.abs(b) < 2.0**62).all() else [int(v) for v in b]


def pack(v: list[int]) -> bytes:
    top = max(map(abs, v), default=0)
    for code, limit in (("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", 1 << 63)):
        if top < limit:
            return code[2].encode() + np.array(v, code).tobytes()
    return b"t" + " ".join(map(str, v)).encode()


def unpack(raw: bytes) -> list[int] | np.ndarray:
    if raw[:1] == b"t":
        return [int(x) for x in raw[1:].split()]
    return np.frombuffer(raw[1:], f"<i{raw[:1].decode()}").astype(np.int64)


def matrix(vectors: list, dim: int) -> np.ndarray:
    """Rows padded with zeros; whole numbers of any size as objects if some don't fit 64 bits."""
    wide = any(isinstance(v, list) for v in vectors)
    out = np.zeros((len(vectors), dim), object if wide else np.float64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = [int(x) for x in v] if wide else v
    return out


def longest(x: np.ndarray) -> float:
    """Largest norm of the rows."""
    return float(np.sqrt(np.square(x.astype(np.float64)).sum(1)).max()) if len(x) else 0.0


class MTree:
    """M-tree over integer vectors (float64 rows), bulk-loaded; distances in the augmented space."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, norm2: float):
        self.ids, self.x, self.norm2 = ids, x, norm2
        self.last = np.sqrt(np.maximum(0.0, norm2 - (x * x).sum(1)))
        self.computed = 0
        self.root = self.build(np.arange(len(ids)), None)

    def between(self, rows: np.ndarray, p: int) -> np.ndarray:
        d = self.x[rows] - self.x[p]
        return np.sqrt((d * d).sum(1) + (self.last[rows] - self.last[p]) ** 2)

    def to(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        self.computed += len(rows)
        d = self.x[rows] - q
        return np.sqrt((d * d).sum(1) + self.last[rows] ** 2)

    def build(self, rows: np.ndarray, parent: int | None) -> tuple:
        """("leaf", rows, parent distances) or ("node", pivots, radii, parent distances, children)."""
        up = self.between(rows, parent) if parent is not None else np.zeros(len(rows))
        if len(rows) <= LEAF:
            return ("leaf", rows, up)
        pivots = [int(rows[0])]
        dist = self.between(rows, pivots[0])
        near = np.zeros(len(rows), int)
        while len(pivots) < FANOUT and dist.max() > 0:
            p = int(rows[dist.argmax()])
            d = self.between(rows, p)
            closer = d < dist
            near[closer] = len(pivots)
            dist = np.minimum(dist, d)
            pivots.append(p)
        if len(pivots) == 1:  # all the same vector
            return ("leaf", rows, up)
        kept = [k for k in range(len(pivots)) if (near == k).any()]
        groups = [rows[near == k] for k in kept]
        piv = np.array([pivots[k] for k in kept])
        radii = np.array([dist[near == k].max() for k in kept])
        above = self.between(piv, parent) if parent is not None else np.zeros(len(piv))
        return ("node", piv, radii, above, [self.build(g, int(p)) for g, p in zip(groups, piv)])

    def search(self, q: np.ndarray, own: int, k: int, floor: float) -> list[tuple[int, int]]:
        """The k best (score, id) with score >= floor, without id ``own``; best first, ties by id."""
        q2 = float(q @ q) + self.norm2
        best: list[tuple[int, int]] = []  # heap of (score, -id), worst on top
        slack = 1e-9 * (q2**0.5) + 1e-6

        def reach() -> float:
            s = max(floor, best[0][0]) if len(best) == k else floor
            return np.inf if s == -np.inf else max(0.0, q2 - 2 * s) ** 0.5 + slack

        heap: list[tuple[float, int, float | None, tuple]] = [(0.0, 0, None, self.root)]
        n = 0
        while heap:
            low, _, dq, node = heapq.heappop(heap)
            limit = reach()
            if low > limit:
                break
            if node[0] == "leaf":
                rows, up = node[1], node[2]
                if dq is not None:
                    rows = rows[np.abs(dq - up) <= limit]
                scores = self.x[rows] @ q
                self.computed += len(rows)
                least = best[0][0] if len(best) == k else floor
                for i in np.flatnonzero(scores >= least):
                    vid = int(self.ids[rows[i]])
                    if vid == own:
                        continue
                    item = (int(scores[i]), -vid)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                continue
            _, piv, radii, above, children = node
            at = np.arange(len(piv)) if dq is None else np.flatnonzero(np.abs(dq - above) - radii <= limit)
            d = self.to(q, piv[at])
            for i, di in zip(at, d):
                low = max(0.0, di - radii[i])
                if low <= limit:
                    n += 1
                    heapq.heappush(heap, (low, n, float(di), children[i]))
        return [(s, -v) for s, v in sorted(best, reverse=True)]


def searched(ids: list[int], vectors: list, queries: list[tuple[int, object, float]], k: int, norm2: float) -> list[tuple[int, int, int]]:
    """(query, vec_id, score) of the k best of one page for every (id, vector, floor)."""
    dim = max(max((len(v) for v in vectors), default=0), max((len(v) for _, v, _ in queries), default=0))
    x, q = matrix(vectors, dim), matrix([v for _, v, _ in queries], dim)
    out = []
    # no partial sum of a product exceeds the product of the norms
    if x.dtype == object or q.dtype == object or not longest(x) * longest(q) < EXACT:
        x, q = (matrix([[int(c) for c in v] for v in vs], dim) for vs in (vectors, [v for _, v, _ in queries]))
        xs = x.astype(object)
        for (own, _, _), row in zip(queries, q.astype(object)):
            got = sorted(((int(s), -i) for s, i in zip(xs @ row, ids) if i != own), reverse=True)[:k]
            out += [(own, -i, max(-LONG_MAX - 1, min(LONG_MAX, s))) for s, i in got]
        return out
    tree = MTree(np.array(ids, np.int64), x, norm2)
    for (own, _, floor), row in zip(queries, q):
        out += [(own, vid, s) for s, vid in tree.search(row, own, k, floor)]
    return out


def _pivot_distances(x: np.ndarray, p: np.ndarray, xa: np.ndarray, pa_: np.ndarray) -> np.ndarray:
    d2 = (x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * x @ p.T + (xa[:, None] - pa_[None]) ** 2
    return np.sqrt(np.maximum(0.0, d2))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: for every query row the k best rows of ``vectors`` of another id.

    Both have vec_id and embedding.
    """

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(i, quantised(v, scale)) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            got = [(i, v) for i, v in got if i is not None and v is not None]
            norms = [float(sum(int(c) * int(c) for c in v)) for _, v in got]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in got], pa.int64()), pa.array([pack(v) for _, v in got], pa.binary()), pa.array(norms, pa.float64())], ["vec_id", "q", "norm2"])

    shape = "vec_id long, q binary, norm2 double"
    pick = [F.col("vec_id").cast("long"), F.col("embedding")]
    rows = checkpoint(vectors.select(*pick).mapInArrow(quantise, shape))
    asked = checkpoint(queries.select(*pick).mapInArrow(quantise, shape).dropDuplicates(["vec_id", "q"]))
    n, norm2, wide = rows.agg(F.count("*"), F.max("norm2"), F.max(F.length("q"))).first()
    n_asked = asked.count()
    norm2 = float(norm2 or 0.0)
    most = max(MAX_PIVOTS, math.isqrt(n))
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(sample, 4 * most)).select("q").collect()
    n_pivots = max(1, min(most, len(some), n // PAGE))
    seen = [unpack(r[0]) for r in some]
    plain = [v for v in seen if not isinstance(v, list)] or [np.zeros(1, np.int64)]
    step = max(1, len(plain) // n_pivots)
    dim = max(len(v) for v in plain)
    piv = np.zeros((min(n_pivots, len(plain)), dim))
    for i in range(len(piv)):
        piv[i, : len(plain[i * step])] = plain[i * step]
    piv_last = np.sqrt(np.maximum(0.0, norm2 - (piv * piv).sum(1)))

    def located(raw: list[bytes], query: bool) -> np.ndarray:
        """Distances to all pivots (vectors shorter or longer than the pivots are padded)."""
        vs = [np.array(unpack(r), np.float64) for r in raw]
        m = max(dim, max((len(v) for v in vs), default=0))
        x = np.zeros((len(vs), m))
        for i, v in enumerate(vs):
            x[i, : len(v)] = v
        p = np.zeros((len(piv), m))
        p[:, :dim] = piv
        xa = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, norm2 - (x * x).sum(1)))
        return _pivot_distances(x, p, xa, piv_last)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = located(batch.column(1).to_pylist(), False)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near], pa.float64())], ["vec_id", "q", "page", "d"])

    placed = checkpoint(rows.mapInArrow(place, "vec_id long, q binary, page int, d double"))
    # a row for each pivot
    pages = {r["page"]: (r["n"], r["r"]) for r in placed.groupBy("page").agg(F.count("*").alias("n"), F.max("d").alias("r")).collect()}
    names = sorted(pages)
    radius = np.array([pages[p][1] for p in names])
    split = {p: -(-pages[p][0] // SPLIT) for p in names}
    chunks = max(1, -(-n_asked // QUERY_CHUNK))
    parts = F.create_map(*[F.lit(v) for p in names for v in (p, split[p])]) if names else None
    if not names:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # (page, part, chunk of queries): a page's rows go to every chunk of queries, in bounded parts
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("vec_id", "q"), parts[F.col("page")]).cast("int"))
    dealt = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).select("page", "part", "chunk", "vec_id", "q")

    def route(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, raw = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                own2 = batch.column(2).to_numpy(zero_copy_only=False)
                d = located(raw, True)[:, names]
                floor = np.full(len(ids), -np.inf) if first else np.array([-np.inf if x is None else x for x in batch.column(3).to_pylist()])
                low = np.maximum(0.0, d - radius[None])
                home = low.argmin(1)
                out = []
                for i in range(len(ids)):
                    if first:
                        go = [home[i]]
                    else:
                        slack = 1e-6 * (1 + own2[i] + norm2)
                        top = (own2[i] + norm2 - low[i] ** 2) / 2 + slack
                        go = [j for j in np.flatnonzero(top >= floor[i]) if j != home[i]]
                    out += [(names[j], part, ids[i] % chunks, ids[i], raw[i], float(floor[i])) for j in go for part in range(split[names[j]])]
                cols = list(zip(*out)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.float64()))], ["page", "part", "chunk", "query_id", "q", "floor"])

        return run

    def search(table: pa.Table, asks: pa.Table) -> pa.Table:
        got: list = []
        if len(table) and len(asks):
            q = [(i, unpack(v), f) for i, v, f in zip(asks["query_id"].to_pylist(), asks["q"].to_pylist(), asks["floor"].to_pylist())]
            got = searched(table["vec_id"].to_pylist(), [unpack(v) for v in table["q"].to_pylist()], q, k, norm2)
        cols = list(zip(*got)) or [[]] * 3
        return pa.table([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    key, routed = ["page", "part", "chunk"], "page int, part int, chunk int, query_id long, q binary, floor double"

    def answers(asks: DataFrame) -> DataFrame:
        return dealt.groupBy(*key).cogroup(asks.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score long")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = checkpoint(answers(asked.mapInArrow(route(True), routed)))
    near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")
    floors = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor"))
    second = asked.join(floors.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").select("vec_id", "q", "norm2", "floor")
    far = answers(second.mapInArrow(route(False), routed))
    ranked = near.unionByName(far).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def search_query(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings, embeddings.where(F.col("vec_id") % 50 == 0))


#: The same rows by DuckDB.
SEARCH_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""
