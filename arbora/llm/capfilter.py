"""Embedding near-duplicates by spherical-cap filters.

Filter directions are products of small random codes: the vector, randomly rotated, is cut into blocks,
every block has its own code words, and a filter is one word of each block.  A vector passes the filters
whose direction it exceeds by a cap threshold; they are list-decoded from the sorted block products, not
tried one by one.  Vectors that share a filter are compared exactly, in double precision.

The number of filters follows the number of vectors and the threshold follows from it, so that a vector
passes about ``CAPS`` filters and a filter meets a bounded number of unrelated vectors at any size.  There
are ``TABLES`` codes of independent rotations, and a vector that exceeds few filters of a code takes its
``NEAREST`` ones, so that none has too few to meet its neighbours.  Where made-up pairs at ``NEAR_COSINE`` still
miss each other too often (short vectors), codes are added, and beyond ``MAX_TABLES`` wider caps taken, until
``RECALL`` of them meet, at any number of vectors.

A pair that shares several filters counts in the smallest of them only (each vector carries its list), so
no list of pairs is ever written: filters give sums of links and a spanning star of their components.
Equal vectors are one class before any of this.  A filter with more than ``BLOCK`` classes is compared in
pairs of blocks dealt to tasks of their own.

Defined cases: vectors that are null, zero, empty or hold null or non-finite components link with nothing;
vectors of different lengths don't link; rows without a vec_id have no links, no component and are not
kept; repeated rows count as vectors each (the component is the same, kept is true for each with the
smallest id); an empty table gives no rows; columns other than vec_id and embedding are not read and may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import checkpoint, components

THRESHOLD = 0.95
CAPS = 32
TABLES = 4
NEAREST = 6
BLOCK = 1024
PART_ROWS = 16_000
SEED = 5
NEAR_COSINE = 0.951
RECALL = 0.98
TRIALS = 400
MAX_TABLES = 12


class Table:
    """Product code of one random rotation for one vector length."""

    def __init__(self, dim: int, n: int, caps: float, seed: list[int]):
        rng = np.random.default_rng(seed)
        self.blocks = max(1, min(dim, 2 if n < 2_000_000 else 3))
        self.words = max(2, math.ceil(max(1024, n) ** (1 / self.blocks)))
        self.size = self.words**self.blocks
        rate = min(0.5, caps / self.size)
        self.least = -NormalDist().inv_cdf(rate) / math.sqrt(dim) * math.sqrt(self.blocks)
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cuts = [round(dim * k / self.blocks) for k in range(self.blocks + 1)]
        self.codes = []
        for a, b in zip(self.cuts, self.cuts[1:]):
            c = rng.standard_normal((self.words, b - a))
            # blocks of unequal length keep the same variance
            self.codes.append(c / np.linalg.norm(c, axis=1, keepdims=True) * math.sqrt((b - a) * self.blocks / dim))

    def passed(self, unit: np.ndarray) -> list[np.ndarray]:
        """Numbers of the filters that each row exceeds, its ``NEAREST`` filters at least."""
        turned = unit @ self.rotation
        products = [turned[:, a:b] @ c.T for a, b, c in zip(self.cuts, self.cuts[1:], self.codes)]
        highest = [p.max(1) for p in products]
        k = min(self.words, NEAREST)
        best = [np.argpartition(-p, k - 1, axis=1)[:, :k] for p in products]
        out = []
        for r in range(len(unit)):
            # the NEAREST best sums of one word of each block lie among the NEAREST best words of each
            number, value = np.zeros(1, np.int64), np.zeros(1)
            for p, top in zip(products, best):
                number = (number[:, None] * self.words + top[r][None]).ravel()
                value = (value[:, None] + p[r][top[r]][None]).ravel()
            keep = np.argsort(-value, kind="stable")[:NEAREST]
            near, least = number[keep], min(self.least, value[keep[-1]]) - 1e-9  # rounding
            number, value = np.zeros(1, np.int64), np.zeros(1)
            for j, p in enumerate(products):
                later = sum(h[r] for h in highest[j + 1 :])
                good = np.flatnonzero(p[r] >= least - later - value.max())
                sums = value[:, None] + p[r][good][None]
                x, y = np.nonzero(sums >= least - later)
                number, value = number[x] * self.words + good[y], sums[x, y]
            out.append(np.union1d(number, near))
        return out


def made_up_pairs(dim: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in two arrays, row by row at ``NEAR_COSINE``."""
    r = np.random.default_rng([seed, dim, 77])
    x = r.standard_normal((TRIALS, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if dim == 1:
        return x, x
    away = r.standard_normal(x.shape)
    away -= (away * x).sum(1, keepdims=True) * x
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    return x, NEAR_COSINE * x + math.sqrt(1 - NEAR_COSINE**2) * away


@lru_cache(8)
def filters_of(dim: int, n: int, caps: int) -> Filters:
    """One set of codes per worker process."""
    return Filters(dim, n, caps)


class Filters:
    """``TABLES`` product codes or more; filter numbers of one table follow those of the one before."""

    def __init__(self, dim: int, n: int, caps: int = CAPS, seed: int = SEED):
        x, y = made_up_pairs(dim, seed)
        while True:
            self.tables: list[Table] = []
            apart = np.ones(len(x), bool)
            while len(self.tables) < TABLES or (apart.mean() > 1 - RECALL and len(self.tables) < MAX_TABLES):
                t = Table(dim, n, caps / TABLES, [seed, dim, len(self.tables)])
                self.tables.append(t)
                at = np.flatnonzero(apart)
                apart[at] = [not len(np.intersect1d(p, q, True)) for p, q in zip(t.passed(x[at]), t.passed(y[at]))]
            if apart.mean() <= 1 - RECALL or n < 16:
                return
            n //= 4  # so few dimensions that caps of this many filters are narrower than neighbours are apart

    def passed(self, unit: np.ndarray) -> list[np.ndarray]:
        """Sorted filter numbers of each row."""
        per = [[k * t.size + x for x in t.passed(unit)] for k, t in enumerate(self.tables)]
        return [np.concatenate(x) for x in zip(*per)]


def raw_vector(values: list | None) -> bytes | None:
    """Bytes of a vector that can link; None otherwise."""
    if not values or any(v is None for v in values):
        return None
    a = np.asarray(values, np.float64) + 0.0  # one zero
    if not np.isfinite(a).all() or not a.any():
        return None
    with np.errstate(over="ignore"):
        short = a.astype(np.float32)
    # half the bytes where nothing is lost; the first byte says which
    return b"f" + short.tobytes() if (short.astype(np.float64) == a).all() else b"d" + a.tobytes()


def length_of(raw: bytes) -> int:
    return (len(raw) - 1) // (4 if raw[:1] == b"f" else 8)


def unit_rows(raw: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(r, np.float32 if r[:1] == b"f" else np.float64, offset=1).astype(np.float64) for r in raw])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def linked(unit_a: np.ndarray, unit_b: np.ndarray | None, lower_a: list[np.ndarray], lower_b: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) at or above the threshold that share none of the lower filters; within a if b is None."""
    sims = unit_a @ (unit_a if unit_b is None else unit_b).T
    near = sims >= threshold
    if unit_b is None:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    if not len(i):
        return i, j
    names = np.unique(np.concatenate([*lower_a, *(lower_b or [])]))
    if len(names):
        def table(lists: list[np.ndarray]) -> np.ndarray:
            t = np.zeros((len(lists), len(names)), np.float32)
            for r, x in enumerate(lists):
                t[r, np.searchsorted(names, x)] = 1
            return t

        a = table(lower_a)
        shared = a @ (a if lower_b is None else table(lower_b)).T > 0
        keep = ~shared[i, j]
        i, j = i[keep], j[keep]
    return i, j


def near_links(vectors: DataFrame, threshold: float = THRESHOLD, caps: int = CAPS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [raw_vector(v) if i is not None else None for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["vec_id", "raw"])

    rows = checkpoint(vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(read, "vec_id long, raw binary"))
    classes = checkpoint(rows.where("raw is not null").groupBy("raw").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    count = classes.count()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Filters] = {}
        for batch in batches:
            raw = batch.column(0).to_pylist()
            lists: list = [None] * len(raw)
            for dim in {length_of(x) for x in raw}:
                at = [i for i, x in enumerate(raw) if length_of(x) == dim]
                if dim not in known:
                    known[dim] = filters_of(dim, count, caps)
                for i, f in zip(at, known[dim].passed(unit_rows([raw[i] for i in at]))):
                    lists[i] = f
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int64() if many else pa.int32()))], ["raw", "rep", "n", "filters"])

    many = count * MAX_TABLES * 8 >= 1 << 31  # filter numbers beyond 32 bits
    passed = checkpoint(classes.mapInArrow(decode, f"raw binary, rep long, n long, filters array<{'long' if many else 'int'}>"))
    dim = F.expr("(length(raw) - 1) div if(substring(raw, 1, 1) = X'66', 4, 8)").cast("int").alias("dim")
    # a member carries the filters below this one only: a pair counts in the smallest that it shares
    member = passed.select("raw", "rep", "n", "filters", dim, F.posexplode("filters").alias("place", "filter"))
    member = member.withColumn("lower", F.slice("filters", F.lit(1), F.col("place"))).drop("filters", "place")
    heavy = member.groupBy("dim", "filter").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK)
    member = member.join(heavy, ["dim", "filter"], "left")
    groups = F.coalesce(F.ceil(F.col("size") / BLOCK), F.lit(1)).cast("int")
    member = member.withColumn("groups", groups).withColumn("mine", F.pmod(F.xxhash64("raw"), F.col("groups")).cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    member = member.select("raw", "rep", "n", "lower", "dim", "filter", "mine", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))
    parts = max(1, count * caps // PART_ROWS)
    member = member.withColumn("part", F.pmod(F.xxhash64("dim", "filter", "low", "high"), F.lit(parts)).cast("int"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("dim", "filter", "low", "high", "rep")])
        keys = np.stack([table[c].to_numpy().astype(np.int64) for c in ("dim", "filter", "low", "high")], 1)
        rep, n, mine = (table[c].to_numpy() for c in ("rep", "n", "mine"))
        raw = table["raw"]
        lists = table["lower"].combine_chunks() if table["lower"].num_chunks != 1 else table["lower"].chunk(0)
        new = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        edges = [0, *new.tolist(), len(keys)]
        out: list[tuple[int, int, int]] = []
        for a, b in zip(edges, edges[1:]):
            if b - a < 2:
                continue
            _, _, low, high = keys[a]
            unit = unit_rows(raw.slice(a, b - a).to_pylist())
            own = [np.asarray(lists[k].values) for k in range(a, b)]
            if low == high:
                i, j = linked(unit, None, own, None, threshold)
            else:
                x, y = np.flatnonzero(mine[a:b] == low), np.flatnonzero(mine[a:b] == high)
                if not len(x) or not len(y):
                    continue
                i, j = linked(unit[x], unit[y], [own[k] for k in x], [own[k] for k in y], threshold)
                i, j = x[i], y[j]
            if not len(i):
                continue
            links = np.bincount(i, n[a + j], b - a) + np.bincount(j, n[a + i], b - a)
            root = np.arange(b - a)
            while True:
                was = root.copy()
                np.minimum.at(root, i, was[j])
                np.minimum.at(root, j, root[i])
                root = root[root]
                if (root == was).all():
                    break
            at = np.flatnonzero(links)
            out += zip(rep[a + at].tolist(), links[at].astype(np.int64).tolist(), rep[a + root[at]].tolist())
        cols = list(zip(*out)) or [[]] * 3
        return pa.table([pa.array(c, pa.int64()) for c in cols], ["rep", "links", "root"])

    found = checkpoint(member.groupBy("part").applyInArrow(compare, "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).where("a <> b").distinct())
    classes = classes.join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select("raw", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("root", "rep").alias("component"))
    every = rows.join(classes, "raw", "left")
    out = every.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def dedup_query(embeddings: DataFrame) -> DataFrame:
    return near_links(embeddings)


#: The same rows by DuckDB, from all pairs; equal where the index misses no link (there is none to miss in the small tables).
DEDUP_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, e FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0) WHERE list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) >= 0.95 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))),
r AS (SELECT vec_id AS node, vec_id AS low FROM embeddings UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.node)
SELECT vec_id, CAST((SELECT count(*) FROM l WHERE l.a = vec_id) AS BIGINT) AS n_links, min(low) AS component_id, vec_id = min(low) AS kept
FROM embeddings JOIN r ON r.node = vec_id GROUP BY vec_id
"""
