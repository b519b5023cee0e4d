"""Hard negatives by a kNN join over a Voronoi partition.

Vectors become integers floor(scale * x).  With M the largest norm, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) turn
the inner product into a distance, |q' - x'|^2 = |q|^2 + M^2 - 2 q.x.  Rows and anchors are assigned to the nearest
of some pivots, rows of a bounded sample.  Of the cells the join keeps small tables: the anchors' largest distance
R, and how many rows of each label lie in which ring around the pivot.  From them follow, without looking at a vector,

* a distance within which every anchor of a cell has its k positives, since |q'-x'| <= R + D + d, with D between
  the two pivots and d from the row to its own;
* the rows that can be nearer than that, since |q'-x'| >= D - R - d;
* and for negatives those whose distance to some anchor of the cell can lie within the bounds that the anchors'
  positives set.

Only to such cells' groups a row is copied.  Neighbouring anchor cells share a group of at most ``GROUP`` anchors
(a larger cell is dealt into chunks), so that a row is copied once for all of them.  In a group, rows are dealt into
parts of about ``PART``; a part's anchors are scored against its rows exactly, and the best of all parts are kept.

Defined cases: rows with a null vec_id, label or vector, or with a null or non-finite component take no part; vectors
of different lengths are compared as if the shorter had zeros behind it; equal vec_ids in several rows are candidates
each, an anchor never meets rows of its own id, and rows that repeat an anchor's id, label and vector ask once; ties
go to the smaller vec_id; where the product of two norms passes 2^52 scores are made in whole numbers, nothing is
pruned, and results are cut off at the range of a long; an empty table, or one without anchors, gives no rows; columns
other than vec_id, label and embedding are not read and may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm.common import checkpoint
from arbora.llm.mtree import EXACT, LONG_MAX, SCALE, longest, matrix, pack, quantised, unpack

POSITIVES, NEGATIVES = 5, 3
#: A negative's score is at least LOW and at most HIGH percent of the positive's.
LOW, HIGH = 50, 95
#: Rows to a pivot, and pivots at most; they are drawn from as many rows.
PAGE, MAX_PIVOTS = 4096, 1024
GROUP, PART, RINGS = 20_000, 8192, 8
#: Anchors scored at a time.
SLICE = 256

ROW = "row_no long, vec_id long, label long, q binary, norm2 double"


def _quantise(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [quantised(x, scale) for x in batch.column(3).to_pylist()]
            keep = [i for i, x in enumerate(v) if x is not None]
            own = batch.take(pa.array(keep, pa.int64()))
            norms = [float(sum(int(c) * int(c) for c in v[i])) for i in keep]
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), pa.array([pack(v[i]) for i in keep], pa.binary()), pa.array(norms, pa.float64())], ["row_no", "vec_id", "label", "q", "norm2"])

    return run


def integer_rows(df: DataFrame, scale: int) -> DataFrame:
    """row_no, vec_id, label, q, norm2 of the rows that take part."""
    kept = df.select(F.monotonically_increasing_id().alias("row_no"), F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding"))
    return kept.where("vec_id is not null and label is not null and embedding is not null").mapInArrow(_quantise(scale), ROW)


class Pivots:
    """Some points of the augmented space and the distances to them."""

    def __init__(self, sample: list[bytes], n: int, norm2: float):
        self.pruned = norm2 < EXACT and n > 0
        vectors = [unpack(r) for r in sample[:n]] if self.pruned else [np.zeros(1, np.int64)]
        self.dim = max(map(len, vectors))
        self.norm2 = norm2 if self.pruned else 0.0
        self.x = matrix(vectors, self.dim)
        self.last = np.sqrt(np.maximum(0.0, self.norm2 - (self.x * self.x).sum(1)))
        #: More than floating point can be wrong by in a distance.
        self.slack = math.sqrt(1e-9 * (1 + 4 * self.norm2))

    def nearest(self, raw: list[bytes], anchors: bool) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its pivot) of packed vectors."""
        if not self.pruned:
            return np.zeros(len(raw), int), np.zeros(len(raw))
        vs = [unpack(r) for r in raw]
        m = max(self.dim, max(map(len, vs), default=0))
        x = matrix(vs, m)
        p = np.zeros((len(self.x), m))
        p[:, : self.dim] = self.x
        own = (x * x).sum(1)
        last = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(0.0, self.norm2 - own))
        d2 = own[:, None] + (p * p).sum(1)[None] - 2 * x @ p.T + (last[:, None] - self.last[None]) ** 2
        near = d2.argmin(1)
        return near, np.sqrt(np.maximum(0.0, d2[np.arange(len(x)), near]))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = self.x[a] - self.x[b]
        return np.sqrt((d * d).sum(1) + (self.last[a] - self.last[b]) ** 2)

    def placed(self, rows: DataFrame, anchors: bool) -> DataFrame:
        """rows with cell and d."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cell, d = self.nearest(batch.column("q").to_pylist(), anchors)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(d, pa.float64())], [*batch.schema.names, "cell", "d"])

        return rows.mapInArrow(run, ROW + ", cell int, d double")

    def apart(self, pairs: DataFrame) -> DataFrame:
        """pairs (home, cell, ...) with the distance of the two pivots as ``apart``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = self.between(batch.column("home").to_numpy(), batch.column("cell").to_numpy())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d, pa.float64())], [*batch.schema.names, "apart"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
        return pairs.mapInArrow(run, f"{kinds}, apart double")


def grouping(cells: dict[int, int], pivots: Pivots, most: int = GROUP) -> dict[int, tuple[int, int]]:
    """Anchor cell -> (group, chunks of the group): a walk to the nearest cell left, full groups end."""
    left, out, group, filled = set(cells), {}, 0, 0
    at = max(left, key=lambda c: (cells[c], -c), default=None)
    while at is not None:
        left.discard(at)
        if filled and filled + cells[at] > most:
            group, filled = group + 1, 0
        filled += cells[at]
        out[at] = (group, max(1, -(-cells[at] // most)))
        if not left:
            break
        rest = np.array(sorted(left))
        at = int(rest[pivots.between(np.full(len(rest), at), rest).argmin()])
    chunks = {}
    for g, c in out.values():
        chunks[g] = max(c, chunks.get(g, 1))
    return {c: (g, chunks[g]) for c, (g, _) in out.items()}


# ---- the exact join of one part ----


def _scores(rows: pa.Table, asks: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the anchor, its scores with all rows)."""
    vs, qs = ([unpack(v) for v in t["q"].to_pylist()] for t in (rows, asks))
    dim = max(map(len, [*vs, *qs]))
    x, q = matrix(vs, dim), matrix(qs, dim)
    if x.dtype == object or q.dtype == object or not longest(x) * longest(q) < EXACT:  # else no partial sum passes 2^52
        xs, qo = (matrix([[int(c) for c in v] for v in t], dim).astype(object) for t in (vs, qs))
        for i in range(len(qo)):
            yield i, np.array([max(-LONG_MAX, min(LONG_MAX, int(s))) for s in xs @ qo[i]], np.int64)
        return
    for k in range(0, len(q), SLICE):
        for i, s in enumerate((q[k : k + SLICE] @ x.T).astype(np.int64)):
            yield k + i, s


def _first(scores: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """Places (in ascending vec_id) of the k highest scores, ties to the earlier."""
    own = scores[among]
    if len(own) > k:
        least = np.partition(own, len(own) - k)[len(own) - k]
        above, ties = among[own > least], among[own == least]
        among = np.concatenate([above, ties[: k - len(above)]])
    return among[np.lexsort((among, -scores[among]))]


def _by_id(rows: pa.Table) -> pa.Table:
    return rows.sort_by([("vec_id", "ascending")])


_POSITIVE = "anchor long, anchor_id long, vec_id long, score long"


def _positives(k: int):
    def run(rows: pa.Table, asks: pa.Table) -> pa.Table:
        out = []
        if len(rows) and len(asks):
            rows = _by_id(rows)
            ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
            anchors, names, own = (asks[c].to_pylist() for c in ("row_no", "vec_id", "label"))
            for i, s in _scores(rows, asks):
                out += [(anchors[i], names[i], int(ids[j]), int(s[j])) for j in _first(s, np.flatnonzero((labels == own[i]) & (ids != names[i])), k)]
        cols = list(zip(*out)) or [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in cols], ["anchor", "anchor_id", "vec_id", "score"])

    return run


_NEGATIVE = "anchor long, place int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest score between low and high percent of a positive's."""
    return -((-low * score) // 100), high * score // 100


def _negatives(k: int, low: int, high: int):
    def run(rows: pa.Table, asks: pa.Table) -> pa.Table:
        out = []
        if len(rows) and len(asks):
            rows = _by_id(rows)
            ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
            anchors, names, own, lists = (asks[c].to_pylist() for c in ("row_no", "vec_id", "label", "positives"))
            for i, s in _scores(rows, asks):
                other = np.flatnonzero((labels != own[i]) & (ids != names[i]))
                mine = s[other]
                for score in {p["score"] for p in lists[i]}:
                    a, b = window(score, low, high)
                    got = _first(s, other[(mine >= a) & (mine <= b)], k)
                    for p in lists[i]:
                        if p["score"] == score:
                            out += [(anchors[i], p["place"], names[i], p["vec_id"], score, int(ids[j]), int(s[j])) for j in got]
        cols = list(zip(*out)) or [[]] * 7
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in _NEGATIVE.split(", ")])

    return run


# ---- the join ----


class Join:
    """Rows and anchors of one run, dealt to cells."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, scale: int = SCALE):
        rows, asked = checkpoint(integer_rows(rows, scale)), integer_rows(anchors, scale).dropDuplicates(["vec_id", "label", "q"])
        n, norm2 = rows.agg(F.count("*"), F.max("norm2")).first()
        sample = [r[0] for r in rows.orderBy(F.xxhash64("vec_id", "q"), "vec_id").limit(MAX_PIVOTS).select("q").collect()]
        self.pivots = Pivots(sample, min(MAX_PIVOTS, max(1, n // PAGE), len(sample)), float(norm2 or 0.0))
        self.rows = checkpoint(self.pivots.placed(rows, False).drop("norm2"))
        asked = checkpoint(self.pivots.placed(asked, True))
        cells = {r["cell"]: (r["n"], r["reach"]) for r in asked.groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("reach")).collect()}  # a row for a pivot
        groups = grouping({c: n for c, (n, _) in cells.items()}, self.pivots)
        self.homes = rows.sparkSession.createDataFrame([(c, groups[c][0], groups[c][1], cells[c][1]) for c in cells], "home int, group int, chunks int, reach double")
        self.anchors = asked.withColumnRenamed("cell", "home").join(F.broadcast(self.homes.select("home", "group", "chunks")), "home")  # a row for a pivot
        width = max((self.rows.agg(F.max("d")).first()[0] or 0.0) / RINGS, 1e-9)
        ring = F.floor(F.col("d") / width)
        self.rings = checkpoint(self.rows.groupBy("cell", "label", ring.alias("ring")).agg(F.count("*").alias("n"), F.max("d").alias("far")))

    def answers(self, served: DataFrame, keys: list[str], anchors: DataFrame, join, schema: str) -> DataFrame:
        """The join's rows, where ``served`` (keys, group, least) tells which rows of a cell a group needs: those with d >= least."""
        sizes = self.rings.join(served, keys).where("far >= least").groupBy("group").agg(F.ceil(F.sum("n") / PART).cast("int").alias("parts"))
        served = served.join(sizes, "group").join(self.homes.select("group", "chunks").distinct(), "group")
        rows = self.rows.join(served, keys).where("d >= least")
        rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("part", self._deal("row_no", "parts"))
        asks = anchors.join(sizes, "group").withColumn("chunk", self._deal("row_no", "chunks")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        key, own = ["group", "chunk", "part"], [c for c in ("row_no", "vec_id", "label", "q", "positives") if c in anchors.columns]
        return rows.select(*key, "vec_id", "label", "q").groupBy(*key).cogroup(asks.select(*key, *own).groupBy(*key)).applyInArrow(join, schema)

    @staticmethod
    def _deal(column: str, into: str) -> Column:
        return F.pmod(F.xxhash64(column), F.col(into)).cast("int")

    def positives(self, k: int) -> DataFrame:
        """anchor, anchor_id, place (from 1), vec_id, score: the k best of the anchor's label."""
        need = self.anchors.select("home", "label").distinct().join(self.homes, "home")
        pairs = checkpoint(self.pivots.apart(need.join(self.rings, "label").select("home", "group", "label", "reach", "cell", "far", "n")))
        # within which distance every anchor of the cell has k rows of its label, besides itself
        upper = F.col("reach") + F.col("apart") + F.col("far")
        so_far = F.sum("n").over(Window.partitionBy("home", "label").orderBy("upper"))
        within = pairs.withColumn("upper", upper).withColumn("held", so_far).where(F.col("held") > k).groupBy("home", "label").agg(F.min("upper").alias("within"))
        least = F.col("apart") - F.col("reach") - F.coalesce(F.col("within"), F.lit(math.inf)) - self.pivots.slack
        served = pairs.join(within, ["home", "label"], "left").groupBy("cell", "label", "group").agg(F.min(least).alias("least"))
        found = self.answers(served, ["cell", "label"], self.anchors, _positives(k), _POSITIVE)
        place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("place", place).where(F.col("place") <= k)

    def negatives(self, positives: DataFrame, k: int, low: int, high: int) -> DataFrame:
        lists = positives.groupBy(F.col("anchor").alias("row_no")).agg(F.collect_list(F.struct("place", "vec_id", "score")).alias("positives"))
        # at most the k positives of an anchor; negative scores have no negatives between their bounds
        asks = checkpoint(self.anchors.join(lists, "row_no").withColumn("positives", F.filter("positives", lambda p: p["score"] >= 0)).where(F.size("positives") > 0))
        best, worst = (f(F.transform("positives", lambda p: p["score"])).cast("double") for f in (F.array_max, F.array_min))
        away = lambda score: F.sqrt(F.greatest(F.lit(0.0), F.col("norm2") + self.pivots.norm2 - 2 * score))
        bounds = asks.groupBy("home").agg(F.min(away(best * high / 100 + 1)).alias("near"), F.max(away(worst * low / 100 - 1)).alias("far"))
        cells = self.homes.join(bounds, "home").withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(len(self.pivots.x) - 1))))
        least = F.greatest(F.col("apart") - F.col("reach") - F.col("far"), F.col("near") - F.col("apart") - F.col("reach")) - self.pivots.slack
        if not self.pivots.pruned:
            least = F.lit(-math.inf)
        served = checkpoint(self.pivots.apart(cells).groupBy("cell", "group").agg(F.min(least).alias("least")))
        found = self.answers(served, ["cell"], asks, _negatives(k, low, high), _NEGATIVE)
        rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Both have vec_id, label and embedding.  For every anchor and each of its best ``positives`` rows of the same label, the best
    ``negatives`` rows of other labels that score between ``low`` and ``high`` percent of the positive.
    """
    join = Join(rows, anchors, scale)
    found = join.negatives(checkpoint(join.positives(positives)), negatives, low, high)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mining_query(embeddings: DataFrame) -> DataFrame:
    """Anchors are rows with a vec_id divisible by 50; a seventh of the rows has the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.select("vec_id", label.alias("label"), "embedding")
    return hard_negatives(rows, rows.where(F.col("vec_id") % 50 == 0))


#: The same rows by DuckDB.
MINING_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS DOUBLE)) AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
pos AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM p WHERE same) WHERE place <= 5),
neg AS (SELECT pos.anchor_id, pos.vec_id AS positive_id, p.vec_id AS negative_id, pos.score AS positive_score, p.score AS negative_score,
               row_number() OVER (PARTITION BY pos.anchor_id, pos.vec_id ORDER BY p.score DESC, p.vec_id) AS rank
        FROM pos JOIN p ON p.anchor_id = pos.anchor_id AND NOT p.same AND 50 * pos.score <= 100 * p.score AND 100 * p.score <= 95 * pos.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3
"""
