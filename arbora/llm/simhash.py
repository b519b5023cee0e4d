"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most r bits share a value within r // 2 (rounded up on
one side) bits of both.  Every distinct fingerprint emits all values within half the radius; the
values are shuffled, fingerprints that meet are verified and linked.  All fingerprints that meet at
one value lie within the radius of each other, so a star around the smallest of them keeps every
component whole, and a value can hold at most 65 distinct fingerprints at radius 2: no group of
copies grows, as exact copies are one fingerprint before the shuffle.

Defined cases: null or word-less text has fingerprint 0 and is linked like any other; a null doc_id
never names a component (a component of null ids only has a null id); repeated rows stay rows; texts of any
length are read whole; an empty table gives no rows; columns other than doc_id and text are not read and may have any name.

The pipeline's stage (:func:`keep_one_similar`) has a rule of its own: texts are linked whose sets of
five-word shingles have a Jaccard similarity of 0.8 or more.  64 bits don't reach that (about ten of them
differ at 0.8), so five-word fingerprints that meet in a ball are only the first candidates.  The rest
come from an exact prefix filter: in one fixed order of all shingles two such sets share one of their
first n - ceil(0.8 n) + 1 each.  Every candidate is verified by its sets; there are no misses.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.llm.common import checkpoint, components, slices

SHINGLE = 3
RADIUS = 2
SEED = 42
CHUNK = 1 << 15
#: The stage of the pipeline: words of a shingle, and the least similarity as a fraction.
STAGE_SHINGLE = 5
ALIKE, OF = 4, 5
#: Common shingles come last in the order of the prefix filter.  They are counted in a sample of the rows;
#: the order decides on the work, never on the result.  The share stays the same as the input grows: with a
#: smaller one a shingle may have more holders before it is found common, and pairs grow with their square.
SAMPLE_ROWS, SAMPLE_SHARE, COMMON, MAX_COMMON = 4_000, 1 / 16, 3, 200_000
#: So many shingles before a shared one tell whether a pair has met already.
BEFORE = 3
#: Up to so many texts are picked by a broadcast, more by a shuffle.
BROADCAST_ROWS = 2_000_000


def shingle_hashes(text: str | bytes | None, shingle: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """The hashes of all shingles of one text, in chunks; a text of fewer words is one shingle."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else (text or b"")
    words = raw.lower().split()  # bytes: lower-cases A-Z, splits at \x20 and \x09-\x0D
    if not words:
        return
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    k = min(shingle, len(words))
    a, b = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    hashed = xxhash.xxh64_intdigest
    for i in range(0, len(a), CHUNK):
        yield np.array([hashed(joined[x:y], seed) for x, y in zip(a[i : i + CHUNK], b[i : i + CHUNK])], "<u8")


def majority(chunks: Iterable[np.ndarray]) -> int:
    """The bits that more than half of all hashes have."""
    n, total = 0, np.zeros(64, np.int64)
    for h in chunks:
        n += len(h)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * total > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: str | bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of one text."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            fp = np.array([fingerprint(x) for x in texts], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def ball_masks(radius: int) -> list[int]:
    """All signed 64-bit masks of at most ``radius`` bits."""
    out = []
    for r in range(radius + 1):
        for bits in combinations(range(64), r):
            m = sum(1 << i for i in bits)
            out.append(m - (1 << 64) if m >> 63 else m)
    return out


def link_fingerprints(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints (fp) -> verified edges (a, b) that connect all within ``radius``."""
    half = (radius + 1) // 2
    masks = F.array(*[F.lit(m) for m in ball_masks(half)])
    met = nodes.select("fp", F.explode(masks).alias("mask")).select("fp", F.expr("fp ^ mask").alias("value"))
    if radius % 2:
        # an odd radius meets at up to half + half = radius + 1 bits: verify every pair of a value
        other = met.select(F.col("fp").alias("b"), "value")
        pairs = met.withColumnRenamed("fp", "a").join(other, "value").where("a > b")
    else:
        least = F.min("fp").over(Window.partitionBy("value"))
        pairs = met.select(F.col("fp").alias("a"), least.alias("b")).where("a <> b")
    return pairs.where(F.expr(f"bit_count(a ^ b) <= {radius}")).select("a", "b").distinct()


def simhash_components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, label, component_id): label names a component even where all its ids are null."""
    fps = checkpoint(fingerprints(docs))
    nodes = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(link_fingerprints(nodes.select("fp"), radius))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "rep", F.coalesce("root", "fp").alias("label")
    )
    ids = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.select("fp", "label").join(ids, "label")
    return fps.join(named, "fp").select("doc_id", "fp", "label", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest reachable doc_id)."""
    return simhash_components(docs, radius).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` with one row of each component: that of its smallest doc_id.

    Rows that repeat an id are told apart by their text: of several rows with the id that names a component
    the first by all columns stays.  A component in which no row has an id keeps its rows of the smallest
    fingerprint, equal ones once.
    """
    cols = [F.col(f"`{c}`") for c in docs.columns]
    found = simhash_components(docs, radius)
    named = found.where("doc_id = component_id").select("doc_id").distinct()
    nameless = found.where("component_id is null and fp = label").select("fp").distinct()
    # the row travels as one column, so no name of it can clash
    packed = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*cols).alias("row"), F.array(*[c.cast("string") for c in cols]).alias("order"))
    kept = packed.join(named.withColumnRenamed("doc_id", "id"), "id", "left_semi")
    kept = kept.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("order"))).where("place = 1").select("row.*")
    without = docs.where("doc_id is null")
    if nameless.isEmpty():
        return kept
    own = without.withColumn("__row", F.struct(*cols)).select("__row", F.col("text").cast("string").alias("text")).mapInArrow(
        _with_fingerprint, T.StructType([T.StructField("__row", docs.select(F.struct(*cols).alias("r")).schema["r"].dataType), T.StructField("fp", T.LongType())])
    )
    rest = own.join(nameless, "fp", "left_semi").groupBy("fp").agg(F.min_by("__row", F.to_json("__row")).alias("__row"))
    return kept.unionByName(rest.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns]))


def _with_fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = np.array([fingerprint(x) for x in batch.column(1).cast(pa.large_binary()).to_pylist()], "<u8").view("<i8")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["__row", "fp"])


def shingle_set(text: str | bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the stage's shingles; no word: none."""
    parts = list(shingle_hashes(text, STAGE_SHINGLE))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, "<u8")


def set_key(found: np.ndarray) -> bytes:
    return hashlib.md5(found.tobytes()).digest()


def prefix(found: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 of a set: rare ones by hash, then those of ``common`` (sorted) by ``rank``."""
    n = len(found)
    if not n:
        return found
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        found = found[np.lexsort((found, np.where(common[at] == found, rank[at], 0)))]
    return found[: n - (ALIKE * n + OF - 1) // OF + 1]


def _plain(docs: DataFrame) -> DataFrame:
    """doc_id, text and a number of the text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tx"))


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of shingles that several rows of a sample have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for x in batch.column(0).cast(pa.large_binary()).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(x).view("<i8"), pa.int64())], ["h"])

    share = min(1.0, max(SAMPLE_SHARE, SAMPLE_ROWS / max(1, docs.count())))
    some = docs.select(F.col("text").cast("string").alias("text")).sample(share, SEED)
    often = some.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= COMMON)
    got = often.orderBy(F.desc("count"), "h").limit(MAX_COMMON).toArrow()
    h, n = got["h"].to_numpy().view("<u8"), got["count"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def shingle_nodes(docs: DataFrame) -> DataFrame:
    """A row for each distinct set of shingles: node, key, n, fp, prefix, rep (of its smallest doc_id, nulls last)."""
    common, rank = common_shingles(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(x) for x in batch.column(1).cast(pa.large_binary()).to_pylist()]
            fp = np.array([majority([x]) for x in sets], "<u8").view("<i8")
            first = [prefix(x, common, rank).view("<i8") for x in sets]
            columns = [pa.array([set_key(x) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array(fp, pa.int64()), pa.array(first, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["doc_id", "tx", "key", "n", "fp", "prefix"])

    rows = _plain(docs).mapInArrow(run, "doc_id long, tx long, key binary, n long, fp long, prefix array<long>")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "tx")).alias("rep")
    nodes = rows.groupBy("key").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("prefix").alias("prefix"), rep)
    return checkpoint(nodes.withColumn("node", F.monotonically_increasing_id()))


def alike(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets have a Jaccard similarity of 0.8 or more."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            for x, tx in zip(batch.column(0).cast(pa.large_binary()).to_pylist(), batch.column(1).to_pylist()):
                if tx not in seen:
                    seen.add(tx)
                    found = shingle_set(x)
                    # the text packs into a third of its set of hashes, and gives it again
                    yield pa.RecordBatch.from_arrays([pa.array([set_key(found)], pa.binary()), pa.array([zstandard.compress(x or b"")], pa.binary())], ["key", "packed"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacked = lru_cache(64)(lambda packed: shingle_set(zstandard.decompress(packed)))
        for batch in slices(batches):
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = unpacked(x), unpacked(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(OF * both >= ALIKE * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    asked = checkpoint(nodes.join(asked, "node", "left_semi").select("node", "key", F.col("rep.tx").alias("tx")))
    picked = asked.select("tx").distinct()
    picked = F.broadcast(picked) if asked.count() <= BROADCAST_ROWS else picked
    own = _plain(docs).join(picked, "tx", "left_semi").select("text", "tx").mapInArrow(sets, "key binary, packed binary")
    own = checkpoint(own.groupBy("key").agg(F.first("packed").alias("packed")).join(asked, "key").select("node", "packed"))
    both = pairs.join(own.select(F.col("node").alias("a"), F.col("packed").alias("x")), "a").join(own.select(F.col("node").alias("b"), F.col("packed").alias("y")), "b")
    return checkpoint(both.select("a", "b", "x", "y").mapInArrow(verified, "a long, b long"))


#: What two sets can share at most, when this is the first shingle they have in common.
NEAR = f"least(n - i, n2 - i2) * {ALIKE + OF} >= {ALIKE} * (n + n2)"


def _release(df: DataFrame) -> None:
    """Let Spark remove the shuffles and checkpoints that nothing refers to any more; they fill the disk."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def shared_shingles(nodes: DataFrame) -> DataFrame:
    """(h, node, n, i) for every shingle h that the prefixes of several nodes hold, i its place in them."""
    held = nodes.select("node", "n", F.posexplode("prefix").alias("i", "h"))
    # a window, which spills, instead of a list of all that hold a common shingle
    held = held.withColumn("holders", F.count("*").over(Window.partitionBy("h"))).where("holders > 1")
    return checkpoint(held.select("h", "node", "n", "i"))


def star_pairs(nodes: DataFrame, shared: DataFrame) -> DataFrame:
    """(a, b): each member of a ball or of a shared shingle with the lead of it.

    The lead of a shingle is the holder that has the fewest rarer ones before it: copies differ by their rare
    shingles, so of a group of near copies it is the one nearest to what all were copied from, and most others
    are similar to it, where a holder taken at random can lie too far from most.
    """
    lead = nodes.groupBy("fp").agg(F.min("node").alias("node"))
    same = nodes.join(lead.withColumnRenamed("node", "b"), "fp").select(F.col("node").alias("a"), "b")
    balls = link_fingerprints(nodes.select("fp").distinct())
    balls = balls.join(lead.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(lead.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b")
    first = F.min(F.struct("i", "node", "n")).over(Window.partitionBy("h"))
    stars = shared.withColumn("c", first).select("node", "n", "i", F.col("c.node").alias("b"), F.col("c.n").alias("n2"), F.col("c.i").alias("i2")).where(NEAR)
    pairs = same.unionByName(balls.select(F.col("x").alias("a"), F.col("y").alias("b"))).unionByName(stars.select(F.col("node").alias("a"), "b"))
    return checkpoint(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def cross_pairs(shared: DataFrame, roots: DataFrame, tried: DataFrame) -> DataFrame:
    """(a, b): all other pairs that share a shingle and differ in component.

    One of two holders in different components lies outside the shingle's largest one, so only those outside
    are joined with all: a group of copies that is linked already is not compared with itself again.  Copies
    share whole runs of shingles, and meet at the first of a run only: if one of the last few before h in one
    set is among those of the other, both hold it, so they meet there or earlier.  Nothing is before the first
    shingle that two sets share, so each pair meets.
    """
    named = shared.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    sizes = named.groupBy("h", "label").count().groupBy("h")
    mixed = sizes.agg(F.count("*").alias("labels"), F.max_by("label", F.struct("count", "label")).alias("main")).where("labels > 1").select("h", "main")
    order = Window.partitionBy("node").orderBy("i")
    last = [F.lag("h", k).over(order).alias(f"p{k}") for k in range(1, BEFORE + 1)]
    held = checkpoint(named.join(mixed, "h").select("h", "node", "n", "i", "label", "main", *last))
    others = [F.col(f"p{k}").alias(f"q{k}") for k in range(1, BEFORE + 1)]
    outside = held.where("label <> main").select("h", F.col("node").alias("b"), F.col("n").alias("n2"), F.col("i").alias("i2"), F.col("label").alias("label2"), *others)
    met_before = " or ".join(f"coalesce(p{k} in ({', '.join(f'q{j}' for j in range(1, BEFORE + 1))}), false)" for k in range(1, BEFORE + 1))
    met = held.join(outside, "h").where(f"label <> label2 and (label = main or node > b) and {NEAR} and not ({met_before})")
    rest = met.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()
    return checkpoint(rest.join(tried, ["a", "b"], "left_anti"))


def similar_components(docs: DataFrame) -> DataFrame:
    """(node, rep, label) for every node, label the smallest node linked to it."""
    nodes = shingle_nodes(docs)
    _release(docs)
    shared = shared_shingles(nodes)
    _release(docs)
    tried = star_pairs(nodes, shared)
    _release(docs)
    roots = checkpoint(components(alike(docs, nodes, tried)))
    _release(docs)
    # what is joined already needs no further pair
    rest = cross_pairs(shared, roots, tried)
    del shared, tried
    _release(docs)
    if not rest.isEmpty():
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(alike(docs, nodes, rest))
        del rest
        _release(docs)
        roots = checkpoint(components(links))
        del links
        _release(docs)
    found = checkpoint(nodes.join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("label")))
    del nodes, roots
    _release(docs)
    return found


def keep_one_similar(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one row of each component of similar texts: that of its smallest doc_id.

    Of several rows with that id and text the first by all columns stays; a component in which no row has
    an id keeps one row too.  Texts without a word are equal.
    """
    cols = [F.col(f"`{c}`") for c in docs.columns]
    best = similar_components(docs).groupBy("label").agg(F.min("rep").alias("rep"))
    best = best.select(F.col("rep.doc_id").alias("__id"), F.col("rep.tx").alias("__tx"))
    # the row travels as one column, so no name of it can clash
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("tx"), F.struct(*cols).alias("row"))
    rows = rows.join(best, (F.col("tx") == F.col("__tx")) & F.col("id").eqNullSafe(F.col("__id")), "left_semi")
    order = Window.partitionBy("tx", "id").orderBy(F.array(*[F.col("row").getField(c).cast("string") for c in docs.columns]))
    return rows.withColumn("place", F.row_number().over(order)).where("place = 1").select("row.*")
