"""Mixing sources to target weights by Sainte-Laguë apportionment (DataFrame functions only).

1. Sizes per (source, fine shard): one aggregate over all documents, 4,096 cells a source and more where a
   cell would hold over 1,024 rows, so a source that holds a third of all rows is already spread before anything
   is joined, and shards follow its size.  Rows without a doc_id are dealt by their text.
2. Targets by water filling: sources by weight, stopping at ``limit`` times a source's size.
3. Equal blocks of ``block`` words are given to sources by the highest quotients target / (2 j + 1),
   and within a source to its shards in the same way: integer quotas per shard.
4. In each shard the documents form a line in seeded order, cut into blocks.  A quota of q among n
   blocks takes block j floor((j+1) q + phase) / n) - floor((j q + phase) / n) times, with a seeded
   phase; what a document gives is counted in closed form, so no block is ever materialised.

Only the table of sources is ordered as a whole; documents meet in shards of bounded size.

Defined cases: null and empty texts have size 0 and are taken 0 times; texts of any length count whole; rows
with one doc_id, source and size (and text, where the id is null) are mixed alike; columns other than doc_id,
text and source are not read and may have any name; a null source is a source of its own, last
in order; an empty table gives no rows; repeated rows are rows of their own; a source without words
has target 0.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm.common import checkpoint, seeded_hash, word_count

FINE_BITS = 12
CELL_ROWS = 1024
SHARD_WORDS = 65536
BLOCK = 4
SEED = "mix"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2


def sainte_lague(rows: DataFrame, group: list[str], keys: list[str], weight: str, seats: str) -> DataFrame:
    """Adds ``quota``: ``seats`` (the same in a group) dealt to rows by highest quotients weight / (2 j + 1).

    Rounding seats * weight / total gives nearly all; only the quotients next to the boundary are
    listed and ranked, some for each row, ties by ``keys``.
    """
    w = Window.partitionBy(*group)
    rows = rows.withColumns({"__n": F.count("*").over(w), "__w": F.sum(F.col(weight).cast("double")).over(w)})
    share = F.when(F.col("__w") > 0, F.col(seats) * F.col(weight).cast("double") / F.col("__w")).otherwise(0.0)
    rows = rows.withColumn("__p", share).withColumn("__a", F.floor(F.col("__p") + 0.5))
    rows = rows.withColumn("__d", F.abs(F.col(seats) - F.sum("__a").over(w)) + F.col("__n"))
    near = F.when(F.col(seats) > 0, F.ceil(F.col("__p") * F.col("__d") / F.col(seats))).otherwise(F.lit(0)) + 2
    rows = rows.withColumn("__m", near).withColumn("__base", F.greatest(F.lit(0), F.col("__a") - F.col("__m")))
    rows = rows.withColumn("__open", F.col(seats) - F.sum("__base").over(w))
    quotients = rows.where(F.col(weight) > 0).select(
        *group, *keys, "__open", F.col(weight).cast("double").alias("__x"), F.explode(F.sequence(F.col("__base"), F.col("__a") + F.col("__m"))).alias("__j")
    )
    order = Window.partitionBy(*group).orderBy((F.col("__x") / (2 * F.col("__j") + 1)).desc(), *[F.col(k).asc_nulls_last() for k in keys], "__j")
    won = quotients.withColumn("__r", F.row_number().over(order)).where("__r <= __open")
    won = won.groupBy(*group, *keys).agg(F.count("*").alias("__won"))
    own = [*group, *keys]
    won = won.select(*[F.col(k).alias(f"__key_{k}") for k in own], "__won")
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in own])
    keep = [c for c in rows.columns if not c.startswith("__")]
    return rows.join(won, on, "left").select(*keep, (F.col("__base") + F.coalesce("__won", F.lit(0))).alias("quota"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """(source, source_size) -> also idx, weight and target, by water filling."""
    whole = Window.partitionBy()
    s = sources.withColumn("idx", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("idx") % len(weights) + 1))
    s = s.withColumn("__cap", F.col("source_size") * limit)
    s = s.withColumns({"__t": F.sum("source_size").over(whole) * share, "__ws": F.sum("weight").over(whole)})
    fill = Window.orderBy(F.col("__cap") / F.col("weight"), "idx").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"__bc": F.coalesce(F.sum("__cap").over(fill), F.lit(0)), "__bw": F.coalesce(F.sum("weight").over(fill), F.lit(0))})
    s = s.withColumn("__lam", (F.col("__t") - F.col("__bc")) / (F.col("__ws") - F.col("__bw")))
    level = F.min(F.when(F.col("__cap") > F.col("weight") * F.col("__lam"), F.struct(F.col("__cap") / F.col("weight"), "idx", "__lam"))).over(whole)
    s = s.withColumn("__level", level["__lam"])
    target = F.when(F.col("__level").isNull(), F.col("__cap").cast("double")).otherwise(F.least(F.col("__cap").cast("double"), F.col("weight") * F.col("__level")))
    return s.withColumn("target", target).select("source", "source_size", "idx", "weight", "target", F.col("__t").alias("total"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT, block: int = BLOCK, seed: str = SEED, keyed: bool = False) -> DataFrame:
    """doc_id, size, source, source_size, target, taken for every row of ``docs``.

    With ``keyed`` also key, a hash of the text that tells apart rows without a doc_id.
    """
    # more cells for more rows, so that a cell holds about CELL_ROWS of them at any size
    fine_bits = min(30, max(FINE_BITS, (docs.count() // CELL_ROWS).bit_length()))
    fine = 1 << fine_bits
    place = F.when(F.col("doc_id").isNull(), F.concat(F.lit("text "), F.xxhash64(F.col("text").cast("string")).cast("string"))).otherwise(F.col("doc_id").cast("string"))
    sized = docs.select(
        F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
        (seeded_hash(place, seed=f"{seed}-shard") % fine).alias("fine"),
        *([_row_key().alias("key")] if keyed else []),
    )
    more = ["key"] if keyed else []
    sums = checkpoint(sized.groupBy("source", "fine").agg(F.sum("size").alias("words")))
    sources = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, limit)
    sources = sources.withColumn("seats", F.floor(F.col("total") / block + 0.5))
    sources = sainte_lague(sources, [], ["idx", "source"], "target", "seats").withColumnRenamed("quota", "source_quota")
    bits = F.coalesce(F.floor(F.log2(F.col("source_size") / float(SHARD_WORDS))), F.lit(0))
    sources = sources.withColumn("shards", F.call_function("shiftleft", F.lit(1), F.least(F.lit(fine_bits), F.greatest(F.lit(0), bits)).cast("int")))
    sources = checkpoint(sources.select("source", "source_size", "target", "source_quota", "shards"))
    s = sources.withColumnRenamed("source", "__source")
    places = sums.join(s, F.col("source").eqNullSafe(F.col("__source"))).drop("__source").withColumn("shard", F.col("fine") % F.col("shards"))
    shards = places.groupBy("source", "shard", "source_quota").agg(F.sum("words").alias("shard_words"))
    shards = sainte_lague(shards, ["source"], ["shard"], "shard_words", "source_quota")
    shards = shards.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("shard_words") / block)))
    shards = shards.withColumn("quota", F.least(F.col("quota"), F.col("blocks") * limit))
    phase = seeded_hash(F.coalesce("source", F.lit("")), F.col("shard"), seed=f"{seed}-phase") % F.col("blocks")
    q = shards.select(F.col("source").alias("__source"), F.col("shard").alias("__shard"), "quota", "blocks", phase.alias("phase"))
    places = places.join(q, F.col("source").eqNullSafe(F.col("__source")) & (F.col("shard") == F.col("__shard")))
    places = checkpoint(places.select(F.col("source").alias("__source"), F.col("fine").alias("__fine"), "source_size", "target", "shard", "quota", "blocks", "phase"))
    rows = sized.join(places, F.col("source").eqNullSafe(F.col("__source")) & (F.col("fine") == F.col("__fine")))
    line = Window.partitionBy("source", "shard").orderBy(F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), F.col("doc_id").cast("string"))), "doc_id", "size", *more).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__s", F.coalesce(F.sum("size").over(line), F.lit(0)))
    start, end, b = F.col("__s"), F.col("__s") + F.col("size"), F.lit(block).cast("long")
    first, last = _div(start, b), _div(end - 1, b)
    before = lambda j: _div(j * F.col("quota") + F.col("phase"), F.col("blocks"))
    times = lambda j: before(j + 1) - before(j)
    taken = (
        F.when(F.col("size") == 0, F.lit(0))
        .when(first == last, times(first) * F.col("size"))
        .otherwise(times(first) * ((first + 1) * b - start) + b * (before(last) - before(first + 1)) + times(last) * (end - last * b))
    )
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *more)


def _row_key() -> Column:
    return F.when(F.col("doc_id").isNull(), F.xxhash64(F.col("text").cast("string"))).otherwise(F.lit(0)).cast("long")


def mixed_documents(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: whole documents, taken / size times each.

    A broken number of times is rounded up or down by a seeded number of the document, so that the
    words of a source stay near its target; documents without a word are left out.
    """
    got = mix(docs, seed=seed, keyed=True, **how)
    got = got.where("taken > 0").groupBy("doc_id", "source", "size", "key").agg(F.max("taken").alias("taken"))
    times = F.col("taken") / F.col("size")
    luck = seeded_hash(F.col("doc_id"), F.col("key"), seed=f"{seed}-copies") / float(1 << 32)
    got = got.withColumn("times", (F.floor(times) + F.when(luck < times - F.floor(times), 1).otherwise(0)).cast("int")).where("times > 0")
    got = got.select(F.col("doc_id").alias("id"), F.col("source").alias("src"), F.col("size").alias("n"), F.col("key").alias("k"), "times")
    # the row travels as one column, so no name of it can clash
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), _row_key().alias("key"))
    on = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("src")) & (F.col("size") == F.col("n")) & (F.col("key") == F.col("k"))
    return rows.join(got, on).select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def mix_query(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


#: The same rows by DuckDB; one statement, no sampling.
MIX_SQL = """
WITH sized AS MATERIALIZED (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         ('0x' || substr(md5('mix-shard:' || doc_id::VARCHAR), 1, 8))::BIGINT % 4096 AS fine
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ix AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx FROM src),
wt AS (SELECT *, CASE idx % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, source_size * 2 AS cap,
              (sum(source_size) OVER ())::DOUBLE * 1.5 AS total FROM ix),
fl AS (SELECT *, sum(weight) OVER () AS ws,
              coalesce(sum(cap) OVER f, 0) AS bc, coalesce(sum(weight) OVER f, 0) AS bw
       FROM wt WINDOW f AS (ORDER BY cap / weight, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lm AS (SELECT *, (total - bc::DOUBLE) / (ws - bw)::DOUBLE AS lam FROM fl),
lv AS (SELECT *, first_value(CASE WHEN cap > weight * lam THEN lam END) OVER (
              ORDER BY CASE WHEN cap > weight * lam THEN 0 ELSE 1 END, cap / weight, idx) AS lev FROM lm),
tg AS MATERIALIZED (SELECT source, source_size, idx, CASE WHEN lev IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, weight * lev) END AS target,
              CAST(floor(total / 4 + 0.5) AS BIGINT) AS seats FROM lv),
sp AS (SELECT *, CASE WHEN sum(target) OVER () > 0 THEN seats * target / sum(target) OVER () ELSE 0 END AS p FROM tg),
sq AS (SELECT idx, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, idx, j) AS r, seats
       FROM (SELECT idx, target, seats, unnest(range(0, CAST(floor(p) AS BIGINT) + 64)) AS j FROM sp WHERE target > 0)),
so AS (SELECT tg.*, coalesce(n, 0) AS squota,
              1 << CAST(least(12, greatest(0, coalesce(floor(log2(CASE WHEN source_size > 0 THEN source_size / 65536.0 END)), 0))) AS INTEGER) AS shards
       FROM tg LEFT JOIN (SELECT idx, count(*) AS n FROM sq WHERE r <= seats GROUP BY idx) USING (idx)),
dx AS MATERIALIZED (SELECT s.doc_id, s.size, so.*, s.fine % so.shards AS shard FROM sized s JOIN so ON s.source IS NOT DISTINCT FROM so.source),
sh AS (SELECT idx, shard, any_value(source) AS source, any_value(squota) AS squota, CAST(sum(size) AS BIGINT) AS words FROM dx GROUP BY idx, shard),
hp AS (SELECT *, CASE WHEN sum(words) OVER (PARTITION BY idx) > 0 THEN squota * words::DOUBLE / (sum(words) OVER (PARTITION BY idx))::DOUBLE ELSE 0 END AS p FROM sh),
hq AS (SELECT idx, shard, row_number() OVER (PARTITION BY idx ORDER BY words::DOUBLE / (2 * j + 1) DESC, shard, j) AS r, squota
       FROM (SELECT idx, shard, words, squota, unnest(range(0, CAST(floor(p) AS BIGINT) + 64)) AS j FROM hp WHERE words > 0)),
qt AS (SELECT sh.*, greatest(1, CAST(ceil(words / 4.0) AS BIGINT)) AS blocks, coalesce(n, 0) AS q0
       FROM sh LEFT JOIN (SELECT idx, shard, count(*) AS n FROM hq WHERE r <= squota GROUP BY idx, shard) USING (idx, shard)),
qs AS (SELECT idx, shard, blocks, least(q0, 2 * blocks) AS quota,
              ('0x' || substr(md5('mix-phase:' || coalesce(source, '') || ':' || shard::VARCHAR), 1, 8))::BIGINT % blocks AS phase FROM qt),
ln AS (SELECT dx.doc_id, dx.size, dx.source_size, dx.target, quota, blocks, phase,
              CAST(coalesce(sum(dx.size) OVER (PARTITION BY dx.idx, dx.shard ORDER BY md5('mix-order:' || dx.doc_id::VARCHAR), dx.doc_id, dx.size
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s
       FROM dx JOIN qs ON dx.idx = qs.idx AND dx.shard = qs.shard),
bl AS (SELECT *, s // 4 AS f, (s + size - 1) // 4 AS l FROM ln)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size = 0 THEN 0
  WHEN f = l THEN (((f + 1) * quota + phase) // blocks - (f * quota + phase) // blocks) * size
  ELSE (((f + 1) * quota + phase) // blocks - (f * quota + phase) // blocks) * ((f + 1) * 4 - s)
     + 4 * ((l * quota + phase) // blocks - ((f + 1) * quota + phase) // blocks)
     + (((l + 1) * quota + phase) // blocks - (l * quota + phase) // blocks) * (s + size - l * 4) END AS BIGINT) AS taken
FROM bl
"""
