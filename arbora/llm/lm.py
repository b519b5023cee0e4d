"""Stupid-backoff scores of documents under the corpus's own n-gram counts.

The count tables of 1-, 2- and 3-grams are hash-partitioned and joined to the exploded n-grams of the
documents, summed per document.  To keep the shuffles small the tables and the joins work on blobs:
a block of documents explodes its n-grams, counts them (map-side), and sends each hash range its
sorted distinct hashes with counts; the range adds up the counts of all blocks and answers in order.
All counts cover all documents.  3-grams are sent after the 2-grams are known: one whose two 2-grams
don't both occur in other documents can't occur there itself, so its count need not be asked for.

A document is scored by the counts of all other documents (its own are taken off), with words
lower-cased A-Z and split at \\x20 and \\x09-\\x0D: c(abc) / c(ab) where it occurs elsewhere, else
``ALPHA`` times c(bc) / c(b), else once more ``ALPHA`` times c(c) / N, else once more ``ALPHA`` over N + 1.
The first two words of a text start at the order that their history allows.

Defined cases: null and empty texts have 0 words and score 0; documents with the same doc_id are scored
each for itself; equal texts in other rows count as other documents; a null doc_id stays null; texts of any length
are read whole, a block is as large as its largest; an empty table gives no rows; columns other than doc_id and text
are not read and may have any name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import word_count
from arbora.llm.packing import MIX1, MIX2, bucket_edges, mixed, pack_counts, pack_sorted, sized_blocks, unpack_counts, unpack_sorted

ALPHA = 0.4
BLOCK_BYTES = 6_000_000
BUCKET_ENTRIES = 1_500_000
PER_BYTE = 0.3
ORDERS = (1, 2, 3)


def exploded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """(document index, position in it, order -> hashes) of all words of a block.

    The hash of order n at a word is that of the n words ending there; valid from position n - 1 on.
    """
    vocab: dict[bytes, int] = defaultdict(lambda: len(vocab))
    parts, sizes = [], []
    for t in texts:
        words = t.lower().split()
        sizes.append(len(words))
        parts.append(np.fromiter(map(vocab.__getitem__, words), np.int64, len(words)))
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    sizes = np.array(sizes, np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    pos = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    of_word = np.array([xxhash.xxh64_intdigest(w, 1) for w in vocab], np.uint64) if vocab else np.zeros(0, np.uint64)
    h1 = of_word[ids] if len(ids) else np.zeros(0, np.uint64)
    h2, h3 = np.zeros_like(h1), np.zeros_like(h1)
    h2[1:] = mixed(h1[:-1] * MIX1 + h1[1:])
    h3[2:] = mixed(h2[1:-1] * MIX2 + h1[2:] * MIX1)
    return doc, pos, {1: h1, 2: h2, 3: h3}


def elsewhere(doc: np.ndarray, gram: np.ndarray, ok: np.ndarray, totals: np.ndarray, n_docs: int) -> np.ndarray:
    """For every word, how often its n-gram occurs in other documents (0 where not in ``ok``)."""
    out = np.zeros(len(doc), np.int64)
    if len(ok):
        _, inv = np.unique(gram[ok], return_inverse=True)
        _, own_inv, own = np.unique(inv * n_docs + doc[ok], return_inverse=True, return_counts=True)
        out[ok] = totals[inv] - own[own_inv]
    return out


def candidates(pos: np.ndarray, t2: np.ndarray) -> np.ndarray:
    """Words whose 3-gram can occur elsewhere: both of its 2-grams do (all others surely count 0)."""
    return np.flatnonzero((pos >= 2) & (t2 > 0) & (np.concatenate([[0], t2[:-1]]) > 0)) if len(pos) else np.zeros(0, np.int64)


def scored(doc: np.ndarray, pos: np.ndarray, left: dict[int, np.ndarray], n_docs: int, words: int, alpha: float) -> tuple[np.ndarray, ...]:
    """Per document: words, words scored at order 3, 2, 1 and 0, sum of log scores."""
    size = np.bincount(doc, minlength=n_docs)
    rest = (words - size)[doc].astype(float)
    t1, t2, t3 = (left[n].astype(float) for n in ORDERS)
    prev = lambda a: np.concatenate([[0.0], a[:-1]])
    start = np.minimum(pos, 2) + 1
    used = np.where((pos >= 2) & (t3 > 0), 3, np.where((pos >= 1) & (t2 > 0), 2, np.where(t1 > 0, 1, 0)))
    top = np.choose(used, [np.ones_like(t1), t1, t2, t3])
    under = np.choose(used, [rest + 1, rest, prev(t1), prev(t2)])
    logs = np.log(top) - np.log(under) + (start - used) * np.log(alpha)
    by = [np.bincount(doc, used == u, minlength=n_docs).astype(np.int64) for u in (3, 2, 1, 0)]
    return (size, *by, np.bincount(doc, logs, minlength=n_docs))


def lm_scores(docs: DataFrame, alpha: float = ALPHA, block_bytes: int = BLOCK_BYTES, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """doc_id, n_words, n3, n2, n1, n0 (words by the order that scored them), log_score."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blocks, bits, (words,) = sized_blocks(rows, block_bytes, PER_BYTE, bucket_entries, F.sum(word_count(F.col("text"))))
    words = int(words or 0)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = [press.compress(t) for t in batch.column(2).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], ["doc_id", "block", "text"])

    # texts are shuffled once and read by three steps: compressed better than the shuffle would
    rows = rows.select("doc_id", "block", "text").mapInArrow(squeeze, "doc_id long, block int, text binary")

    def texts_of(table: pa.Table) -> list[bytes]:
        open_ = zstandard.ZstdDecompressor()
        return [open_.decompress(t) for t in table["text"].to_pylist()]

    def blobs(block: int, grams: dict[int, np.ndarray]) -> pa.Table:
        """What a block sends: per order and bucket the sorted distinct hashes and their counts."""
        out: dict[str, list] = {"bucket": [], "n": [], "block": [], "hashes": [], "counts": []}
        for n, gram in grams.items():
            h, c = np.unique(gram, return_counts=True)
            edges = bucket_edges(h, bits)
            for b in np.flatnonzero(np.diff(edges)):
                x, y = edges[b], edges[b + 1]
                for k, v in zip(out, (int(b), n, block, pack_sorted(h[x:y]), pack_counts(c[x:y]))):
                    out[k].append(v)
        return pa.table([pa.array(out["bucket"], pa.int32()), pa.array(out["n"], pa.int32()), pa.array(out["block"], pa.int32()), pa.array(out["hashes"], pa.binary()), pa.array(out["counts"], pa.binary())], list(out))

    def told(answers: pa.Table, n: int) -> np.ndarray:
        got = sorted((b, raw) for m, b, raw in zip(answers["n"].to_pylist(), answers["bucket"].to_pylist(), answers["totals"].to_pylist()) if m == n)
        return np.concatenate([unpack_counts(raw) for _, raw in got]) if got else np.zeros(0, np.int64)

    def send(table: pa.Table) -> pa.Table:
        _, pos, grams = exploded(texts_of(table))
        return blobs(table["block"][0].as_py(), {n: grams[n][pos >= n - 1] for n in (1, 2)})

    def send_three(table: pa.Table, answers: pa.Table) -> pa.Table:
        doc, pos, grams = exploded(texts_of(table))
        t2 = elsewhere(doc, grams[2], np.flatnonzero(pos >= 1), told(answers, 2), len(table))
        return blobs(table["block"][0].as_py(), {3: grams[3][candidates(pos, t2)]})

    def add(table: pa.Table) -> pa.Table:
        hashes = [unpack_sorted(x.as_py()) for x in table["hashes"]]
        counts = np.concatenate([unpack_counts(x.as_py()) for x in table["counts"]])
        every = np.concatenate(hashes)
        order = np.argsort(every, kind="stable")
        new = np.ones(len(every), bool)
        new[1:] = every[order][1:] != every[order][:-1]
        sums = np.add.reduceat(counts[order], np.flatnonzero(new))
        total = np.empty(len(every), np.int64)
        total[order] = sums[np.cumsum(new) - 1]
        cuts = np.cumsum([len(h) for h in hashes])[:-1]
        return pa.table([table["block"], table["n"], table["bucket"], pa.array([pack_counts(t) for t in np.split(total, cuts)], pa.binary())], ["block", "n", "bucket", "totals"])

    def receive(table: pa.Table, answers: pa.Table) -> pa.Table:
        doc, pos, grams = exploded(texts_of(table))
        left = {n: elsewhere(doc, grams[n], np.flatnonzero(pos >= n - 1), told(answers, n), len(table)) for n in (1, 2)}
        left[3] = elsewhere(doc, grams[3], candidates(pos, left[2]), told(answers, 3), len(table))
        made = scored(doc, pos, left, len(table), words, alpha)
        return pa.table([table["doc_id"], *[pa.array(x, pa.int64()) for x in made[:-1]], pa.array(made[-1], pa.float64())], ["doc_id", "n_words", "n3", "n2", "n1", "n0", "log_score"])

    def counted(sent: DataFrame) -> DataFrame:
        return sent.groupBy("bucket", "n").applyInArrow(add, "block int, n int, bucket int, totals binary")

    blob = "bucket int, n int, block int, hashes binary, counts binary"
    low = counted(rows.groupBy("block").applyInArrow(send, blob))
    high = counted(rows.groupBy("block").cogroup(low.where("n = 2").groupBy("block")).applyInArrow(send_three, blob))
    return (
        rows.groupBy("block").cogroup(low.unionByName(high).groupBy("block"))
        .applyInArrow(receive, "doc_id long, n_words long, n3 long, n2 long, n1 long, n0 long, log_score double")
    )


def lm_query(docs: DataFrame) -> DataFrame:
    return lm_scores(docs).withColumn("log_score", F.round("log_score", 4))


#: The same rows by DuckDB.
LM_SQL = """
WITH t AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
e AS (SELECT rid, unnest(ws) AS c, generate_subscripts(ws, 1) AS i FROM t),
g AS MATERIALIZED (SELECT rid, i, c, lag(c, 1) OVER w AS b, lag(c, 2) OVER w AS a FROM e WINDOW w AS (PARTITION BY rid ORDER BY i)),
own AS (SELECT g.*,
    count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY rid, c) AS t1,
    count(*) OVER (PARTITION BY b, c) - count(*) OVER (PARTITION BY rid, b, c) AS t2,
    count(*) OVER (PARTITION BY a, b, c) - count(*) OVER (PARTITION BY rid, a, b, c) AS t3,
    (SELECT count(*) FROM e) - count(*) OVER (PARTITION BY rid) AS n FROM g),
ctx AS (SELECT *, lag(t1) OVER w AS p1, lag(t2) OVER w AS p2 FROM own WINDOW w AS (PARTITION BY rid ORDER BY i)),
u AS (SELECT *, least(i, 3) AS st, CASE WHEN i >= 3 AND t3 > 0 THEN 3 WHEN i >= 2 AND t2 > 0 THEN 2 WHEN t1 > 0 THEN 1 ELSE 0 END AS o FROM ctx),
s AS (SELECT rid, o, (CASE o WHEN 3 THEN ln(t3) - ln(p2) WHEN 2 THEN ln(t2) - ln(p1) WHEN 1 THEN ln(t1) - ln(n) ELSE -ln(n + 1) END) + (st - o) * ln(0.4) AS l FROM u)
SELECT t.doc_id, CAST(count(o) AS BIGINT) AS n_words, CAST(count(*) FILTER (o = 3) AS BIGINT) AS n3, CAST(count(*) FILTER (o = 2) AS BIGINT) AS n2,
    CAST(count(*) FILTER (o = 1) AS BIGINT) AS n1, CAST(count(*) FILTER (o = 0) AS BIGINT) AS n0, round(coalesce(sum(l), 0), 4) AS log_score
FROM t LEFT JOIN s USING (rid) GROUP BY t.rid, t.doc_id
"""
