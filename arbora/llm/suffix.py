"""Removal of repeated byte passages by difference-cover suffix sorting, distributed by content.

A window is a string of ``LENGTH`` bytes inside one document.  Every byte covered by a window that also
starts earlier (smaller doc_id, or same document and earlier start) is removed.

Distribution.  The smallest-hash ``GRAM``-byte string inside a window (the leftmost of equals) is its
anchor.  Equal windows have equal anchors at equal distance, so suffixes can be dealt out by anchor and
compared there only.  Consecutive windows with one anchor form a run, one string.

1. Blocks of documents send each hash range their distinct anchors and how many runs have them.
2. A range adds up and answers for each anchor: one run only (none of its windows repeats: equal windows
   of one run would have their anchor at different distances), several, or very many.
3. Runs of anchors with several runs are dealt out by anchor, those that are equal inside a block once.
   Anchors with very many runs are split: their windows go by distance from the anchor, a few starts
   together, and by a hash of the bytes that these windows share.
4. Each part takes equal strings together (their bytes, not hashes, are compared), suffix-sorts the
   distinct ones (DC3): sort triples at positions 1 and 2 mod 3, name them, recurse on the names until
   they differ, sort the rest by first byte and the rank behind it, merge; then neighbours in the suffix
   array are compared on their first ``LENGTH`` bytes.  All but the earliest of equal windows are reported.
5. Blocks cut the covered bytes.

Hashes only decide where strings meet: what is removed has been compared byte by byte.  The steps are one
lazy chain; blocks derive their runs once and get them back with the answers.  There is at most one blob
per block and range, and never more blobs than anchors in them, so their number stays linear.

Defined cases: null text is empty (0 bytes, hash of nothing); texts of any length are cut into overlapping
pieces for hashing, never shortened; rows with one doc_id count as documents in an order given by their
text; rows without a doc_id come last, in an order given by their text; equal rows repeat each other like
any others; an empty table gives no rows; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import sha256_hex
from arbora.llm.packing import MIX1, bucket_edges, mixed, pack_counts, pack_sorted, planes, sized_blocks, unpack_counts, unpack_sorted, unplanes

LENGTH = 100
GRAM = 32
PIECE = 1 << 20
BLOCK_BYTES = 6_000_000
BUCKET_ENTRIES = 400_000
HOT_RUNS = 5_000
HOT_STEP = 4
SORT_BYTES = 1_000_000
BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


# ---- suffix sorting ----


def ranked(triples: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, names from 1) of rows of three non-negative numbers, packed into one where they fit."""
    widths = [int(k.max()).bit_length() if len(k) else 0 for k in triples]
    if sum(widths) <= 63:
        one = triples[0] << (widths[1] + widths[2]) | triples[1] << widths[2] | triples[2]
        order = np.argsort(one)
        keys = [one]
    else:
        order = np.lexsort(triples[::-1])
        keys = triples
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new) + 1
    return order, names


def suffix_array(t: np.ndarray, depth: int = 1 << 62) -> np.ndarray:
    """Suffix array of positive numbers by the difference cover {1, 2} mod 3.

    Suffixes that agree on their first ``depth`` numbers may stand in any order.
    """
    n = len(t)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    s = np.concatenate([t, np.zeros(3, np.int64)])
    # a position n is sampled too if n mod 3 = 1, so that every rest has a ranked suffix behind it
    at = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    order, names = ranked([s[at], s[at + 1], s[at + 2]])
    if names.max() < len(at):
        if depth > 3:
            order = suffix_array(names, -(-depth // 3))
        names = np.empty(len(at), np.int64)
        names[order] = np.arange(1, len(at) + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[at] = names
    sampled = at[order]
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    rest = rest[np.lexsort((rank[rest + 1], s[rest]))]
    # merge: one total order by counting, for every rest, the sampled suffixes before it
    i, j = sampled, rest
    one = i % 3 == 1
    place = np.zeros(len(j), np.int64)
    # 1 mod 3 against 0 mod 3: (byte, rank behind); 2 mod 3: (byte, byte, rank two behind)
    for own, mine, other in (
        (i[one], [s[i[one]], rank[i[one] + 1]], [s[j], rank[j + 1]]),
        (i[~one], [s[i[~one]], s[i[~one] + 1], rank[i[~one] + 2]], [s[j], s[j + 1], rank[j + 2]]),
    ):
        o, _ = ranked([np.concatenate([a, b]) for a, b in zip([*mine, mine[0] * 0], [*other, other[0] * 0])][:3])
        is_rest = o >= len(own)
        before = np.cumsum(~is_rest)
        count = np.empty(len(j), np.int64)
        count[o[is_rest] - len(own)] = before[is_rest]
        place += count
    out = np.empty(n, np.int64)
    # suffixes that agree to the depth may be counted either way: keep the order of the rests
    slots = np.maximum.accumulate(place) + np.arange(len(j))
    taken = np.zeros(n, bool)
    taken[slots] = True
    out[slots] = j
    out[~taken] = i
    return out


def repeated(strings: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that occur more than once: (class of equal ones, string, offset)."""
    sizes = np.array([len(x) for x in strings])
    raw = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    begins = np.cumsum(sizes + 1) - sizes - 1
    t = raw.astype(np.int64) + 2
    t[begins + sizes] = 1  # a separator behind every string, so that no window runs on
    sa = suffix_array(t, length)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    offset = np.arange(len(t)) - begins[owner]
    sa = sa[offset[sa] + length <= sizes[owner[sa]]]  # whole windows only
    if len(sa) < 2:
        none = np.zeros(0, np.int64)
        return none, none, none
    windows = np.ndarray((len(raw) - length + 1,), f"V{length}", raw, strides=(1,))
    same = np.zeros(len(sa), bool)
    for at in range(1, len(sa), 20_000):
        w = windows[sa[at - 1 : at + 20_000 - 1 + 1]]
        same[at : at + len(w) - 1] = w[1:] == w[:-1]
    cls = np.cumsum(~same)
    many = np.bincount(cls)[cls] > 1
    return cls[many], owner[sa[many]], offset[sa[many]]


# ---- runs of windows ----


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i mod 2^64 for i < n at least."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, 2 * PIECE + 4096)
        p = np.full(m, BASE, np.uint64)
        q = np.full(m, pow(BASE, -1, 1 << 64), np.uint64)
        p[0] = q[0] = 1
        _powers[:] = [np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)]
    return _powers[0], _powers[1]


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours."""
    n = len(a) - w + 1
    pad = -len(a) % w
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    b = np.concatenate([a, np.full(pad, top, np.uint64)]).reshape(-1, w)
    left = np.minimum.accumulate(b, axis=1).reshape(-1)
    right = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def runs_of(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Runs of windows of all texts: doc, lo (first start), count, gap (anchor - lo), anchor (its hash, evenly spread)."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("doc", "lo", "count", "gap", "anchor")}
    # the same for every buffer: truncation must not change the order of two hashes
    bits = np.uint64((PIECE + 4096 + length).bit_length())
    batch: list[tuple[int, int, bytes]] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if not batch:
            return
        buf = np.frombuffer(b"".join(x for _, _, x in batch), np.uint8)
        n = len(buf)
        p, q = powers(n + 1)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[:n], out=prefix[1:], dtype=np.uint64)
        full = mixed((prefix[gram:] - prefix[:-gram]) * q[: n - gram + 1])
        packed = ((full >> bits) << bits) | np.arange(len(full), dtype=np.uint64)
        low = sliding_min(packed, length - gram + 1)
        anchor_at = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        sizes = np.array([len(x) for _, _, x in batch])
        ends = np.cumsum(sizes)
        piece = np.repeat(np.arange(len(sizes)), sizes)[: len(low)]
        start = np.flatnonzero(np.arange(len(low)) + length <= ends[piece])
        if len(start):
            new = np.ones(len(start), bool)
            new[1:] = (start[1:] != start[:-1] + 1) | (anchor_at[start[1:]] != anchor_at[start[:-1]]) | (piece[start[1:]] != piece[start[:-1]])
            first = np.flatnonzero(new)
            lo = start[first]
            count = np.diff(np.append(first, len(start)))
            gap = anchor_at[lo] - lo
            # minima crowd at the low end, so they are mixed once more before they choose a range
            anchor = mixed(full[anchor_at[lo]] * MIX1 + MIX1)
            where = np.array([b for _, b, _ in batch])[piece[lo]] - (ends - sizes)[piece[lo]]
            for k, v in zip(out, (np.array([d for d, _, _ in batch])[piece[lo]], lo + where, count, gap, anchor)):
                out[k].append(v)
        batch.clear()
        held = 0

    for d, text in enumerate(texts):
        for at in range(0, max(0, len(text) - length + 1), PIECE):
            part = text[at : at + PIECE + length - 1]
            if held + len(part) > PIECE + 4096:
                flush()
            batch.append((d, at, part))
            held += len(part)
    flush()
    return {k: np.concatenate(v) if v else np.zeros(0, np.uint64 if k == "anchor" else np.int64) for k, v in out.items()}


def pack_layout(runs: dict[str, np.ndarray], begins: np.ndarray, place: np.ndarray) -> bytes:
    """Runs of a block without their anchors, which are named by their place among the sorted distinct ones."""
    parts = [pack_sorted((begins[runs["doc"]] + runs["lo"]).astype(np.uint64)), pack_counts(runs["count"]), pack_counts(runs["gap"]), planes(place.astype(np.uint64), 4)]
    return np.array([len(p) for p in parts], "<u8").tobytes() + b"".join(parts)


def unpack_layout(raw: bytes, begins: np.ndarray) -> dict[str, np.ndarray]:
    edges = np.cumsum([32, *np.frombuffer(raw[:32], "<u8").astype(np.int64)])
    start, count, gap, place = (raw[a:b] for a, b in zip(edges, edges[1:]))
    at = unpack_sorted(start).astype(np.int64)
    doc = np.searchsorted(begins, at, "right") - 1
    return {"doc": doc, "lo": at - begins[doc], "count": unpack_counts(count), "gap": unpack_counts(gap), "place": unplanes(place, len(at), 4).astype(np.int64)}


def pieces_of_hot(text: bytes, lo: int, count: int, gap: int, length: int) -> list[tuple[int, int, int]]:
    """(first start, starts, hash) of a run cut by distance from its anchor, ``HOT_STEP`` starts at most.

    The hash is of distance and of the bytes that all windows of that distance range share, so equal
    windows get equal hashes, and strings that differ there part ways.
    """
    out, at, step = [], 0, min(HOT_STEP, length)
    while at < count:
        zone = (gap - at) // step
        m = min(count - at, gap - at - zone * step + 1)
        inner = lo + gap - zone * step
        out.append((lo + at, m, xxhash.xxh64_intdigest(text[inner : inner - step + 1 + length], zone)))
        at += m
    return out


def intervals(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rows (doc, first start, starts) of sorted window starts."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    return np.stack([doc[first], start[first], np.diff(np.append(first, len(doc)))], 1).astype(np.int64)


class Block:
    """Documents of a block in their order."""

    def __init__(self, table: pa.Table):
        ids = table["doc_id"].to_pylist()
        texts = table["text"].cast(pa.large_binary()).to_pylist()
        # ids stay below 2^62; rows without one follow by a hash of their text
        key = [x if x is not None else (1 << 62) + (xxhash.xxh64_intdigest(t) >> 3) for x, t in zip(ids, texts)]
        order = sorted(range(len(ids)), key=lambda i: (key[i], texts[i]))
        self.ids = [ids[i] for i in order]
        self.texts = [texts[i] for i in order]
        self.keys = np.array([key[i] for i in order], np.int64)
        # where each document begins; empty ones share their begin with the next, which then owns it
        self.begins = np.cumsum([0, *map(len, self.texts)])[:-1]


def dedup(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, bucket_entries: int = BUCKET_ENTRIES, hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay) for every row."""
    return _dedup(docs, length, block_bytes, bucket_entries, hot_runs, True)


def _dedup(docs: DataFrame, length: int, block_bytes: int, bucket_entries: int, hot_runs: int, keep_bytes: bool) -> DataFrame:
    gram = min(GRAM, max(1, length // 3))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blocks, bits, _ = sized_blocks(rows, block_bytes, 2.0 / (length - gram + 2), bucket_entries)
    sorts = max(1, blocks)  # tasks of suffix sorting
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def send(table: pa.Table) -> pa.Table:
        block, number = Block(table), table["block"][0].as_py()
        runs = runs_of(block.texts, length, gram)
        anchor, place, count = np.unique(runs["anchor"], return_inverse=True, return_counts=True)
        edges = bucket_edges(anchor, bits)
        got: list[tuple] = []
        for b in np.flatnonzero(np.diff(edges)):
            x, y = edges[b], edges[b + 1]
            got.append((int(b), number, pack_sorted(anchor[x:y]), pack_counts(count[x:y])))
        if len(anchor):  # the block's own runs, back to it with the answers
            got.append((number % (1 << bits), number, pack_layout(runs, block.begins, place), None))
        cols = list(zip(*got)) or [[]] * 4
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["bucket", "block", "anchors", "counts"])

    def judge(table: pa.Table) -> pa.Table:
        own = table.filter(table["counts"].is_null())
        table = table.filter(table["counts"].is_valid())
        said = []
        if len(table):
            anchors = [unpack_sorted(x.as_py()) for x in table["anchors"]]
            _, place = np.unique(np.concatenate(anchors), return_inverse=True)
            total = np.bincount(place, np.concatenate([unpack_counts(x.as_py()) for x in table["counts"]]))[place]
            answer = ((total > 1).astype(np.uint8) + (total > hot_runs)).astype(np.uint8)
            said = [x.tobytes() for x in np.split(answer, np.cumsum([len(a) for a in anchors])[:-1])]
        return pa.table(
            [pa.chunked_array([*table["block"].chunks, *own["block"].chunks], pa.int32()), pa.array([*table["bucket"].to_pylist(), *[-1] * len(own)], pa.int32()), pa.array([*said, *own["anchors"].to_pylist()], pa.binary())],
            ["block", "bucket", "said"],
        )

    def deal(table: pa.Table, answers: pa.Table) -> pa.Table:
        got: dict[str, list] = {"part": [], "anchor": [], "key": [], "block": [], "doc": [], "lo": [], "body": []}
        if len(table) and len(answers):
            block, number = Block(table), table["block"][0].as_py()
            replies = sorted(zip(answers["bucket"].to_pylist(), answers["said"].to_pylist()))
            runs = unpack_layout(replies[0][1], block.begins)
            said = np.frombuffer(b"".join(x for _, x in replies[1:]), np.uint8)
            if replies[0][0] != -1 or len(said) != runs["place"].max() + 1:
                raise RuntimeError("answers don't fit the runs of the block")
            said = said[runs["place"]]
            seen: set[bytes] = set()
            again: list[tuple[int, int, int]] = []  # equal to an earlier string of this block
            at = np.flatnonzero(said)
            for d, lo, n, gap, name, kind in zip(*(runs[c][at].tolist() for c in ("doc", "lo", "count", "gap", "place")), said[at].tolist()):
                text = block.texts[d]
                whole = text[lo : lo + n + length - 1]
                # the anchor itself is read again: its hash places it the same in every block
                anchor = xxhash.xxh64_intdigest(text[lo + gap : lo + gap + gram])
                for x, m, a in [(lo, n, 0)] if kind == 1 else pieces_of_hot(text, lo, n, gap, length):
                    body = whole[x - lo : x - lo + m + length - 1]
                    if body in seen:
                        again.append((d, x, m))
                        continue
                    seen.add(body)
                    a = (anchor + a * BASE) & 0xFFFFFFFFFFFFFFFF
                    for c, v in zip(got, (a % sorts, a - (1 << 64) if a >> 63 else a, int(block.keys[d]), number, d, x, body)):
                        got[c].append(v)
            if again:  # doc -1: the block's own finding, on its way back to it
                for c, v in zip(got, (number % sorts, 0, 0, number, -1, 0, np.array(again, "<i8").tobytes())):
                    got[c].append(v)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
        return pa.table([pa.array(v, k) for v, k in zip(got.values(), kinds)], list(got))

    def compare(table: pa.Table) -> pa.Table:
        found: list[tuple[int, bytes]] = []
        own = table.filter(pc.equal(table["doc"], -1))
        found += zip(own["block"].to_pylist(), own["body"].to_pylist())
        table = table.filter(pc.not_equal(table["doc"], -1)).sort_by([(c, "ascending") for c in ("anchor", "key", "block", "doc", "lo")])
        anchor, key, block, doc, lo = (table[c].to_numpy() for c in ("anchor", "key", "block", "doc", "lo"))
        ends = np.cumsum(pc.binary_length(table["body"]).to_numpy().astype(np.int64)) if len(table) else np.zeros(0, np.int64)
        at = 0
        while at < len(table):  # some anchors at a time, whole ones
            end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SORT_BYTES))
            end = int(np.searchsorted(anchor, anchor[min(end, len(table) - 1)], "right"))
            first: dict[bytes, int] = {}
            for r, body in enumerate(table["body"].slice(at, end - at).to_pylist(), at):
                if first.setdefault(body, r) != r:  # rows are in order: an equal string starts earlier
                    found.append((int(block[r]), np.array([doc[r], lo[r], len(body) - length + 1], "<i8").tobytes()))
            if len(first) > 1:  # windows of one string have their anchor at different distances
                cls, r, start = repeated(list(first), length)
                r = np.array(list(first.values()), np.int64)[r]
                start = lo[r] + start
                o = np.lexsort((start, doc[r], block[r], key[r], cls))
                o = o[1:][cls[o[1:]] == cls[o[:-1]]]  # all but the earliest of each class
                o = o[np.lexsort((start[o], doc[r[o]], block[r[o]]))]
                mine = block[r[o]]
                for x in np.split(o, np.flatnonzero(np.diff(mine)) + 1):
                    if len(x):
                        found.append((int(block[r[x[0]]]), intervals(doc[r[x]].astype(np.int64), start[x]).astype("<i8").tobytes()))
            at = end
        hits: dict[int, list[bytes]] = {}
        for b, raw in found:
            hits.setdefault(b, []).append(raw)
        return pa.table([pa.array(list(hits), pa.int32()), pa.array([b"".join(v) for v in hits.values()], pa.binary())], ["block", "hits"])

    def cut(table: pa.Table, hits: pa.Table) -> pa.Table:
        block = Block(table)
        spans: list[list[tuple[int, int]]] = [[] for _ in block.texts]
        for raw in hits["hits"].to_pylist():
            for d, x, n in np.frombuffer(raw, "<i8").reshape(-1, 3).tolist():
                spans[d].append((x, x + n - 1 + length))
        removed, n_spans, kept = [], [], []
        for text, own in zip(block.texts, spans):
            at, parts, n = 0, [], 0
            stop = -1
            for a, b in sorted(own):
                if a > stop:
                    n += 1
                    parts.append(text[at:a])
                stop = at = max(stop, b)
            parts.append(text[at:])
            rest = b"".join(parts)
            removed.append(len(text) - len(rest))
            n_spans.append(n)
            kept.append(rest if keep_bytes else sha256_hex(rest))
        return pa.table(
            [pa.array(block.ids, pa.int64()), pa.array([len(t) for t in block.texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary() if keep_bytes else pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )

    sent = rows.groupBy("block").applyInArrow(send, "bucket int, block int, anchors binary, counts binary")
    answers = sent.groupBy("bucket").applyInArrow(judge, "block int, bucket int, said binary")
    dealt = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(deal, "part int, anchor long, key long, block int, doc int, lo long, body binary")
    hits = dealt.groupBy("part").applyInArrow(compare, "block int, hits binary")
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept " + ("binary" if keep_bytes else "string")
    return rows.groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(cut, out)


def dedup_query(docs: DataFrame) -> DataFrame:
    """The digest form: kept_sha256 in place of the kept bytes."""
    return _dedup(docs, LENGTH, BLOCK_BYTES, BUCKET_ENTRIES, HOT_RUNS, False).withColumnRenamed("kept", "kept_sha256")
