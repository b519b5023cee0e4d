"""Compact blobs for two-way exchanges between blocks of documents and buckets of hashes.

A block sends each bucket (a range of the top bits) its sorted distinct hashes once, however often they
occur in the block, and gets an answer in the same order.  A hot key is thus one entry per block, and
shuffled bytes are far fewer than with one row per occurrence.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIX1, MIX2, MIX3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * MIX2
    h = (h ^ (h >> np.uint64(27))) * MIX3
    return h ^ (h >> np.uint64(31))


def planes(a: np.ndarray, width: int) -> bytes:
    """Low ``width`` bytes of unsigned 64-bit numbers, byte planes one after the other (compress well)."""
    return a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplanes(raw: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def pack_sorted(a: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit numbers as differences of just enough bytes."""
    d = np.diff(a, prepend=np.uint64(0))
    first, rest = d[:1], d[1:]
    width = max(1, (int(rest.max()).bit_length() + 7) // 8) if len(rest) else 1
    # a few wide gaps must not widen all: gaps over six bytes go aside
    if width > 6:
        at = np.flatnonzero(rest >> np.uint64(48))
        if len(at) < len(rest) // 8:
            wide = rest[at]
            rest = rest.copy()
            rest[at] &= np.uint64((1 << 48) - 1)
            head = np.array([len(a), 6, len(at)], "<u4").tobytes()
            return head + first.astype("<u8").tobytes() + at.astype("<u4").tobytes() + wide.astype("<u8").tobytes() + planes(rest, 6)
    return np.array([len(a), width, 0], "<u4").tobytes() + first.astype("<u8").tobytes() + planes(rest, width)


def unpack_sorted(raw: bytes) -> np.ndarray:
    n, width, aside = (int(x) for x in np.frombuffer(raw[:12], "<u4"))
    if n == 0:
        return np.zeros(0, np.uint64)
    first, at = np.frombuffer(raw[12:20], "<u8"), 20
    where = np.frombuffer(raw[at : at + 4 * aside], "<u4")
    wide = np.frombuffer(raw[at + 4 * aside : at + 12 * aside], "<u8")
    rest = unplanes(raw[at + 12 * aside :], n - 1, width).copy()
    rest[where] = wide
    return np.cumsum(np.concatenate([first, rest]), dtype=np.uint64)


def pack_counts(a: np.ndarray) -> bytes:
    """Non-negative numbers, mostly small: a byte each, larger ones aside."""
    at = np.flatnonzero(a >= 255)
    return np.array([len(a), len(at)], "<u4").tobytes() + at.astype("<u4").tobytes() + a[at].astype("<u8").tobytes() + np.minimum(a, 255).astype(np.uint8).tobytes()


def unpack_counts(raw: bytes) -> np.ndarray:
    n, big = (int(x) for x in np.frombuffer(raw[:8], "<u4"))
    out = np.frombuffer(raw[8 + 12 * big :], np.uint8).astype(np.int64)
    out[np.frombuffer(raw[8 : 8 + 4 * big], "<u4")] = np.frombuffer(raw[8 + 4 * big : 8 + 12 * big], "<u8").astype(np.int64)
    return out


def bucket_edges(a: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket of sorted ``a`` begins; the last entry is len(a)."""
    if not bits:
        return np.array([0, len(a)])
    starts = (np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    return np.append(np.searchsorted(a, starts), len(a))


def sized_blocks(docs: DataFrame, block_bytes: int, per_byte: float, bucket_entries: int, *more) -> tuple[int, int, list]:
    """(number of blocks, bits of buckets, values of ``more``) for documents with a text column.

    Both numbers follow the input; ``per_byte`` is the expected number of entries sent per byte.
    """
    row = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), *more).first()
    size = int(row[0])
    blocks = max(1, -(-size // block_bytes))
    buckets = max(1, int(size * per_byte / bucket_entries))
    return blocks, max(0, (buckets - 1).bit_length()), list(row)[1:]
