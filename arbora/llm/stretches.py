"""Texts cut into short byte stretches that a tokenizer encodes each on its own, with whole arrays at a time.

A text is cut only where no token can span the cut and where the encoding on either side doesn't depend on the
other.  Equal stretches are encoded once and remembered by the worker, so the tokenizer sees a text's different
words and not all of its occurrences.  Which neighbouring bytes may be cut apart is given as a table of 256 x 256.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut at a time; masks of this size stay in the processor's cache.
CUT_BYTES = 1 << 20
#: Stretches that a worker remembers, and bytes of the longest one it does.
MEMO, MEMO_BYTES = 250_000, 64
#: Words that a worker knows as flat arrays.
KNOWN = 600_000

BLANKS = [9, 10, 11, 12, 13, 32]
LETTERS = [*range(65, 91), *range(97, 123)]
DIGITS = [*range(48, 58)]
SIGNS = [b for b in range(128) if b not in {*BLANKS, *LETTERS, *DIGITS}]


def pair_table(*pairs: tuple[list[int], list[int]]) -> np.ndarray:
    """True where a byte of the first list may be cut from a byte of the second."""
    table = np.zeros((256, 256), bool)
    for a, b in pairs:
        table[np.ix_(a, b)] = True
    return table


def grouped(array: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of a string array with about ``limit`` bytes each, one row at least."""
    ends = np.cumsum(pc.binary_length(array).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(array):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield at, end
        at = end


def _bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string array and where its rows begin and end in them."""
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Cutter:
    """Cuts texts by a table of byte pairs.

    ``dropped`` bytes (blanks) belong to no stretch and always cut; with ``follow`` a cut before a blank needs one of these bytes behind it.
    """

    def __init__(self, table: np.ndarray, dropped: list[int] | None = None, mapped: np.ndarray | None = None, follow: np.ndarray | None = None):
        self.flat = table.reshape(-1)
        self.kept = np.ones(256, bool)
        if dropped:
            self.kept[dropped] = False
            full = table.copy()
            full[dropped] = full[:, dropped] = True
            self.flat = full.reshape(-1)
        self.drops, self.mapped, self.follow = bool(dropped), mapped, follow

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(all stretches in order, where each text's stretches begin and the last's end); no nulls in ``texts``."""
        texts = texts.cast(pa.large_string())
        data, lens, firsts, n = [], [], [np.zeros(1, np.int64)], 0
        for a, b in grouped(texts, CUT_BYTES):
            raw, at = _bytes_of(texts.slice(a, b - a))
            if self.mapped is not None:
                raw = self.mapped[raw]
            first = np.zeros(len(raw) + 1, bool)
            if len(raw):
                first[1:-1] = self.flat[(raw[:-1].astype(np.uint16) << 8) | raw[1:]]
            if self.follow is not None and len(raw):
                blank = np.flatnonzero(first[:-1] & (raw == 32))
                first[blank[~self.follow[raw[np.minimum(blank + 1, len(raw) - 1)]]]] = False
            first[at] = True
            first = first[:-1]
            if self.drops:
                keep = self.kept[raw]
                first &= keep
                pos = np.flatnonzero(first)
                before = np.cumsum(keep, dtype=np.int32)
                ends = np.append(before[pos] - 1, before[-1] if len(before) else 0)
                raw = raw[keep]
            else:
                pos = np.flatnonzero(first)
                ends = np.append(pos, len(raw))
            firsts.append(n + np.searchsorted(pos, at[1:]))
            n += len(pos)
            data.append(raw)
            lens.append(np.diff(ends))
        ends = np.zeros(n + 1, np.int64)
        if lens:
            np.cumsum(np.concatenate(lens), out=ends[1:])
        joined = np.concatenate(data) if data else np.zeros(0, np.uint8)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(joined)]), np.concatenate(firsts)


class Remembered:
    """What ``make`` gives for lists of stretches; forgets all when full.  Long stretches are not kept."""

    def __init__(self, make: Callable[[list[bytes]], list], most: int = MEMO):
        self.make, self.most, self.known = make, most, {}

    def of(self, stretches: list[bytes]) -> list:
        known = self.known
        found = [known.get(s) for s in stretches]
        new = [i for i, x in enumerate(found) if x is None]
        if new:
            if len(known) + len(new) > self.most:
                known.clear()
            room = self.most - len(known)
            for i, made in zip(new, self.make([stretches[i] for i in new])):
                found[i] = made
                if room > 0 and len(stretches[i]) <= MEMO_BYTES:
                    known[stretches[i]] = made
                    room -= 1
        return found


class KnownWords:
    """Ids of words met before, as flat arrays: some forty bytes a word.  When full it begins anew; long words are not kept."""

    def __init__(self, make: Callable[[list[bytes]], list[bytes]], most: int = KNOWN):
        self.make, self.most = make, most
        self.clear()

    def clear(self) -> None:
        self.words = pa.array([], pa.large_binary())
        self.ids, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, sizes): word k has the ids from begins[k] on, sizes[k] of them; ``words`` are all different."""
        found = pc.index_in(words, value_set=self.words)
        lost = found.is_null().to_numpy(zero_copy_only=False)
        place = pc.fill_null(found, 0).to_numpy().astype(np.int64)
        ids, sizes = self.ids, self.sizes
        if lost.any():
            new = words.filter(pa.array(lost))
            made = self.make(new.to_pylist())
            place[lost] = len(sizes) + np.arange(len(new))
            ids = np.concatenate([ids, np.frombuffer(b"".join(made), "<u4")])
            sizes = np.concatenate([sizes, np.fromiter(map(len, made), np.int64, len(made)) >> 2])
        begins = np.cumsum(sizes) - sizes
        out = ids, begins[place], sizes[place]
        if lost.any():
            self._keep(new, made)
        return out

    def _keep(self, new: pa.Array, made: list[bytes]) -> None:
        short = pc.less_equal(pc.binary_length(new), MEMO_BYTES)
        new, made = new.filter(short), [m for m, s in zip(made, short.to_pylist()) if s]
        if len(self.words) + len(new) > self.most:
            self.clear()
            new, made = new.slice(0, self.most), made[: self.most]
        self.words = pa.concat_arrays([self.words, new])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(made), "<u4")])
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, made), np.int64, len(made)) >> 2])


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every range, one after the other."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lens), lens)
