"""BPE encoding and decoding by tree concatenation.

A text longer than ``STRETCH`` characters is cut into halves, these into halves and so on, wherever the
cuts fall: inside words, special strings or combining sequences.  The stretches are encoded on their own and
joined pairwise.  At each join a window of text around the cut is encoded anew, and grown until both sides
agree exactly: it begins and ends at a blank (or with the stretch), its encoding begins as the left one's
does there and ends as the right one's does, and what it replaces is what the two sides had.  Blanks are
dropped by the tokenizer and never part of a token, so what lies beyond such a window can't change.

Inside a stretch a text is split at the tokenizer's special strings, normalised by the tokenizer's own
normalizer and cut into its pre-tokens, which are encoded by the model and remembered.  A pre-token of more
than ``LONG`` symbols (text without a blank) has no blank for a window to end at; it is cut into halves
down to ``LEAF`` symbols, all leaves are encoded in one parallel batch, and joined with windows of tokens:
the token left of the window with the window's first, and the window's last with the token right of it,
must each encode, taken together, to just these two tokens.  A sequence in which every adjacent pair does
so is the BPE encoding of its text.  So all results equal the encoding in one piece.

Defined cases: null text is the empty text (no tokens, the hash of no bytes); texts of any length are
encoded whole; special strings in a text become their ids, as in the library; repeated rows stay rows; a
null doc_id stays null; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import slices

STRETCH = 1024
MARGIN = 48
LONG = 512
LEAF = 128
WINDOW = 4
MEMO = 150_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, n = {b: chr(b) for b in keep}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + n)
            n += 1
    return [out[b] for b in range(256)]


class _Memo(dict):
    """Pre-token -> (packed ids, decoded bytes); forgets all when it holds MEMO entries."""

    def __init__(self, fill):
        super().__init__()
        self.fill = fill

    def __missing__(self, key):
        if len(self) >= MEMO:
            self.clear()
        self[key] = made = self.fill(key)
        return made


class TreeBPE:
    """Encoder and decoder for a byte-level BPE tokenizer file with an end-of-word suffix."""

    def __init__(self, path: str, long: int = LONG, leaf: int = LEAF, stretch: int = STRETCH):
        from tokenizers import Tokenizer, models

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.long, self.leaf, self.stretch = long, max(2, leaf), max(2, stretch)
        self.joins = self.grown = 0
        self.whole = Tokenizer.from_file(path)
        self.whole.no_padding()
        self.whole.no_truncation()
        self.normalizer = self.whole.normalizer
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.last = self.whole.model
        self.inner = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges))
        self.names = {i: t for t, i in self.whole.get_vocab(with_added_tokens=True).items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # white space is one blank after normalisation, so \s can be written as the blank
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace(r"\s", " "))
        self.symbols = byte_symbols()
        self.memo = _Memo(lambda piece: self.packed(self.piece_ids(piece)))
        # scripts beyond these blocks are cut by the library: its Unicode tables may differ from ours
        self.plain = re.compile("[\x00-ɏ‐-›€]*").fullmatch

    def packed(self, ids: list[int]) -> tuple[bytes, bytes]:
        return np.array(ids, "<u4").tobytes(), " ".join([self.names[i] for i in ids]).encode()

    def mapped(self, piece: str) -> str:
        s = self.symbols
        return "".join([s[b] for b in piece.encode("utf-8")])

    def piece_ids(self, piece: str) -> list[int]:
        text = self.mapped(piece)
        if len(text) <= self.long:
            return [t.id for t in self.last.tokenize(text)]
        return self.tree(text)

    def unit(self, text: str, at_end: bool) -> list[int]:
        if at_end:
            return [t.id for t in self.last.tokenize(text)]
        return [t.id for t in self.inner.model.tokenize(text)]

    def plain_name(self, i: int) -> tuple[str, bool]:
        name = self.names[i]
        if self.suffix and name.endswith(self.suffix) and name != self.suffix:
            return name[: -len(self.suffix)], True
        return name, False

    def agrees(self, a: int, b: int) -> bool:
        (x, _), (y, end) = self.plain_name(a), self.plain_name(b)
        return self.unit(x + y, end) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours' joined text from their own encodings."""
        n = WINDOW
        if self.agrees(left[-1], right[0]):
            return left + right
        while True:
            i, j = max(0, len(left) - n), min(len(right), n)
            names = [self.plain_name(t) for t in (*left[i:], *right[:j])]
            mid = self.unit("".join(x for x, _ in names), names[-1][1])
            if (i == 0 or self.agrees(left[i - 1], mid[0])) and (j == len(right) or self.agrees(mid[-1], right[j])):
                return left[:i] + mid + right[j:]
            n *= 2

    def tree(self, text: str) -> list[int]:
        """Ids of one long pre-token."""
        cuts = [text[k : k + self.leaf] for k in range(0, len(text), self.leaf)]
        parts = [e.ids for e in self.inner.encode_batch(cuts[:-1], add_special_tokens=False)]
        parts.append(self.unit(cuts[-1], True))
        while len(parts) > 1:
            joined = [self.join(parts[k], parts[k + 1]) for k in range(0, len(parts) - 1, 2)]
            parts = joined + parts[2 * len(joined) :]
        return parts[0]

    def plainly(self, text: str) -> list[tuple[bytes, bytes]]:
        """(packed ids, decoded text) of each pre-token of a stretch."""
        out = []
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                out.append(self.packed([self.special[part]]))
            elif part:
                norm = self.normalizer.normalize_str(part)
                if self.plain(norm):
                    found = self.pieces.findall(norm)
                else:
                    found = [norm[a:b] for _, (a, b) in self.whole.pre_tokenizer.pre_tokenize_str(norm)]
                out += map(self.memo.__getitem__, found)
        return out

    def joined(self, text: str, a: int, cut: int, b: int, left: list, right: list) -> list:
        """The encoding of text[a:b] from those of text[a:cut] and text[cut:b]."""
        self.joins += 1
        reach = MARGIN
        while True:
            first, last = max(a, cut - reach), min(b, cut + reach)
            blank, end = _blank.search(text, first, cut), _last_blank(text, cut, last)
            p, q = a if first == a else blank.start() if blank else -1, b if last == b else end
            if p >= 0 and q >= 0:
                tail, head, mid = self.plainly(text[p:cut]), self.plainly(text[cut:q]), self.plainly(text[p:q])
                keep = len(left) - len(tail)
                if (
                    left[keep:] == tail
                    and right[: len(head)] == head
                    and (p == a or (tail and mid and tail[0] == mid[0]))
                    and (q == b or (head and mid and head[-1] == mid[-1]))
                ):
                    del left[keep:]
                    left += mid
                    left += right[len(head) :]
                    return left
            reach *= 2
            self.grown += 1

    def entries(self, text: str) -> list[tuple[bytes, bytes]]:
        """(packed ids, decoded text) of each pre-token of a whole text."""
        parts = [(k, self.plainly(text[k : k + self.stretch])) for k in range(0, len(text), self.stretch)]
        while len(parts) > 1:
            ends = [k for k, _ in parts[1:]] + [len(text)]
            pairs = [(parts[k][0], self.joined(text, parts[k][0], ends[k], ends[k + 1], parts[k][1], parts[k + 1][1])) for k in range(0, len(parts) - 1, 2)]
            parts = pairs + parts[2 * len(pairs) :]
        return parts[0][1] if parts else []

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(b"".join([x for x, _ in self.entries(text or "")]), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.names[i] for i in ids)

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of tokens, SHA-256 of the packed ids, SHA-256 of the decoded text."""
        found = self.entries(text or "")
        ids = b"".join([x for x, _ in found])
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(b" ".join([y for _, y in found])).hexdigest()


_blank = re.compile("[ \n\t]")


def _last_blank(text: str, a: int, b: int) -> int:
    """Position behind the last blank of text[a:b]; -1 if there is none."""
    return max(text.rfind(c, a, b) for c in " \n\t") + 1 or -1


_loaded: dict[str, TreeBPE] = {}


def loaded(path: str) -> TreeBPE:
    """One encoder per worker process."""
    if path not in _loaded:
        _loaded[path] = TreeBPE(path)
    return _loaded[path]


def _each(docs: DataFrame, path: str, schema: str, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for some in slices(batches):
            cols = make(bpe, some.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([some.column(0), *cols.values()], ["doc_id", *cols])
        bpe.memo.clear()  # the worker lives on, for other stages

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<long>: the general operator."""
    return _each(docs, path, "doc_id long, ids array<long>", lambda bpe, texts: {"ids": pa.array([bpe.encode(t) for t in texts], pa.list_(pa.int64()))})


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<long>")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row."""

    def make(bpe: TreeBPE, texts: list[str | None]) -> dict[str, pa.Array]:
        n, a, b = zip(*map(bpe.digests, texts), strict=True)
        return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a), "decoded_sha256": pa.array(b)}

    return _each(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
