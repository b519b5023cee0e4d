"""Tokens of two tokenizers aligned by the bytes they cover.

A text's B tokens are intervals of its bytes, kept as a static index: their starts and ends, both ascending.
Every A token stabs it by two bisections, for the first interval that ends behind its start and the first that
starts behind its end; what lies between overlaps it.  A gap between two B tokens that no A token spans is a
group boundary: tokens of both sides end there.  ``link_counts`` adds up over the corpus how many links hold an id of A and
one of B together; ``alignment_query`` weighs every document's links by these counts.

Texts are cut into stretches where neither tokenizer has a token across (before a blank, between letters, digits
and signs), so such a place is always a group boundary.  Each different stretch is encoded, indexed and aligned
once and remembered; a document is the sequence of its stretches.  For tokenizers without such places a
stretch is the whole text.

Nothing is collected: documents are described in blocks of some 4 MB of text, written to the shared checkpoint
folder.  A block asks for its distinct pairs of ids, counts are summed by pair, joined to what was asked, and come
back to the block.  The counts' size is bounded by the vocabularies, and what a block asks by its text.

Defined cases: texts that are null or empty, or whose tokens of A or of B don't spell out blank + text (U+2581 in a
text reads as a blank), have no tokens: zeros and ''; texts of any length are taken whole, a longer one is a block of its
own; special strings in texts are plain text; repeated rows stay rows and count each; ties for the highest count are all
best; a null doc_id stays null; an empty table gives no rows; columns other than doc_id and text are not read and may
have any name.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm import stretches as st
from arbora.llm.bpe import byte_symbols
from arbora.llm.common import ensure_checkpoint_dir

BLOCK_BYTES = 1 << 22
#: Blocks are rows of megabytes: Parquet looks at its buffer after each few of them, not after a hundred, and begins a new group of rows.
ROW_GROUPS = {"parquet.block.size": 1 << 24, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 2}
#: A block's ids of A and B as one number.
SHIFT = 32
BATCH = 1024
#: White space beyond ASCII begins with these bytes in UTF-8.
WIDE_BLANKS = [0xC2, 0xE1, 0xE2, 0xE3]


class Aligner:
    """Tokenizer file A (byte-level BPE of the tokenizers library) against model B (sentencepiece)."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        self.a = Tokenizer.from_file(a_path)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = {c: b for b, c in enumerate(byte_symbols())}
        names = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.a_bytes[i] = bytes(byte[c] for c in name) if all(c in byte for c in name) else name.encode()
        n = self.b.get_piece_size()
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        self.a_lens, self.b_lens = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # decimal ids, each with the sign that may follow
        self.written = [f"{i}{sign}".encode() for size, signs in ((len(self.a_bytes), ",|"), (n, ",;")) for sign in signs for i in range(size)]
        self.cutter = st.Cutter(self.cuts(spec), follow=self.followers())
        self.known = st.Remembered(self.aligned)

    def cuts(self, spec: dict) -> np.ndarray:
        """Pairs of bytes between which both tokenizers always end a token, whatever stands around them."""
        cut = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") is not None or cut.get("type") != "ByteLevel" or not cut.get("use_regex") or cut.get("add_prefix_space"):
            return np.zeros((256, 256), bool)
        # A's pattern cuts runs of letters, of digits and of signs apart and lets a blank begin the next run
        table = st.pair_table((st.LETTERS, st.DIGITS + st.SIGNS), (st.DIGITS, st.LETTERS + st.SIGNS), ([b for b in range(256) if b != 32], [32]))
        # B merges whatever is a piece: cut only pairs that stand in no piece
        for piece in self.b_bytes:
            if len(piece) > 1:
                raw = np.frombuffer(piece, np.uint8)
                table[raw[:-1], raw[1:]] = False
                if b"\n" in piece:  # a line end must keep what follows from the blank that B adds
                    return np.zeros((256, 256), bool)
        return table

    @staticmethod
    def followers() -> np.ndarray:
        """Bytes before which a blank begins a token: no white space, and not the begin of any."""
        ok = np.ones(256, bool)
        ok[[*st.BLANKS, *range(28, 32), *WIDE_BLANKS]] = False
        return ok

    def b_ids(self, texts: list[str]) -> list[list[int]]:
        """B puts a blank before a text: it is the stretch's own, or cut off again behind a line end."""
        own = [t[0] == " " for t in texts]
        found = self.b.encode([t[1:] if o else "\n" + t for t, o in zip(texts, own)], num_threads=1)
        return [x if o else x[2:] for x, o in zip(found, own)]

    def aligned(self, stretches: list[bytes]) -> list[bytes]:
        """For each stretch: numbers of A tokens, B tokens, groups and links, the links' pairs, the groups as text."""
        out = []
        for k in range(0, len(stretches), BATCH):
            out += self._aligned(stretches[k : k + BATCH])
        return out

    def _aligned(self, stretches: list[bytes]) -> list[bytes]:
        texts = [s.decode() for s in stretches]
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.b_ids(texts)
        odd = np.full(4, 0xFFFFFFFF, "<u4").tobytes()
        spelt = [b"".join([t[i] for i in x]) for t, ids in ((self.a_bytes, a), (self.b_bytes, b)) for x in ids]
        good = [k for k, s in enumerate(stretches) if spelt[k] == s == spelt[len(a) + k]]
        out = [odd] * len(stretches)
        if not good:
            return out
        na, nb = (np.array([len(x[k]) for k in good], np.int64) for x in (a, b))
        a_ids, b_ids = (np.fromiter(chain.from_iterable(x[k] for k in good), np.int64) for x in (a, b))
        a_end, b_end = np.cumsum(self.a_lens[a_ids]), np.cumsum(self.b_lens[b_ids])
        a_start, b_start = a_end - self.a_lens[a_ids], b_end - self.b_lens[b_ids]
        low, high = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
        # gap g lies behind interval g; tokens low .. high - 1 overlap, so gaps low .. high - 2 are spanned
        step = np.zeros(len(b_ids) + 1, np.int64)
        np.add.at(step, low, 1)
        np.add.at(step, high - 1, -1)
        boundary = np.cumsum(step)[:-1] == 0
        ends = np.cumsum(boundary)
        b_group = ends - boundary
        a_group = b_group[low]
        links = high - low
        pair = (np.repeat(a_ids, links) << SHIFT) | b_ids[st.spread(low, links)]
        # order: a group's A tokens, then its B tokens
        n_a = len(self.a_bytes)
        a_code = a_ids + n_a * np.append(a_group[1:] != a_group[:-1], True)
        b_code = 2 * n_a + b_ids + len(self.b_bytes) * boundary
        code = np.empty(len(a_ids) + len(b_ids), np.int64)
        code[np.arange(len(a_ids)) + np.searchsorted(b_group, a_group, "left")] = a_code
        code[np.arange(len(b_ids)) + np.searchsorted(a_group, b_group, "right")] = b_code
        words = [self.written[c] for c in code.tolist()]
        at, bt = np.cumsum(na), np.cumsum(nb)
        behind = np.concatenate([[0], np.cumsum(links)])[at]
        n_links = np.diff(behind, prepend=0)
        n_groups = np.diff(np.concatenate([[0], ends])[bt], prepend=0)
        heads = np.stack([na, nb, n_groups, n_links], 1).astype("<u4").tobytes()
        raw = pair.astype("<i8").tobytes()
        w = x = 0
        for k, to, lk, size in zip(good, behind.tolist(), n_links.tolist(), (na + nb).tolist()):
            out[k] = heads[w : w + 16] + raw[8 * (to - lk) : 8 * to] + b"".join(words[x : x + size])[:-1]
            w += 16
            x += size
        return out

    def block(self, texts: pa.Array) -> dict:
        """What a block of texts needs of its distinct stretches, most frequent first, and of its documents."""
        texts = pc.fill_null(texts, "")
        some = pc.binary_join_element_wise(pa.scalar(" "), texts, pa.scalar(""))
        found, at = self.cutter.cut(pc.if_else(pc.equal(texts, ""), "", some))
        coded = found.dictionary_encode()
        index = coded.indices.to_numpy()
        order = np.argsort(-np.bincount(index, minlength=len(coded.dictionary)), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        index = rank.astype(np.int32)[index]
        made = self.known.of(coded.dictionary.take(pa.array(order)).to_pylist())
        heads = np.frombuffer(b"".join([m[:16] for m in made]), "<u4").reshape(-1, 4).astype(np.int64)
        odd = heads[:, 0] == 0xFFFFFFFF
        heads[odd] = 0
        size = heads[:, 3].tolist()
        link = np.frombuffer(b"".join([m[16 : 16 + 8 * n] for m, n in zip(made, size)]), "<i8")
        groups = [m[16 + 8 * n :] for m, n in zip(made, size)]
        before = np.concatenate([[0], np.cumsum(odd[index])])[at]
        good = np.diff(before) == 0  # documents that both tokenizers spell out
        cuts = np.diff(at)
        per = np.stack([np.diff(np.concatenate([[0], np.cumsum(heads[:, k][index])])[at]) for k in range(4)], 1) * good[:, None]
        listed = index.tolist()
        text = [b";".join([groups[i] for i in listed[a:b]]) if ok and b > a else b"" for a, b, ok in zip(at[:-1].tolist(), at[1:].tolist(), good.tolist())]
        used = np.repeat(good, cuts)
        return {"per": per, "groups": text, "good": good, "index": index, "cuts": cuts, "used": np.bincount(index[used], minlength=len(made)), "link": link, "links": heads[:, 3]}


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner per worker process."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``): the general operator."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in batches:
            for a, b in st.grouped(pc.fill_null(batch.column(1), ""), BLOCK_BYTES):
                got = own.block(batch.column(1).slice(a, b - a))
                counts = [pa.array(got["per"][:, k]) for k in range(4)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *counts, pa.array([g.decode() for g in got["groups"]], pa.string())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"])
        own.known.known.clear()

    return _texts(docs).mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string")


_BLOCK = "block string, pairs array<long>, times array<long>, stretch_links binary, links binary, doc_ids array<long>, counts array<long>, digests array<string>, sizes binary, stretches binary"
_KINDS = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _schema(columns: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[k]) for n, k in (part.split() for part in columns.split(","))])


def described(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each block of documents: its pairs of linked ids with their numbers, its stretches' links, its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in batches:
            for a, b in st.grouped(pc.fill_null(batch.column(1), ""), block_bytes):
                got = own.block(batch.column(1).slice(a, b - a))
                coded = pa.array(got["link"]).dictionary_encode()
                place = coded.indices.to_numpy()
                times = np.bincount(place, np.repeat(got["used"], got["links"]), len(coded.dictionary)).astype(np.int64)
                row = {
                    "block": uuid.uuid4().hex, "pairs": coded.dictionary.to_pylist(), "times": times.tolist(), "stretch_links": got["links"].astype("<u4").tobytes(), "links": place.astype("<u4").tobytes(),
                    "doc_ids": batch.column(0).slice(a, b - a).to_pylist(), "counts": got["per"].reshape(-1).tolist(),
                    "digests": [hashlib.sha256(g).hexdigest() if n else "" for g, n in zip(got["groups"], got["per"][:, 0].tolist())],
                    "sizes": (got["cuts"] * got["good"]).astype("<u4").tobytes(), "stretches": got["index"][np.repeat(got["good"], got["cuts"])].astype("<u4").tobytes(),
                }
                yield pa.RecordBatch.from_pylist([row], schema=_schema(_BLOCK))
        own.known.known.clear()

    return _texts(docs).mapInArrow(run, _BLOCK)


def link_counts(blocks: DataFrame) -> DataFrame:
    """pair, count, best: how many links of all documents hold two ids, and whether none of the B id's pairs has more."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    counts = each.groupBy("pair").agg(F.sum("times").alias("count"))
    top = F.max("count").over(Window.partitionBy(F.col("pair").bitwiseAND((1 << SHIFT) - 1)))  # as many rows as A has ids
    return counts.select("pair", "count", (F.col("count") == top).alias("best"))


_WEIGHED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _weighed(left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of one block with the counts it asked for."""
    places = right["place"].to_numpy()
    out = []
    for row in left.to_pylist():
        count, best = np.zeros(len(row["pairs"]), np.int64), np.zeros(len(row["pairs"]), np.int64)
        count[places], best[places] = right["count"].to_numpy(), right["best"].to_numpy(zero_copy_only=False)
        link = np.frombuffer(row["links"], "<u4")
        ends = np.cumsum(np.frombuffer(row["stretch_links"], "<u4"), dtype=np.int64)
        index = np.frombuffer(row["stretches"], "<u4")
        at = np.cumsum(np.frombuffer(row["sizes"], "<u4"), dtype=np.int64)
        per = []
        for value in (best, count):
            stretch = np.diff(np.concatenate([[0], np.cumsum(value[link])])[ends], prepend=0)
            per.append(np.diff(np.concatenate([[0], np.cumsum(stretch[index])])[at], prepend=0))
        four = np.array(row["counts"], np.int64).reshape(-1, 4)
        out.append(pa.table([pa.array(row["doc_ids"], pa.int64()), *[pa.array(four[:, k]) for k in range(4)], pa.array(per[0], pa.int64()), pa.array(per[1], pa.int64()), pa.array(row["digests"], pa.string())], schema=_schema(_WEIGHED)))
    return pa.concat_tables(out) if out else _schema(_WEIGHED).empty_table()


def alignment_query(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/alignment-{uuid.uuid4().hex}"
    described(docs, a_path, b_path).write.options(compression="zstd", **ROW_GROUPS).parquet(folder)
    blocks = spark.read.parquet(folder)
    asked = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    told = asked.join(link_counts(blocks), "pair").select("block", "place", "count", "best")
    kept = spark.read.parquet(folder).drop("times")
    return kept.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_weighed, _WEIGHED)
