"""Token files compressed by Re-Pair grammars, with random access.

``write_tokens`` orders documents by doc_id in ranges, encodes them and packs them into shards of whole
documents, half a million ids each.  In a shard the pairs of neighbouring symbols that occur most are replaced
by new symbols (nonterminals), again and again: every round counts all pairs, takes those that occur often
enough, prefers the more frequent where two overlap, and rewrites the sequence; the bound on "often" falls from
round to round down to ``FREQUENT``, and it ends when a round no longer replaces 1/64 of the symbols.  Pairs
never cross the end of a document.  A shard stores its rules, how many ids each of them expands to, the
remaining symbols, and how many ids and symbols every document has: a document, or a stretch of one, is
decoded from its own symbols alone (``read_tokens``).

The files are Parquet written by Spark, a row for each shard, so they can lie in any store and a lost executor's
part is written again.  ``documents_of`` reads them back as a row for each document.

Defined cases: null text is the empty text (the end id only); texts of any length stay whole, a shard is as
large as its largest document; documents with the same doc_id are written in the order of a hash of their text,
those without one come last; repeated rows stay rows; an empty table writes no shard and reads as no rows;
columns other than doc_id and text are not read and may have any name.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import stretches as st
from arbora.llm.common import ensure_checkpoint_dir
from arbora.operators.fixpoint import running_total

END = 1
SHARD_IDS = 500_000
#: Documents of one range of doc_ids; its shards are written by one task.
RANGE_ROWS = 20_000
FREQUENT = 16
#: Bytes of text that are encoded at a time.
GROUP_BYTES = 1 << 21
#: Ids that fit two bytes.
SHORT = 1 << 16

SHARD = (
    "shard string, first_id long, first_hash long, seq long, n_ids long, vocab long, doc_ids array<long>, doc_tokens array<long>, doc_symbols array<long>, "
    "rules binary, lengths binary, symbols binary"
)


# ---- encoding ----


class WordEncoder:
    """Ids of whole texts by the tokenizers library, a different word at a time.

    For tokenizers that drop blanks and cut words into letters, single digits and runs of signs: what stands
    between such cuts is encoded on its own.  Texts with a part of a special string are given to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_padding()
        self.whole.no_truncation()
        self.model = self.whole.model
        self.vocab = self.whole.get_vocab_size(with_added_tokens=True)
        self.special = "<|"
        not_quote = [b for b in st.SIGNS if b != ord("'")]
        table = st.pair_table((st.LETTERS, st.SIGNS + st.DIGITS), (st.DIGITS, st.SIGNS + st.DIGITS + st.LETTERS), (st.SIGNS, st.DIGITS), (not_quote, st.LETTERS))
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        self.cutter = st.Cutter(table, st.BLANKS, lower)
        self.known = st.KnownWords(self.encoded)

    def encoded(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word."""
        out: list = [None] * len(words)
        rest = []
        tokens = self.model.tokenize
        for i, w in enumerate(words):
            if w.isalpha():  # ASCII letters in lower case: one pre-token, as it is
                out[i] = np.array([t.id for t in tokens(w.decode())], "<u4").tobytes()
            else:
                rest.append(i)
        for k in range(0, len(rest), 1024):
            some = rest[k : k + 1024]
            for i, e in zip(some, self.whole.encode_batch_fast([words[i].decode() for i in some], add_special_tokens=False)):
                out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each text has); nulls are empty."""
        texts = pc.fill_null(texts, "")
        odd = np.flatnonzero(pc.match_substring(texts, self.special).to_numpy(zero_copy_only=False))
        if len(odd):
            mask = np.zeros(len(texts), bool)
            mask[odd] = True
            plain = pc.if_else(pa.array(mask), "", texts)
        else:
            plain = texts
        words, at = self.cutter.cut(plain)
        coded = words.dictionary_encode()
        flat, begins, sizes = self.known.of(coded.dictionary)
        index = coded.indices.to_numpy()
        lens = sizes[index]
        ids = flat[st.spread(begins[index], lens)]
        counts = np.diff(np.concatenate([[0], np.cumsum(lens)])[at])
        if not len(odd):
            return ids, counts
        parts, cuts = [], np.concatenate([[0], np.cumsum(counts)])
        for k, i in enumerate(odd):
            own = self.whole.encode(texts[int(i)].as_py(), add_special_tokens=False).ids
            parts += [ids[cuts[odd[k - 1]] if k else 0 : cuts[i]], np.array(own, "<u4")]
            counts[i] = len(own)
        return np.concatenate([*parts, ids[cuts[odd[-1]] :]]), counts


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


# ---- grammars ----


def _chosen(s: np.ndarray, last: np.ndarray, least: int, room: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(positions that don't overlap, pair at each) of the pairs that occur ``least`` times, ``room`` pairs at most."""
    key = (s[:-1].astype(np.int64) << 32) | s[1:]
    h = ((key * np.int64(-7046029254386353131)) >> np.int64(44)) & 0xFFFFF
    h[last[:-1]] = 1 << 20
    cells = np.bincount(h, minlength=(1 << 20) + 1)
    cells[-1] = 0
    at = np.flatnonzero((cells >= least)[h])  # a pair occurs no more often than its cell
    if not len(at):
        return None
    coded = pa.array(key[at]).dictionary_encode()
    index = coded.indices.to_numpy()
    times = np.bincount(index)
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(times), np.int64)
    rank[order] = np.arange(len(times), 0, -1)
    good = times >= least
    good[order[room:]] = False
    mine = good[index]
    at, p = at[mine], rank[index[mine]]
    near = np.diff(at) == 1
    lost = np.zeros(len(at), bool)
    lost[:-1] |= near & (p[1:] > p[:-1])
    lost[1:] |= near & (p[:-1] > p[1:])
    at = at[~lost]
    # neighbours that are left are equal pairs (x x x x): every second one
    place = np.arange(len(at))
    begin = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, place, 0))
    at = at[(place - begin) % 2 == 0]
    return at, key[at]


def compress(ids: np.ndarray, last: np.ndarray, vocab: int, frequent: int = FREQUENT, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules as pairs, their expansions' lengths, symbols) of ids; symbol vocab + k is rule k.

    ``last`` is true at every document's last id.  ``most`` bounds the rules; by default symbols stay within
    two bytes if ids do.
    """
    if most is None:
        most = SHORT - vocab if vocab <= SHORT else 1 << 30
    s, last, frequent = ids.astype(np.int32), last.copy(), max(2, frequent)
    rules, n = [np.zeros((0, 2), np.int64)], 0
    least = max(frequent, len(s) >> 9)
    while n < most and len(s) > 1:
        found = _chosen(s, last, least, most - n)
        used = 0
        if found is not None:
            at, pair = found
            coded = pa.array(pair).dictionary_encode()
            index, pairs = coded.indices.to_numpy(), coded.dictionary.to_numpy()
            kept = np.bincount(index) >= 2  # others lost nearly all their places to more frequent ones
            number = vocab + n + np.cumsum(kept) - 1
            mine = kept[index]
            at, used = at[mine], int(mine.sum())
            s[at] = number[index[mine]]
            last[at] = last[at + 1]
            stays = np.ones(len(s), bool)
            stays[at + 1] = False
            s, last = s[stays], last[stays]
            rules.append(np.stack([pairs[kept] >> 32, pairs[kept] & 0xFFFFFFFF], 1))
            n += int(kept.sum())
        if least == frequent and used * 64 <= len(s):
            break
        least = max(frequent, least >> 3)
    found_rules = np.concatenate(rules)
    lengths = np.ones(vocab + n, np.int64)
    k = 0
    for some in rules:  # a round's rules use symbols of rounds before
        lengths[vocab + k : vocab + k + len(some)] = lengths[some].sum(1)
        k += len(some)
    return found_rules, lengths[vocab:], s


def expand(symbols: np.ndarray, rules: np.ndarray, vocab: int) -> np.ndarray:
    """The ids that symbols stand for."""
    out = symbols.astype(np.int64)
    while True:
        big = out >= vocab
        if not big.any():
            return out
        size = 1 + big
        at = np.cumsum(size) - size
        wider = np.empty(int(size.sum()), np.int64)
        pair = rules[out[big] - vocab]
        wider[at] = np.where(big, 0, out)
        wider[at[big]], wider[at[big] + 1] = pair[:, 0], pair[:, 1]
        out = wider


class Shard:
    """One stored row: all of its ids, those of a document, or any stretch."""

    def __init__(self, row: dict):
        self.vocab = row["vocab"]
        self.rules = np.frombuffer(row["rules"], "<u4").astype(np.int64).reshape(-1, 2)
        lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        self.symbols = np.frombuffer(row["symbols"], "<u2" if self.vocab + len(self.rules) <= SHORT else "<u4")
        sizes = np.ones(self.vocab + len(self.rules), np.int64)
        sizes[self.vocab :] = lengths
        self.sizes = sizes
        self.before = np.concatenate([[0], np.cumsum(sizes[self.symbols])])
        self.doc_symbols = np.concatenate([[0], np.cumsum(np.asarray(row["doc_symbols"], np.int64))])

    def ids(self) -> np.ndarray:
        """All ids; every rule is expanded once."""
        full = expand(np.arange(self.vocab, self.vocab + len(self.rules)), self.rules, self.vocab)
        table = np.concatenate([np.arange(self.vocab), full])
        begin = np.cumsum(self.sizes) - self.sizes
        return table[st.spread(begin[self.symbols], self.sizes[self.symbols])]

    def document(self, k: int) -> np.ndarray:
        return expand(self.symbols[self.doc_symbols[k] : self.doc_symbols[k + 1]], self.rules, self.vocab)

    def stretch(self, start: int, end: int) -> np.ndarray:
        """Ids start to end (exclusive) of the shard: only the symbols that cover them are expanded."""
        start, end = max(0, start), min(end, int(self.before[-1]))
        if start >= end:
            return np.zeros(0, np.int64)
        a = int(np.searchsorted(self.before, start, "right")) - 1
        b = int(np.searchsorted(self.before, end, "left"))
        return expand(self.symbols[a:b], self.rules, self.vocab)[start - self.before[a] :][: end - start]


# ---- files ----


def _shards(path: str, end_id: int, shard_ids: int, frequent: int):
    def packed(held: list, seq: int, enc: WordEncoder) -> pa.RecordBatch:
        doc_ids = [i for ids, _, _, _ in held for i in ids]
        tokens = np.concatenate([c for _, _, c, _ in held])
        ids = np.concatenate([x for _, _, _, x in held])
        last = np.zeros(len(ids), bool)
        ends = np.cumsum(tokens)
        last[ends - 1] = True
        rules, lengths, symbols = compress(ids, last, enc.vocab, frequent)
        sizes = np.concatenate([np.ones(enc.vocab, np.int64), lengths])[symbols]
        at = np.searchsorted(np.cumsum(sizes), ends) + 1
        width = "<u2" if enc.vocab + len(rules) <= SHORT else "<u4"
        row = {
            "shard": uuid.uuid4().hex, "first_id": doc_ids[0], "first_hash": held[0][1], "seq": seq, "n_ids": len(ids), "vocab": enc.vocab, "doc_ids": doc_ids, "doc_tokens": tokens.tolist(),
            "doc_symbols": np.diff(at, prepend=0).tolist(), "rules": rules.astype("<u4").tobytes(), "lengths": lengths.astype("<u4").tobytes(), "symbols": symbols.astype(width).tobytes(),
        }
        return pa.RecordBatch.from_pylist([row], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        held, n, seq = [], 0, 0
        for batch in batches:
            texts = batch.column("text")
            for a, b in st.grouped(pc.fill_null(texts, ""), GROUP_BYTES):
                some = batch.slice(a, b - a)
                ids, counts = enc.encode(some.column("text"))
                cuts = np.cumsum(counts)
                ids, counts = np.insert(ids, cuts, end_id).astype(np.uint32), counts + 1
                names, hashes = some.column("doc_id").to_pylist(), some.column("hash").to_pylist()
                at, k = np.cumsum(counts), 0
                while k < len(counts):  # a shard takes whole documents until it is full
                    start = int(at[k - 1]) if k else 0
                    to = min(len(counts), int(np.searchsorted(at, start + shard_ids - n)) + 1)
                    held.append((names[k:to], hashes[k], counts[k:to], ids[start : at[to - 1]]))
                    n += int(at[to - 1]) - start
                    k = to
                    if n >= shard_ids:
                        yield packed(held, seq, enc)
                        held, n, seq = [], 0, seq + 1
                        pa.default_memory_pool().release_unused()
        if held:
            yield packed(held, seq, enc)
        enc.known.clear()  # the worker lives on, for other stages

    return run


_LISTS = {"array<long>": pa.list_(pa.int64()), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_SCHEMA = pa.schema([(n, _LISTS[k]) for n, k in (part.split() for part in SHARD.split(","))])


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END, shard_ids: int = SHARD_IDS, range_rows: int = RANGE_ROWS, frequent: int = FREQUENT) -> None:
    """Write the ids of all documents, each followed by ``end_id``, in ascending order of doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    n = max(1, -(-docs.count() // range_rows))
    order = [F.col("doc_id").asc_nulls_last(), F.col("hash")]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt.mapInArrow(_shards(tokenizer, end_id, shard_ids, frequent), SHARD).write.parquet(folder)


def documents_of(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, from the files alone."""
    shards = spark.read.parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                raw = Shard(row).ids().astype("<u4").tobytes()
                ends = np.cumsum(row["doc_tokens"]) * 4
                begins = np.concatenate([[0], ends[:-1]])
                view = memoryview(raw)
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([row["shard"]] * len(ends), pa.string()), "doc_id": pa.array(row["doc_ids"], pa.int64()), "within": pa.array(begins // 4, pa.int64()),
                    "n_tokens": pa.array(row["doc_tokens"], pa.int64()), "ids_crc32": pa.array([zlib.crc32(view[a:b]) for a, b in zip(begins, ends)], pa.int64()),
                })

    kept = ["shard", "vocab", "doc_ids", "doc_tokens", "doc_symbols", "rules", "lengths", "symbols"]
    each = shards.select(*kept).mapInArrow(run, "shard string, doc_id long, within long, n_tokens long, ids_crc32 long")
    sizes = shards.select("shard", F.col("first_id").isNull().alias("unnamed"), "first_id", "first_hash", "seq", "n_ids")
    begin = running_total(sizes, ["unnamed", "first_id", "first_hash", "seq"], "n_ids", "before").select("shard", "before")
    return each.join(begin, "shard").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def read_tokens(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """doc_id, ids array<long>: the documents named in ``wanted`` (doc_id), each decoded from its own symbols."""
    index = spark.read.parquet(folder).select("shard", F.posexplode("doc_ids").alias("place", "doc_id"))
    hits = index.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("shard").agg(F.collect_list("place").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([row["doc_ids"][k] for k in row["places"]], pa.int64()),
                    "ids": pa.array([shard.document(k).tolist() for k in row["places"]], pa.list_(pa.int64())),
                })

    return spark.read.parquet(folder).drop("first_id", "first_hash", "seq", "n_ids").join(hits, "shard").mapInArrow(run, "doc_id long, ids array<long>")


def token_query(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write all documents to the shared checkpoint folder and describe what the files hold."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer, folder)
    return documents_of(spark, folder)
