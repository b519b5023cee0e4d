"""Language identification in two steps: family first, then pairwise linear SVMs within it.

Features are hashed counts of letter 1-, 2- and 3-grams of the whole lower-cased text (square roots,
unit length).  A linear SVM per family decides the family; within the family one linear SVM per pair
of languages votes.  The classifier is fitted on a bounded sample: at most ``PER_LANG`` different rows of
each language, those with the smallest hash of doc_id.  Each pair of languages is learned in a task of its own, all
families in one, from ``FAMILY_ROWS`` of these rows (at least ``FAMILY_LEAST`` of a language); rows stay sparse.
Prediction reads whole texts of all rows.

Defined cases: null text or text without a letter is ``und`` with score 0; with no rows to learn from
everything is ``und``; a language that ``FAMILIES`` doesn't name is a family of its own; a null doc_id
is neither learned from nor held out (held_out false); repeated rows stay rows and are learned from once;
very long texts are read whole, a stretch at a time; an empty table gives no rows; columns other than
doc_id, text and lang are not read and may have any name.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm.common import checkpoint, crc_mod, slices

PER_LANG = 1500
DIM = 1 << 14
STRETCH = 1 << 18
EPOCHS = 8
PARTS = 64
BROADCAST_ROWS = 200_000
#: Rows that the families' task learns from in all, and from each language at least.
FAMILY_ROWS, FAMILY_LEAST = 6000, 50

# Families of common language codes.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr"],
}
_letter = re.compile(r"[^\W\d_]")


def family_of(lang: str) -> str:
    return next((f for f, ls in FAMILIES.items() if lang in ls), lang)


def features(text: str) -> np.ndarray | None:
    """Unit vector of hashed letter n-grams; None without a letter."""
    if not _letter.search(text):
        return None
    out = np.zeros(DIM, np.float64)
    for at in range(0, len(text), STRETCH):  # whole text, a stretch at a time (two characters shared)
        raw = text[max(0, at - 2) : at + STRETCH].lower()
        code = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        letter = ((code >= 97) & (code <= 122)) | ((code >= 0xC0) & (code != 0xD7) & (code != 0xF7) & (code < 0x2000)) | (code >= 0x2C00)
        code = np.where(letter, code, np.uint64(32))
        keep = np.ones(len(code), bool)
        keep[1:] = letter[1:] | letter[:-1]
        code, letter = code[keep], letter[keep]
        if len(code) < 3:
            code = np.concatenate([code, np.full(3 - len(code), 32, np.uint64)])
        for n in (1, 2, 3):
            h = np.full(len(code) - n + 1, n, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + code[k : len(code) - n + 1 + k]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            out += np.bincount((h >> np.uint64(40)).astype(np.int64) % DIM, minlength=DIM)
    out = np.sqrt(out)
    return (out / np.linalg.norm(out)).astype(np.float32)


def sparse(f: np.ndarray) -> bytes:
    return np.flatnonzero(f).astype("<i4").tobytes() + f[f != 0].astype("<f4").tobytes()


class Rows:
    """Packed feature vectors; only the rows asked for are made dense."""

    def __init__(self, packed: list[bytes]):
        self.packed, self.shape = packed, (len(packed), DIM)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), DIM), np.float32)
        for k, i in enumerate(at):
            f = self.packed[i]
            half = len(f) // 2
            out[k, np.frombuffer(f[:half], "<i4")] = np.frombuffer(f[half:], "<f4")
        return out


def linear_svm(x: Rows, y: np.ndarray, epochs: int = EPOCHS, lam: float = 1e-4) -> np.ndarray:
    """Pegasos on the hinge loss with balanced classes; the last weight is the bias."""
    rng = np.random.default_rng(7)
    n, d = x.shape
    w, t = np.zeros(d + 1), 0
    pos, neg = max(1, int((y > 0).sum())), max(1, int((y < 0).sum()))
    weight = np.where(y > 0, n / (2 * pos), n / (2 * neg))
    mean, step = np.zeros(d + 1), 0
    for epoch in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 64):
            i = order[at : at + 64]
            t += 1
            eta = 1 / (lam * (t + 1000))
            some = x[i]
            bad = y[i] * (some @ w[:d] + w[d]) < 1
            g = (weight[i] * y[i] * bad)
            w *= 1 - eta * lam
            w[:d] += eta / len(i) * (g @ some)
            w[d] += eta / len(i) * 0.1 * g.sum()
            if epoch >= epochs // 2:
                mean += w
                step += 1
    return mean / max(1, step)


def grouped(langs: list[str]) -> dict[str, list[int]]:
    """Family -> numbers of its languages."""
    groups: dict[str, list[int]] = {}
    for k, lang in enumerate(langs):
        groups.setdefault(family_of(lang), []).append(k)
    return groups


def family_svms(packed: list[bytes], lab: np.ndarray, groups: dict[str, list[int]]) -> dict[str, np.ndarray]:
    """One SVM for each family against all others."""
    x = Rows(packed)
    return {name: linear_svm(x, np.where(np.isin(lab, members), 1.0, -1.0)) for name, members in groups.items()}


def pack(model: dict) -> str:
    put = lambda w: base64.b64encode(np.asarray(w, "<f4").tobytes()).decode()
    return json.dumps(model | {k: {n: put(w) for n, w in model[k].items()} for k in ("family_w", "pair_w")})


def unpack(text: str) -> dict:
    m = json.loads(text)
    get = lambda s: np.frombuffer(base64.b64decode(s), "<f4")
    return m | {k: {n: get(w) for n, w in m[k].items()} for k in ("family_w", "pair_w")}


def predict(model: dict, text: str | None) -> tuple[str, float]:
    f = features(text) if text and model["langs"] else None
    if f is None:
        return "und", 0.0
    margin = lambda w: float(f @ w[:-1] + w[-1])
    sure = lambda m: 1 / (1 + np.exp(-2 * max(-30.0, min(30.0, m))))
    score = 1.0
    if model["family_w"]:
        by = {name: margin(w) for name, w in model["family_w"].items()}
        family = max(sorted(by), key=by.get)
        score = sure(by[family])
    else:
        family = next(iter(model["families"]))
    members = model["families"][family]
    votes, edge = {k: 0 for k in members}, {k: 0.0 for k in members}
    for a, b in combinations(members, 2):
        m = margin(model["pair_w"][f"{a},{b}"])
        votes[a if m >= 0 else b] += 1
        edge[a] += m
        edge[b] -= m
    best = max(members, key=lambda k: (votes[k], edge[k], -k))
    if len(members) > 1:
        score *= sure(edge[best] / (len(members) - 1))
    return model["langs"][best], float(score)


def fit(docs: DataFrame, held_out, per_lang: int = PER_LANG) -> dict:
    """Fit on at most ``per_lang`` rows of each language among rows where ``held_out`` is false."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out & F.col("doc_id").isNotNull())
    # a common language is first cut down in parts of its own, so that no task sees all of its rows
    order = lambda *by: Window.partitionBy(*by).orderBy(F.xxhash64("doc_id"), "doc_id", "tx")
    rows = rows.withColumn("tx", F.xxhash64("text"))
    ids = rows.select("doc_id", "lang", "tx").distinct().withColumn("part", F.pmod(F.hash("doc_id", "tx"), F.lit(PARTS)))
    for by in (["lang", "part"], ["lang"]):
        ids = ids.withColumn("place", F.row_number().over(order(*by))).where(F.col("place") <= per_lang)
    ids = checkpoint(ids.select("doc_id", "lang", "tx"))
    # three short columns; as many languages as a broadcast holds, beyond that an ordinary join
    picked = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    sample = rows.join(picked, ["doc_id", "lang", "tx"]).dropDuplicates(["doc_id", "lang", "tx"])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                some = batch.slice(at, 128)
                made = [(sparse(f), lang, key) for f, lang, key in zip(map(features, some.column(0).to_pylist()), some.column(1).to_pylist(), some.column(2).to_pylist()) if f is not None]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.binary(), pa.string(), pa.int64()))], ["f", "lang", "key"])

    vs = checkpoint(sample.select("text", "lang", F.xxhash64("doc_id").alias("key")).mapInArrow(vectors, "f binary, lang string, key long"))
    langs = sorted(r[0] for r in vs.select("lang").distinct().collect())
    groups = grouped(langs)
    model: dict = {"langs": langs, "families": groups, "family_w": {}, "pair_w": {}}
    # a task for all families, of some rows of each language, and a task for each pair
    pairs = [(a, b) for members in groups.values() for a, b in combinations(members, 2)]
    jobs = [(langs[k], f"{a},{b}") for a, b in pairs for k in (a, b)]
    if not langs or not (jobs or len(groups) > 1):
        return model
    each = max(FAMILY_LEAST, FAMILY_ROWS // len(langs))
    first = vs.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("key", "f"))).where(F.col("place") <= each)  # at most per_lang rows a language
    family = first.select(F.lit("").alias("job"), "lang", "f") if len(groups) > 1 else None
    pair = vs.join(F.broadcast(docs.sparkSession.createDataFrame(jobs, "lang string, job string")), "lang").select("job", "lang", "f") if jobs else None  # two rows for each pair of languages
    dealt = pair if family is None else family if pair is None else family.unionByName(pair)

    def learn(key: tuple, table: pa.Table) -> pa.Table:
        job, got = key[0].as_py(), sorted(zip(table["lang"].to_pylist(), table["f"].to_pylist()))  # the same model whatever order rows arrive in
        packed, lab = [f for _, f in got], np.array([langs.index(lang) for lang, _ in got])
        if job:
            made = {job: linear_svm(Rows(packed), np.where(lab == int(job.split(",")[0]), 1.0, -1.0))}
        else:
            made = family_svms(packed, lab, groups)
        return pa.table([pa.array([bool(job)] * len(made)), pa.array(list(made)), pa.array([np.asarray(w, "<f4").tobytes() for w in made.values()])], ["pair", "name", "w"])

    for r in dealt.groupBy("job").applyInArrow(learn, "pair boolean, name string, w binary").collect():  # a row for each family and each pair
        model["pair_w" if r["pair"] else "family_w"][r["name"]] = np.frombuffer(r["w"], "<f4")
    return model


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs`` (only doc_id and text are read)."""
    packed = pack(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = unpack(packed)
        for batch in slices(batches):
            made = [predict(m, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in made], pa.string()), pa.array([b for _, b in made], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_query(docs: DataFrame) -> DataFrame:
    """Learn from ids with crc32 mod 3 other than 1, predict all rows."""
    held = lambda c: F.coalesce(crc_mod(c, 3) == 1, F.lit(False))
    model = fit(docs, held(F.col("doc_id")))
    return identify(docs, model).select("doc_id", held(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
