"""Toxicity by a weighted finite-state grammar over clauses.

Each word becomes a symbol: insults of eight strengths (learned words and stems), threats, targets ("you"
and its like), negations, reporting verbs, quotation marks, other words.  Five transducers are composed
into one machine that reads a clause (``arbora/llm/transducer.py``):

* negation weakens the insults and threats among the three words behind it;
* reported speech weakens those behind a reporting verb or inside quotation marks;
* target guesses whether the clause addresses someone, and accepts the guess only if it does;
* threat gives weight to threats in clauses that address someone;
* insult gives weight to insults, more in clauses that address someone.

A clause's weight is that of the best accepting path; words count by the clause they stand in.  Matched
clauses add up, and a logistic calibration turns the document's sums into a score.

The insult words and stems are learned from labelled rows: words and word beginnings that occur in toxic
texts of several families (near copies, by their five-word shingles, count once) and next to never in clean
ones.  The sample is bounded: at most ``SAMPLE`` doc_ids, those with the smallest hash, one text of each,
and no more once ``SAMPLE_BYTES`` are passed.  Scoring reads whole texts of all rows.

Defined cases: null and empty texts get the calibrated score of no match; very long texts are read whole,
clause by clause; where nothing is learned (no labels, one class only, or no word beyond chance) every score
is 0 and nothing is rejected; a null doc_id is never learned from nor held out; repeated rows stay rows; of
several texts with one doc_id the one with the smallest hash is learned from; repeated label rows are merged by
their maximum; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm.common import crc_mod, slices
from arbora.llm.transducer import Lexicon, Transducer, composed

SAMPLE = 12_000
SAMPLE_BYTES = 64_000_000
STEM_LENGTHS = (4, 5, 6, 7, 8)
MIN_LOG_ODDS = 3.0
FAMILY_SHINGLE = 5
FAMILY_SIMILARITY = 0.5
NEGATION_REACH = 3
LEVELS = 8
NEGATED, REPORTED, TARGETED = 0.25, 0.5, 1.25

# Closed word classes of the grammar, by symbol.
TARGET = "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes tus vosotros".split()
NEGATION = "not no never none neither isn't aren't wasn't don't doesn't didn't nicht kein keine niemals nie ne pas jamais aucun nunca jamás ningún ni".split()
REPORT = "said says say saying called calls wrote quoted quote claims claimed reported reports sagte sagt schrieb zitierte dit disait écrit dijo dice escribió".split()
THREAT = "kill hurt destroy beat punch stab shoot strangle attack töten schlagen umbringen tuer frapper détruire matar golpear destruir".split()

_token = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?;:\n\"“”„«»]")
_word = re.compile(r"[^\W_]+")
_long_gap = re.compile(f"w{{{NEGATION_REACH + 1},}}")
_matter = re.compile(f"[1-{LEVELS}H]")


# ---- the grammar ----
# Symbols are (kind, strength): "w" other word, "T" target, "N" negation, "R" report, "Q" quotation mark,
# "I" insult, "H" threat; the target transducer writes "I+" and "H+" in clauses that address someone.

PLAIN = [(k, 0.0) for k in "wTNRQ"]


def _weakened(read: tuple[str, float], by: float) -> tuple[str, float]:
    return (read[0], read[1] * by) if read[0] in "IH" else read


def negation(alphabet: list) -> Transducer:
    """State: words that the last negation still reaches."""

    def step(left, read):
        to = NEGATION_REACH if read[0] == "N" else max(0, left - 1)
        yield (_weakened(read, NEGATED) if left else read), 0.0, to

    return Transducer.of([0], range(NEGATION_REACH + 1), alphabet, step)


def reported_speech(alphabet: list) -> Transducer:
    """State: whether the words are someone else's; quotation marks open and close, a verb opens."""

    def step(inside, read):
        to = not inside if read[0] == "Q" else inside or read[0] == "R"
        yield (_weakened(read, REPORTED) if inside else read), 0.0, to

    return Transducer.of([False], [False, True], alphabet, step)


def target(alphabet: list) -> Transducer:
    """Two readings of a clause: it addresses no one, or it does and a target must come ("open") or came ("met")."""

    def step(reading, read):
        if reading == "none":
            yield read, 0.0, "none"
        else:
            marked = (read[0] + "+", read[1]) if read[0] in "IH" else read
            yield marked, 0.0, "met" if read[0] == "T" else reading

    return Transducer.of(["none", "open"], ["none", "met"], alphabet, step)


def _weighing(alphabet: list, kind: str, plain: float, targeted: float) -> Transducer:
    def step(_, read):
        factor = {kind: plain, kind + "+": targeted}.get(read[0])
        if factor is None:
            yield read, 0.0, 0
        else:
            yield ("w", 0.0), read[1] * factor, 0

    return Transducer.of([0], [0], alphabet, step)


def threat(alphabet: list) -> Transducer:
    return _weighing(alphabet, "H", 0.0, TARGETED)


def insult(alphabet: list) -> Transducer:
    return _weighing(alphabet, "I", 1.0, TARGETED)


def clause_machine() -> Transducer:
    """Negation, reported speech, target, threat and insult composed, each over what the one before writes."""
    alphabet = [*PLAIN, ("H", 1.0), *[("I", k / LEVELS) for k in range(1, LEVELS + 1)]]
    machines = []
    for make in (negation, reported_speech, target, threat, insult):
        machines.append(make(alphabet))
        alphabet = sorted(machines[-1].written)
    return composed(machines)


#: The symbol of each letter in a clause written as a string.
LETTERS = {k: (k, 0.0) for k in "wTNRQ"} | {"H": ("H", 1.0)} | {str(k): ("I", k / LEVELS) for k in range(1, LEVELS + 1)}


#: Words, and clauses, whose weight a worker remembers; the result doesn't depend on it.
REMEMBERED = 50_000


class _Symbols(dict):
    """Word -> letter of its symbol; forgets all when it holds REMEMBERED words."""

    def __init__(self, fixed: dict[str, str], lexicon: Lexicon):
        super().__init__(fixed)
        self.fixed, self.lexicon = fixed, lexicon

    def __missing__(self, word: str) -> str:
        if len(self) > REMEMBERED + len(self.fixed):
            self.clear()
            self.update(self.fixed)
        weight = self.lexicon.weight(word)
        self[word] = letter = str(max(1, min(LEVELS, round(weight * LEVELS)))) if weight > 0 else "w"
        return letter


class Grammar:
    """The composed machine with a model's lexicon and calibration."""

    def __init__(self, model: dict):
        self.bias, self.gain, self.gain_max = model["calibration"]
        self.known = model["known"]
        fixed = {w: s for s, ws in (("T", TARGET), ("N", NEGATION), ("R", REPORT), ("H", THREAT)) for w in ws}
        fixed |= dict.fromkeys("\"“”„«»", "Q") | dict.fromkeys(".!?;:\n", "|")
        self.symbols = _Symbols(fixed, Lexicon(model["words"], model["stems"]))
        self.machine = clause_machine()
        self.memo: dict[str, float] = {}

    def clause(self, letters: str) -> float:
        """Weight of one clause written in symbol letters."""
        got = self.memo.get(letters)
        if got is None:
            if len(self.memo) > REMEMBERED:
                self.memo.clear()
            self.memo[letters] = got = self.machine.weight([LETTERS[x] for x in letters])
        return got

    def clauses(self, text: str) -> Iterator[float]:
        """Weight of each clause in which the machine matches."""
        letters = "".join(map(self.symbols.__getitem__, _token.findall(text.lower())))
        if _matter.search(letters):
            # beyond the reach of a negation further plain words change nothing
            for clause in _long_gap.sub("w" * (NEGATION_REACH + 1), letters).split("|"):
                if _matter.search(clause) and (weight := self.clause(clause)) > 0:
                    yield weight

    def sums(self, text: str | None) -> tuple[float, float]:
        """(log1p of all clause weights, largest clause weight capped at 3)."""
        total, top = 0.0, 0.0
        for w in self.clauses(text or ""):
            total += w
            top = max(top, w)
        return math.log1p(total), min(top, 3.0)

    def score(self, text: str | None) -> float:
        if not self.known:
            return 0.0
        a, b = self.sums(text)
        z = self.bias + self.gain * a + self.gain_max * b
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


NOTHING = {"words": {}, "stems": {}, "calibration": (0.0, 0.0, 0.0), "known": False}


# ---- learning ----


def families(texts: list[str]) -> list[int]:
    """A number for each text; texts whose five-word shingles have a Jaccard similarity of a half or more share it.

    Candidates meet in bands of two of 32 minima, so copies meet and independent texts that share a word don't.
    """
    sets, bands = [], defaultdict(list)
    seeds = np.random.default_rng(11).integers(1, 1 << 63, 32, dtype=np.uint64) | np.uint64(1)
    for i, text in enumerate(texts):
        ws = _word.findall(text.lower())
        grams = {" ".join(ws[k : k + FAMILY_SHINGLE]) for k in range(max(1, len(ws) - FAMILY_SHINGLE + 1))}
        h = np.array(sorted(xxhash.xxh64_intdigest(g) for g in grams), np.uint64)
        sets.append(h)
        low = [int(((h ^ (h >> np.uint64(29))) * s).min()) for s in seeds]
        for k in range(0, len(low), 2):
            bands[k, low[k], low[k + 1]].append(i)
    root = list(range(len(texts)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for members in bands.values():
        for i in members[1:]:
            a, b = find(members[0]), find(i)
            if a != b:
                both = len(np.intersect1d(sets[members[0]], sets[i], True))
                if both >= FAMILY_SIMILARITY * (len(sets[members[0]]) + len(sets[i]) - both):
                    root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def significant(t: int, c: int, rate: float, units: int) -> bool:
    """Whether t toxic families beside c clean texts are beyond chance among so many units (binomial bound)."""
    n, share = t + c, t / (t + c)
    if share <= rate:
        return False
    gap = share * math.log(share / rate) + ((1 - share) * math.log((1 - share) / (1 - rate)) if c else 0.0)
    return n * gap >= math.log(units + 1) + 3


def logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Newton steps of ridge logistic regression."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [0.1] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge @ w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def learn(rows: list[tuple[str, int]]) -> dict:
    """Model from (text, toxic) pairs."""
    used, seen = [], set()
    for text, toxic in rows:
        key = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
        if key not in seen:
            seen.add(key)
            used.append((text, int(toxic)))
    toxic_texts = [t for t, x in used if x]
    clean_texts = [t for t, x in used if not x]
    if not toxic_texts or not clean_texts:
        return NOTHING

    def units(text: str) -> set[str]:
        words = set(_word.findall(text.lower()))
        return words | {f"{w[:n]}*" for w in words for n in STEM_LENGTHS if len(w) > n}

    own: dict[str, set[int]] = defaultdict(set)
    clean: Counter[str] = Counter()
    family = families(toxic_texts)
    for text, f in zip(toxic_texts, family):
        for u in units(text):
            own[u].add(f)
    for text in clean_texts:
        clean.update(u for u in units(text) if u in own)
    n_toxic, n_clean = len(set(family)), len(clean_texts)
    rate = n_toxic / (n_toxic + n_clean)

    def weight(u: str) -> float:
        t, c = len(own[u]), clean[u]
        odds = math.log(((t + 0.5) / (n_toxic + 1)) / ((c + 0.5) / (n_clean + 1)))
        return min(1.0, odds / 6) if odds >= MIN_LOG_ODDS and significant(t, c, rate, len(own)) else 0.0

    strong = {u: w for u in own if (w := weight(u)) > 0}
    if not strong:
        return NOTHING
    stems: dict[str, float] = {}
    for u in sorted((u for u in strong if u.endswith("*")), key=lambda u: (len(u), u)):
        stem = u[:-1]
        # a longer stem is listed only where it weighs more than every shorter one it begins with
        if strong[u] > max((stems.get(stem[:n], 0.0) for n in range(1, len(stem))), default=0.0):
            stems[stem] = strong[u]
    words = {u: w for u, w in sorted(strong.items()) if not u.endswith("*") and w > max((stems.get(u[:n], 0.0) for n in range(1, len(u))), default=0.0)}
    model = NOTHING | {"words": words, "stems": stems, "known": True}
    grammar = Grammar(model)
    x = np.array([(1.0, *grammar.sums(text)) for text, _ in used])
    return model | {"calibration": logistic(x, np.array([t for _, t in used], float))}


def sampled(docs: DataFrame, labels: DataFrame, held_out: Column | None, sample: int, sample_bytes: int) -> DataFrame:
    """doc_id, text, toxic of at most ``sample`` labelled doc_ids, one text of each, until ``sample_bytes`` are passed."""
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    lab = lab.where("doc_id is not null and toxic is not null")
    if held_out is not None:
        lab = lab.where(~held_out)
    ids = lab.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # ids are sample rows of two numbers at most, whatever the tables' size
    rows = texts.join(F.broadcast(ids), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")  # of the sample only
    rows = rows.withColumn("before", F.sum(F.octet_length("text")).over(order) - F.octet_length("text"))
    return rows.where(F.col("before") < sample_bytes).select("doc_id", "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> dict:
    """Learn from the bounded sample of the labelled rows that are not ``held_out`` (a column over doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for batch in batches:
            got += zip(*(c.to_pylist() for c in batch.columns))
        got.sort()
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(learn([(t, x) for _, t, x in got]))])], ["model"])

    row = sampled(docs, labels, held_out, sample, sample_bytes).coalesce(1).mapInArrow(run, "model string").first()
    return json.loads(row[0]) if row else NOTHING


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score for every row (only doc_id and text are read)."""
    packed = json.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(json.loads(packed))
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([grammar.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: dict, limit: float = 0.5) -> DataFrame:
    """The rows whose score is under ``limit``, all columns as they were."""
    packed, names = json.dumps(model), docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(json.loads(packed))
        for batch in slices(batches):
            yield batch.filter(pa.array([grammar.score(t) < limit for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from ids with crc32 mod 5 other than 0, score all rows."""
    held = lambda c: F.coalesce(crc_mod(c, 5) == 0, F.lit(False))
    model = fit(docs, labels, held(F.col("doc_id")))
    return score(docs, model).select("doc_id", held(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
