"""Operators against brute force on small fixtures, with the odd cases: nulls, empty tables, ties, repeats, clashing columns."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from arbora.llm import bpe, capfilter, langid, lm, mixing, mtree, pii, simhash, suffix, toxicity
from arbora.llm.queries import tokenizer_path

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi pi rho".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    base = [prose(r, r.randint(1, 150)) for _ in range(25)]
    texts = base + [base[0]] * 3 + [base[1] + " tail", "pre " + base[2]] + [base[3][:200] + " new " + base[4]] + ["", None, "\t\n ", "Ünïcode Straße " + base[5], "x" * 700]
    out = [(i, t, "en", r.choice(["s1", "s1", "s2", None]), len(t or "")) for i, t in enumerate(texts)]
    return out + [out[7], (None, base[8], "en", "s1", 3), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # a column that clashes with names used inside
    return spark.createDataFrame([(*x, 1) for x in rows], DOC + ", block int").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def collected(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---- 1: search ----


def test_search(spark):
    r = np.random.default_rng(1)
    vec = [[float(v) for v in r.normal(size=6)] for _ in range(300)]
    data = [(i, v) for i, v in enumerate(vec)] + [(900, vec[50]), (901, vec[50]), (7, vec[7]), (902, None), (903, [1.0, None]), (904, [float("nan")] * 6), (None, vec[0]), (905, [2.5]), (950, [0.0] * 6)]
    df = spark.createDataFrame([(*x, 1, "q") for x in data], "vec_id long, embedding array<double>, label int, q string")
    got = collected(mtree.search_query(df))
    valid = [(i, np.floor(256 * np.array(v + [0.0] * (6 - len(v)), float)).astype(int)) for i, v in data if i is not None and v and None not in v and np.isfinite(v).all()]
    want = []
    for q, x in {i: x for i, x in valid if i % 50 == 0}.items():
        best = sorted((-int(x @ y), i) for i, y in valid if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want, key=repr)
    assert mtree.search_query(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_mtree_skips_distances():
    r = np.random.default_rng(2)
    centers = r.normal(size=(20, 8)) * 400
    x = np.floor(np.repeat(centers, 100, 0) + r.normal(size=(2000, 8)) * 5)
    tree = mtree.MTree(np.arange(2000), x, float((x * x).sum(1).max()))
    tree.computed = 0
    got = tree.search(x[3], 3, 5, -np.inf)
    s = (x @ x[3]).astype(int)
    assert got == [(int(s[i]), int(i)) for i in sorted((i for i in range(2000) if i != 3), key=lambda i: (-s[i], i))[:5]]
    assert tree.computed < 1500


def test_wide_components():
    big = [[10**9, -(10**9)], [3 * 10**9, 1], [1, 1]]
    got = mtree.searched([1, 2, 3], [np.array(v) for v in big], [(9, np.array([2, 1]), -np.inf)], 2, 0.0)
    assert got == [(9, 2, 6 * 10**9 + 1), (9, 1, 10**9)]


def test_exact_past_many_wide_components():
    """Where sums in floating point are no longer exact, whole numbers decide."""
    r = random.Random(3)
    xs = [[r.randint(-(2**24), 2**24) for _ in range(64)] for _ in range(60)]
    xs += [[*xs[0][:-1], xs[0][-1] + 1], [*xs[0][:-1], xs[0][-1] - 1]]
    got = mtree.searched(list(range(62)), [np.array(v) for v in xs], [(99, np.array(xs[0]), -np.inf)], 5, 0.0)
    want = sorted((-sum(a * b for a, b in zip(xs[0], x)), i) for i, x in enumerate(xs))[:5]
    assert got == [(99, i, -s) for s, i in want]


def test_search_with_repeated_query_ids(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [3.0, 0.0]), (2, [0.0, 5.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = collected(mtree.search_query(df))
    assert got == [(0, 1, 2, 5 * 65536), (0, 2, 1, 3 * 65536), (0, 3, 3, 65536), (0, 4, 3, 65536), (0, 5, 1, 0)]


# ---- 2: language model ----


def test_lm(docs, empty, rows):
    got = sorted(((r["doc_id"], r["n_words"], r["n3"], r["n2"], r["n1"], r["n0"], r["log_score"]) for r in lm.lm_query(docs).collect()), key=repr)
    texts = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t, *_ in rows]
    grams = lambda ws, n: [tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)]
    from collections import Counter

    total = {n: sum((Counter(grams(w, n)) for w in texts), Counter()) for n in (1, 2, 3)}
    want = []
    for (i, *_), ws in zip(rows, texts):
        own = {n: Counter(grams(ws, n)) for n in (1, 2, 3)}
        left = lambda g: total[len(g)][g] - own[len(g)][g]  # noqa: B023, E731
        used, score = Counter(), 0.0
        for k in range(len(ws)):
            top = min(k, 2) + 1
            for n in range(top, -1, -1):
                g = tuple(ws[k - n + 1 : k + 1])
                if n == 0 or left(g) > 0:
                    rest = sum(map(len, texts)) - len(ws)
                    p = 1 / (rest + 1) if n == 0 else left(g) / (rest if n == 1 else left(g[:-1]))
                    used[n] += 1
                    score += np.log(p) + (top - n) * np.log(0.4)
                    break
        want.append((i, len(ws), used[3], used[2], used[1], used[0], round(score, 4)))
    for a, b in zip(got, sorted(want, key=repr)):
        assert a[:6] == b[:6] and a[6] == pytest.approx(b[6], abs=2e-4)
    assert lm.lm_query(empty).count() == 0


# ---- 3: mixing ----


def test_mixing(docs, empty, rows, spark):
    got = mixing.mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == sorted((i, size(t)) for i, t, *_ in rows if i is not None)
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        s = by.setdefault(r["source"], [0, r["source_size"], r["target"]])
        s[0] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert sum(t for _, _, t in by.values()) == pytest.approx(1.5 * total)
    for taken, n, target in by.values():
        assert target <= 2 * n + 1e-9 and abs(taken - target) <= max(8, 0.02 * n)
    assert collected(mixing.mix_query(docs)) == collected(mixing.mix_query(docs.repartition(5)))
    assert mixing.mix_query(empty).count() == 0
    none = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix(none).collect()] == [0, 0]
    assert mixing.mixed_documents(docs).columns == docs.columns and mixing.mixed_documents(docs).count() > len(rows) / 2


def test_highest_quotients(spark):
    df = spark.createDataFrame([("a", 53.0, 10), ("b", 24.0, 10), ("c", 23.0, 10), ("d", 0.0, 10)], "k string, w double, seats long")
    got = {r["k"]: r["quota"] for r in mixing.sainte_lague(df, [], ["k"], "w", "seats").collect()}
    heap = sorted(((-w / (2 * j + 1), k) for k, w in (("a", 53), ("b", 24), ("c", 23)) for j in range(10)))[:10]
    assert got == {k: sum(x == k for _, x in heap) for k in "abcd"}


def test_mixed_documents_with_clashing_names_and_null_ids(spark):
    cols = "doc_id long, text string, source string, __words long, times int, row string, key long, size string"
    rows = [(i if i % 3 else None, f"word {i} " * (1 + i % 5), "s", -1, -1, "r", -1, "z") for i in range(60)]
    got = mixing.mixed_documents(spark.createDataFrame(rows, cols))
    assert got.columns == [c.split()[0] for c in cols.split(", ")]
    kept = got.collect()
    words = lambda some: sum(len(r[1].split()) for r in some)
    assert {tuple(r) for r in kept} <= set(rows) and abs(words(kept) - 1.5 * words(rows)) < 0.15 * words(rows)
    nameless = [r for r in kept if r[0] is None]
    share = words(nameless) / words([r for r in rows if r[0] is None])
    assert 1.0 < share < 2.0


# ---- 4: personal data ----


PII = [
    "mail a.b@c.de, x@y. d@e-f.co.uk@g.hi a@b.c_d@e.f", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.255 9.9.9", "card 4242 4242 4242 4242 and 4242-4242-4242-4241 12345678901234567890",
    "+1 (713) 555-8702 +12345 + 44 20 7946 0958 +442079460958.", "é 4242424242424242 ünï a@b.cd", None, "", "1" * 30_000, "a" * 30_000 + "@", "call me on phone: (713) 555-8702 now", "order 713-555-8702",
    "contact: joe (at) example (dot) com", "4242 4242 4242 4242" * 50,
]


def brute_spans(t):
    rx = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, p in enumerate(rx):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (c > "4") for i, c in enumerate(reversed(d))) % 10 == 0
            if k == 0 or (k == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (k == 2 and 14 <= len(d) <= 19 and luhn) or (k == 3 and 10 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii(spark, empty):
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(PII)], "doc_id long, text string, kind int")
    for r in pii.pii_query(df).collect():
        t = PII[r["doc_id"]] or ""
        want = brute_spans(t) if len(t) < 20_000 else []
        listed = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest(), t[:60]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(k == x for _, x, _ in want) for k in range(4)]
        assert set(listed) <= set(r["spans"].split(",")) or not listed
    spans = {r["doc_id"]: r["spans"] for r in pii.pii_query(df).collect()}
    assert "phone:" in spans[9] and spans[10] == "" and "email:" in spans[11]
    out = {r["doc_id"]: r["text"] for r in pii.redacted(df).collect()}
    assert out[9] == "call me on phone: [PHONE] now" and out[4] == "é [CARD] ünï [EMAIL]" and out[5] is None and out[6] == ""
    assert pii.pii_query(empty).count() == 0


# ---- 5: toxicity ----


def test_toxicity(spark):
    r = random.Random(5)
    bad = ["grok", "blar", "snub"]
    texts = []
    for i in range(400):
        toxic = i % 4 == 0
        ws = [r.choice("abcdefghij") + r.choice("aeiou") + r.choice("klmnop") + r.choice("aeiou") for _ in range(60)]
        for _ in range(3 * toxic):
            ws.insert(r.randrange(60), r.choice(bad) + r.choice(["a", "ly", "ten", ""]))
        texts.append((i, " ".join(ws) + ".", int(toxic)))
    docs = spark.createDataFrame([(i, t, 7) for i, t, _ in texts] + [(1000, None, 7), (1001, "", 7), (None, "grok blar", 7), (1, texts[1][1], 7)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in texts] + [(5000, 1, 1), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_query(docs, labels).collect()
    assert len(got) == 404
    wrong = sum(r["predicted"] != (r["doc_id"] % 4 == 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 400)
    assert wrong <= 8
    assert all(r["predicted"] == 0 for r in got if r["doc_id"] in (1000, 1001)) and all(0 <= r["score"] <= 1 for r in got)
    nothing = toxicity.toxicity_query(docs, labels.limit(0)).collect()
    assert all(r["score"] == 0 for r in nothing)


def test_grammar_damps_negation_and_report():
    g = toxicity.Grammar({"words": {"fool": 1.0}, "stems": {}, "calibration": (-2.0, 3.0, 1.0), "known": True})
    plain, negated, reported, target = (g.score(t) for t in ("what a fool", "he is not a fool", "she said a fool", "you fool"))
    assert negated < reported < plain < target


def test_nothing_learned_keeps_every_row(spark, empty):
    """Labels that no word tells apart, one class only, no labels, no documents: no score, nothing rejected."""
    r = random.Random(4)
    texts = [(i, prose(r, 30), "en", "s", 1) for i in range(40)]
    df = spark.createDataFrame(texts + [(None, None, None, None, None), (50, "", "en", "s", 0)], DOC).withColumn("toxic", F.lit(1))
    for toxic in (lambda i: i % 3 != 0, lambda i: True, lambda i: False):
        labels = spark.createDataFrame([(i, 1, int(toxic(i))) for i in range(40)], "doc_id long, quality int, toxic int")
        model = toxicity.fit(df, labels)
        assert not model["known"] and collected(toxicity.keep_clean(df, model)) == collected(df)
        assert all(x["score"] == 0 and x["predicted"] == 0 for x in toxicity.toxicity_query(df, labels).collect())
    assert toxicity.toxicity_query(empty, labels).count() == 0
    assert toxicity.toxicity_query(df, labels.limit(0)).count() == df.count()


def test_toxic_families():
    """Independent texts that share a common word are families of their own; near copies are one."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base = [" ".join(["zork", *[word() for _ in range(60)]]) for _ in range(20)]
    copies = [t + " more words" for t in base[:5]] + base[5:8]
    got = toxicity.families(base + copies)
    assert len(set(got)) == 20 and got[20:] == got[:8]
    model = toxicity.learn([(t, 1) for t in base + copies] + [(" ".join(word() for _ in range(60)), 0) for _ in range(40)])
    assert set(model["stems"]) | set(model["words"]) == {"zork"}


def test_sample_bounds(spark):
    """Rows that repeat a doc_id don't widen the sample; it ends once its bytes are passed."""
    df = spark.createDataFrame([(i % 6, f"text {i} " + "pad " * 100) for i in range(60)] + [(9, "x" * 500_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] * 3, "doc_id long, toxic int")
    for rows, size, most in ((100, 1 << 30, 7), (4, 1 << 30, 4), (100, 1000, 4)):
        out = toxicity.sampled(df, labels, None, rows, size).collect()
        assert 1 <= len(out) <= most and len({r["doc_id"] for r in out}) == len(out), (rows, size)


def test_very_long_text():
    g = toxicity.Grammar({"words": {"fool": 1.0}, "stems": {"dolt": 0.5}, "calibration": (-2.0, 3.0, 1.0), "known": True})
    assert g.score("plain words here. " * 200_000) == g.score("") < 0.5 < g.score("plain words here. " * 200_000 + "you fool") == g.score("you fool")
    assert g.sums("doltish") == g.sums("dolt") != g.sums("dol") == g.sums(None)


def test_composed_transducers():
    """The composed machine weighs every string as the five machines do one after the other."""
    from arbora.llm.transducer import NEVER, Transducer

    machine = toxicity.clause_machine()
    alphabet = sorted({read for _, read in machine.arcs})
    parts, letters = [], alphabet
    for make in (toxicity.negation, toxicity.reported_speech, toxicity.target, toxicity.threat, toxicity.insult):
        parts.append(make(letters))
        letters = sorted(parts[-1].written)

    def runs(m, string):
        front = [(s, (), 0.0) for s in m.starts]
        for x in string:
            front = [(to, (*out, y), w + v) for s, out, w in front for y, v, to in m.arcs.get((s, x), ())]
        return [(out, w + m.finals[s]) for s, out, w in front if s in m.finals]

    r = random.Random(1)
    for _ in range(300):
        paths = [(tuple(r.choice(alphabet) for _ in range(r.randint(0, 7))), 0.0)]
        got = machine.weight(paths[0][0])
        for m in parts:
            paths = [(out, w + v) for string, w in paths for out, v in runs(m, string)]
        assert got == pytest.approx(max((w for _, w in paths), default=NEVER))
    assert Transducer([0], {}, {}).weight("") == NEVER


# ---- 6: BPE ----


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_bpe_equals_the_library(whole):
    tree = bpe.TreeBPE(tokenizer_path(), long=16, leaf=3)
    r = random.Random(6)
    texts = ["", " ", "Hello World's it'll 12 3.5!!", "<|endoftext|>a<|startoftext|> b", "ＡＢ ß İ ǰ J̌ Ω Ω Σας ΣΑΣ", "日本語 テスト 🙂🙂 é é", "a\x1cb\x85c d", "don't DON'T 'Re"]
    texts += ["".join(r.choice("abcdehinorstuABü") for _ in range(n)) for n in (15, 16, 17, 40, 200, 999)] + ["a" * 5000, "ab" * 700 + "!" * 300, prose(r, 50)]
    texts += ["".join(r.choice(["the", "ing", "tion", "er", "x", "ß", "你"]) for _ in range(100)) for _ in range(20)]
    for t in texts:
        ids = whole.encode(t, add_special_tokens=False).ids
        assert tree.encode(t) == ids, t[:50]
        assert tree.decode(ids) == whole.decode(ids, skip_special_tokens=False)


def test_bpe_tree_of_texts(spark, whole):
    """Cuts anywhere in a text; on the tables' own documents the joins are made and the ids are the library's."""
    tree = bpe.TreeBPE(tokenizer_path(), long=16, leaf=3, stretch=5)
    r = random.Random(7)
    parts = ["the", "ing", "<|endoftext|>", "<|endof", " ", "  ", "\n", "é", "e\u0301", "Σ", "İ", "日", "'s", "'", "12", ".", "!", "\x85", "x" * 20, "ab ", "ß"]
    for _ in range(400):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 40)))
        assert tree.encode(text) == whole.encode(text, add_special_tokens=False).ids, text
    assert tree.joins > 1000 and tree.grown > 0
    tree = bpe.TreeBPE(tokenizer_path())
    some = "x" * 3000 + " tail " + "word " * 3000
    for text in [x["text"] or "" for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [some, "y" * 40_000]:
        ids = whole.encode(text, add_special_tokens=False).ids
        assert tree.encode(text) == ids
        assert tree.digests(text)[2] == hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert tree.joins > 200


def test_bpe_rows(docs, empty, rows, whole):
    got = collected(bpe.digests(docs, tokenizer_path()))
    want = []
    for i, t, *_ in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.digests(empty, tokenizer_path()).count() == 0
    back = bpe.decode(bpe.encode(docs, tokenizer_path()), tokenizer_path()).collect()
    assert len(back) == len(rows)


# ---- 7: SimHash ----


def brute_fingerprint(t):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(ws[k : k + 3]), 42) for k in range(max(1, len(ws) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(docs, empty, rows):
    got = simhash.near_duplicates(docs).collect()
    fp = [brute_fingerprint(t) for _, t, *_ in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if bin(fp[i] ^ fp[j]).count("1") <= 2:
            group[find(i)] = find(j)
    ids = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    want = sorted(((d, f"{fp[i]:016x}", ids.get(find(i))) for i, (d, *_) in enumerate(rows)), key=repr)
    assert sorted(map(tuple, got), key=repr) == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(ids.values()))


def test_ball_links(spark):
    r = random.Random(7)
    base = [r.getrandbits(64) for _ in range(5)]
    near = [b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base for _ in range(6)] + [b ^ 0b111 for b in base]
    fps = sorted({x - (1 << 64) if x >> 63 else x for x in base + near})
    from arbora.llm.common import components

    e = simhash.link_fingerprints(spark.createDataFrame([(x,) for x in fps], "fp long"))
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for a, b in e.collect())
    root = {r["node"]: r["root"] for r in components(e).collect()}
    for a, b in itertools.combinations(fps, 2):
        if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2:
            assert root[a] == root[b]


def shingles(t):
    ws = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
    return {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()


def test_stage_keeps_one_of_similar(spark):
    """Planted copies at a similarity of 0.8 to 0.95, all pairs by brute force; a passage that many share."""
    import corpus_pipeline

    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    passage, texts = " ".join(word() for _ in range(40)), ["", None, " \t", "Two words", "two WORDS"]
    for k in range(60):
        words = [word() for _ in range(r.randint(30, 300))]
        texts.append(" ".join(words) + (" " + passage if k % 3 == 0 else ""))
        for edits in (1, 2, 4, 6):
            copy = texts[-1].split()
            for _ in range(edits):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    rows = [(1000 - i if i % 50 else None, t, "en", "s1", i) for i, t in enumerate(texts)]
    rows += [(None, "no id here at all", "en", "s1", 0)] * 2
    sets, group, between = [shingles(x[1]) for x in rows], list(range(len(rows))), 0

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both, all_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
        if 5 * both >= 4 * all_:
            group[find(i)] = find(j)
            between += 0.8 <= both / max(1, all_) <= 0.95
    assert between > 60
    want = {}
    for i, x in enumerate(rows):
        best = want.get(find(i))
        want[find(i)] = best if x[0] is None or (best is not None and best < x[0]) else x[0]
    got = corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, DOC).repartition(5), "").collect()
    assert sorted((x["doc_id"] for x in got), key=repr) == sorted(want.values(), key=repr)


def test_work_on_a_group_of_near_copies(spark, monkeypatch):
    """A third of all rows copied from one text, some too far to be similar: pairs compared stay in proportion to rows."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base, texts = [word() for _ in range(140)], []
    for _ in range(400):
        copy = base[:]
        for at in r.sample(range(140), r.randint(0, 6)):
            copy[at] = word()
        texts.append(" ".join(copy))
    texts += [" ".join(word() for _ in range(60)) for _ in range(800)]
    r.shuffle(texts)
    seen, alike = [], simhash.alike

    def counted(docs, nodes, pairs):
        seen.append(pairs.count())
        return alike(docs, nodes, pairs)

    monkeypatch.setattr(simhash, "alike", counted)
    got = simhash.keep_one_similar(spark.createDataFrame([(i, t, "en", "s1", 1) for i, t in enumerate(texts)], DOC).repartition(7)).collect()
    sets, group = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    holders = {}
    for i, x in enumerate(sets):
        for h in x:
            holders.setdefault(h, []).append(i)
    for i, j in {p for v in holders.values() for p in itertools.combinations(v, 2)}:
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            group[b] = a
    assert sorted(x["doc_id"] for x in got) == sorted({find(i) for i in group})
    assert sum(seen) < 3 * len(texts)


def join_rows(spark, run):
    """The rows made by the joins of ``run`` that compare places in prefixes."""
    store, made = spark._jsparkSession.sharedState().statusStore(), []
    ran = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    executions = store.executionsList()
    for e in (executions.apply(k) for k in range(ran, executions.size())):
        metrics, nodes = store.executionMetrics(e.executionId()), store.planGraph(e.executionId()).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            for m in (node.metrics().apply(k) for k in range(node.metrics().size()) if "Join" in node.name() and "least(" in node.desc()):
                if m.name() == "number of output rows" and metrics.contains(m.accumulatorId()):
                    made.append(int(metrics.apply(m.accumulatorId()).replace(",", "")))
    return made


def test_copies_meet_once(spark):
    """Long copies too far from each other to be similar: each pair meets, and not at every shingle it shares."""
    r = random.Random(13)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    texts = []
    for size, edits in ((1500, 28), (60, 2), (400, 7)):
        base = [word() for _ in range(size)]
        for _ in range(14):
            copy = base[:]
            for at in r.sample(range(size), edits):
                copy[at] = word()
            texts.append(" ".join(copy))
    docs = spark.createDataFrame([(i, t, "en", "s1", 1) for i, t in enumerate(texts)], DOC).repartition(3)
    nodes = simhash.shingle_nodes(docs)
    shared = simhash.shared_shingles(nodes)
    none = spark.createDataFrame([], "node long, root long")
    pairs = []
    rows = join_rows(spark, lambda: pairs.extend(simhash.cross_pairs(shared, none, spark.createDataFrame([], "a long, b long")).collect()))
    at = {}
    for x in nodes.collect():
        for i, h in enumerate(x["prefix"]):
            at.setdefault(h, []).append((x["node"], x["n"], i))
    want = set()
    for holders in at.values():
        for (a, n, i), (b, n2, i2) in itertools.combinations(holders, 2):
            if 9 * min(n - i, n2 - i2) >= 4 * (n + n2):
                want.add((max(a, b), min(a, b)))
    assert {(x["a"], x["b"]) for x in pairs} == want and len(want) > 150
    assert len(rows) == 1 and rows[0] < 2 * len(want)


# ---- 8: embeddings ----


def test_caps(spark):
    r = np.random.default_rng(8)
    base = r.normal(size=(60, 32))
    data = [*base, *(base[:20] + r.normal(size=(20, 32)) * 0.1), *(np.repeat(base[:1], 40, 0) + r.normal(size=(40, 32)) * 0.08), base[5], base[5] * 2]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    odd = [(500, None), (501, [0.0] * 32), (502, [float("inf")] + [1.0] * 31), (503, []), (None, rows[3][1]), (504, [1.0, 2.0]), (3, rows[3][1])]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows + odd], "vec_id long, embedding array<double>, label int, part int")
    got = capfilter.dedup_query(df).collect()
    assert len(got) == len(rows) + len(odd)
    keyed = [(i, np.array(v)) for i, v in [*rows, (504, [1.0, 2.0]), (3, rows[3][1])]]
    link = lambda x, y: len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95
    truth = {}
    for k, (i, x) in enumerate(keyed):
        truth[i] = sum(link(x, y) for m, (_, y) in enumerate(keyed) if m != k)
    for row in got:
        if row["vec_id"] in truth:
            assert row["n_links"] == truth[row["vec_id"]], row
        elif row["vec_id"] is not None:
            assert (row["n_links"], row["component_id"], row["kept"]) == (0, row["vec_id"], True)
        else:
            assert (row["n_links"], row["component_id"], row["kept"]) == (0, None, False)
    # blocks of a heavy filter give the same
    old, capfilter.BLOCK = capfilter.BLOCK, 8
    try:
        assert collected(capfilter.dedup_query(df)) == sorted(map(tuple, got), key=repr)
    finally:
        capfilter.BLOCK = old
    assert capfilter.dedup_query(df.limit(0)).count() == 0


def test_cap_recall():
    r = np.random.default_rng(9)
    x = r.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = r.normal(size=x.shape)
    n -= (n * x).sum(1, keepdims=True) * x
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * n / np.linalg.norm(n, axis=1, keepdims=True)
    for size in (10_000, 1_000_000):
        f = capfilter.Filters(64, size)
        a, b = f.passed(x[:1500]), f.passed(y[:1500])
        assert np.mean([bool(set(p) & set(q)) for p, q in zip(a, b)]) >= 0.97
        assert np.mean([len(p) for p in a]) < 4 * capfilter.CAPS


@pytest.mark.parametrize(("dim", "size"), [(4, 100_000), (8, 2_100_000), (16, 1_000_000), (16, 20_000_000), (64, 3_000_000), (256, 1_000_000)])
def test_cap_recall_at_any_length_and_size(dim, size):
    """Fresh pairs, not those that the number of codes was fitted on; sizes on both sides of the change of shape."""
    r = np.random.default_rng(dim + 1)
    x = r.normal(size=(800, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = r.normal(size=x.shape)
    n -= (n * x).sum(1, keepdims=True) * x
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * n / np.linalg.norm(n, axis=1, keepdims=True)
    f = capfilter.Filters(dim, size)
    assert np.mean([bool(set(p) & set(q)) for p, q in zip(f.passed(x), f.passed(y))]) >= 0.95


def test_short_and_double_vectors_are_told_apart():
    a, b = capfilter.raw_vector([0.5, 1.0]), capfilter.raw_vector([0.1, 1.0])
    assert a[:1] == b"f" and b[:1] == b"d" and capfilter.length_of(a) == capfilter.length_of(b) == 2
    assert capfilter.raw_vector([1e300, 1.0])[:1] == b"d" and capfilter.raw_vector([-0.0, 1.0]) == capfilter.raw_vector([0.0, 1.0])


# ---- 9: passages ----


def brute_dedup(rows, length):
    order = sorted((i is None, i if i is not None else (1 << 62) + (xxhash.xxh64_intdigest((t or "").encode()) >> 3), (t or "").encode(), k) for k, (i, t) in enumerate(rows))
    seen, out = set(), {}
    for _, _, raw, k in order:
        cover = np.zeros(len(raw) + 1, int)
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                cover[p] += 1
                cover[p + length] -= 1
            seen.add(w)
        gone = np.cumsum(cover)[:-1] > 0 if raw else np.zeros(0, bool)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[k] = (rows[k][0], len(raw), int(gone.sum()), spans, bytes(np.frombuffer(raw, np.uint8)[~gone]))
    return sorted(out.values(), key=repr)


@pytest.mark.parametrize(("length", "hot"), [(100, 5000), (100, 1), (20, 2)])
def test_suffix_dedup(spark, docs, empty, rows, length, hot):
    r = random.Random(length)
    shared = prose(r, 60)
    more = [(100 + k, prose(r, r.randint(0, 20)) + shared[r.randint(0, 100) :] + prose(r, 5)) for k in range(30)] + [(200, "z" * 900), (201, "abc" * 400), (202, shared + shared)]
    data = [(i, t) for i, t, *_ in rows] + more
    df = spark.createDataFrame([(*x, 9) for x in data], "doc_id long, text string, block int")
    got = suffix._dedup(df, length, 4000, 50, hot, True).collect()
    assert sorted(((a, b, c, d, bytes(e)) for a, b, c, d, e in got), key=repr) == brute_dedup(data, length)
    assert suffix.dedup_query(empty).count() == 0


def test_suffix_array():
    r = random.Random(1)
    for n in [*range(0, 40), 200]:
        t = np.array([r.randint(1, 3) for _ in range(n)], np.int64)
        assert suffix.suffix_array(t).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 500)
    r = random.Random(2)
    t = prose(r, 600).encode()
    runs = suffix.runs_of([t, t[:50], b""])
    assert runs["count"].sum() == len(t) - 99 and sorted(itertools.chain.from_iterable(range(a, a + n) for a, n in zip(runs["lo"], runs["count"]))) == list(range(len(t) - 99))


# ---- 10: languages ----


def test_languages(spark):
    r = random.Random(10)
    parts = {"en": ["th", "er", "ing", "and"], "de": ["sch", "ü", "ung", "ei"], "fr": ["é", "eau", "oi", "qu"], "es": ["ñ", "ción", "ll", "ó"], "xx": ["zz", "kk", "qq", "w"]}
    data = []
    for i in range(500):
        lang = list(parts)[i % 5]
        data.append((i, " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 3))) for _ in range(40)), lang, "s"))
    odd = [(1000, None, "en", "s"), (1001, "", "en", "s"), (1002, "123 !?", None, "s"), (None, "thering", "de", "s"), (1, data[1][1], "en", "s")]
    df = spark.createDataFrame([(*x, 3, 4) for x in data + odd], "doc_id long, text string, lang string, source string, features int, score int")
    got = langid.language_query(df).collect()
    assert len(got) == 505
    held = [r for r in got if r["held_out"] and r["doc_id"] < 500]
    assert held and np.mean([r["lang_pred"] == data[r["doc_id"]][2] for r in held]) > 0.95
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1000, 1001, 1002)) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in langid.language_query(df.where("doc_id > 999")).collect()} <= {"und", "en"}
    long = "schung " * 100_000
    assert langid.features(long) is not None


def test_languages_of_nothing_and_of_repeated_rows(spark, empty):
    assert langid.language_query(empty).count() == 0
    rows = [(i % 4, "the thing and the other" if i % 2 else "der schuh und das ei", "en" if i % 2 else "de") for i in range(400)]
    df = spark.createDataFrame([*rows, (9, "der schuh und das ei " * 20_000, None), (10, "the thing " * 20_000, None)], "doc_id long, text string, lang string")
    model = langid.fit(df, F.lit(False), per_lang=3)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, model).collect()}
    assert got == {0: "de", 1: "en", 2: "de", 3: "en", 9: "de", 10: "en"}


# ---- pipeline ----


def test_pipeline_by_the_rule_of_the_stage(spark, docs, empty, tmp_path, whole):
    """All stages in a row, near-duplicates by five words and a similarity of 0.8; then over an empty table."""
    import corpus_pipeline
    from collections import Counter

    toxic = [(300 + k, f"zork zork {prose(random.Random(k), 20)} zork.", "en", "s2", 9) for k in range(40)]
    labels = [(i, 1, 0) for i in range(30)] + [(i, 1, 1) for i, *_ in toxic[:35]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.drop("block").unionByName(spark.createDataFrame(toxic, DOC)).write.parquet(str(tmp_path / "documents.parquet"))
    now, tables = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        assert name == "bpe" or out.columns == now.columns
        out.write.parquet(str(tmp_path / name))
        tables[name] = (now.collect(), spark.read.parquet(str(tmp_path / name)).collect())
        now = spark.read.parquet(str(tmp_path / name))
    before, after = tables["toxicity"]
    assert Counter(map(repr, after)) == Counter(repr(r) for r in before if "zork" not in (r["text"] or ""))
    before, after = tables["simhash_near_dedup"]
    sets, group = [shingles(r["text"]) for r in before], list(range(len(before)))
    for _ in range(5):
        for i, j in itertools.combinations(range(len(before)), 2):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                group[i] = group[j] = min(group[i], group[j])
    best = {}
    for i, r in enumerate(before):
        if r["doc_id"] is not None:
            best[group[i]] = min(r["doc_id"], best.get(group[i], r["doc_id"]))
    assert sorted(r["doc_id"] for r in after if r["doc_id"] is not None) == sorted(best.values())
    before, after = tables["pii"]
    assert Counter(r["text"] for r in after) == Counter(r["text"] for r in before)  # nothing personal in these
    before, after = tables["mixing"]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    copies = Counter(r["doc_id"] for r in after)
    share = {r["doc_id"]: r["taken"] / r["size"] for r in mixing.mix(spark.read.parquet(str(tmp_path / "pii"))).collect() if r["size"]}
    for r in before:
        n = copies.get(r["doc_id"], 0)
        assert (n == 0) if not size(r["text"]) else int(share[r["doc_id"]]) <= n <= int(share[r["doc_id"]]) + 1
    before, after = tables["bpe"]
    ids = [whole.encode(r["text"] or "", add_special_tokens=False).ids for r in before]
    assert sorted(r["ids_sha256"] for r in after) == sorted(hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for x in ids)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(after)
    none = str(tmp_path / "none")
    empty.write.parquet(f"{none}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{none}/labels.parquet")
    assert corpus_pipeline.run(spark, none).count() == 0


# ---- long texts, null and repeated ids, clashing names ----


def test_very_long_texts_in_counts_mix_and_fingerprints(spark):
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    df = spark.createDataFrame([(1, long, "a"), (2, long + " end", "a"), (3, "short text here", "b")], "doc_id long, text string, source string")
    assert {r["doc_id"]: r["n_words"] for r in lm.lm_query(df).collect()} == {1: 60_000, 2: 60_001, 3: 3}
    assert {r["doc_id"]: r["size"] for r in mixing.mix_query(df).collect()} == {1: 60_000, 2: 60_001, 3: 3}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    assert got[1] == (f"{brute_fingerprint(long):016x}", 1) and got[2][1] == 1 and got[3] == (f"{brute_fingerprint('short text here'):016x}", 3)


def test_personal_data_of_null_and_repeated_ids(spark, empty):
    rows = [(None, "mail a@b.cd now"), (7, "mail a@b.cd now"), (7, "mail a@b.cd now"), (7, None), (None, None), (8, "x " * 100_000 + "10.0.0.1")]
    got = sorted(((r["doc_id"], r["n_email"], r["n_ip"]) for r in pii.pii_query(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(None, 1, 0), (7, 1, 0), (7, 1, 0), (7, 0, 0), (None, 0, 0), (8, 0, 1)], key=repr)
    assert pii.pii_query(empty).count() == 0


def test_pipeline_over_clashing_columns(spark, tmp_path):
    """Columns named like those used inside travel through all stages but the last."""
    import corpus_pipeline

    odd = "doc_id long, text string, lang string, source string, n_chars long, block int, spans string, fine int, taken long, row string, label int, node long, key long, score double"
    rows = [(k, prose(random.Random(k), 40), "en", f"s{k % 2}", 5, k, "x", k, 1, "r", 0, k, k, 0.5) for k in range(12)] + [(None, "one two three four five six", "en", None, 1, 1, "y", 1, 2, "r", 1, 1, 1, 0.1)]
    spark.createDataFrame(rows, odd).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(12)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = now.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == names, name
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    assert {r["block"] for r in now.collect() if r["doc_id"] is not None} <= set(range(12)) and now.count() >= 13


def test_pii_selection_and_long_lists(spark):
    """Spans settled best first, more matches than a chunk holds, redaction of every selected place, wider forms."""
    many = " ".join(f"mail u{i}@h{i}.org call (555) 123-{i:04d} or +49 30 {1000000 + i} é" for i in range(700))
    wide = ["tel 030 1234567 now", "phone: 06 12 34 56 78.", "host 2001:db8::1 up", "order 030 1234567 now", "at 12:30:45 sharp", "a std::move b", "tel 555-123-4567 @ 12.de x", "x" * 40 + "é tel 555 123 4567"]
    rows = [(0, many), *enumerate(wide, 1), (20, None), (20, "")]
    got = pii.all_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] < 20}
    for r in got:
        base, spans, selected = ([(x["s"], x["k"], x["e"]) for x in r[c]] for c in ("base", "spans", "selected"))
        assert base == brute_spans(r["text"]) and spans == sorted(spans) and set(base) <= set(spans) <= set(selected)
        score = {(x["s"], x["k"], x["e"]): x["over"] for x in r["extra"]}
        taken = list(base)
        for c in sorted(score, key=lambda c: (-score[c], c)):
            if not any(b[0] < c[2] and c[0] < b[2] for b in taken):
                taken.append(c)
        assert spans == sorted(taken)
    assert len(by_id[0]["spans"]) == 2100 and by_id[0]["base"][-1]["e"] == len(many) - 2
    kinds = {i: [pii.KINDS[x["k"]] for x in r["spans"]] for i, r in by_id.items() if i}
    assert kinds[1] == kinds[2] == kinds[8] == ["phone"] and kinds[3] == ["ip"] and kinds[4] == kinds[5] == kinds[6] == []
    cut = {r["doc_id"]: r["text"] for r in pii.redacted(spark.createDataFrame(rows[:-2], "doc_id long, text string")).collect()}
    for i, text in rows[:-2]:
        want, at = "", 0
        runs = []
        for x in by_id[i]["selected"]:
            if runs and x["s"] < runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], x["e"])
            else:
                runs.append([x["s"], x["e"], x["k"]])
        for a, b, k in runs:
            want, at = want + text[at:a] + f"[{pii.KINDS[k].upper()}]", b
        assert cut[i] == want + text[at:]
