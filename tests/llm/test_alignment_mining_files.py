"""Operators 11 to 13 against brute force: whole texts by the libraries, all pairs of vectors, all ids in order."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arbora.llm import alignment, grammar, stretches, voronoi
from arbora.llm.bpe import byte_symbols
from arbora.llm.queries import tokenizer_path

ODD = [
    "", None, "a▁b", " lead", "  two", "tail ", "tail  ", "\n", "\n\n x", "a \n b", "tab\t x", " ", "<|endoftext|> x <s></s>", "don't we'll 'twas", "3.14abc 12,5", "é à  ü",
    "  x 　y  z  w", "日本語 テキスト", "\x00\x1c a", "á b", "…«x» —", "x" * 5000, "!!!???...", "aaa" + " " * 40 + "b", "<0x0A> x", "\x85 a \x85b", "ﬁ ﷺ 🙂🙂 x🙂y",
    "<|startoftext|> A <|EndOfText|><|endoftext|>", "ÀB İI ΑΣ K", "Áb ≠ x",
]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(1)
    signs = [" ", "  ", "\n", "a", "B", "Z", "é", "9", "12", "'s", "'", "...", "-", "▁", "\t", "the", "ing", " ", "日", "🙂", "<", ">", "|"]
    words = ["token", "Tokens", "of", "the", "corpus", "are", "counted,", "twice.", "naïve", "(see", "above)"]
    made = ["".join(r.choice(signs) for _ in range(r.randint(1, 25))) for _ in range(300)]
    made += [" ".join(r.choice(words) for _ in range(r.randint(1, 80))) for _ in range(60)]
    return ODD + made + made[:5] + ["long text " * 20_000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i if i % 17 else i // 2, t, 1, "x") for i, t in enumerate(texts)] + [(None, "no id", 1, "x"), (None, None, 2, "y"), (5, ODD[5], 1, "x")]
    # columns that clash with names used inside
    return spark.createDataFrame(rows, "doc_id long, text string, block int, hash string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# ---- 11 ----


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    byte = {c: n for n, c in enumerate(byte_symbols())}
    a_raw = lambda i: bytes(byte[c] for c in a.id_to_token(i))
    b_raw = lambda i: bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    seen, counts = [], Counter()
    for i, t in rows:
        ids = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        raw = ([a_raw(x) for x in ids[0]], [b_raw(x) for x in ids[1]])
        if not t or any(b"".join(x) != (" " + t).encode() for x in raw):
            seen.append((i, [], [], [], ""))
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in raw]
        links = [(ids[0][j], ids[1][k]) for j, e in enumerate(ends[0]) for k, f in enumerate(ends[1]) if max(e - len(raw[0][j]), f - len(raw[1][k])) < min(e, f)] if len(t) < 2000 else near(ids, raw, ends)
        groups, at = [], [0, 0]
        for cut in sorted({*ends[0]} & {*ends[1]}):
            to = [e.index(cut, s) + 1 for e, s in zip(ends, at)]
            groups.append("|".join(",".join(map(str, x[s:e])) for x, s, e in zip(ids, at, to)))
            at = to
        counts.update(links)
        seen.append((i, *ids, links, ";".join(groups)))
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(n, top.get(y, 0))
    digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    return sorted(((i, len(x), len(y), g.count("|") if g else 0, len(ln), sum(counts[p] == top[p[1]] for p in ln), sum(counts[p] for p in ln), digest(g)) for i, x, y, ln, g in seen), key=repr), {i: g for i, *_, g in seen}


def near(ids, raw, ends):
    """Links of a long text by walking both sides."""
    out, k = [], 0
    for j, e in enumerate(ends[0]):
        s = e - len(raw[0][j])
        while ends[1][k] <= s:
            k += 1
        m = k
        while m < len(ends[1]) and ends[1][m] - len(raw[1][m]) < e:
            out.append((ids[0][j], ids[1][m]))
            m += 1
    return out


def test_alignment(spark, docs, empty):
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want, _ = plain_alignment(rows)
    assert sorted(map(tuple, alignment.alignment_query(docs, *paths).collect()), key=repr) == want
    some = docs.where("doc_id < 40")
    by = plain_alignment([(r["doc_id"], r["text"]) for r in some.collect()])[0]
    got = alignment.align(some, *paths).collect()
    assert sorted((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") for r in got) == sorted((*x[:5], x[7]) for x in by)
    assert alignment.alignment_query(empty, *paths).count() == 0


def test_alignment_in_small_blocks(spark, docs):
    """Counts are those of the whole corpus, whatever the blocks."""
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    count = lambda size: sorted(map(tuple, alignment.link_counts(alignment.described(docs, *paths, block_bytes=size)).collect()))
    whole = count(1 << 24)
    assert count(200) == whole and any(not best for *_, best in whole)


def test_whole_texts_where_nothing_may_be_cut():
    own = alignment.Aligner(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    texts = pa.array(["some words, and 12 more", "x\n y"])
    cut = own.block(texts)
    own.cutter = stretches.Cutter(np.zeros((256, 256), bool))
    own.known.known.clear()
    plain = own.block(texts)
    assert plain["groups"] == cut["groups"] and plain["per"].tolist() == cut["per"].tolist() and len(plain["used"]) == 2 < len(cut["used"])


# ---- 12 ----


def plain_mining(rows, low=50, high=95):
    taken = [(i, m, [int(np.floor(256 * c)) for c in x]) for i, m, x in rows if i is not None and m is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out, asked = [], set()
    for i, m, x in taken:
        if i % 50 or (i, m, tuple(x)) in asked:
            continue
        asked.add((i, m, tuple(x)))
        for p, j in sorted((-dot(x, y), j) for j, n, y in taken if j != i and n == m)[:5]:
            best = sorted((-dot(x, y), k) for k, n, y in taken if k != i and n != m and -low * p <= 100 * dot(x, y) <= -high * p)[:3]
            out += [(i, j, r + 1, k, -p, -s) for r, (s, k) in enumerate(best)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<double>, home int, part string"


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(5)
    centers = r.normal(size=(12, 6)) * 2
    rows = [(i, int(i % 4 if r.random() < 0.8 else r.integers(4)), [float(v) for v in centers[i % 12] + r.normal(size=6) * 0.3]) for i in range(700)]
    v = rows[3][2]
    return rows + [
        rows[50], (3000, 1, v), (3001, 1, v), (3002, 2, v), (3002, 2, v), (None, 1, v), (7000, None, v), (7001, 1, None), (7002, 1, [1.0, None]), (7003, 2, [float("nan")] * 6),
        (7050, 2, [1.5]), (7100, 3, [0.0] * 6), (7150, 9, [1.0] * 6), (100, 3, [1.0, 2.0]), (7200, 1, []),
    ]


def test_hard_negatives(spark, vectors, monkeypatch):
    df = spark.createDataFrame([(*x, 1, "q") for x in vectors], VECTORS).repartition(4)
    want = plain_mining(vectors)
    assert sorted(map(tuple, voronoi.hard_negatives(df, df.where("vec_id % 50 = 0")).collect())) == want and len(want) > 100
    # many cells, groups, chunks and parts
    for name, value in (("PAGE", 40), ("GROUP", 3), ("PART", 50)):
        monkeypatch.setattr(voronoi, name, value)
    join = voronoi.Join(df, df.where("vec_id % 50 = 0"))
    assert len(join.pivots.x) > 10
    served = join.positives(5)
    assert sorted(map(tuple, join.negatives(served, 3, 50, 95).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == want


def test_bounds_keep_rows_from_groups(spark, monkeypatch):
    """Far clusters are not copied to each other's anchors."""
    monkeypatch.setattr(voronoi, "PAGE", 60)
    monkeypatch.setattr(voronoi, "GROUP", 2)
    r = np.random.default_rng(3)
    rows = [(i, i // 100, [float(v) for v in np.eye(6)[i // 100] * 40 + r.normal(size=6) * 0.1]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    join, copied = voronoi.Join(df, df.where("vec_id % 50 = 0")), []
    real = join.answers

    def counted(served, keys, anchors, how, schema):
        copied.append(join.rows.join(served, keys).where("d >= least").count())
        return real(served, keys, anchors, how, schema)

    monkeypatch.setattr(join, "answers", counted)
    assert join.positives(5).count() == 60
    assert copied[0] <= 600 < 600 * join.homes.select("group").distinct().count()


def test_hard_negatives_of_large_numbers_and_of_nothing(spark):
    big = [(i, i % 3, [float(3e9 * (1 + i % 5)), float(2e9 + i)]) for i in range(0, 120, 5)]
    df = spark.createDataFrame(big, "vec_id long, label int, embedding array<double>")
    top = (1 << 63) - 1
    got = sorted(map(tuple, voronoi.hard_negatives(df, df.where("vec_id % 50 = 0")).collect()))
    assert got == [] or all(x[4] <= top for x in got)
    assert voronoi.hard_negatives(df.limit(0), df.limit(0)).count() == 0 and voronoi.hard_negatives(df, df.limit(0)).count() == 0
    half = [(0, 1, [2.0**15]), (1, 1, [2.0**15]), (2, 2, [2.0**14]), (3, 2, [2.0**14 + 2]), (4, 3, [2.0**15])]
    df = spark.createDataFrame(half, "vec_id long, label int, embedding array<double>")
    assert [tuple(r) for r in voronoi.hard_negatives(df, df.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 1, 3, 2**46, 2**45 + 2**32), (0, 1, 2, 2, 2**46, 2**45)]


def test_mining_query_by_sql(spark, tmp_path, vectors):
    duckdb = pytest.importorskip("duckdb")
    df = spark.createDataFrame([x for x in vectors if x[0] is not None and len(x[2] or "xxxxxx") == 6 and x[0] not in (50, 3002)], "vec_id long, label int, embedding array<double>")
    df.write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/e/*.parquet'")
    assert sorted(map(tuple, voronoi.mining_query(df).collect())) == sorted(con.sql(voronoi.MINING_SQL).fetchall())


# ---- 13 ----


def plain_files(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.no_padding()
    t.no_truncation()
    made = [(i, np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")) for i, x in rows]
    return made


def test_token_files(spark, docs, empty, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    made = plain_files(rows)
    folder = str(tmp_path / "tokens")
    grammar.write_tokens(docs, tokenizer_path(), folder, shard_ids=500, range_rows=90, frequent=2)
    got = grammar.documents_of(spark, folder).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in made)
    assert spark.read.parquet(folder).count() > 10
    inorder = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in inorder] == np.cumsum([0] + [r["n_tokens"] for r in inorder])[:-1].tolist()
    keys = [(r["doc_id"] is None, r["doc_id"] or 0) for r in inorder]
    assert keys == sorted(keys)
    wanted = spark.createDataFrame([(3,), (5,), (20,), (999_999,)], "doc_id long")
    assert sorted((r["doc_id"], r["ids"]) for r in grammar.read_tokens(spark, folder, wanted).collect()) == sorted((i, x.tolist()) for i, x in made if i in (3, 5, 20))
    assert sorted(map(tuple, grammar.token_query(docs, tokenizer_path()).collect()), key=repr) == sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got), key=repr)
    assert grammar.token_query(empty, tokenizer_path()).count() == 0


def shard_of(ids, last, vocab, **more):
    rules, lengths, symbols = grammar.compress(ids, last, vocab, **more)
    width = "<u2" if vocab + len(rules) <= grammar.SHORT else "<u4"
    sizes = np.concatenate([np.ones(vocab, int), lengths])[symbols]
    at = np.searchsorted(np.cumsum(sizes), np.flatnonzero(last) + 1) + 1
    row = {"vocab": vocab, "rules": rules.astype("<u4").tobytes(), "lengths": lengths.astype("<u4").tobytes(), "symbols": symbols.astype(width).tobytes(), "doc_symbols": np.diff(at, prepend=0).tolist()}
    return grammar.Shard(row), len(rules)


@pytest.mark.parametrize("vocab,most", [(50, None), (70_000, None), (50, 3), (50, 0)])
def test_grammar_round_trip_and_random_access(vocab, most):
    r = np.random.default_rng(7)
    phrase = [r.integers(0, 50, r.integers(2, 9)) for _ in range(30)]
    docs = [np.concatenate([phrase[k] for k in r.integers(0, 30, r.integers(1, 40))]) for _ in range(60)] + [np.full(1001, 7), np.array([1]), np.array([7, 7])]
    ids = np.concatenate(docs)
    last = np.zeros(len(ids), bool)
    ends = np.cumsum([len(d) for d in docs])
    last[ends - 1] = True
    shard, n = shard_of(ids, last, vocab, frequent=3, most=most)
    assert shard.ids().tolist() == ids.tolist()
    assert n == most if most is not None else (n > 20 and len(shard.symbols) < len(ids) / 3)
    for k in (0, 5, 60, 61, 62):
        assert shard.document(k).tolist() == docs[k].tolist()
    for a, b in [(0, 1), (10, 500), (3, 3), (len(ids) - 5, len(ids) + 9), *r.integers(0, len(ids), (40, 2)).tolist()]:
        assert shard.stretch(a, b).tolist() == ids[a:b].tolist()


def test_encoder_gives_the_library_ids(texts):
    enc = grammar.WordEncoder(tokenizer_path())
    ids, counts = enc.encode(pa.array(texts))
    ends = np.cumsum(counts)
    for (_, want), a, b in zip(plain_files([(0, t) for t in texts]), ends - counts, ends):
        assert ids[a:b].tolist() == want[:-1].tolist()


def test_remembered_forgets():
    calls = []
    memo = stretches.Remembered(lambda words: [calls.append(w) or w.upper() for w in words], most=3)
    assert memo.of([b"a", b"b", b"a"]) and memo.of([b"c" * 100, b"d", b"e"]) == [b"C" * 100, b"D", b"E"]
    assert len(memo.known) <= 3 and b"c" * 100 not in memo.known and memo.of([b"d"]) == [b"D"] and calls.count(b"d") == 1


# ---- 3 and 10: no hot cell, bounded fits ----


def test_rows_without_ids_lie_in_many_shards(spark, monkeypatch):
    from arbora.llm import mixing

    seen = []
    real = mixing.checkpoint
    monkeypatch.setattr(mixing, "checkpoint", lambda df: seen.append(real(df)) or seen[-1])
    df = spark.range(100_000).selectExpr("cast(null as long) as doc_id", "concat('a b c d e ', id) as text", "'one' as source")
    assert abs(mixing.mix(df).agg(F.sum("taken")).first()[0] - 900_000) < 500
    cells = seen[0].agg(F.count("*"), F.max("words")).first()
    assert cells[0] > 4000 and cells[1] < 600
    monkeypatch.setattr(mixing, "CELL_ROWS", 4)
    seen.clear()
    mixing.mix(df)
    assert seen[0].count() > 20_000  # cells follow the rows


def test_a_fit_of_sixty_languages_in_bounded_tasks(spark, monkeypatch):
    from arbora.llm import langid

    r = random.Random(4)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    own = {f"l{k:02d}": ["".join(r.choices(alphabet, k=3)) for _ in range(6)] for k in range(60)}
    rows = [(i, " ".join("".join(r.choices(own[lang], k=2)) for _ in range(25)), lang) for i, lang in enumerate(list(own) * 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "family_of", lambda lang: f"f{int(lang[1:]) // 4}")
    model = langid.fit(df, F.col("doc_id") % 8 == 7)
    assert len(model["langs"]) == 60 and len(model["family_w"]) == 15 and len(model["pair_w"]) == 90
    dense = langid.Rows([langid.sparse(langid.features(t)) for _, t, _ in rows[:3]])
    assert np.array_equal(dense[np.array([2])][0], langid.features(rows[2][1])) and langid.predict(model, rows[5][1])[0] == rows[5][2]


def test_known_words_begin_anew():
    calls = []
    known = stretches.KnownWords(lambda words: [calls.append(w) or np.frombuffer(w, np.uint8).astype("<u4").tobytes() for w in words], most=3)
    for some in ([b"a", b"bc"], [b"bc", b"d" * 80, b"e"], [b"f", b"a", b"g"], [b"a"], []):
        ids, begins, sizes = known.of(pa.array(some, pa.large_binary()))
        assert [bytes(ids[b : b + n].astype(np.uint8)) for b, n in zip(begins, sizes)] == some
        assert len(known.words) <= 3
    assert calls.count(b"bc") == 1


# ---- 8 ----


def test_embedding_groups_by_sql(spark, tmp_path):
    """Planted copies, near copies and a chain of them, against all pairs in SQL."""
    duckdb = pytest.importorskip("duckdb")
    from arbora.llm import capfilter

    r = np.random.default_rng(2)
    base = r.normal(size=(60, 16))
    near = [base[k] + r.normal(size=16) * 0.02 for k in range(12)]
    chain = [base[40] + k * 0.28 * np.linalg.norm(base[40]) * np.eye(16)[3] for k in range(1, 4)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([*base, *near, *chain, base[5], base[5] * 3, np.zeros(16)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df.write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/e/*.parquet'")
    want = sorted(con.sql(capfilter.DEDUP_SQL).fetchall())
    assert sorted(map(tuple, capfilter.dedup_query(df).select("vec_id", "n_links", "component_id", "kept").collect())) == want and sum(x[1] for x in want) >= 24
