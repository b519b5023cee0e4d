r"""Personal data by candidate gradient boosting (DataFrame functions only on the main path).

Generators propose spans, overlapping ones too: four strict patterns (the base, always kept) and four
loose ones with high recall.  Each loose candidate gets format and context features; boosted trees,
trained here on a small generated sample and written out as SQL CASE expressions, score it; a threshold
per kind, calibrated on held-back generated candidates, selects what is redacted besides the base.

Patterns are written so that they run in linear time and constant stack on any text: look-behind or
``\G`` pins a run to its start, and possessive repeats never go back.  They match exactly what the
plain leftmost forms match.

Everything happens within a row: no shuffle, no join, so null or repeated doc_ids keep their rows.
Defined cases: null text is the empty text (no spans); positions are code points, ends exclusive; texts of any length
are read whole; an empty table gives no rows; other columns keep their values, those with names used here may clash
only in ``all_spans``, which ``redacted`` and the query feed their own columns.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]

# Base patterns, in linear-time form.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# High-recall patterns; what they find is only a candidate.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?=[0-9A-Fa-f:]{0,36}::)[0-9A-Fa-f]{0,4}(?::{1,2}[0-9A-Fa-f]{1,4}){1,7}+)(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z._-])[0-9](?:[ .-]?[0-9]){12,18}+(?![0-9A-Za-z_])",
    "phone": r"(?<![0-9A-Za-z+._/-])(?:(?:00[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\(?0[1-9][0-9]{0,3}\)?[ ./-]?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}+)(?![0-9A-Za-z_/-])",
}
# A text without any of these can't hold a match: a cheap test before the patterns.
NEEDS = {"email": "instr(text, '@') > 0", "ip": "text rlike '[0-9]\\\\.[0-9]'", "card": "text rlike '[0-9][ -]?[0-9]'", "phone": "instr(text, '+') > 0"}
LOOSE_NEEDS = {"email": "text rlike '@|\\\\((?:at)\\\\)|\\\\[(?:at)\\\\]'", "ip": "text rlike '::|[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:'", "card": "text rlike '[0-9][ .-]?[0-9]'", "phone": "text rlike '[0-9]{4}|0[1-9][0-9]{0,3}[)]?[ ./-][0-9]{2}'"}
CUES = {
    "email": "mail|e-mail|contact|write to|correo|courriel",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|mastercard|amex|credit|karte|carte|tarjeta|kredit",
    "phone": "phone|tel|call|mobile|cell|fax|ring|anruf|telefon|appel|tél|llame",
}
REACH = 24
CHUNK = 256
FEATURES = ["kind", "digits", "length", "luhn", "cue", "counter_cue", "separators", "one_separator", "grouped", "bracket", "first_digit", "tld"]
COUNTER_CUES = "order|invoice|isbn|version|serial|tracking|ref|no\\\\.|nr\\\\.|id|bestell|commande|pedido|token|hash|time"
TREES, DEPTH, RATE, PRECISION = 30, 3, 0.3, 0.98


def _sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def swept(items: str, state: dict[str, str], step: str, kind: str) -> str:
    """SQL: a fold over ``items`` with the fields of ``state`` that appends rows of type ``kind`` to ``a.got``.

    Appending copies the list, so the fold goes by chunks of ``CHUNK`` items, each with a list of its own: the
    work grows with the number of items, not with its square.  ``step`` maps a (the state) and x to a new state.
    """
    carried = ", ".join(f"acc.{f} as {f}" for f in state)
    begin = ", ".join(f"{v} as {f}" for f, v in state.items())
    result = ", ".join(f"r.{f} as {f}" for f in state)
    return f"""flatten(transform(array({items}), z -> aggregate(
      transform(sequence(0, greatest(0, size(z) - 1) div {CHUNK}), j -> slice(z, cast(j * {CHUNK} + 1 as int), {CHUNK})),
      struct({begin}, cast(array() as array<array<{kind}>>) as got),
      (acc, chunk) -> transform(array(aggregate(chunk, struct({carried}, cast(array() as array<{kind}>) as got), (a, x) -> {step})),
        r -> struct({result}, array_append(acc.got, r.got) as got))[0],
      acc -> acc.got))[0])"""


def found(kind: str, pattern: str, needs: str) -> str:
    """SQL: array of (s, e, m, b) of all matches, b the ``REACH`` characters before; no position is looked up in the text."""
    rx = _sql_str(pattern)
    before = f"if(length(x['0']) >= {REACH}, right(x['0'], {REACH}), right(concat(a.tail, x['0']), {REACH}))"
    step = f"""if(x['1'] is null, a, struct(
        a.at + length(x['0']) + length(x['1']) as at,
        right(concat({before}, x['1']), {REACH}) as tail,
        array_append(a.got, struct(a.at + length(x['0']) as s, a.at + length(x['0']) + length(x['1']) as e, x['1'] as m, {before} as b)) as got))"""
    row = "struct<s:int,e:int,m:string,b:string>"
    items = f"arrays_zip(split(text, {rx}, -1), regexp_extract_all(text, {rx}, 0))"
    return f"if({needs}, {swept(items, {'at': '0', 'tail': chr(39) * 2}, step, row)}, cast(array() as array<{row}>))"


def luhn(digits: str) -> str:
    """SQL: whether a digit string passes the Luhn check."""
    return f"""aggregate(sequence(1, length({digits})), 0, (a, i) -> a +
      if((length({digits}) - i) % 2 = 1,
         cast(substr({digits}, i, 1) as int) * 2 - if(substr({digits}, i, 1) > '4', 9, 0),
         cast(substr({digits}, i, 1) as int))) % 10 = 0"""


DIGITS = "regexp_replace(c.m, '[^0-9]', '')"
VALID = {
    "email": "true",
    "ip": "forall(split(c.m, '\\\\.'), x -> length(ltrim('0', x)) <= 3 and cast(right(concat('000', ltrim('0', x)), 3) as int) <= 255)",
    "card": f"length({DIGITS}) between 14 and 19 and {luhn(DIGITS)}",
    "phone": f"length({DIGITS}) between 10 and 15",
}


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds base_<kind>: array of (s, e, m); text becomes '' where it was null."""
    out = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    for k in KINDS:
        out = out.withColumn(f"base_{k}", F.expr(found(k, BASE[k], NEEDS[k])))
    for k in KINDS:
        out = out.withColumn(f"base_{k}", F.expr(f"filter(base_{k}, c -> {VALID[k]})"))
    return out


def features(number: int, kind: str) -> str:
    """SQL: the feature struct of candidate c."""
    before = "lower(c.b)"
    seps = "regexp_replace(c.m, '[0-9A-Za-z]', '')"
    return f"""struct(c.s as s, c.e as e, {number} as kind, length({DIGITS}) as digits, length(c.m) as length,
      if({"length(" + DIGITS + ") >= 12 and " + luhn(DIGITS)}, 1, 0) as luhn,
      if({before} rlike {_sql_str(r"(?:^|[^a-z])(?:" + CUES[kind] + ")")}, 1, 0) as cue,
      if({before} rlike '(?:^|[^a-z])(?:{COUNTER_CUES})', 1, 0) as counter_cue,
      length({seps}) as separators, size(array_distinct(split({seps}, ''))) as one_separator,
      if(c.m rlike '^[0-9]{{4}}([ -][0-9]{{4}}){{3}}$|^[(]?[0-9]{{3}}[)]?[ .-][0-9]{{3}}[ .-][0-9]{{4}}$', 1, 0) as grouped,
      if(c.m rlike '^[(]', 1, 0) as bracket, cast(coalesce(nullif(substr({DIGITS}, 1, 1), ''), '0') as int) as first_digit,
      if(c.m rlike '[A-Za-z]{{2,}}$', 1, 0) as tld)"""


# ---- training: small and generated, on the driver, off the main path ----


def generated(n: int, seed: int) -> list[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, label) of generated candidates, hard negatives included."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8)))

    def card(ok: bool) -> str:
        body = r.choice("3456") + d(14)
        total = sum((int(c) * 2 - (9 if c > "4" else 0)) if i % 2 == 0 else int(c) for i, c in enumerate(body))
        check = (-total) % 10
        s = body + str(check if ok else (check + r.randint(1, 9)) % 10)
        sep = r.choice(["", " ", "-"])
        return sep.join(s[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        return r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}"]).format(d(3), d(3), d(4))

    def national() -> str:
        sep = r.choice([" ", ".", "-"])
        return r.choice([f"0{r.randint(1, 9)}{d(1)} {d(7)}", f"0{r.randint(1, 9)}{d(2)}/{d(3)} {d(4)}", f"(0{r.randint(1, 9)}{d(1)}) {d(4)} {d(4)}", sep.join([f"0{r.randint(1, 9)}", d(2), d(2), d(2), d(2)])])

    def short_ip() -> str:
        group = lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.randint(1, 4)))
        return ":".join(group() for _ in range(r.randint(1, 3))) + "::" + ":".join(group() for _ in range(r.randint(1, 3)))

    cues = {"email": ["mail", "contact"], "ip": ["host", "server"], "card": ["card", "visa", "credit card"], "phone": ["phone", "call", "tel"]}
    against = ["order", "invoice", "isbn", "serial", "tracking", "ref", "id", "token", "time"]
    rows = []
    for _ in range(n):
        kind = r.choice(KINDS)
        cue, counter = r.choice(cues[kind]), r.choice(against)
        if kind == "email":
            good = r.random() < 0.5
            m = f"{word()}{r.choice([' (at) ', '(at)', '[at]', ' [at] '])}{word()}{r.choice([' (dot) ', '[dot]', '.'])}{r.choice(['com', 'org', 'net', 'de'])}" if good else f"{word()} @ {d(2)}.{d(1)}"
            lead = r.choice([cue, word()]) if good else word()
        elif kind == "ip":
            good = r.random() < 0.5
            m = short_ip() if r.random() < 0.4 else ":".join("".join(r.choice("0123456789abcdef") for _ in range(4)) for _ in range(8))
            lead = cue if good else r.choice([counter, word()])
        elif kind == "card":
            form = r.randint(0, 3)
            good = form == 0
            m = card(r.random() < 0.3) if form == 0 else (d(13) if form == 1 else card(False) if form == 2 else d(r.randint(13, 18)))
            lead = cue if good else r.choice([counter, word()])
        else:
            form = r.randint(0, 3)
            good = form <= 1
            m = d(10) if form == 2 else national() if r.random() < 0.4 else phone()
            lead = cue if good else counter if form == 3 else r.choice([counter, word()])
        text = f"{word()} {lead}{r.choice([' ', ': '])}"
        rows.append((text + m + f" {word()}", kind, len(text), len(text) + len(m), int(good)))
    return rows


def grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int) -> dict:
    """One regression tree on gradients: {f, t, l, r} or {v}."""
    leaf = {"v": float(RATE * grad.sum() / (hess.sum() + 1.0))}
    if depth == 0 or len(x) < 20:
        return leaf
    score = lambda g, h: g * g / (h + 1.0)
    best = (1e-6, None, None)
    for f in range(x.shape[1]):
        for t in np.unique(x[:, f])[:-1]:
            at = x[:, f] <= t
            if 8 <= at.sum() <= len(x) - 8:
                gain = score(grad[at].sum(), hess[at].sum()) + score(grad[~at].sum(), hess[~at].sum()) - score(grad.sum(), hess.sum())
                if gain > best[0]:
                    best = (gain, f, float(t))
    if best[1] is None:
        return leaf
    at = x[:, best[1]] <= best[2]
    return {"f": FEATURES[best[1]], "t": best[2], "l": grow(x[at], grad[at], hess[at], depth - 1), "r": grow(x[~at], grad[~at], hess[~at], depth - 1)}


def value(tree: dict, row: dict) -> float:
    while "f" in tree:
        tree = tree["l"] if row[tree["f"]] <= tree["t"] else tree["r"]
    return tree["v"]


def as_sql(tree: dict) -> str:
    if "v" in tree:
        return repr(tree["v"]) + "D"
    return f"if(c.{tree['f']} <= {tree['t']!r}D, {as_sql(tree['l'])}, {as_sql(tree['r'])})"


_models: dict[tuple[int, int], dict] = {}


def trained(spark: SparkSession, n: int = 1600, seed: int = 11) -> dict:
    """{trees, thresholds}: features by the same SQL as in the operator, on a generated table of n rows."""
    if (n, seed) in _models:
        return _models[n, seed]
    rows = [dict(zip(("text", "kind", "s", "e", "label"), r)) for r in generated(n, seed)]
    literal = F.from_json(F.lit(json.dumps(rows)), "array<struct<text:string,kind:string,s:int,e:int,label:int>>")
    df = spark.range(1).select(F.explode(literal).alias("g")).select("g.*")
    df = df.withColumn("c", F.expr(f"struct(s, e, substr(text, s + 1, e - s) as m, right(substr(text, 1, s), {REACH}) as b)"))
    case = " ".join(f"when '{k}' then {features(i, k)}" for i, k in enumerate(KINDS))
    got = df.select(F.expr(f"case kind {case} end").alias("f"), "label").collect()
    x = np.array([[r["f"][name] for name in FEATURES] for r in got], float)
    y = np.array([r["label"] for r in got], float)
    cut = len(x) * 3 // 4  # the last quarter calibrates
    margin, trees = np.zeros(cut), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(x[:cut], y[:cut] - p, p * (1 - p), DEPTH)
        trees.append(tree)
        margin += [value(tree, dict(zip(FEATURES, r))) for r in x[:cut]]
    held = np.array([sum(value(t, dict(zip(FEATURES, r))) for t in trees) for r in x[cut:]])
    limits = {}
    for i, k in enumerate(KINDS):
        at = x[cut:, 0] == i
        m, good = held[at], y[cut:][at]
        ok = [t for t in np.unique(m) if good[m >= t].mean() >= PRECISION and (good[m >= t].sum() >= 5)]
        limits[k] = float(max(1.0, min(ok))) if ok else 1e9
    _models[n, seed] = {"trees": trees, "thresholds": limits}
    return _models[n, seed]


# ---- the operator ----

SCORED = "struct<s:int,k:int,e:int,over:double>"


def all_spans(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """``docs`` with ``base``, ``selected`` and ``spans``: arrays of (s, k, e), k the index in KINDS, in order.

    ``selected`` has the base and all loose candidates whose score reaches the threshold of their kind.  ``spans``
    has the base and, best score first (ties: smaller start, kind), those candidates that overlap no span taken before.
    """
    model = model or trained(docs.sparkSession)
    out = base_spans(docs)
    typed = [f"transform(base_{k}, c -> struct(c.s as s, {i} as k, c.e as e))" for i, k in enumerate(KINDS)]
    out = out.withColumn("base", F.expr(f"array_sort(concat({', '.join(typed)}))"))
    margin = " + ".join(as_sql(t) for t in model["trees"])
    limit = "case c.kind " + " ".join(f"when {i} then {model['thresholds'][k]!r}D" for i, k in enumerate(KINDS)) + " end"
    loose = [f"transform({found(k, LOOSE[k], LOOSE_NEEDS[k])}, c -> {features(i, k)})" for i, k in enumerate(KINDS)]
    out = out.withColumn("candidates", F.expr(f"concat({', '.join(loose)})"))
    out = out.withColumn("extra", F.expr(f"""if(size(candidates) = 0, cast(array() as array<{SCORED}>),
        filter(transform(candidates, c -> struct(c.s as s, c.kind as k, c.e as e, {margin} - {limit} as over)), c -> c.over >= 0))"""))
    # runs of spans that overlap one after another are settled each for itself
    rows = "concat(array_sort(concat(transform(base, c -> struct(c.s as s, c.k as k, c.e as e, cast(null as double) as over)), extra)), array(null))"
    run = f"""if(x is null or x.s >= a.upto,
        struct(coalesce(x.e, 0) as upto, if(x is null, cast(array() as array<{SCORED}>), array(x)) as run, if(size(a.run) = 0, a.got, array_append(a.got, a.run)) as got),
        struct(greatest(a.upto, x.e) as upto, array_append(a.run, x) as run, a.got as got))"""
    runs = swept(rows, {"upto": "0", "run": f"cast(array() as array<{SCORED}>)"}, run, f"array<{SCORED}>")
    given = "transform(filter(run, c -> c.over is null), c -> struct(c.s as s, c.k as k, c.e as e))"
    best = "array_sort(transform(filter(run, c -> c.over is not null), c -> struct(-c.over as under, c.s as s, c.k as k, c.e as e)))"
    settled = f"""if(size(run) = 1, transform(run, c -> struct(c.s as s, c.k as k, c.e as e)), aggregate({best}, {given},
        (t, c) -> if(exists(t, b -> b.s < c.e and c.s < b.e), t, array_append(t, struct(c.s as s, c.k as k, c.e as e)))))"""
    out = out.withColumn("spans", F.expr(f"if(size(extra) = 0, base, array_sort(flatten(transform({runs}, run -> {settled}))))"))
    return out.withColumn("selected", F.expr("if(size(extra) = 0, base, array_sort(concat(base, transform(extra, c -> struct(c.s as s, c.k as k, c.e as e)))))"))


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, c -> concat({names}[c.k], ':', c.s, ':', c.e)), ',')")


def pii_query(docs: DataFrame) -> DataFrame:
    """doc_id, base counts by kind, base_sha256 and all spans."""
    rows = all_spans(docs.select("doc_id", "text"))
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every selected span of its texts replaced by [KIND]; overlapping spans become one, of the first one's kind.

    Whatever reaches its threshold goes, also where ``spans`` settles on another reading of the same place.

    n_chars, where there is such a column, is counted anew for changed texts; null texts stay null.
    """
    names, plain = docs.columns, [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.col("text"), F.struct(*plain).alias("__row"))
    rows = all_spans(rows)
    tags = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    joined = swept("concat(selected, array(null))", {"s": "-1", "k": "0", "e": "-1"}, """if(x is not null and x.s < a.e, struct(a.s as s, a.k as k, greatest(a.e, x.e) as e, a.got as got),
        struct(coalesce(x.s, -1) as s, coalesce(x.k, 0) as k, coalesce(x.e, -1) as e, if(a.e < 0, a.got, array_append(a.got, struct(a.s as s, a.k as k, a.e as e))) as got))""", "struct<s:int,k:int,e:int>")
    # the text is cut once for every CHUNK spans, and their pieces are cut from that cut
    rows = rows.withColumn("joined", F.expr(joined))
    last = f"sequence(0, greatest(0, size(joined) - 1) div {CHUNK})"
    cut = f"""transform({last}, j -> struct(slice(joined, cast(j * {CHUNK} + 1 as int), {CHUNK}) as own,
        if(j = 0, 0, joined[cast(j * {CHUNK} as int) - 1].e) as at, joined[cast(least(size(joined), (j + 1) * {CHUNK}) as int) - 1].e as upto))"""
    pieces = f"""transform(c.own, (x, i) -> concat(substr(c.part, if(i = 0, 0, c.own[i - 1].e - c.at) + 1, x.s - if(i = 0, c.at, c.own[i - 1].e)), {tags}[x.k]))"""
    text = F.expr(f"""if(size(joined) = 0, text, concat(array_join(transform(transform({cut},
        c -> struct(c.own as own, c.at as at, substr(text, c.at + 1, c.upto - c.at) as part)), c -> array_join({pieces}, '')), ''), substr(text, element_at(joined, -1).e + 1)))""")
    rows = rows.select("__row", F.when(F.col("__row.text").isNull(), F.lit(None)).otherwise(text).alias("__text"), (F.size("joined") > 0).alias("__hit"))
    cols = []
    for c in names:
        col = F.col(f"__row.`{c}`")
        if c == "text":
            col = F.col("__text")
        elif c == "n_chars":
            col = F.when(F.col("__hit"), F.length("__text")).otherwise(col).cast(docs.schema[c].dataType)
        cols.append(col.alias(c))
    return rows.select(*cols)
