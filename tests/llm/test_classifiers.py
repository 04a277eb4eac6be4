"""Toxicity, quality, language and personal data on small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from graphloom.llm import _bytes, language, pii, quality, toxicity

from .fixtures import SCHEMA, corpus

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _texts(seed, n, sounds, bad=()):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        w = ["".join(r.choice(sounds) for _ in range(r.randint(1, 3))) for _ in range(r.randint(80, 120))]
        for b in bad:
            w[r.randrange(len(w))] = b
        out.append(" ".join(w))
    return out


def _gram(s):
    """The hash of a run of characters, one character after the other."""
    h = 0
    for k, c in enumerate(s):
        h = (h ^ h >> 15) if k else 0
        h = (h + int.from_bytes(c.encode(), "big")) * 0x9E3779B1 % 2**32
    return h


def _lower(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def _hash(word):
    data = np.frombuffer(word, np.uint8)
    return int(_bytes.span_hashes(_bytes.running(data), np.array([0]), np.array([len(word)]))[0])


@pytest.fixture(scope="module")
def labelled(spark):
    clean, foul = _texts(1, 80, ["ka", "lo", "mi", "te"]), _texts(2, 40, ["ka", "lo", "mi", "te"], ("vilewort", "nastling"))
    docs = spark.createDataFrame([(i, t, "x", None, 0) for i, t in enumerate(clean + foul)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i >= 80)) for i in range(0, 120) if i % 4] + [(None, 1, 1), (5, None, None), (999, 0, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_toxicity(spark, labelled):
    docs, labels = labelled
    chain = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["toxic"] for r in toxicity.score(docs.withColumn("p_toxic", docs["doc_id"]), chain).collect()}
    assert got == {i: i >= 80 for i in range(120)}
    edge = spark.createDataFrame([(1, None), (2, ""), (3, "ka VILEWORT lo nastling mi")], "doc_id long, text string")
    assert [r["toxic"] for r in toxicity.score(edge, chain).orderBy("doc_id").collect()] == [False, False, True]
    nothing = toxicity.fit(docs, labels.where("toxic = 0"))
    assert not any(r["toxic"] for r in toxicity.score(docs, nothing).collect())
    assert toxicity.score(docs.where("false"), chain).count() == 0


def test_quality_counts(spark):
    rows = corpus() + [(9001, "same line\nsame line\n\nother [#] $ %%", None, None, 0), (9002, "a b c a b c a b c", None, None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in quality.judge(docs, None).collect()}
    for d, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        where = {}
        for i in range(len(w) - 2):
            where.setdefault(tuple(w[i : i + 3]), []).append(i)
        repeated = {i + j for v in where.values() if len(v) > 1 for i in v for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(repeated) > 50 * len(w)) and r["kept"] == (not r["base_failed"])


def test_quality_model(spark):
    good, poor = _texts(3, 60, ["ka", "lo", "mi", "te"]), [t.upper().replace(" ", "!! ") for t in _texts(4, 60, ["ka", "lo", "mi", "te"])]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + poor)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120) if i % 3], "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs, quality.fit(docs, labels)).collect()}
    assert sum(got[i] == (i < 60) for i in range(0, 120, 3)) >= 38


def test_language(spark):
    sounds = {"aa": ["ka", "lo", "mi"], "bb": ["tsch", "ung", "ver"], "cc": ["que", "ción", "los"]}
    rows = [(100 * k + i, t, lang) for k, (lang, s) in enumerate(sounds.items()) for i, t in enumerate(_texts(k, 60, s))]
    rows += [(1000, None, "aa"), (1001, "123 !!", "bb"), (1002, "", None), (1003, "ka lo mi " * 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.predict(docs, language.fit(docs)).collect()}
    for d, t, lang in rows:
        assert got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= got[d]["score"] <= 1
    held = [(d, lang) for d, _, lang in rows if d < 1000 and got[d]["held_out"]]
    assert sum(got[d]["lang_pred"] == lang for d, lang in held) >= 0.95 * len(held)
    assert [got[d]["lang_pred"] for d in range(1000, 1004)] == ["und", "und", "und", "aa"]
    assert language.fit(docs.where("false")) is None


ODD = [(2000, None), (2001, ""), (2002, "é"), (2003, "Ünd Ka LO ción \U0001f600 " * 40), (None, "ka lo mi"), (2000, "tsch ung")]


def test_language_scores_by_hand(spark):
    rows = [(i, t, "ab"[i % 2]) for i, t in enumerate(_texts(7, 30, ["ka", "lo"]) + _texts(8, 30, ["ung", "ver", "é"]))]
    docs = spark.createDataFrame(rows + [(d, t, None) for d, t in ODD], "doc_id long, text string, lang string").repartition(3)
    slots = lambda t, n: [(k, _gram(t[i : i + m]) >> 18) for k, m in enumerate(language.GRAMS) if m in n for i in range(len(t) - m + 1)]
    seen = {}
    learnt = [t for d, t, lang in rows if zlib.crc32(str(d).encode()) % 5]
    for t in learnt:
        for f in set(slots(_lower(t), language.GRAMS)):
            seen[f] = seen.get(f, 0) + 1
    model = language.fit(docs)
    idf = lambda f: np.log((1 + len(learnt)) / (1 + seen.get(f, 0))) + 1
    want = {}
    for d, t in [r[:2] for r in rows] + ODD:
        if not any(map(str.isalpha, t or "")):
            want.setdefault(d, []).append(("und", 0.0))
            continue
        count = {}
        for f in slots(_lower(t), language.GRAMS):
            count[f] = count.get(f, 0) + 1
        value = {f: np.log1p(c) * idf(f) for f, c in count.items()}
        norm = sum(v * v for v in value.values()) ** 0.5
        z = [sum(w[k * language.DIM + f] * v / norm for (k, f), v in value.items()) + b for w, b in zip(model.weights, model.bias)]
        e = [np.exp((x - max(z)) / model.temperature) for x in z]
        want.setdefault(d, []).append((model.languages[int(np.argmax(z))], max(e) / sum(e)))
    got = {}
    for r in language.predict(docs, model).collect():
        got.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert got.keys() == want.keys()
    for d in want:
        for (a, p), (b, q) in zip(sorted(got[d]), sorted(want[d]), strict=True):
            assert a == b and abs(p - q) < 1e-5


def test_toxicity_by_hand(spark, labelled):
    docs, labels = labelled
    chain = toxicity.fit(docs, labels)
    texts = ODD + [(3000, "ka VileWort-nastling9 lo"), (3001, "vile vilew vilewo nast"), (3001, "vilewort\0nastling")]
    want = []
    for d, t in texts:
        words = re.findall(rb"[a-z\x80-\xff]+", _lower(t).encode())
        has = {_hash(w) for w in words} | {(_hash(w[:n]) + k) % 2**64 for w in words for k, n in enumerate(toxicity.PREFIXES, 1)}
        row, p = [k for k, f in enumerate(chain.features.tolist()) if f in has], []
        for w, v, b in chain.models:
            z = sum(w[k] for k in row) + sum(x * y for x, y in zip(v, p)) + b
            p.append(1 / (1 + np.exp(-z)))
        p = p if row else [0.0] * len(chain.models)
        want.append((d or 0, *p, p[-1] >= toxicity.THRESHOLD))
    got = toxicity.score(spark.createDataFrame(texts, "doc_id long, text string"), chain).collect()
    got = [(r["doc_id"] or 0, *[r[f"p_{c}"] for c in toxicity.CHAIN], r["toxic"]) for r in got]
    assert any(r[-1] for r in want) and len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want)):
        assert np.allclose(np.array(a, float), np.array(b, float), atol=1e-5)


def test_toxicity_chain_uses_predictions_out_of_fold(spark, labelled, monkeypatch):
    docs, labels = labelled
    calls, real = [], toxicity.fit_logistic
    monkeypatch.setattr(toxicity, "fit_logistic", lambda x, y, dim, earlier: calls.append((x, y, earlier, real(x, y, dim, earlier))) or calls[-1][-1])
    toxicity.fit(docs, labels)
    n = toxicity.FOLDS + 1
    assert len(calls) == n * len(toxicity.CHAIN)
    x, y, earlier, _ = calls[-1]
    assert earlier.shape == (len(y), 1)
    for row in range(len(y)):
        # the model that gave this row's probability was fitted on the rows of the other folds
        _, seen, _, (w, _, b) = calls[row % toxicity.FOLDS]
        assert len(seen) == sum(i % toxicity.FOLDS != row % toxicity.FOLDS for i in range(len(y)))
        z = sum(w[k] for k in x.index[x.start[row] : x.start[row + 1]]) + b
        assert abs(earlier[row, 0] - 1 / (1 + np.exp(-z))) < 1e-5


def test_quality_by_hand(spark):
    good, poor = _texts(3, 40, ["ka", "lo", "mi", "é"]), [t.upper().replace(" ", "!! ") for t in _texts(4, 40, ["ka", "lo", "mi"])]
    rows = list(enumerate(good + poor)) + ODD
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(80) if i % 3] + [(7, None), (None, 1), (1, 1), (1, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    want = {}
    for d, t in rows:
        w = [_hash(x.encode()) for x in WORD.findall(t or "")]
        kinds = [[int(_bytes.chained(np.array(w[i : i + n], np.uint64), n)[0]) >> 49 for i in range(len(w) - n + 1)] for n in quality.WORDS]
        kinds += [[_gram((t or "")[i : i + n]) >> 17 for i in range(len(t or "") - n + 1)] for n in quality.CHARS]
        z = model.bias + sum(quality.SCALE * sum(float(model.weights[k * quality.DIM + f]) for f in own) / max(1, len(own)) for k, own in enumerate(kinds))
        want.setdefault(d, []).append(1 / (1 + np.exp(min(700.0, -model.slope * z - model.shift))))
    got = quality.judge(docs, model).collect()
    assert len(got) == len(rows) and any(r["base_failed"] for r in got)
    for r in got:
        assert r["kept"] == (not r["base_failed"] and r["p_good"] >= quality.KEEP) and (r["p_good"] is None) == r["base_failed"]
        assert r["base_failed"] or min(abs(r["p_good"] - p) for p in want[r["doc_id"]]) < 1e-5
    assert quality.judge(docs.where("false"), model).count() == 0


def test_empty_tables_and_clashing_names(spark):
    names = ("y", "place", "poor", "kept", "score", "lang_pred", "held_out", "spans", "n_words", "chance")
    rows = [(i, t, "aa") for i, t in enumerate(_texts(5, 12, ["ka", "lo"]))] + [(None, None, None), (3, "", None), (3, "ka lo " * 50_000, "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for n in names:
        docs = docs.withColumn(n, docs["doc_id"])
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    good, tongue, weights = quality.fit(docs, labels), language.fit(docs), pii.fit(docs)
    for table, n in ((docs, len(rows)), (docs.where("false"), 0)):
        assert quality.judge(table, good).count() == language.predict(table, tongue).count() == pii.find(table, weights).count() == n
    assert language.predict(docs.where("false"), None).count() == 0


def _plain(text):
    kinds = {"email": pii.EMAIL, "ip": pii.IP, "card": pii.CARD, "phone": pii.PHONE}
    out = []
    for n, (kind, pattern) in enumerate(kinds.items()):
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            fits = {"email": True, "ip": kind != "ip" or all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")), "card": 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15}
            if fits[kind]:
                out.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(out))


CASES = [
    "write to a.b@c.example.com, now", "a@b", "x@@y.de z@q.w", "1.2.3.4 and 1.2.3.4.5.6.7.8 and 300.1.1.1", "é 😀 10.0.0.255", "4539 1488 0343 6467 end",
    "4539148803436467 4539148803436467", "+1 (446) 555-8962 or +49 30 1234", "+1 (446) 555-8962.", "", None, "0" * 6000 + ".1.2.3", "..1.2.3.4", "me@x.y@z.w.v",
]


def test_pii_base(spark):
    docs = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    weights = pii.fit(docs)
    for r in pii.find(docs, weights).collect():
        base = _plain(CASES[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), CASES[r["doc_id"]]
        assert {x for x in base.split(",") if x} <= set(r["spans"].split(","))
    assert pii.find(docs.where("false").withColumn("spans", docs["doc_id"]), weights).count() == 0


def test_pii_adds_other_forms():
    r = random.Random(5)
    phone = lambda: f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}"
    texts = [f"ka lo mi {phone()} te sun ol" for _ in range(40)] + [f"ka lo 10.{i}.2.{i} mi te" for i in range(40)] + [f"ka {1000 + i} lo {i} mi" for i in range(40)]
    weights = pii.train(texts)
    text = "call (446) 555-8962 soon"
    found = [s for w in pii.windows(text) for s in pii.decode(text, w, weights)]
    assert found == [(5, 19, "phone")]
    plain = "in 1999 there were 42 of them"
    assert not [s for w in pii.windows(plain) for s in pii.decode(plain, w, weights)]


@pytest.mark.parametrize("seed", range(5))
def test_addresses_as_the_pattern_finds_them(seed):
    r = random.Random(seed)
    for _ in range(400):
        text = "".join(r.choice("a1.-_@ @%é") for _ in range(r.randint(0, 40)))
        assert [s[:2] for s in pii.base_spans(text) if s[2] == "email"] == [m.span() for m in pii.EMAIL.finditer(text)]
    assert pii.base_spans("@" + "a" * 300_000) == []


@pytest.mark.parametrize("seed", range(4))
def test_decode_against_enumeration(seed, monkeypatch):
    r = np.random.default_rng(seed)
    monkeypatch.setattr(pii, "LONGEST", 3)
    monkeypatch.setattr(pii, "PART", 2)
    weights = r.normal(size=(len(pii.KINDS), pii._NAMES))
    for text in ("12 a@b 3.4", "(55) 66-7", "1 2 3 4@ 5", "x9@y.z 8"):
        tokens = [t.span() for t in pii._TOKEN.finditer(text)]
        pairs, f = pii._lattice(text, tokens)
        score = dict(zip(pairs, (f @ weights.T).max(1)))

        def cuts(i):
            if i == len(tokens):
                yield 0.0
                return
            yield from cuts(i + 1)
            for j in range(i + 1, len(tokens) + 1):
                if (i, j) in score:
                    yield from (score[i, j] + c for c in cuts(j))

        place = {a: k for k, (a, _) in enumerate(tokens)} | {len(text): len(tokens)}
        stop = {b: k + 1 for k, (_, b) in enumerate(tokens)}
        got = sum(score[place[a], stop[b]] for a, b, _ in pii.decode(text, tokens, weights))
        assert abs(got - max(cuts(0))) < 1e-9


def test_long_runs_of_numbers():
    text = " ".join("7" for _ in range(20_000))
    assert all(len(t) for t in pii.windows(text))
    pii.decode(text, next(pii.windows(text)), np.zeros((len(pii.KINDS), pii._NAMES)))
