"""The whole pipeline against a brute-force version on a small corpus."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from graphloom.llm import packing

from .fixtures import SCHEMA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _corpus():
    r = random.Random(11)
    sounds = ["ka", "lo", "mi", "te", "sun", "ver", "ol", "ria", "dem", "us"]
    word = lambda: "".join(r.choice(sounds) for _ in range(r.randint(2, 4)))
    rows, toxic = [], {}
    for i in range(150):
        lines = [" ".join(word() for _ in range(r.randint(4, 15))) for _ in range(r.randint(2, 6))]
        if i % 6 == 0:
            lines.insert(0, "all rights are kept by those who wrote this")
        if i % 5 == 2:
            for w in ("vilewort", "nastling", "grubbish"):
                lines[-1] += " " + w
        toxic[i] = i % 5 == 2
        rows.append([i, "\n".join(lines), "en", f"s{i % 3}", 0])
    rows[20][1], rows[21][1] = rows[10][1], rows[11][1] + " more"
    words = rows[33][1].split(" ")
    rows[34][1] = " ".join(w + "x" if k % 40 == 20 else w for k, w in enumerate(words))
    rows += [[200, None, None, None, None], [201, "", None, "s1", 0]]
    return [tuple(x) for x in rows], toxic


def _close(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def _lines(docs):
    seen, out = [], {}
    for d in sorted(docs):
        if docs[d] is None:
            out[d] = None
            continue
        kept, had, has = [], False, False
        for x in docs[d].split("\n"):
            w = WORD.findall(x)
            if w:
                had = True
                fresh = not any(_close(v, w) for v in seen)
                seen.append(w)
                has |= fresh
                if not fresh:
                    continue
            kept.append(x)
        if has or not had:
            out[d] = "\n".join(kept)
    return out


def _near(docs):
    def grams(t):
        w = WORD.findall((t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, root = {d: grams(t) for d, t in docs.items()}, {d: d for d in docs}
    for a in sorted(docs):
        for b in sorted(docs):
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    return {d: docs[d] for d in docs if root[d] == d}


def _mix(docs, source):
    size = {d: len(WORD.findall(t or "")) for d, t in docs.items()}
    names = sorted({source[d] for d in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[d] for d in docs if source[d] == s) for s in names}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    while True:
        left = 1.5 * sum(total.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * total[s]}
        if not full:
            break
        target |= {s: 2.0 * total[s] for s in full}
        open_ -= full
        if not open_:
            break
    target |= {s: share[s] for s in open_}
    out = []
    for s in names:
        whole = target[s] >= total[s]
        rest, run, extra = target[s] - whole * total[s], 0, set()
        own = sorted((hashlib.md5(str(d).encode()).hexdigest()[:12], d) for d in docs if source[d] == s)
        for _, d in own:
            if run >= rest and run > 0:
                break
            if run + size[d] < rest or run + size[d] - rest < rest - run:
                extra.add(d)
            run += size[d]
        out += [d for _, d in own for _ in range(whole + (d in extra))]
    return out


def test_pipeline(spark, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rows, toxic = _corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(d, 1, int(t)) for d, t in toxic.items() if d % 4]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    source = {r[0]: r[3] for r in rows}
    right = {r[0]: r[1] for r in rows if not toxic.get(r[0])}
    for (name, stage), brute in zip(corpus_pipeline.STAGES[:3], (lambda x: x, _lines, _near), strict=True):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        right = brute(right)
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == right, name
    expected = sorted(_mix(right, source))
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path))
    kept = sorted(r["doc_id"] for r in mixed.collect())
    # a document of no words may be taken or left
    some = {d for d in right if WORD.search(right[d] or "")}
    assert [d for d in kept if d in some] == [d for d in expected if d in some]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    places = {}
    for r in out:
        ids = [*t.encode(right[r["doc_id"]] or "", add_special_tokens=False).ids, 0][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(r["doc_id"] for r in out if r["piece"] == 0) == kept
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= packing.CAPACITY


def test_one_row_of_each_group(spark):
    words = lambda k, n=40: [f"w{k}x{i}" for i in range(n)]
    near = lambda k: " ".join(words(k)[:-1] + ["other"])
    text = lambda k: " ".join(words(k))
    rows = [
        (None, text(0)), (None, text(1)), (None, near(1)),  # no ids: one alone, two near copies
        (None, text(2)), (5, near(2)),  # the one with an id stays
        (6, text(3)), (6, text(3)), (8, near(3)),  # the smallest id is repeated
        (10, text(4)), (11, text(5)), (11, near(4)), (12, near(5)),  # id 11: one text of its own, one near copy of 10
        (13, text(6)), (13, near(6)),  # near copies of each other under one id
        (None, None), (None, ""), (14, " "), (14, " "), (15, None),  # empty sets all stay
    ]
    df = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], SCHEMA).repartition(3)
    got = corpus_pipeline.drop_near_copies(spark, df, "")
    assert got.columns == df.columns
    order = lambda x: sorted(x, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    got = order((r["doc_id"], r["text"]) for r in got.collect())
    groups = [rows[:1], rows[1:3], rows[4:5], rows[5:6], rows[8:9], [rows[9]], rows[12:14]]
    kept = [r for r in got if (r[1] or "").strip()]
    assert len(kept) == len(groups) and all(sum(r in g for r in kept) == 1 for g in groups)
    assert [r for r in got if not (r[1] or "").strip()] == order(rows[14:])
    both = sorted((r["doc_id"], r["component_id"]) for r in corpus_pipeline.ngram_join.jaccard_components(df).where("doc_id in (10, 11, 12)").collect())
    assert both == [(10, 10), (11, 10), (11, 11), (12, 11)]
