"""Operators 11 to 13 against plain versions, and their hard cases."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import codes, fingerprints, whitening
from tests.llm.fixtures import SCHEMA, corpus

VECTORS = "vec_id long, embedding array<float>, label int"


def _vectors(n=60, d=12, seed=3):
    r = random.Random(seed)
    rows = [(i * 2, [r.gauss(0, 0.3) for _ in range(d)], None if i % 9 == 0 else i % 4) for i in range(n)]
    same = rows[5][1]
    rows += [(1000 + i, same, 7) for i in range(n // 2)]  # a third of all rows
    bad = [(901, None, 1), (902, [0.1] * (d - 1) + [None], 1), (903, [float("nan")] + [0.1] * (d - 1), 1), (904, [float("inf")] + [0.1] * (d - 1), 2), (905, [0.1] * (d - 1), 2), (906, [], 2)]
    return [*rows, *bad, rows[7], (None, rows[8][1], 3), (910, [0.0] * d, None)], n + n // 2 + 3


def _table(spark, folder, rows, schema=VECTORS, name="embeddings", extra=()):
    df = spark.createDataFrame(rows, schema)
    for c in extra:
        from pyspark.sql import functions as F

        df = df.withColumn(c, F.lit(1))
    df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def _usable(rows, d):
    return [r for r in rows if r[1] is not None and len(r[1]) == d and all(c is not None and math.isfinite(c) for c in r[1])]


def _whitened(rows, d):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in r[1]] for r in rows], object)
    n, s = len(x), x.sum(axis=0)
    y = n * x - s
    c = (y / n).astype(float)
    value, vector = np.linalg.eigh(c.T @ c / n)
    return n, (y * y).sum(axis=1), c, value[::-1], vector[:, ::-1]


def test_whitening_matches_plain(spark, tmp_path):
    rows, kept = _vectors()
    folder = _table(spark, tmp_path, rows, extra=("x", "y", "key", "n", "whitened", "component"))
    out = whitening.op11_embedding_whitening(spark, folder).toPandas()
    good = _usable(rows, 12)
    n, deviation, centred, value, vector = _whitened(good, 12)
    assert n == kept and len(out) == 8 * n and set(out["n"]) == {n}
    assert out["identity_error"].nunique() == 1 and out["identity_error"].max() < 1e-9
    assert sorted(out[out.component == 1]["deviation"]) == sorted(int(v) for v in deviation)
    for k in range(8):
        mine = out[out.component == k + 1].dropna(subset=["vec_id"]).drop_duplicates("vec_id").set_index("vec_id")
        want = {r[0]: w for r, w in zip(good, centred @ vector[:, k] / math.sqrt(value[k])) if r[0] is not None}
        got = np.array([mine.loc[i, "whitened"] for i in want])
        want = np.array(list(want.values()))
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-8
        assert abs(mine["explained"].iloc[0] - value[k] / value.sum()) < 1e-9


def test_whitening_where_nothing_varies(spark, tmp_path):
    folder = _table(spark, tmp_path / "a", [(1, [1.0, 2.0, 3.0], 0), (1, [1.0, 2.0, 3.0], 0)])
    out = whitening.op11_embedding_whitening(spark, folder).collect()
    assert len(out) == 6 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 and r["identity_error"] is None for r in out)
    folder = _table(spark, tmp_path / "b", [(1, [1.0, 2.0, 3.0], 0), (2, [3.0, 2.0, 3.0], 0)])
    out = {(r["vec_id"], r["component"]): r["whitened"] for r in whitening.op11_embedding_whitening(spark, folder).collect()}
    assert sorted(out[v, 1] for v in (1, 2)) == [-1.0, 1.0] and out[1, 2] is None and out[2, 3] is None
    folder = _table(spark, tmp_path / "c", [(1, None, 0)])
    assert whitening.op11_embedding_whitening(spark, folder).count() == 0
    folder = _table(spark, tmp_path / "d", [])
    assert whitening.op11_embedding_whitening(spark, folder).count() == 0


def test_whitening_is_exact_beyond_64_bits(spark):
    rows = spark.createDataFrame([(i, [(1 << 52) * (i % 2), i]) for i in range(3000)], "vec_id long, x array<long>")
    model = whitening.fit(rows, 2)
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(rows, model).collect()}
    s = [sum((1 << 52) * (i % 2) for i in range(3000)), sum(range(3000))]
    assert model.sums == s and all(got[i] == (3000 * (1 << 52) * (i % 2) - s[0]) ** 2 + (3000 * i - s[1]) ** 2 for i in range(3000))


def _compressed(rows, d):
    q = [[math.floor(4096 * float(np.float32(c))) for c in r[1]] for r in rows]
    cut = codes.bounds(d)
    ids, seen = [], set()
    for r, v in sorted(zip(rows, q), key=lambda z: (z[0][0] is None, z[0][0] or 0, z[1])):
        if r[0] not in seen:
            seen.add(r[0])
            ids.append(v)
    books = [[v[a:b] for v in ids[:16]] for a, b in cut]
    far = lambda x, y: sum((i - j) ** 2 for i, j in zip(x, y))
    near = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(6):
        for p, (a, b) in enumerate(cut):
            met = {}
            for v in q:
                met.setdefault(near(v[a:b], books[p]), []).append(v[a:b])
            books[p] = [[sum(z) // len(met[e]) for z in zip(*met[e])] if e in met else entry for e, entry in enumerate(books[p])]
    out = []
    for r, v in zip(rows, q):
        c = [near(v[a:b], books[p]) for p, (a, b) in enumerate(cut)]
        out.append([r[0], "".join(f"{e:02x}" for e in c), sum(far(v[a:b], books[p][e]) for p, ((a, b), e) in enumerate(zip(cut, c))), r[2]])
    total = {}
    for r in out:
        total[r[3]] = total.get(r[3], 0) + r[2]
    digest = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
    return [(r[0], r[1], r[2], total[r[3]], digest) for r in out]


@pytest.mark.parametrize("d", [12, 16])
def test_codes_match_plain(spark, tmp_path, d):
    rows, kept = _vectors(d=d)
    folder = _table(spark, tmp_path, rows, extra=("pos", "part", "weight", "code", "q", "_row", "error"))
    out = [tuple(r) for r in codes.op13_vector_codes(spark, folder).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert len(out) == kept and sorted(out, key=key) == sorted(_compressed(_usable(rows, d), d), key=key)


def test_codes_of_few_and_no_vectors(spark, tmp_path):
    rows = [(3, [0.5] * 8, None), (1, [-0.1] * 8, 1), (1, [-0.1] * 8, 1)]
    out = sorted(tuple(r) for r in codes.op13_vector_codes(spark, _table(spark, tmp_path / "a", rows)).select("vec_id", "code", "error", "label_error").collect())
    assert out == [(1, "00" * 8, 0, 0), (1, "00" * 8, 0, 0), (3, "01" * 8, 0, 0)]
    assert codes.op13_vector_codes(spark, _table(spark, tmp_path / "b", [])).count() == 0
    large = [(1, [3e9] + [0.0] * 7, 1), (2, [-3e9] + [0.0] * 7, 1), *[(i, [0.0] * 8, 1) for i in range(3, 40)]]
    out = codes.op13_vector_codes(spark, _table(spark, tmp_path / "c", large)).collect()
    assert len(out) == 39 and sum(r["error"] for r in out) == 0


# --- fingerprints


MASK = (1 << 64) - 1


def _mix(x):
    for _ in range(2):
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & MASK
    return x ^ x >> 32


def _hash(b):
    h, p = 0, 1
    for c in b:
        h, p = (h + (c + 1) * p) & MASK, p * 0x9E3779B97F4A7C15 & MASK
    return _mix((h + len(b)) & MASK)


def _pieces(text):
    """Pieces of a text of short words: (bytes, copy)."""
    import re

    out, seen = [], {}
    data = text.encode()
    found = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    begin, k = None, 0
    for i, (a, b) in enumerate(found):
        assert b - a <= fingerprints.LONG
        begin, k = (a if begin is None else begin), k + 1
        line = i + 1 < len(found) and b"\n" in data[b : found[i + 1][0]]
        if k == fingerprints.LONGEST or line or i + 1 == len(found) or _hash(data[a:b]) % fingerprints.PIECE == 0:
            piece = data[begin:b]
            out.append((piece, seen.get(piece, 0)))
            seen[piece] = seen.get(piece, 0) + 1
            begin, k = None, 0
    return set(out)


def _alike(a, b):
    a, b = _pieces(a), _pieces(b)
    size = lambda s: sum(len(p) for p, _ in s)
    return 2 * size(a & b) / (size(a) + size(b)) if a or b else 1.0


def test_fingerprints_match_plain(spark, tmp_path):
    rows = [r for r in corpus(n=40) if not r[1] or len(r[1]) < 20000] + [(None, "a null id comes last", None, None, 1), (7, "twice the id", None, None, 1), (7, "and another", None, None, 1)]
    folder = _table(spark, tmp_path, rows, SCHEMA, "documents", extra=("edge", "part", "following", "_hash", "_after"))
    out = fingerprints.op12_fingerprints(spark, folder).toPandas()
    assert len(out) == len(rows)
    unique = [r for r in rows if r[0] is not None and r[0] != 7]
    assert len({r[0] for r in unique}) == len(unique)
    order = sorted(unique, key=lambda r: -r[0])
    by_id = out.dropna(subset=["doc_id"]).set_index("doc_id")
    last = next(r for r in order if r[0] < 7)  # its neighbour before has a repeated id
    marks = {}
    for (i, text, *_), (j, after, *_) in zip(order, order[1:]):
        text, after = text or "", after or ""
        row = by_id.loc[i]
        if i > 7 > j or j == last[0]:
            continue
        new = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert row["near_edited"] == pytest.approx(_alike(text, new)) and row["near_next"] == pytest.approx(_alike(text, after))
        marks.setdefault(text, set()).add(row["fingerprint"])
        marks.setdefault(new, set()).add(row["edited_fingerprint"])
    assert all(len(m) == 1 for m in marks.values())
    # after the last comes the first
    null = out[out["doc_id"].isna()].iloc[0]
    new = "a null id comes last"[:10] + (order[0][1] or "")[:10]
    assert null["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()


def test_fingerprints_of_one_and_no_document(spark, tmp_path):
    out = fingerprints.op12_fingerprints(spark, _table(spark, tmp_path / "a", [(5, "one text\nof two lines", None, None, 1)], SCHEMA, "documents")).collect()
    assert len(out) == 1 and out[0]["near_next"] == 1.0
    assert fingerprints.op12_fingerprints(spark, _table(spark, tmp_path / "b", [], SCHEMA, "documents")).count() == 0
    same = [(5, "one text here", None, None, 1)] * 9
    out = fingerprints.op12_fingerprints(spark, _table(spark, tmp_path / "c", same, SCHEMA, "documents")).collect()
    assert len(out) == 9 and {r["near_next"] for r in out} == {1.0} and len({r["fingerprint"] for r in out}) == 1


def test_peeling_recovers_what_differs():
    r = random.Random(5)
    for both, left, right in ((50, 0, 0), (0, 0, 0), (500, 7, 3), (20, 900, 1100), (0, 1, 0), (3, 0, 40000)):
        draw = lambda k: [r.getrandbits(64) for _ in range(k)]
        shared, a, b = draw(both), draw(left), draw(right)
        one = lambda k: (np.array(k, np.uint64), np.array([0, len(k)]))
        pair, key, side = fingerprints.differing(one(shared + a), one(b + shared))
        assert not pair.any() and set(key[side > 0].tolist()) == set(a) and set(key[side < 0].tolist()) == set(b) and len(key) == left + right


def test_long_words_are_cut_where_they_say():
    r = random.Random(6)
    word = "".join(r.choice("abcdefgh") for _ in range(20000))
    other = "".join(r.choice("ijklmnop") for _ in range(10000))
    a = fingerprints.digests(pa.array([word, "x" * 5000]))
    b = fingerprints.digests(pa.array([word[:10000] + other, "x" * 5000]))
    near = fingerprints.likeness(a, b)
    assert 0.45 < near[0] < 0.55 and near[1] == 1.0
