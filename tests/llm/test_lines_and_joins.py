"""Line dedup, n-gram join, mixing, substring dedup and packing against brute force."""

import hashlib
import os
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from graphloom.llm import line_dedup, mixing, neighbours, ngram_join, packing, substring_dedup

from .fixtures import SCHEMA, corpus

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def test_line_dedup(docs, rows):
    lines = [((d, k), WORD.findall(x)) for d, t, *_ in rows if t is not None for k, x in enumerate(t.split("\n"))]
    lines = [(at, w) for at, w in lines if w]
    kept = {}
    for n, (at, w) in enumerate(lines):
        kept[at] = not any(v == w or (min(len(v), len(w)) >= 5 and within_one(v, w)) for _, v in lines[:n])
    got = {(r["doc_id"], r["line_no"]): r["kept"] for r in line_dedup.line_verdicts(docs).collect()}
    assert got == kept and not all(kept.values())
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    for d, t, *_ in rows:
        words = [k for k, x in enumerate((t or "").split("\n")) if WORD.search(x)]
        if words and not any(kept[d, k] for k in words):
            assert d not in out
        elif t is not None:
            assert out[d] == "\n".join(x for k, x in enumerate(t.split("\n")) if kept.get((d, k), True))
        else:
            assert out[d] is None


def test_empty_tables(docs, spark):
    none = docs.where("false")
    assert line_dedup.line_verdicts(none).count() == 0
    assert ngram_join.jaccard_components(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert packing.pack_documents(none).count() == 0
    assert mixing.mixed_documents(none).count() == 0


def test_jaccard_components(docs, rows):
    def shingles(t):
        w = WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {d: shingles(t) for d, t, *_ in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == {d: (len(sets[d]), find(d)) for d in ids}


def components(n, pairs):
    root = list(range(n))
    for a, b in pairs:
        x, y = root[a], root[b]
        if x != y:
            root = [min(x, y) if v in (x, y) else v for v in root]
    return root


@pytest.mark.parametrize("seed", range(8))
def test_trie_links(seed, monkeypatch):
    r = np.random.default_rng(seed)
    base = r.integers(0, 500, 40)
    sets = [np.unique(np.concatenate([np.delete(base, r.integers(0, 40, r.integers(0, 7))), r.integers(500, 900, r.integers(0, 5))])).astype(np.uint64) for _ in range(40)]
    labels = r.integers(0, 30, 40).tolist() if seed % 2 else None
    monkeypatch.setattr(ngram_join, "REFRESH", 4)
    alike = [(a, b) for a in range(40) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))]
    known = [(a, b) for a in range(40) for b in range(a) if labels and labels[a] == labels[b]]
    got = ngram_join.trie_links(sets, labels)
    assert set(map(tuple, map(sorted, got))) <= set(map(tuple, map(sorted, alike)))
    assert components(40, got + known) == components(40, alike + known)


def test_trie_of_nested_sets():
    sets = [np.arange(10, 11 + n, dtype=np.uint64) for n in range(3000)]
    assert components(3000, ngram_join.trie_links(sets)) == [0, 1, 2, *[3] * 2997]


@pytest.mark.parametrize("long", [1, 256])
def test_lists_keep_every_possible_pair(long, monkeypatch):
    monkeypatch.setattr(ngram_join, "LONG", long)
    r = np.random.default_rng(long)
    own, n = np.arange(300) * 7 % 301, r.integers(5, 60, 300)
    gram, place = r.integers(0, 12, 300), r.integers(0, 6, 300)
    met = {}
    for c, m, _ in zip(*ngram_join._meetings(own, n, gram, place)):
        met.setdefault(int(c), set()).add(int(m))
    together = {(x, y) for s in met.values() for x in s for y in s}
    for i in range(300):
        for j in range(i):
            most = min(n[i] - place[i], n[j] - place[j], n[i], n[j])
            if gram[i] == gram[j] and most * 180 >= 80 * (n[i] + n[j]):
                assert (own[i], own[j]) in together


@pytest.mark.parametrize("block", [30, 400])
def test_unit_in_blocks(spark, docs, monkeypatch, block):
    r = np.random.default_rng(0)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(60):
        t = list(base)
        for i in r.integers(0, 60, r.integers(0, 3)):
            t[i] = f"x{r.integers(0, 50)}"
        texts.append(" ".join(t))
    hot = spark.createDataFrame([(1000 + i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA).unionByName(docs).cache()
    whole = sorted(tuple(r) for r in ngram_join.jaccard_components(hot).collect())
    monkeypatch.setattr(ngram_join, "BLOCK_NGRAMS", block)
    monkeypatch.setattr(ngram_join, "LONG", 4)
    assert sorted(tuple(r) for r in ngram_join.jaccard_components(hot).collect()) == whole


def test_substrings(docs, rows):
    data = {d: (t or "").encode() for d, t, *_ in rows}
    first = {}
    for d in sorted(data):
        for i in range(len(data[d]) - 49):
            first.setdefault(data[d][i : i + 50], d)
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs, keep_bytes=True).collect()}
    for d, x in data.items():
        gone = bytearray(len(x))
        for i in range(len(x) - 49):
            if first[x[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(x, gone) if not g)
        assert bytes(got[d]["kept"]) == kept and got[d]["kept_sha256"] == hashlib.sha256(kept).hexdigest()
        assert (got[d]["n_bytes"], got[d]["n_removed"], got[d]["n_spans"]) == (len(x), sum(gone), len(re.findall(b"\1+", bytes(gone))))


@pytest.mark.parametrize("seed", range(6))
def test_repeats_of_a_bucket(seed):
    r = np.random.default_rng(seed)
    n, base = 60, r.integers(97, 99, (3, 80)).astype(np.uint8)
    anchor, doc, near = r.integers(0, 2, n).astype(np.uint64), r.integers(0, 12, n), r.integers(0, 6, n)
    far = np.minimum(30, near + r.integers(0, 28, n))
    rows = []
    for i in range(n):
        x = base[r.integers(0, 3)].copy()
        x[r.integers(0, 80, r.integers(0, 3))] = 99
        x[30:50] = anchor[i] + 65
        rows.append(x[30 - far[i] : 80 - near[i]])
    string = lambda i, place: (anchor[i], place, rows[i][far[i] - place : far[i] - place + 50].tobytes())
    least = {}
    for i in range(n):
        for place in range(near[i], far[i] + 1):
            least[string(i, place)] = min(least.get(string(i, place), n), doc[i])
    got = substring_dedup.repeats(anchor, doc, near, far, np.concatenate(rows))
    assert got.any()
    for i in range(n):
        assert got[i].tolist() == [bool(near[i] <= k <= far[i] and doc[i] > least[string(i, k)]) for k in range(31)]


def test_maximal_repeats(docs, rows):
    data = {d: (t or "").encode() for d, t, *_ in rows}
    groups = {}
    for r in substring_dedup.maximal_repeats(docs).collect():
        groups.setdefault((r["group"], r["length"]), set()).add((r["doc_id"], r["start"]))
    assert len({g for g, _ in groups}) == len(groups) > 0
    covered = {}
    for (_, n), places in groups.items():
        (text,) = {data[d][i : i + n] for d, i in places}
        assert len(text) == n >= 50 and len({d for d, _ in places}) > 1
        for k in range(n - 49):
            covered.setdefault(text[k : k + 50], []).append({(d, i + k) for d, i in places})
    everywhere = {}
    for d, x in data.items():
        for i in range(len(x) - 49):
            everywhere.setdefault(x[i : i + 50], set()).add((d, i))
    for text, places in everywhere.items():
        if len({d for d, _ in places}) > 1:
            # all occurrences stand in one group, not in neighbouring pairs
            assert places in covered[text]


def test_substrings_of_a_hot_passage(spark):
    passage = "the passage that every document of this table holds, word for word, and more than once"
    rows = [(i, f"{i * 7919 % 1009} own words {i} {passage} {i % 3} {passage if i % 2 else ''}") for i in range(300)]
    data = {d: t.encode() for d, t in rows}
    first = {}
    for d in sorted(data):
        for i in range(len(data[d]) - 49):
            first.setdefault(data[d][i : i + 50], d)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for r in substring_dedup.remove_repeats(docs).collect():
        x, gone = data[r["doc_id"]], set()
        for i in range(len(x) - 49):
            if first[x[i : i + 50]] < r["doc_id"]:
                gone.update(range(i, i + 50))
        assert r["n_removed"] == len(gone)


def test_mixing(docs, rows):
    sized = docs.select("doc_id", "source", "lang", mixing.word_count(docs["text"]).alias("size"))
    out = mixing.mix(sized).collect()
    assert len(out) == len(rows) and all(r["copies"] in (0, 1, 2) for r in out)
    total = sum(r["size"] for r in out)
    by = {}
    for r in out:
        by.setdefault(r["source"], [r["source_size"], r["target"], 0, 0])
        by[r["source"]][2] += r["size"] * r["copies"]
        by[r["source"]][3] = max(by[r["source"]][3], r["size"])
    assert abs(sum(t for _, t, *_ in by.values()) - 1.5 * total) < 1e-6
    for size, target, taken, largest in by.values():
        assert target <= 2 * size + 1e-9 and abs(taken - target) <= largest
    assert sorted((r["doc_id"], r["copies"]) for r in mixing.mix(sized.repartition(3)).collect()) == sorted((r["doc_id"], r["copies"]) for r in out)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in out)


def test_packing(docs, rows):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 0] for d, x, *_ in rows}
    got = packing.pack_documents(docs).collect()
    used = {}
    for r in got:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"]
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in got) == sum(map(len, ids.values()))
    for s in used.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_encoder_is_the_tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    e = packing.Encoder(public_tokenizers.path(packing.VOCABULARY), public_tokenizers.path(packing.RANKS))
    for text in ["Don't stop", "a  b\n\n c\t", "x\x1cy", "½ ² Straße", "日本 语", "<|endoftext|> x", "  ", "'s'll", "\xa0\x85z", "", "é́"]:
        assert e.ids(text) == np.array(e.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_encoder_is_the_tokenizer_on_all_texts():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    e = packing.Encoder(public_tokenizers.path(packing.VOCABULARY), public_tokenizers.path(packing.RANKS))
    texts = sorted({t for t in pq.read_table(path)["text"].to_pylist() if t})
    for lo in range(0, len(texts), 500):
        part = texts[lo : lo + 500]
        for text, ids in zip(part, e.tokenizer.encode_batch(part, add_special_tokens=False)):
            assert e.ids(text) == np.array(ids.ids, "<u4").tobytes(), text[:200]


@pytest.mark.parametrize("seed", range(30))
def test_reduction_keeps_the_optimum(seed):
    """Few sequences as an exhaustive search finds, and never more than best-fit alone would need beyond it."""
    r = np.random.default_rng(100 + seed)
    lengths = sorted(r.integers(1, 13, 8).tolist(), reverse=True)

    def best(i, rooms):
        if i == len(lengths):
            return len(rooms)
        out = min((best(i + 1, [*rooms[:k], room - lengths[i], *rooms[k + 1 :]]) for k, room in enumerate(rooms) if room >= lengths[i] and room not in rooms[:k]), default=99)
        return min(out, best(i + 1, [*rooms, 12 - lengths[i]]))

    n = sum(many for many, _ in packing.reduce_and_fit({w: lengths.count(w) for w in set(lengths)}, 12))
    assert best(0, []) <= n <= best(0, []) + 1


def test_plan_does_not_grow_with_the_documents():
    plan = lambda n: packing.reduce_and_fit({w: n // 300 for w in range(700, 1000)})
    few, many = plan(300_000), plan(3_000_000)
    assert len(few) == len(many) <= 2 * 300
    assert sum(n * w * q for n, content in many for w, q in content) == sum(range(700, 1000)) * 10_000


@pytest.mark.parametrize("seed", range(20))
def test_reduction_keeps_every_piece(seed):
    r = np.random.default_rng(seed)
    capacity = int(r.choice([10, 20, 50]))
    lengths = r.integers(1, capacity + 1, r.integers(0, 60)).tolist()
    counts = {w: lengths.count(w) for w in set(lengths)}
    got, n = dict.fromkeys(counts, 0), 0
    for many, content in packing.reduce_and_fit(counts, capacity):
        assert many > 0 and sum(w * q for w, q in content) <= capacity
        n += many
        for w, q in content:
            got[w] += many * q
    assert got == counts and n <= -(-sum(lengths) // capacity) * 1.3 + 1


def fewest(lengths, capacity):
    """The least number of sequences, by trying all."""
    best = len(lengths)

    def place(left, rooms):
        nonlocal best
        if len(rooms) >= best and left:
            return
        if not left:
            best = min(best, len(rooms))
            return
        w, rest = left[0], left[1:]
        for k, room in enumerate(rooms):
            if w <= room and room not in rooms[:k]:
                place(rest, [*rooms[:k], room - w, *rooms[k + 1 :]])
        place(rest, [*rooms, capacity - w])

    place(sorted(lengths, reverse=True), [])
    return best


def test_packing_against_all_packings():
    more = 0
    for seed in range(150):
        r = np.random.default_rng(seed)
        capacity = int(r.choice([10, 20, 37]))
        lengths = r.integers(1, capacity + 1, r.integers(1, 11)).tolist()
        n = sum(many for many, _ in packing.reduce_and_fit({w: lengths.count(w) for w in set(lengths)}, capacity))
        least = fewest(lengths, capacity)
        assert least <= n <= least + 1
        more += n > least
    assert more <= 3


def test_neighbours(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 8)).astype(np.float32)
    x[50:70] = x[49]
    rows = [(i, [float(v) for v in x[i]]) for i in range(400)]
    rows += [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [None] * 8), (904, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for q in neighbours.nearest_neighbours(df, df["vec_id"] % 10 == 0, 10).collect():
        got.setdefault(q["query_id"], []).append((q["rank"], q["vec_id"], q["score"]))
    assert set(got) == set(range(0, 400, 10))
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        right = [i for i in np.lexsort((np.arange(400), d)) if i != q][:10]
        found.sort()
        assert [k for k, *_ in found] == list(range(1, 11))
        assert all(abs(s - d[v]) < 1e-12 for _, v, s in found)
        hit += len({v for _, v, _ in found} & set(right))
    assert hit >= 0.9 * 10 * len(got)
    assert neighbours.nearest_neighbours(df.where("false"), df["vec_id"] % 10 == 0).count() == 0
    # other lengths are searched among themselves; of a repeated id the smallest vector counts; a null id takes no part
    more = spark.createDataFrame([(10, [2.0, 0.0]), (11, [2.0, 1.0]), (12, [5.0, 0.0]), (12, [9.0, 0.0]), (13, [1.0] * 3), (None, [2.0, 0.0])], "vec_id long, embedding array<float>").withColumn("node", F.lit("x"))
    assert sorted(tuple(r) for r in neighbours.nearest_neighbours(more, more["vec_id"] % 10 == 0).collect()) == [(10, 1, 11, 1.0), (10, 2, 12, 3.0)]
    assert neighbours.nearest_neighbours(df.where("vec_id < 4"), df["vec_id"] == 0).count() == 3


def test_search_goes_on_to_the_end(spark, monkeypatch):
    nodes = neighbours.packed(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "node long, v array<float>")).cache()
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(29)], "u long, v long, d float")
    queries = nodes.where("node in (0, 29)").selectExpr("node div 29 as query_id", "z as q")
    monkeypatch.setattr(neighbours, "ENTRIES", 1)
    # one of the two ends is 15 steps or more from the only entry
    best = {r["query_id"]: r["node"] for r in neighbours.search(nodes, chain, queries).where("d = 0").collect()}
    assert best == {0: 0, 1: 29}
    monkeypatch.setattr(neighbours, "SEARCH_ROUNDS", 2)
    with pytest.raises(RuntimeError):
        neighbours.search(nodes, chain, queries)


def test_build_goes_on_until_settled(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(600, 6))
    nodes = neighbours.packed(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "node long, v array<float>")).cache()
    monkeypatch.setattr(neighbours, "CHUNK", 16)
    monkeypatch.setattr(neighbours, "ROUNDS", 1)
    with pytest.raises(RuntimeError):
        neighbours.build_graph(nodes)


REPEATED = [
    (1, "alpha beta gamma delta eps\nonly here", "en", "a"),
    (2, "alpha beta gamma delta eps\nonly there", "en", "a"),
    (2, "alpha beta gamma delta eps\nprecious unique line\nelse", "de", "b"),
    (3, "twice the same text of this row", "en", "a"),
    (3, "twice the same text of this row", "en", "a"),
    (None, "no id but some words of its own", "en", None),
    (None, None, None, None),
    (4, "", "en", "b"),
    (4, "", "en", "b"),
]
CLASHING = ["_id", "_lost", "_some", "_copies", "_place", "row", "text_key", "copy", "lost", "copies", "t", "of", "_t", "other_id"]


@pytest.fixture(scope="module")
def repeated(spark):
    df = spark.createDataFrame(REPEATED, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit(c).alias(c) for c in CLASHING], F.lit(1).alias("a.b")).repartition(3).cache()


def test_line_dedup_of_repeated_rows(repeated):
    kept = sorted((r["doc_id"] or 0, r["line_no"], r["kept"]) for r in line_dedup.line_verdicts(repeated).collect())
    second = [k for k in kept if k[:2] == (2, 0)]
    assert [k[2] for k in second] == [False, False]
    assert sorted(k for k in kept if k[0] == 3) == [(3, 0, False), (3, 0, True)]
    out = line_dedup.dedup_lines(repeated)
    assert out.columns == repeated.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["lang"] or "", r["_id"]) for r in out.collect()) == sorted([
        (1, "alpha beta gamma delta eps\nonly here", "en", "_id"), (2, "only there", "en", "_id"), (2, "precious unique line\nelse", "de", "_id"),
        (3, "twice the same text of this row", "en", "_id"), (0, "no id but some words of its own", "en", "_id"), (0, "", "", "_id"), (4, "", "en", "_id"), (4, "", "en", "_id"),
    ])


def test_mixing_of_repeated_rows(repeated):
    sized = repeated.withColumn("size", mixing.word_count(F.col("text")))
    out = mixing.mix(sized).collect()
    assert len(out) == len(REPEATED)
    fate = {}
    for r in out:
        assert fate.setdefault((r["doc_id"], r["source"]), r["copies"]) == r["copies"]
    mixed = mixing.mixed_documents(repeated)
    assert mixed.columns == repeated.columns and mixed.count() == sum(r["copies"] for r in out)


def test_substrings_of_repeated_rows(spark):
    passage = "this passage of more than fifty bytes stands in several documents, some of one id"
    rows = [(1, "x " + passage), (2, passage + " and more"), (2, "short"), (2, "another row with " + passage), (2, "another row with " + passage), (None, passage), (3, None), (3, passage)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep_bytes=True).collect()
    kept = sorted((r["doc_id"] or 0, bytes(r["kept"]).decode(), r["n_removed"]) for r in got)
    n = len(passage)
    assert kept == sorted([(1, "x " + passage, 0), (2, " and more", n), (2, "short", 0), (2, "another row with", n + 1), (2, "another row with", n + 1), (0, passage, 0), (3, "", 0), (3, "", n)])


def test_packing_and_join_of_repeated_rows(repeated):
    pytest.importorskip("public_tokenizers")
    got = packing.pack_documents(repeated).collect()
    assert len(got) == len(REPEATED) and len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    one = ngram_join.one_of_each_group(repeated)
    assert one.columns == repeated.columns and one.count() == 8
