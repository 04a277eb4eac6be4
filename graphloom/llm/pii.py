"""Personal data: exact patterns, and a semi-Markov conditional random field that adds spans.

The model reads windows of tokens around digits and at-signs.  Every run of up to
``LONGEST`` tokens is a candidate segment scored as a whole (its digits, groups,
check sum, separators, surroundings), every other token stands for itself, and a
dynamic programme over the window chooses boundaries and types together.  It is
trained on windows of a bounded sample whose segments the patterns label, with
some of them rewritten into forms that the patterns do not cover.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._bytes import slices, utf8

KINDS = ("email", "ip", "card", "phone")
#: Spans whose surroundings train the model, tokens of an entity, steps of training.
SAMPLE, LONGEST, STEPS = 300, 12, 60
#: Tokens whose segments are scored together.
PART = 256
#: The patterns of the base spans.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_AROUND = _LOCAL | {"@", "(", " ", ")"}
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)
_TRIGGER = re.compile(r"[0-9@]")
_NUMBER = re.compile(r"@|[0-9]{4}")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """What the patterns find, by start and kind; matches that fail their test are dropped without another try."""
    out: list[Span] = []
    # an address lies around its at-sign: what may stand before it reaches back to the last match, so no place is tried twice
    last, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > last and text[lo - 1] in _LOCAL:
            lo -= 1
        if lo < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((lo, m.end(), "email"))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if _TRIGGER.search(text):
        for run in _DOTTED.finditer(text):
            if run[0].count(".") >= 3:
                for m in IP.finditer(run[0]):
                    if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                        out.append((m.start() + run.start(), m.end() + run.start(), "ip"))
        for m in CARD.finditer(text):
            if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        for m in PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def windows(text: str) -> Iterator[list[tuple[int, int]]]:
    """Tokens (start, end) of each stretch around digits and at-signs."""
    tokens: list[tuple[int, int]] = []
    last = -1
    for m in _TRIGGER.finditer(text):
        if m.start() <= last:
            continue
        # a stretch reaches as far as its characters could belong to one entity, and a little more
        lo = m.start()
        while lo > last + 1 and m.start() - lo < 64 and text[lo - 1] in _AROUND:
            lo -= 1
        hi = m.end()
        quiet = 0
        while hi < len(text) and quiet < 24:
            quiet = 0 if text[hi] in "0123456789@" else quiet + 1
            hi += 1
        last = hi - 1
        tokens = [(t.start() + lo, t.end() + lo) for t in _TOKEN.finditer(text[lo:hi])]
        if tokens:
            yield tokens


#: Features of a segment, in the order of ``_features``.
_NAMES = 36


def _features(text: str, a: int, b: int, n: int) -> np.ndarray:
    """What the whole span text[a:b] of n tokens looks like."""
    s = text[a:b]
    f = np.zeros(_NAMES)
    digits = _digits(s)
    d = len(digits)
    groups = re.findall(r"[0-9]+", s)
    letters = sum(c.isalpha() for c in s)
    f[0] = 1
    f[1] = d == 0
    f[2], f[3], f[4], f[5] = 1 <= d < 7, 7 <= d < 10, 10 <= d <= 13, 14 <= d <= 19
    f[6] = d > 19
    f[7] = 14 <= d <= 19 and luhn(digits)
    f[8] = 14 <= d <= 19 and not f[7]
    f[9] = letters > 0
    f[10] = s.count("@") == 1
    f[11] = "@" in s and "." in s.split("@")[-1].strip(".") and not s.endswith((".", "@"))
    f[12] = s.startswith("+")
    f[13] = s.startswith("(") and ")" in s
    f[14] = s.count("(") != s.count(")")
    f[15] = len(groups) == 4 and s.count(".") == 3 and len(s) == d + 3 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    f[16] = s.count(".") == 3 and not f[15]
    f[17] = not s[0].isalnum() and s[0] not in "+("
    f[18] = not s[-1].isalnum()
    f[19] = a > 0 and (text[a - 1].isalnum() or text[a - 1] in "@+")
    f[20] = b < len(text) and (text[b].isalnum() or text[b] == "@")
    f[21] = any(c.isspace() for c in s)
    f[22] = any(c.isspace() for c in s) and letters > 0
    f[23] = "\n" in s
    f[24] = [len(g) for g in groups[-3:]] == [3, 3, 4]
    f[25] = len(groups) >= 4 and all(len(g) == 4 for g in groups[:3])
    f[26] = n == 1
    f[27] = n > 8
    f[28] = bool(re.search(r"[^0-9A-Za-z@.()+ _%-]", s))
    f[29] = letters > 0 and "@" not in s
    f[30] = a > 1 and text[a - 1] in "-.(" and text[a - 2].isdigit()
    f[31] = b + 1 < len(text) and text[b] in "-. " and text[b + 1].isdigit()
    f[32] = d == len(s)
    f[33] = "@" in s and any(c.isspace() for c in s)
    # a part of a longer name: a joint between letters or digits is cut
    f[34] = a > 1 and text[a - 1] in "._%+-" and text[a - 2].isalnum()
    f[35] = b + 1 < len(text) and text[b] in "._%+-" and text[b + 1].isalnum()
    return f


def _lattice(text: str, tokens: list[tuple[int, int]], first: int = 0, end: int | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Candidate segments (first token, end token) that begin in [first, end), and their features; entities begin and end with no
    space and hold a digit or at-sign."""
    pairs, rows = [], []
    for i in range(first, len(tokens) if end is None else min(end, len(tokens))):
        if text[tokens[i][0]].isspace():
            continue
        for j in range(i + 1, min(len(tokens), i + LONGEST) + 1):
            a, b = tokens[i][0], tokens[j - 1][1]
            if text[b - 1].isspace() or not _TRIGGER.search(text, a, b):
                continue
            pairs.append((i, j))
            rows.append(_features(text, a, b, j - i))
    return pairs, np.array(rows).reshape(len(rows), _NAMES)


def _order(pairs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    p = np.array(pairs, int).reshape(len(pairs), 2)
    return p[:, 0], p[:, 1]


def _forward_backward(n: int, pairs: list[tuple[int, int]], score: np.ndarray) -> tuple[np.ndarray, float]:
    """Probability of each (segment, type) and the log partition; a token outside scores 0."""
    ends: list[list[int]] = [[] for _ in range(n + 1)]
    starts: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (i, j) in enumerate(pairs):
        ends[j].append(k)
        starts[i].append(k)
    any_type = np.logaddexp.reduce(score, axis=1) if len(pairs) else np.zeros(0)
    fore, back = np.zeros(n + 1), np.zeros(n + 1)
    for j in range(1, n + 1):
        ways = [fore[j - 1], *[fore[pairs[k][0]] + any_type[k] for k in ends[j]]]
        fore[j] = np.logaddexp.reduce(ways)
    for i in range(n - 1, -1, -1):
        ways = [back[i + 1], *[back[pairs[k][1]] + any_type[k] for k in starts[i]]]
        back[i] = np.logaddexp.reduce(ways)
    if not pairs:
        return np.zeros((0, len(KINDS))), fore[n]
    i, j = _order(pairs)
    return np.exp(fore[i][:, None] + score + back[j][:, None] - fore[n]), fore[n]


def decode(text: str, tokens: list[tuple[int, int]], weights: np.ndarray) -> list[Span]:
    """The best cut of the window into entities and single tokens.

    Features are made for ``PART`` starts at a time and only scores are kept, and
    of those only what can win (a token outside scores 0), so a window as long
    as a whole text needs little memory.
    """
    n = len(tokens)
    pairs: list[tuple[int, int]] = []
    kind: list[int] = []
    best: list[float] = []
    for first in range(0, n, PART):
        own, f = _lattice(text, tokens, first, first + PART)
        if own:
            score = f @ weights.T
            good = np.flatnonzero(score.max(1) > 0)
            pairs += [own[k] for k in good]
            kind += score[good].argmax(1).tolist()
            best += score[good].max(1).tolist()
    if not pairs:
        return []
    top, via = [0.0] * (n + 1), [-1] * (n + 1)
    by_end: dict[int, list[int]] = {}
    for k, (_, j) in enumerate(pairs):
        by_end.setdefault(j, []).append(k)
    for j in range(1, n + 1):
        top[j] = top[j - 1]
        for k in by_end.get(j, ()):
            if top[pairs[k][0]] + best[k] > top[j]:
                top[j], via[j] = top[pairs[k][0]] + best[k], k
    out, j = [], n
    while j:
        if via[j] < 0:
            j -= 1
            continue
        i = pairs[via[j]][0]
        out.append((tokens[i][0], tokens[j - 1][1], KINDS[kind[via[j]]]))
        j = i
    return out[::-1]


def _rewritten(s: str, kind: str, turn: int) -> tuple[str, bool]:
    """A span in a form that the patterns do not cover, or spoilt so that it is none (then false), or as it is."""
    if kind == "phone" and turn % 3:
        d = _digits(s)[-10:]
        return (f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}")[turn % 2], True
    if kind == "email" and turn % 3 == 1:
        return s.replace("@", " @ "), True
    if kind == "card" and turn % 2:
        return s[:-1] + str((int(s[-1]) + 1 + turn % 8) % 10), False
    if kind == "ip" and turn % 3 == 1:
        return "9" + s.zfill(15)[-14:], False
    return s, True


def train(texts: list[str]) -> np.ndarray:
    """Weights (kinds x features) by gradient ascent on the likelihood of the windows' labelled cuts."""
    problems = []
    for turn, text in enumerate(texts):
        new, gold, last = [], [], 0
        for a, b, kind in base_spans(text):
            if a < last:
                continue
            new.append(text[last:a])
            at = sum(map(len, new))
            form, real = _rewritten(text[a:b], kind, turn)
            new.append(form)
            if real:
                gold.append((at, at + len(form), kind))
            last = b
        changed = "".join([*new, text[last:]])
        for tokens in windows(changed):
            pairs, f = _lattice(changed, tokens)
            if pairs:
                where = {(tokens[i][0], tokens[j - 1][1]): k for k, (i, j) in enumerate(pairs)}
                right = [(where[a, b], KINDS.index(kind)) for a, b, kind in gold if (a, b) in where]
                problems.append((len(tokens), pairs, f, right))
    w = np.zeros((len(KINDS), _NAMES))
    w[:, 0] = -1
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        grad = -1e-3 * w * max(1, len(problems))
        for n, pairs, f, right in problems:
            p, _ = _forward_backward(n, pairs, f @ w.T)
            grad -= p.T @ f
            for k, kind in right:
                grad[kind] += f[k]
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        w += 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def fit(docs: DataFrame) -> np.ndarray:
    """Train on at most ``SAMPLE`` documents with a base span: of each kind a share, from a sample by hash of id and text.

    Only stretches around the spans are gathered, so the sample has a bound in
    characters too.  Without any such document the model adds nothing.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = {}
                base = base_spans(text or "")
                for a, b, kind in base:
                    found.setdefault(kind, (doc, kind, text[max(0, a - 40) : min(b, a + 80) + 40]))
                # long numbers and at-signs that no pattern takes
                for m in _NUMBER.finditer(text or ""):
                    if not any(m.start() < b + 40 and a < m.end() + 40 for a, b, _ in base):
                        found.setdefault("none", (doc, "none", text[max(0, m.start() - 40) : min(m.end(), m.start() + 80) + 40]))
                rows += found.values()
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)], ["doc_id", "kind", "text"])

    marked = F.col("text").rlike("@|[0-9][0-9.() -]{5}")
    # a hash threshold bounds what the search for spans has to read in Python: about 5 * SAMPLE different rows, equal ones once
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    marked = docs.where(marked).select("doc_id", "text", place.alias("place"))
    n = marked.count()
    some = marked.where(F.col("place") < int((1 << 40) * min(1.0, 5 * SAMPLE / max(1, n)))).groupBy("place").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))
    found = some.select("doc_id", "text").mapInArrow(cut, "doc_id long, kind string, text string")
    rows = sorted((r["kind"], r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in found.collect())
    texts = []
    for kind in (*KINDS, "none"):
        texts += [t for k, *_, t in rows if k == kind][: SAMPLE // (len(KINDS) + 1)]
    return train(texts)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def find(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Spans of each row of ``docs(doc_id, text, ...)``: base counts, ``base_sha256`` and all ``spans``.

    Positions are code points, ends exclusive.  Null counts as empty and has no
    spans.  The model's spans join the base ones unless they overlap one.
    """
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, (_, off) = batch.column("text"), utf8(batch.column("text"))
            for lo, hi in slices(off):
                rows = []
                for text in texts[lo:hi].to_pylist():
                    base = base_spans(text or "")
                    more = []
                    if text and _TRIGGER.search(text):
                        for tokens in windows(text):
                            more += [s for s in decode(text, tokens, weights) if not any(s[0] < b and a < s[1] for a, b, _ in base)]
                    rows.append((*[sum(k == kind for *_, k in base) for kind in KINDS], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more)))
                columns = [pa.array(c, pa.int64() if i < len(KINDS) else pa.string()) for i, c in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], *columns], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op6_pii_spans(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find(docs, fit(docs))
