"""Quality rules and a logistic regression on hashed word and character n-grams.

Base rules count words, symbols, repeated lines and repeated three-word windows
over whole texts.  What they let through is judged by a logistic regression,
trained on a bounded sample of labelled rows, with its scores calibrated to
probabilities on the part of the sample it was not trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import _bytes as B
from graphloom.llm._linear import Sparse, fit_logistic, platt, sigmoid

#: The model is fitted on at most so many labelled documents, of low and of good quality.
SAMPLE = {0: 1000, 1: 2000}
DIM, SCALE = 1 << 15, 16.0
#: Lengths of the character n-grams and of the word n-grams.
CHARS, WORDS = (2, 4), (1, 2)
#: Fixed thresholds: fewest words, largest share of repeated words, least probability of good quality.
LEAST_WORDS, REPEATED, KEEP = 50, 0.5, 0.5
#: Symbols.
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
_CONTINUED = np.zeros(256, bool)
_CONTINUED[0x80:0xC0] = True


def _repeated_words(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text the words in three-word windows that stand twice or more in it."""
    n = len(h)
    if n < 3:
        return np.zeros(len(first) - 1, np.int64)
    own = np.repeat(np.arange(len(first) - 1), np.diff(first))
    windows = B.chained(h, 3)
    inside = own[:-2] == own[2:]
    # the text is part of the key, so equal keys are windows of one text
    key = B.mix(windows + B.mix(own[:-2].astype(np.uint64) + np.uint64(1)))
    at = np.flatnonzero(inside)
    order = at[np.argsort(key[at])]
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(n, bool)
    for j in range(3):
        covered[order[twice] + j] = True
    return np.bincount(own[covered], minlength=len(first) - 1)


def _repeated_lines(text: str | None) -> int:
    """Lines with a word that are equal to an earlier line."""
    if not text or "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x and not _blank(x)]
    return len(lines) - len(set(lines))


def _blank(line: str) -> bool:
    return not line.strip(" \t\n\x0b\x0c\r")


def _measure(texts: list[str | None], data: np.ndarray, off: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The base counts of each text, the hashes of its words, and where each text's words begin."""
    starts, ends, first = B.words(data, off)
    h = B.span_hashes(B.running(data), starts, ends)
    ahead = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    points, symbols = ahead(~B.SPACE[data] & ~_CONTINUED[data]), ahead(SYMBOL[data])
    return {
        "n_words": np.diff(first),
        "word_chars": points[off[1:]] - points[off[:-1]],
        "n_symbols": symbols[off[1:]] - symbols[off[:-1]],
        "n_dup_lines": np.array([_repeated_lines(t) for t in texts], np.int64),
        "n_repeat_words": _repeated_words(h, first),
    }, h, first


def _slots(data: np.ndarray, off: np.ndarray, h: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed features of all texts: for each kind of n-gram (slot of each, where each text's begin).

    Character n-grams that would cross the end of a text are left out by their
    place, so texts do not see each other.
    """
    out = []
    for n in WORDS:
        slots = (B.chained(h, n) >> np.uint64(64 - 15)).astype(np.int64)
        begin = np.minimum(first[:-1], len(slots))
        out.append((slots, begin, np.maximum(begin, np.minimum(first[1:] - n + 1, len(slots)))))
    chars, start = B.characters(data, off)
    for n in CHARS:
        slots = (B.grams(chars, n) >> np.uint32(32 - 15)).astype(np.int64)
        begin = np.minimum(start[:-1], len(slots))
        out.append((slots, begin, np.maximum(begin, np.minimum(start[1:] - n + 1, len(slots)))))
    return out


def _sparse(data: np.ndarray, off: np.ndarray, h: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's features and values: of every kind the share of each n-gram, times ``SCALE``."""
    kinds, out = _slots(data, off, h, first), []
    for i in range(len(off) - 1):
        index, value = [], []
        for k, (slots, begin, end) in enumerate(kinds):
            own, n = np.unique(slots[begin[i] : end[i]], return_counts=True)
            index.append(own + k * DIM)
            value.append(n * (SCALE / max(1, n.sum())))
        out.append((np.concatenate(index) if index else np.zeros(0, np.int64), np.concatenate(value) if value else np.zeros(0)))
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, x: Sparse) -> np.ndarray:
        return sigmoid(self.slope * (x.dot(self.weights) + self.bias) + self.shift)


KINDS = len(WORDS) + len(CHARS)


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on a bounded sample (``SAMPLE``) of labelled documents; None if a class is missing.

    Labels without id or quality are left out; of several for one id the lowest
    counts, and of several texts of one id the smallest.  A fifth of the sample
    calibrates.
    """
    label = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min((F.col("quality") > 0).cast("int")).alias("y"))
    low, good = (label.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in SAMPLE.items())

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in B.parts(batch.column("text")):
                starts, ends, first = B.words(data, off)
                h = B.span_hashes(B.running(data), starts, ends)
                x = _sparse(data, off, h, first)
                columns = [pa.array([i.astype("<u4").tobytes() for i, _ in x], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in x], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], batch.column("y")[lo:hi], *columns], ["doc_id", "y", "i", "v"])

    # at most the sample's rows: the broadcast has a fixed bound, and so has what comes back, one row an id
    rows = docs.select("doc_id", "text").join(F.broadcast(low.unionAll(good)), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    rows = rows.mapInArrow(features, "doc_id long, y int, i binary, v binary").toPandas().sort_values("doc_id")
    y = rows["y"].to_numpy()
    held = np.arange(len(y)) % 5 == 0
    if min((y[held] > 0).sum(), (y[held] <= 0).sum(), (y[~held] > 0).sum(), (y[~held] <= 0).sum()) == 0:
        return None
    x = Sparse.of([(np.frombuffer(i, "<u4"), np.frombuffer(v, "<f4")) for i, v in zip(rows["i"], rows["v"], strict=True)])
    del rows
    w, _, b = fit_logistic(x.pick(np.flatnonzero(~held)), y[~held], KINDS * DIM, l2=1e-4, steps=80)
    slope, shift = platt(x.pick(np.flatnonzero(held)).dot(w) + b, y[held])
    return Model(w.astype(np.float32), b, slope, shift)


def judge(docs: DataFrame, model: Model | None) -> DataFrame:
    """Base counts and verdict of each row of ``docs(doc_id, text, ...)``; every text is read whole.

    Null and empty texts have no words and fail the base rules.  Without a model
    the base rules alone decide.  Returns ``doc_id, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, p_good, kept``; p_good is
    null where the base rules fail or there is no model.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, p_good double, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for lo, hi, data, off in B.parts(texts):
                base, h, first = _measure(texts[lo:hi].to_pylist(), data, off)
                failed = (base["n_words"] < LEAST_WORDS) | (base["n_repeat_words"] > REPEATED * base["n_words"])
                good = np.ones(hi - lo)
                if model:
                    z = np.zeros(hi - lo)
                    for k, (slots, begin, end) in enumerate(_slots(data, off, h, first)):
                        z += _score(slots, begin, end, model.weights[k * DIM : (k + 1) * DIM])
                    good = sigmoid(model.slope * (z + model.bias) + model.shift)
                columns = [pa.array(base[c].astype(np.int64)) for c in counts]
                p = pa.array(good, mask=failed | (model is None))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], *columns, pa.array(failed), p, pa.array(~failed & (good >= KEEP))], ["doc_id", *counts, "base_failed", "p_good", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _score(slots: np.ndarray, begin: np.ndarray, end: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each text the weighted shares of its n-grams, as in training."""
    total = np.concatenate([[0.0], np.cumsum(w[slots], dtype=np.float64)])
    return SCALE * (total[end] - total[begin]) / np.maximum(1, end - begin)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
