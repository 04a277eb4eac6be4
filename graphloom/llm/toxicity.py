"""Toxicity by classifier chains over word features.

Categories are predicted one after the other; each model sees the word features
and the probabilities of the categories before it.  In training those
probabilities are out-of-fold predictions, so a later model learns from what an
earlier one says about texts it has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import _bytes as B
from graphloom.llm._linear import Sparse, fit_logistic, sigmoid

#: The models are fitted on at most so many labelled documents, toxic and other.
SAMPLE = {1: 1200, 0: 3600}
#: Features: whole words, and their beginnings of so many bytes; at most so many are chosen for each category.
PREFIXES = (4, 5)
MAX_FEATURES, FOLDS, THRESHOLD = 1024, 5, 0.5
#: A feature counts if it is in this share of a category's sample (and three documents), so many times as common there as elsewhere.
SHARE, LIFT = 0.007, 8
#: In this order, each from a label of its own; `poor`: text that the labels call of low quality.
CHAIN = ("poor", "toxic")


def _features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each word of all texts its text, and its feature hashes (one array for each kind)."""
    data = B.LOWER[data]
    starts, ends, first = B.words(data, off, B.LETTER)
    total = B.running(data)
    own = np.repeat(np.arange(len(off) - 1), np.diff(first))
    kinds = [B.span_hashes(total, starts, ends)]
    for k, n in enumerate(PREFIXES, 1):
        kinds.append(B.span_hashes(total, starts, np.minimum(ends, starts + n)) + np.uint64(k))
    return own, kinds


@dataclass
class Chain:
    """``features``: sorted hashes; for each category (weights, weights of earlier categories, bias)."""

    features: np.ndarray
    models: list[tuple[np.ndarray, np.ndarray, float]]

    def probabilities(self, x: Sparse) -> np.ndarray:
        p = np.zeros((len(x), 0))
        for w, v, b in self.models:
            p = np.column_stack([p, sigmoid(x.dot(w) + p @ v + b)])
        return p


def _find(features: np.ndarray, table: np.ndarray, own: np.ndarray, kinds: list[np.ndarray], n: int) -> Sparse:
    """Which of the chosen features each of n texts has. ``table``: by 16 bits, whether any has them."""
    found, width = [], max(1, len(features))
    for h in kinds:
        at = np.flatnonzero(table[(h & np.uint64(0xFFFF)).astype(np.int64)])
        k = np.minimum(np.searchsorted(features, h[at]), max(0, len(features) - 1))
        ok = features[k] == h[at] if len(features) else np.zeros(len(at), bool)
        found.append(own[at[ok]] * np.int64(width) + k[ok])
    pairs = np.unique(np.concatenate(found))
    start = np.searchsorted(pairs // width, np.arange(n + 1))
    return Sparse(pairs % width, np.ones(len(pairs), np.float32), start)


def _table(features: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << 16, bool)
    table[(features & np.uint64(0xFFFF)).astype(np.int64)] = True
    return table


def _telling(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Hashes of the features that tell the documents with y = 1 from the others, at most ``MAX_FEATURES``."""
    if not y.any() or y.all():
        return np.zeros(0, np.uint64)
    inside, n_in = np.unique(np.concatenate([r for r, t in zip(rows, y, strict=True) if t]), return_counts=True)
    other, n_other = np.unique(np.concatenate([r for r, t in zip(rows, y, strict=True) if not t]), return_counts=True)
    at = np.minimum(np.searchsorted(other, inside), max(0, len(other) - 1))
    n_other = np.where(other[at] == inside, n_other[at], 0) if len(other) else np.zeros(len(inside))
    lift = (n_in + 0.5) / (y.sum() + 1) / ((n_other + 0.5) / ((y == 0).sum() + 1))
    telling = np.flatnonzero((n_in >= max(3, SHARE * y.sum())) & (lift >= LIFT))
    return inside[telling[np.lexsort((inside[telling], -n_in[telling] * np.log(lift[telling])))][:MAX_FEATURES]]


def fit(docs: DataFrame, labels: DataFrame) -> Chain:
    """Fit the chain on a bounded sample (``SAMPLE``) of labelled documents, the first by hash of their id.

    Rows of ``labels`` without id or ``toxic`` are left out; an id labelled
    twice counts as toxic, or as poor, if either says so, and as not poor without
    a ``quality``; of several texts of one id the smallest is learnt from.
    Without toxic or without clean labels the chain has no features and calls
    nothing toxic.
    """
    poor = F.coalesce(F.max((F.col("quality") <= 0).cast("int")), F.lit(0))
    label = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"), poor.alias("poor"))
    parts = [label.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in SAMPLE.items()]
    chosen = parts[0].unionAll(parts[1])

    def unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in B.parts(batch.column("text")):
                own, kinds = _features(data, off)
                first = np.searchsorted(own, np.arange(hi - lo + 1))
                rows = [np.unique(np.concatenate([k[first[i] : first[i + 1]] for k in kinds])).tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c)[lo:hi] for c in ("doc_id", "y", "poor")], pa.array(rows, pa.binary())], ["doc_id", "y", "poor", "h"])

    # at most the sample's rows: the broadcast has a fixed bound, and so has what comes back, one row an id
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"), F.min("poor").alias("poor"))
    sample = sample.mapInArrow(unique, "doc_id long, y int, poor int, h binary").toPandas().sort_values("doc_id")
    y = sample["y"].to_numpy()
    if not len(y) or y.min() == y.max():
        return Chain(np.zeros(0, np.uint64), [])
    rows = [np.frombuffer(h, np.uint64) for h in sample["h"]]
    poor = sample["poor"].to_numpy()
    features = np.union1d(_telling(rows, poor), _telling(rows, y))
    x = []
    for r in rows:
        k = np.flatnonzero(np.isin(features, r, assume_unique=True))
        x.append((k, np.ones(len(k), np.float32)))
    x = Sparse.of(x)
    fold = np.arange(len(y)) % FOLDS
    models, earlier = [], np.zeros((len(y), 0))
    for target in (poor, y):
        held = np.zeros(len(y))
        for f in range(FOLDS):
            w, v, b = fit_logistic(x.pick(np.flatnonzero(fold != f)), target[fold != f], len(features), earlier[fold != f])
            mine = x.pick(np.flatnonzero(fold == f))
            held[fold == f] = sigmoid(mine.dot(w) + earlier[fold == f] @ v + b)
        models.append(fit_logistic(x, target, len(features), earlier))
        earlier = np.column_stack([earlier, held])
    return Chain(features, models)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """Adds the chain's probabilities ``p_poor``, ``p_toxic`` and ``toxic`` to whole documents.

    A text with none of the features (null and empty ones too) is not toxic and
    has probabilities 0.  Other columns, whatever their names, pass through.
    """
    names = [f"p_{c}" for c in CHAIN]
    old = [c for c in docs.columns if c not in (*names, "toxic")]
    schema = docs.select(*old).schema
    for n in names:
        schema = schema.add(n, "double")
    schema = schema.add("toxic", "boolean")
    features, table = chain.features, _table(chain.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.zeros((batch.num_rows, len(CHAIN)))
            if len(features):
                for lo, hi, data, off in B.parts(batch.column("text")):
                    x = _find(features, table, *_features(data, off), hi - lo)
                    p[lo:hi] = chain.probabilities(x) * (np.diff(x.start) > 0)[:, None]
            columns = [*batch.columns, *[pa.array(c) for c in p.T], pa.array(p[:, -1] >= THRESHOLD)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *names, "toxic"])

    return docs.select(*old).mapInArrow(run, schema)


def op7_toxicity_chain(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chain = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", "text"), chain).drop("text")
