"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Weights are learnt online by follow-the-regularised-leader with an elastic-net
penalty, which keeps most of them exactly zero, and the scores are calibrated by
a temperature on examples that the training did not use.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import _bytes as B
from graphloom.llm._linear import Sparse

#: Examples of each language that the weights and the temperature are fitted on, at most, and of all languages together (but 20 of each).
SAMPLE, WHOLE_SAMPLE = 400, 80_000
#: Entries of the document frequencies that are added up together.
CHUNK = 1 << 12
#: Lengths of the n-grams in characters, and features of each length.
GRAMS, DIM = (1, 2, 3, 4), 1 << 14
FOLDS, EPOCHS = 5, 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-4, 1e-4
UNKNOWN = "und"


def _slots(data: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length the feature of every n-gram, and where each text's n-grams begin and end."""
    chars, start = B.characters(B.LOWER[data], off)
    out = []
    for n in GRAMS:
        slots = (B.grams(chars, n) >> np.uint32(32 - 14)).astype(np.int64)
        begin = np.minimum(start[:-1], len(slots))
        out.append((slots, begin, np.maximum(begin, np.minimum(start[1:] - n + 1, len(slots)))))
    return out


def _counts(kinds: list, i: int) -> list[np.ndarray]:
    return [np.bincount(slots[begin[i] : end[i]], minlength=DIM) for slots, begin, end in kinds]


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """How many of all ``docs`` have each feature, in one table of fixed size for the whole corpus.

    A task adds up its own documents; tables of tasks are added in Spark.
    """
    size = DIM * len(GRAMS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size, np.int64), 0
        for batch in batches:
            for lo, hi, data, off in B.parts(batch.column("text")):
                kinds = _slots(data, off)
                n += hi - lo
                for k, (slots, begin, end) in enumerate(kinds):
                    # feature and text as one number, each pair once
                    own = np.repeat(np.arange(hi - lo), end - begin)
                    at = np.repeat(begin - np.concatenate([[0], np.cumsum(end - begin)[:-1]]), end - begin) + np.arange(len(own))
                    seen = np.zeros((hi - lo) * DIM, bool)
                    seen[own * DIM + slots[at]] = True
                    total[k * DIM : (k + 1) * DIM] += seen.reshape(hi - lo, DIM).sum(0)
        parts = [total[i : i + CHUNK].astype("<i8").tobytes() for i in range(0, size, CHUNK)]
        columns = [pa.array(range(len(parts)), pa.int32()), pa.array([n] * len(parts), pa.int64()), pa.array(parts)]
        yield pa.RecordBatch.from_arrays(columns, ["chunk", "n", "df"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        df = sum((np.frombuffer(x.as_buffer(), "<i8") for x in table.column("df")), np.zeros(CHUNK, np.int64))
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "n": [sum(table.column("n").to_pylist())], "df": [df.astype("<i8").tobytes()]})

    schema = "chunk int, n long, df binary"
    rows = docs.select("text").mapInArrow(count, schema).groupBy("chunk").applyInArrow(add, schema).collect()  # one table of `size` counters
    rows.sort(key=lambda r: r["chunk"])
    return rows[0]["n"] if rows else 0, np.concatenate([np.frombuffer(r["df"], "<i8") for r in rows]) if rows else np.zeros(size, np.int64)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # languages x features
    bias: np.ndarray
    temperature: float

    def scores(self, x: Sparse) -> np.ndarray:
        return np.column_stack([x.dot(w) for w in self.weights]) + self.bias

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        return _softmax(z / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _vector(counts: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit-length TF-IDF of one text, with logarithmic term frequencies."""
    c = np.concatenate(counts)
    i = np.flatnonzero(c)
    v = np.log1p(c[i]) * idf[i]
    return i, v / max(1e-12, np.sqrt((v * v).sum()))


def _ftrl(x: Sparse, y: np.ndarray, classes: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Follow the regularised leader, proximal: coordinates keep sums of gradients (z) and of their
    squares (n); a weight is zero until |z| exceeds the L1 penalty."""
    z, n = np.zeros((classes, dim + 1)), np.zeros((classes, dim + 1))
    step = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for r in step.permutation(len(x)):
            i = np.append(x.index[x.start[r] : x.start[r + 1]], dim)
            v = np.append(x.value[x.start[r] : x.start[r + 1]], 1.0)
            w = _leader(z[:, i], n[:, i])
            p = w @ v
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y[r]] -= 1
            g = p[:, None] * v
            more = n[:, i] + g * g
            z[:, i] += g - (np.sqrt(more) - np.sqrt(n[:, i])) / ALPHA * w
            n[:, i] = more
    w = _leader(z, n)
    return w[:, :-1], w[:, -1]


def _leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    return np.where(np.abs(z) <= L1, 0.0, w)


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    loss = lambda t: -np.log(_softmax(z / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()
    a, b, g = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(docs: DataFrame) -> Model | None:
    """Learn from ``docs(doc_id, text, lang)`` outside the held-out fold, with a known language.

    Document frequencies cover all of them; weights and temperature are fitted
    on at most ``SAMPLE`` of each language (the first by hash of id and text, fewer
    of each if there are very many languages; a fifth sets the temperature), and
    every language is learnt.  None if there is nothing to learn from.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "") & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    n, df = document_frequencies(known)
    idf = np.log((1 + n) / (1 + df)) + 1
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return None
    most = max(20, min(SAMPLE, WHOLE_SAMPLE // len(sizes)))
    # a hash threshold leaves about twice the sample of each language, so no language is ordered as a whole
    chance = known.sparkSession.createDataFrame([(lang, min(1.0, (2 * most + 50) / c)) for lang, c in sizes.items()], "lang string, chance double")
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / (1 << 40)
    drawn = known.select("doc_id", "text", "lang", place.alias("place")).join(F.broadcast(chance), "lang").where("place < chance")
    # repeated rows have the same place; so they count once
    drawn = drawn.groupBy("lang", "place").agg(F.min("text").alias("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in B.parts(batch.column("text")):
                kinds = _slots(data, off)
                x = [_vector(_counts(kinds, i), idf) for i in range(hi - lo)]
                i, v = (pa.array([a.astype(t).tobytes() for a in c], pa.binary()) for c, t in zip(zip(*x, strict=True), ("<u4", "<f4"), strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("lang")[lo:hi], batch.column("place")[lo:hi], i, v], ["lang", "place", "i", "v"])

    rows = drawn.mapInArrow(vectors, "lang string, place double, i binary, v binary").toPandas()
    rows = rows.sort_values(["lang", "place"]).groupby("lang").head(most)
    languages = sorted(rows["lang"].unique())
    y = rows["lang"].map({c: k for k, c in enumerate(languages)}).to_numpy()
    x = Sparse.of([(np.frombuffer(i, "<u4"), np.frombuffer(v, "<f4")) for i, v in zip(rows["i"], rows["v"], strict=True)])
    del rows
    aside = np.arange(len(y)) % 5 == 0
    w, b = _ftrl(x.pick(np.flatnonzero(~aside)), y[~aside], len(languages), DIM * len(GRAMS))
    model = Model(languages, idf, w, b, 1.0)
    if aside.any():
        model.temperature = _temperature(model.scores(x.pick(np.flatnonzero(aside))), y[aside])
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of each row, from its whole text alone.

    A text that is null or has no letter, and any text if nothing could be
    learnt, is ``und`` with score 0.  A null id is not held out.
    """
    schema = "doc_id long, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for lo, hi, data, off in B.parts(texts):
                clear = np.array([_has_letter(t) for t in texts[lo:hi].to_pylist()])
                best, p = np.array([UNKNOWN] * (hi - lo), object), np.zeros(hi - lo)
                if model and clear.any():
                    kinds, at = _slots(data, off), np.flatnonzero(clear)
                    z = np.empty((len(at), len(model.languages)))
                    for row, i in enumerate(at):
                        j, v = _vector(_counts(kinds, i), model.idf)
                        z[row] = model.weights[:, j] @ v + model.bias
                    q = model.probabilities(z)
                    best[at], p[at] = np.array(model.languages, object)[q.argmax(1)], q.max(1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], pa.array(best, pa.string()), pa.array(p)], ["doc_id", "lang_pred", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, schema)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs.select("doc_id", "text", "lang")))
