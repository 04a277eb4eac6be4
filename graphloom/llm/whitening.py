"""Whitening of embeddings by principal components of exactly centred rows.

Vectors become integers first, so their number and sums are exact and every
row is centred exactly: n x - S is an integer vector, one division away from
the centred row.  MLlib's RowMatrix adds up the Gramian of these rows in the
executors (a triangle of d x d numbers a task, merged in a tree); divided by n it is
the covariance, whose eigenvectors are found on the driver.  The d x k matrix
that whitens is broadcast; rows never meet each other.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm._vectors import integers, usable
from graphloom.plans.stash import stash

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8


@dataclass(frozen=True)
class Whitening:
    """``n`` rows with ``sums`` (exact), the matrix ``axes`` (d x k, null columns where nothing varies), the share of the variance of each component."""

    n: int
    sums: list[int]
    largest: int
    axes: np.ndarray
    explained: list[float | None]


def _centred(x: np.ndarray, n: int, sums: list[int], largest: int) -> np.ndarray:
    """n x - S as integers; Python's own where 64 bits may not do."""
    if 2 * n * largest < 1 << 63:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _row_squares(y: np.ndarray) -> list[int]:
    """The exact sum of squares of each row of integers."""
    if y.dtype != object:
        top = int(np.abs(y).max(initial=0))
        if top * top * y.shape[1] >= 1 << 63:
            y = y.astype(object)
    return [int(v) for v in (y * y).sum(axis=1)]


def column_sums(rows: DataFrame) -> tuple[int, list[int], int]:
    """Number of rows, exact sum of each entry of ``x``, and the largest magnitude."""

    def partial(batches):
        for b in batches:
            if len(b):
                x = np.stack(b["x"].to_numpy())
                top = int(np.abs(x).max(initial=0))
                total = x.sum(axis=0) if top * len(x) < 1 << 63 else x.astype(object).sum(axis=0)
                yield pd.DataFrame({"at": np.arange(x.shape[1], dtype=np.int32), "n": len(x), "total": [str(v) for v in total], "top": top})

    parts = rows.select("x").mapInPandas(partial, "at int, n long, total string, top long")
    out = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.max("top").alias("top")).orderBy("at").collect()
    return (out[0]["n"], [int(r["total"]) for r in out], max(r["top"] for r in out)) if out else (0, [], 0)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The whitening of ``rows(x array<long>)``, all of one length.

    Components go by falling eigenvalue; each axis' largest entry is positive.
    An eigenvalue that is zero up to rounding has no whitened values.
    """
    n, sums, largest = column_sums(rows)
    d = len(sums)
    if not n:
        return Whitening(0, [], 0, np.zeros((0, 0)), [])

    def centre(batches):
        for b in batches:
            if len(b):
                y = _centred(np.stack(b["x"].to_numpy()), n, sums, largest)
                yield pd.DataFrame({"y": list((y / n).astype(float))})

    centred = rows.select("x").mapInPandas(centre, "y array<double>").select(array_to_vector("y").alias("y"))
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "y"), n, d)
    covariance = matrix.computeGramianMatrix().toArray() / n
    value, vector = np.linalg.eigh(covariance)
    value, vector = value[::-1], vector[:, ::-1]
    trace = float(np.trace(covariance))
    k = min(components, d)
    axes = np.full((d, k), np.nan)
    for c in range(k):
        if value[c] > d * np.finfo(float).eps * value[0]:
            axis = vector[:, c]
            axes[:, c] = axis * np.sign(axis[np.abs(axis).argmax()]) / np.sqrt(value[c])
    return Whitening(n, sums, largest, axes, [max(float(value[c]), 0.0) / trace if trace > 0 else None for c in range(k)])


def whiten(rows: DataFrame, model: Whitening, key: str = "vec_id") -> DataFrame:
    """``(key, deviation decimal(38,0), whitened array<double>)`` of each row: its exact squared distance from the mean times n^2, and its whitened components."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def project(batches):
        m = sent.value
        for b in batches:
            if len(b):
                y = _centred(np.stack(b["x"].to_numpy()), m.n, m.sums, m.largest)
                w = (y / m.n).astype(float) @ m.axes
                yield pd.DataFrame({"key": b["key"], "deviation": [Decimal(v) for v in _row_squares(y)], "whitened": [[None if v != v else v for v in r] for r in w.tolist()]})

    kind = rows.schema[key].dataType.simpleString()
    out = rows.select(F.col(key).alias("key"), "x").mapInPandas(project, f"key {kind}, deviation decimal(38,0), whitened array<double>")
    return out.withColumnRenamed("key", key)


def identity_error(whitened: DataFrame, components: int) -> float | None:
    """The largest entry of the covariance of ``whitened`` (centred, divisor n) minus the identity; components without values are left out."""
    w = lambda i: F.element_at("whitened", i + 1)
    pairs = [F.max(F.lit(None).cast("double"))] + [F.abs(F.covar_pop(w(i), w(j)) - F.lit(1.0 if i == j else 0.0)) for i in range(components) for j in range(i, components)]
    found = [v for v in whitened.agg(*[p.alias(f"p{i}") for i, p in enumerate(pairs)]).first() if v is not None]
    return max(found) if found else None


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector that takes part and each of its first 8 components.

    A vector that is null, holds null or non-finite entries, or has another
    length than most takes no part; repeated rows and null ids are rows like
    any other.  No vectors: no rows.  Where nothing varies along a component
    (equal rows, fewer rows than components), ``whitened`` is null; ``explained`` is
    null if nothing varies at all, and ``identity_error`` looks at the other components.  A deviation
    beyond 64 bits is null (``whiten`` itself has 38 digits).  Other columns are
    not looked at.
    """
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    rows = usable(table, "embedding").select("vec_id", integers("embedding", SCALE, SHIFT).alias("x"))
    model = fit(rows)
    scores = stash(whiten(rows, model), "whitened")
    k = len(model.explained)
    error = identity_error(scores, k)
    share = F.array(*[F.lit(v).cast("double") for v in model.explained]) if k else F.array().cast("array<double>")
    out = scores.select("vec_id", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
