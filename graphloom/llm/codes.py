"""Compression of vectors to codes: product codebooks by weighted Lloyd rounds over distinct parts.

Vectors become integers and are cut into parts.  Equal parts at a position are
one row with a weight, so a vector that a third of the table repeats costs a
round no more than any other.  A round is one pass over the distinct parts:
each task measures its parts against the codebooks (a few entries, sent along)
and returns weighted integer sums, so rounds are exact and agree in any order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm._vectors import integers, usable
from graphloom.plans.stash import stash

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: A key with more than one in so many rows is joined by broadcast; there are at most so many of them (a position).
HOT = 1000


def bounds(length: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """Where each part of a vector begins and ends; equal where the length divides."""
    return [(length * p // parts, length * (p + 1) // parts) for p in range(parts)]


def split(rows: DataFrame, length: int, parts: int = PARTS) -> DataFrame:
    """``rows(..., q)`` with a row for each part: ``pos, part`` in place of ``q``."""
    pieces = F.array(*[F.slice("q", lo + 1, hi - lo) for lo, hi in bounds(length, parts)])
    return rows.select(*[c for c in rows.columns if c != "q"], F.posexplode(pieces).alias("pos", "part"))


def first_entries(rows: DataFrame, length: int, entries: int = ENTRIES, parts: int = PARTS) -> list[list[list[int]]]:
    """The parts of the vectors with the smallest ids, ascending; of several vectors of an id the smallest, null ids last."""
    ids = rows.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(entries).withColumnRenamed("vec_id", "_id")
    first = rows.join(F.broadcast(ids), F.col("vec_id").eqNullSafe(F.col("_id"))).groupBy("vec_id").agg(F.min("q").alias("q"))
    chosen = [r["q"] for r in first.orderBy(F.asc_nulls_last("vec_id")).collect()]
    return [[q[lo:hi] for q in chosen] for lo, hi in bounds(length, parts)]


def _nearest(parts: np.ndarray, book: list[list[int]], exact: type) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each part (of two as near the first), and the squared distance."""
    parts, book = parts.astype(exact), np.array(book, exact).reshape(len(book), -1)
    far = np.stack([((parts - c) ** 2).sum(axis=1) for c in book], axis=1) if parts.shape[1] else np.zeros((len(parts), len(book)), exact)
    code = far.argmin(axis=1).astype(np.int64)
    return code, far[np.arange(len(parts)), code]


def _by_position(batch: pd.DataFrame):
    for pos, b in batch.groupby("pos"):
        yield int(pos), b, np.stack(b["part"].to_numpy())


def _exact(largest: int, length: int, n: int) -> type:
    """64-bit integers if all squares and weighted sums fit, else Python's own."""
    return np.int64 if 4 * largest * largest * max(length, 1) < 1 << 63 and largest * max(n, 1) < 1 << 63 else object


def lloyd(distinct: DataFrame, books: list[list[list[int]]], rounds: int = ROUNDS, exact: type = np.int64) -> list[list[list[int]]]:
    """The codebooks after ``rounds`` rounds over ``distinct(pos, part, weight)``.

    An entry becomes the componentwise floor of the mean of its parts; an entry
    without parts stays.  What comes back to the driver is one row an entry and
    component.
    """
    for _ in range(rounds):
        now = books

        def sums(batches, now=now):
            for batch in batches:
                for pos, b, parts in _by_position(batch):
                    code, _ = _nearest(parts, now[pos], exact)
                    weight = b["weight"].to_numpy().astype(exact)
                    for c in np.unique(code):
                        on = code == c
                        total = (parts[on].astype(exact) * weight[on][:, None]).sum(axis=0)
                        yield pd.DataFrame({"pos": pos, "entry": int(c), "at": np.arange(len(total)), "weight": int(weight[on].sum()), "total": [str(v) for v in total]})

        found = distinct.mapInPandas(sums, "pos int, entry int, at int, weight long, total string")
        found = found.groupBy("pos", "entry", "at").agg(F.sum("weight").alias("weight"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        books = [[list(c) for c in book] for book in books]
        for r in found.collect():
            books[r["pos"]][r["entry"]][r["at"]] = int(r["total"]) // r["weight"]
    return books


def assigned(distinct: DataFrame, books: list[list[list[int]]], exact: type = np.int64) -> DataFrame:
    """``(pos, part, weight, code, far)``: the nearest entry of each distinct part and the squared distance (null beyond 64 bits)."""

    def code(batches):
        for batch in batches:
            for pos, b, parts in _by_position(batch):
                c, far = _nearest(parts, books[pos], exact)
                far = pd.array([int(v) if v < 1 << 63 else None for v in far], "Int64") if exact is object else far
                yield pd.DataFrame({"pos": pos, "part": b["part"], "weight": b["weight"], "code": c, "far": far})

    return distinct.mapInPandas(code, "pos int, part array<bigint>, weight long, code int, far long")


def attach(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``table``, one row for each (null-safe) key of ``rows``.

    ``weight`` counts the rows of a key: keys above a ``HOT``-th of ``total``,
    which can only be few, come by broadcast; all others by a shuffled join, in which none is large.
    """
    named = table.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in table.columns if c not in (*keys, weight)], weight)
    on = lambda: [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    hot, cold = named.where(F.col(weight) * HOT > total), named.where(F.col(weight) * HOT <= total)
    drop = [*[f"_{k}" for k in keys], weight]
    few = rows.join(F.broadcast(hot), on(), "inner").drop(*drop)
    rest = rows.join(F.broadcast(hot), on(), "left_anti").join(cold.hint("merge"), on(), "inner").drop(*drop)
    return few.unionByName(rest)


def compress(rows: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[list[list[int]]]]:
    """Codes of ``rows(vec_id, ..., q array<long>)``, and the codebooks.

    Returns all columns but ``q``, with ``codes array<int>`` and ``error`` (long).
    """
    rows = stash(rows.withColumn("_row", F.monotonically_increasing_id()), "vectors")
    n, largest = rows.agg(F.count("*"), F.max(F.array_max(F.transform("q", F.abs)))).first()
    exact = _exact(largest or 0, length, n)
    distinct = stash(split(rows.select("q"), length, parts).groupBy("pos", "part").agg(F.count("*").alias("weight")), "parts")
    books = lloyd(distinct, first_entries(rows, length, entries, parts), rounds, exact)
    coded = stash(assigned(distinct, books, exact), "codes")
    met = attach(split(rows, length, parts), coded, ["pos", "part"], "weight", n)
    own = [c for c in rows.columns if c != "q"]
    places = [F.max(F.when(F.col("pos") == p, F.col("code"))).alias(f"_c{p}") for p in range(parts)]
    # a missing distance makes the sum null
    whole = F.when(F.count("far") == parts, F.sum("far")).alias("error")
    out = met.groupBy(*own).agg(*places, whole)
    return out.select(*[c for c in own if c != "_row"], F.array(*[f"_c{p}" for p in range(parts)]).alias("codes"), "error"), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's code, error and the error of its label.

    A vector that is null, holds null or non-finite components, or has another
    length than most takes no part; repeated rows each have a row, of a
    repeated id the smallest vector starts an entry, null ids come last.  Fewer
    than 16 ids make as many entries; equal entries tie to the first, so the
    others stay unused.  Where 8 does not divide the length, parts differ by
    one.  No vectors: no rows.  Other columns are not looked at.
    """
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    rows = usable(table, "embedding").select("vec_id", "label", integers("embedding", SCALE).alias("q"))
    one = rows.select(F.size("q").alias("d")).take(1)
    kept, books = compress(rows, one[0]["d"] if one else 0)
    kept = stash(kept, "coded")
    labels = stash(kept.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "labels")
    out = attach(kept, labels, ["label"], "_n", kept.count())
    code = F.concat(*[F.lower(F.lpad(F.hex(F.get("codes", F.lit(p))), 2, "0")) for p in range(PARTS)])
    digest = hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    kept = f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS k, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT k, vec_id, label, CAST(i AS INT) AS pos, q[len(q) * i // {PARTS} + 1 : len(q) * (i + 1) // {PARTS}] AS part FROM kept, range({PARTS}) t(i)),
d AS MATERIALIZED (SELECT pos, part, count(*) AS w FROM p GROUP BY ALL),
b0 AS MATERIALIZED (SELECT pos, CAST(e AS INT) AS e, part AS c FROM (SELECT pos, part, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS e FROM p) WHERE e < {ENTRIES})"""
    steps = [kept]
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT pos, part, w, arg_min(e, (far, e)) AS e, min(far) AS far
  FROM (SELECT d.pos, part, w, e, list_sum(list_transform(list_zip(part, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS far FROM d JOIN b{r} b ON b.pos = d.pos)
  GROUP BY pos, part, w)""")
        if r < ROUNDS:
            steps.append(f"""b{r + 1} AS MATERIALIZED (
  SELECT b.pos, b.e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN (
    SELECT pos, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c
    FROM (SELECT pos, e, j, sum(part[j] * w) AS s, sum(w) AS n FROM (SELECT *, unnest(range(1, len(part) + 1)) AS j FROM a{r}) GROUP BY pos, e, j)
    GROUP BY pos, e) m ON m.pos = b.pos AND m.e = b.e)""")
    body = ",\n".join(steps)
    return f"""
WITH {body},
v AS MATERIALIZED (
  SELECT k, vec_id, label, string_agg(printf('%02x', e), '' ORDER BY pos) AS code, CAST(sum(far) AS BIGINT) AS error
  FROM p JOIN a{ROUNDS} USING (pos, part) GROUP BY k, vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY pos, e)) FROM b{ROUNDS}) AS codebooks_sha256
FROM v
"""


OP13_SQL = _sql()
