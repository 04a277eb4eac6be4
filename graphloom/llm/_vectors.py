"""Vector columns: which rows take part, and their components as integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scaled components from this magnitude on have no exact integer in a double.
EXACT = 2.0**53


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is there, all entries finite, and of the table's commonest length (of two as common the longer).

    A vector of another length lacks entries or has some that no other has, so
    it takes no part, like a vector with null entries.
    """
    finite = F.forall(column, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))  # NaN is larger than all numbers
    rows = vectors.where(F.col(column).isNotNull() & finite)
    lengths = rows.groupBy(F.size(column).alias("length")).agg(F.count("*").alias("n")).where("length > 0")
    top = lengths.orderBy(F.desc("n"), F.desc("length")).limit(1).collect()
    return rows.where(F.size(column) == (top[0]["length"] if top else -1))


def integers(column: str, scale: int, shift: int = 0) -> Column:
    """``floor(scale * c) + shift`` of each entry c; raises where that has no exact integer."""
    scaled = lambda c: c.cast("double") * scale
    return F.transform(
        column, lambda c: F.when(F.abs(scaled(c)) < EXACT, F.floor(scaled(c)) + shift).otherwise(F.raise_error(F.lit("a vector entry is too large to be an integer")))
    )
