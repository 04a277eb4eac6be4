"""Carrying annotations between builds by fingerprints of functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = ("size", "insns", "blocks", "shape")
#: Start and multiplier of the shape hash.
START, TIMES = 1469598103934665603, 1099511628211


def shape_hash(tagged: DataFrame) -> DataFrame:
    """``(func, shape)`` from ``tagged(func, pos, tag)``: the tags of a function folded in order, wrapping at 64 bits.

    The multiplier is 2**40 + 435, so a product of 64 bits is put together from
    the halves of its factor without a sum that overflows.
    """
    tags = F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda x: x["tag"].cast("long"))
    half = F.lit(0xFFFFFFFF).cast("long")

    def step(h: Column, tag: Column) -> Column:
        x = h.bitwiseXOR(tag)
        low = x.bitwiseAND(half)
        small = low * (TIMES - (1 << 40))
        high = F.shiftrightunsigned(small, 32) + F.shiftrightunsigned(x, 32) * (TIMES - (1 << 40)) + F.shiftleft(low, 8)
        return F.shiftleft(high, 32).bitwiseOR(small.bitwiseAND(half))

    return tagged.groupBy("func").agg(F.aggregate(tags, F.lit(START).cast("long"), step).alias("shape"))


def match_fingerprints(source: DataFrame, target: DataFrame) -> DataFrame:
    """Pairs of functions of both builds whose fingerprints agree in every part (an extension: no call path)."""
    same = [source[p].eqNullSafe(target[p]) for p in PARTS]
    return source.join(target, same).select(source["func"].alias("source"), target["func"].alias("target"))


def mismatch(pairs: DataFrame) -> DataFrame:
    """Adds ``why``: a line for each part that differs, empty if none does."""
    lines = [F.when(~F.col(f"s_{p}").eqNullSafe(F.col(f"t_{p}")), F.concat(F.lit(f"{p}: "), F.coalesce(F.col(f"s_{p}").cast("string"), F.lit("?")), F.lit(" -> "), F.coalesce(F.col(f"t_{p}").cast("string"), F.lit("?")))) for p in PARTS]
    return pairs.withColumn("why", F.concat_ws("\n", *lines))


def upsert(table: DataFrame, updates: DataFrame, key: str, columns: list[str], overwrite: bool = True) -> DataFrame:
    """The table with the updates' values: where they have one, or only where the table has none."""
    u = updates.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = table.join(u, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_{c}", c) if overwrite else F.coalesce(F.when(F.col(c) != "", F.col(c)), f"_{c}", c))
    return out.select(*table.columns)
