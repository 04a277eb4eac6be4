"""A whole code dump: header, types and a block for each function, a row each, within a budget of bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.notation import hex_upper
from graphloom.operators.render import reference_list
from graphloom.plans.stash import stash

#: Bits of a key that one histogram looks at.
DIGIT = 12


def boundary(rows: DataFrame, key: str, amount: Column, need: int) -> tuple[int, int] | None:
    """The key at which the running sum of ``amount``, by ascending ``key`` (long, not negative), reaches ``need``, and the sum before it.

    None if all amounts together stay below.  Histograms of the key's digits,
    highest first, of which only the bucket at the boundary is opened: an
    aggregation a digit, at most 4,096 rows to the driver, nothing is sorted.
    """
    top = rows.agg(F.max(key)).first()[0]
    if top is None or need <= 0:
        return None
    shift, prefix, before = -(-max(int(top).bit_length(), 1) // DIGIT) * DIGIT, 0, 0
    while shift:
        inside = rows.where(F.shiftright(F.col(key), shift) == prefix) if shift < 63 else rows
        shift -= DIGIT
        sums = inside.groupBy(F.shiftright(F.col(key), shift).alias("d")).agg(F.sum(amount).alias("s")).orderBy("d").collect()
        for r in sums:
            if before + r["s"] >= need:
                prefix = r["d"]
                break
            before += r["s"]
        else:
            return None
    return prefix, before


def within_total(blocks: DataFrame, fixed: int, budget: int) -> DataFrame:
    """``blocks(place, size, seed, ...)`` left after dropping the smallest, earlier ones of equal size first and never seeds, until ``fixed`` and the rest fit ``budget``.

    The size and then the place at which dropping stops are found from histograms.
    """
    whole = fixed + (blocks.agg(F.sum("size")).first()[0] or 0)
    if whole <= budget:
        return blocks
    loose = blocks.where(~F.col("seed"))
    found = boundary(loose, "size", F.col("size"), whole - budget)
    if found is None:
        return blocks.where("seed")
    size, before = found
    equal = -(-(whole - budget - before) // size)
    last, _ = boundary(loose.where(F.col("size") == size), "place", F.lit(1), equal)
    return blocks.where(F.col("seed") | (F.col("size") > size) | ((F.col("size") == size) & (F.col("place") > last)))


def function_blocks(functions: DataFrame, edges: DataFrame, base: int = 0) -> DataFrame:
    """``(id, text)``: the block of each of ``functions(id, name, start, code)`` with its references in and out (``edges(src, dst, types)``).

    Code that is null or empty is said to have failed.
    """
    f = functions
    for of, other in (("dst", "src"), ("src", "dst")):
        refs = reference_list(edges, functions, of, other).select(F.col(of).alias("id"), F.col("refs").alias(f"_{of}"))
        f = f.join(refs, "id", "left")
    named = F.concat(F.col("name"), F.lit(" ("), hex_upper(F.col("start")), F.lit(")"))
    code = F.when(F.coalesce("code", F.lit("")) == "", "// (decompilation failed)\n").when(F.col("code").endswith("\n"), F.col("code")).otherwise(F.concat("code", F.lit("\n")))
    parts = [
        F.lit("// Incoming xrefs for "), named, F.lit(": "), F.coalesce("_dst", F.lit("None")), F.lit("\n// Outgoing xrefs for "), named, F.lit(": "), F.coalesce("_src", F.lit("None")),
        F.lit("\n// --- Function: "), named, F.lit(" ---\n// offset: RVA "), hex_upper(F.col("start") - base), F.lit(" EA "), hex_upper(F.col("start")), F.lit("\n"), code,
        F.lit("// --- End Function: "), named, F.lit(" ---\n\n"),
    ]
    return f.select("id", F.concat(*parts).alias("text"))


def code_dump(spark: SparkSession, blocks: DataFrame, types: DataFrame, seeds: int, budget: int | None = None) -> DataFrame:
    """``(section, place, text)``: header (0), type declarations (1) and blocks (2) of a dump, in this order a whole file.

    ``blocks(place, seed, text)``, ``types(place, text)``.  With a budget, blocks are dropped (``within_total``).  Every piece
    is a row, so a dump of any size is written as sorted partitions (``write_text``), and no row is the file.
    """
    start = "// Start: all functions (no seed resolution)\n" if not seeds else f"// Start functions: {seeds}\n"
    head = spark.createDataFrame([(0, 0, "// Decompiled code\n\n" + start + "\n")], "section int, place long, text string")
    t = types.select(F.lit(1).alias("section"), F.col("place").cast("long").alias("place"), "text")
    b = stash(blocks.select(F.col("place").cast("long").alias("place"), "seed", "text", F.octet_length("text").cast("long").alias("size")), "blocks")
    if budget is not None:
        fixed = head.unionByName(t).agg(F.sum(F.octet_length("text"))).first()[0]
        b = within_total(b, fixed, budget)
    return head.unionByName(t).unionByName(b.select(F.lit(2).alias("section"), "place", "text"))


def write_text(pieces: DataFrame, path: str, *order: str) -> None:
    """The pieces' texts, which end with a line feed, as files that follow each other by name: ranges of the order, sorted within."""
    line = F.substring("text", F.lit(1), F.length("text") - 1)
    pieces.repartitionByRange(*order).sortWithinPartitions(*order).select(line.alias("text")).write.text(path)
