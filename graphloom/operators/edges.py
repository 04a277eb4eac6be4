"""Typed reference edges and the joins that produce them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.order import numbered
from graphloom.plans.stash import stash


def dedup_types(refs: DataFrame) -> DataFrame:
    """``(src, dst, types)``: one edge for each pair, with its distinct reference types in order."""
    return refs.where("src <> dst").groupBy("src", "dst").agg(F.array_sort(F.collect_set("ref")).alias("types"))


def containing(points: DataFrame, functions: DataFrame, at: str = "addr") -> DataFrame:
    """Adds ``func_start`` and ``func_id`` of the function whose [start, end) holds each point; others are dropped.

    Functions are sorted by length into classes, each 16 times as long as the
    one before, and cut into blocks of their class' length, of which a function
    meets two at most.  So the range join becomes an equality join on class and
    block, and one huge function does not put all points into one block: a point
    is looked up once in each class that there is, 16 at most.
    """
    f = functions.where("end > start").select(F.col("start").alias("func_start"), F.col("end").alias("_end"), F.col("id").alias("func_id"))
    bits = F.length(F.bin(F.col("_end") - F.col("func_start") - 1))
    f = f.withColumn("_class", F.ceil(bits / 4).cast("int"))
    found = sorted(r["_class"] for r in f.select("_class").distinct().collect())
    block = lambda c, k: F.shiftright(c.cast("long"), 4 * k)
    pick = lambda c: F.element_at(F.create_map(*[x for k in found or [1] for x in (F.lit(k), block(c, k))]), F.col("_class"))
    f = f.withColumn("_block", F.explode(F.array_distinct(F.array(pick(F.col("func_start")), pick(F.col("_end") - 1)))))
    places = F.array(*[F.struct(F.lit(k).alias("_class"), block(F.col(at), k).alias("_block")) for k in found or [1]])
    p = points.withColumn("_place", F.explode(places)).withColumns({"_class": F.col("_place._class"), "_block": F.col("_place._block")})
    inside = (F.col("func_start") <= F.col(at)) & (F.col(at) < F.col("_end"))
    return p.join(f, ["_class", "_block"]).where(inside).drop("_class", "_block", "_place", "_end")


def last_definition(rows: DataFrame, key: str, order: list[str], is_use: Column, is_definition: Column, value: Column, back: int = 20) -> DataFrame:
    """For each use the value of the nearest definition among the ``back`` rows before it (null if none)."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-back, -1)
    found = F.last(F.when(is_definition, value), ignorenulls=True).over(w)
    return rows.withColumn("found", found).where(is_use)


def followed_by(rows: DataFrame, key: str, order: list[str], what: str, first: str, second: str) -> DataFrame:
    """Rows of kind ``first`` that a row of kind ``second`` follows at once."""
    nxt = F.lead(what).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_next", nxt).where((F.col(what) == first) & (F.col("_next") == second)).drop("_next")


def virtual_dispatch(calls: DataFrame, slots: DataFrame) -> DataFrame:
    """``(src, dst)``: a call through an offset may reach each function at that offset of any table."""
    calls = calls.select("src", "offset").distinct()
    return calls.join(slots.select("offset", F.col("func").alias("dst")).distinct(), "offset").where("src <> dst").select("src", "dst").distinct()


#: Functions in a row of ``dispatched``, and into how many shares the calls through an offset are dealt.
TOGETHER, SHARES = 4096, 32


def dispatched(refs: DataFrame, calls: DataFrame, slots: DataFrame, ref: int) -> DataFrame:
    """``(src, dst, types)``: ``dedup_types`` of ``refs(src, dst, ref)`` and of ``virtual_dispatch(calls, slots)`` as type ``ref``.

    Pairs of virtual dispatch are as many as calls times functions at their
    offset, so they are made last, out of lists of functions, and never shuffled:
    a pair that ``refs`` has too gets its type there and is taken off the list, one that
    meets at several offsets counts at the smallest.
    """
    calls = stash(calls.select("src", "offset").where("src is not null and offset is not null").distinct(), "calls")
    at = slots.select("offset", F.col("func").alias("dst")).where("dst is not null and offset is not null").distinct()
    at = stash(at.join(at.groupBy("dst").agg(F.collect_list("offset").alias("offsets")), "dst"), "slots")
    known = stash(dedup_types(refs), "known")
    hits = stash(known.select("src", "dst").join(calls, "src").join(at.select("offset", "dst"), ["offset", "dst"]).select("src", "offset", "dst"), "hits")
    both = F.array_sort(F.array_union("types", F.array(F.lit(ref).cast("long"))))
    typed = known.join(hits.select("src", "dst").distinct().withColumn("_hit", F.lit(True)), ["src", "dst"], "left").select("src", "dst", F.when(F.col("_hit"), both).otherwise(F.col("types")).alias("types"))
    # lists of functions with one offset only, and functions with several
    one = at.where("size(offsets) = 1")
    lists = F.pmod(F.xxhash64("dst"), F.ceil(F.col("_n") / TOGETHER))
    one = one.join(one.groupBy("offset").agg(F.count("*").alias("_n")), "offset").groupBy("offset", lists.alias("_list")).agg(F.collect_list("dst").alias("dsts"))
    several = at.where("size(offsets) > 1").select("offset", F.array("dst").alias("dsts"), "offsets")
    every = one.select("offset", "dsts", F.lit(None).cast(at.schema["offsets"].dataType).alias("offsets")).unionByName(several)
    every = stash(every, "lists").withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    own = calls.join(calls.groupBy("src").agg(F.collect_list("offset").alias("mine")), "src").join(hits.groupBy("src", "offset").agg(F.collect_list("dst").alias("gone")), ["src", "offset"], "left")
    own = stash(own, "own").withColumn("_share", F.pmod(F.xxhash64("src"), F.lit(SHARES)).cast("int"))
    pairs = own.join(every, ["offset", "_share"]).where(F.col("offsets").isNull() | (F.col("offset") == F.array_min(F.array_intersect("offsets", "mine"))))
    left = F.when(F.col("gone").isNull(), F.col("dsts")).otherwise(F.array_except("dsts", "gone"))
    pairs = pairs.select("src", F.explode(left).alias("dst")).where("src <> dst")
    return typed.unionByName(pairs.select("src", "dst", F.array(F.lit(ref).cast("long")).alias("types")))


def table_runs(slots: DataFrame, step: int = 8, least: int = 3) -> DataFrame:
    """Runs of ``least`` or more consecutive slots: ``(table_start, offset, func)``; of a slot's functions the smallest counts.

    ``slots(region, slot, func)``.  Consecutive slots keep the difference between
    address and place in the order of all slots, so a run is a group of equal
    differences, wherever it lies; no task sees a region as a whole.
    """
    s = numbered(slots.groupBy("region", "slot").agg(F.min("func").alias("func")), "region", "slot")
    s = s.withColumn("_island", F.col("slot") - F.col("idx") * step)
    runs = s.groupBy("region", "_island").agg(F.count("*").alias("_n"), F.min("slot").alias("table_start")).where(F.col("_n") >= least)
    return s.join(runs, ["region", "_island"]).select("region", "table_start", (F.col("slot") - F.col("table_start")).alias("offset"), "func")


def until_bad(entries: DataFrame, key: str, order: str, bad: Column, most: int = 20) -> DataFrame:
    """The first ``most`` entries of each table before the first bad one."""
    w = Window.partitionBy(key).orderBy(order)
    first_bad = F.min(F.when(bad, F.col(order))).over(Window.partitionBy(key))
    e = entries.withColumn("_n", F.row_number().over(w)).withColumn("_bad", first_bad)
    return e.where((F.col("_n") <= most) & (F.col("_bad").isNull() | (F.col(order) < F.col("_bad")))).drop("_n", "_bad")
