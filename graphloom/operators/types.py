"""Types trimmed to what is accessed: members that hold an accessed offset stay, through nested types, and gaps are padded."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.edges import containing
from graphloom.plans.stash import stash

#: Types stand this far apart when offsets of all types are looked up at once; no type is larger.
ROOM = 1 << 36


def accessed_members(members: DataFrame, accesses: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``(type, off)`` of the members that hold an accessed offset, with what nested members pass on to their types.

    ``members(type, off, size, nested)``: members of a type do not overlap;
    ``nested`` is the type of a member that is a structure itself.  ``type`` is a number
    below 2**26.  Each round looks up the new offsets of all types in one range
    join and carries those inside nested members into their types, until no
    offset is new.
    """
    m = stash(members.select((F.col("type") * ROOM + F.col("off")).alias("start"), (F.col("type") * ROOM + F.col("off") + F.col("size")).alias("end"), F.struct("type", "off", "nested").alias("id")), "members")
    new = stash(accesses.select("type", "off").distinct(), "accesses")
    seen, kept = new, None
    for _ in range(max_rounds):
        points = new.select((F.col("type") * ROOM + F.col("off")).alias("addr"), F.col("off").alias("at"))
        hit = stash(containing(points, m).select("at", "func_id.type", "func_id.off", "func_id.nested"), "hit")
        found = hit.select("type", "off").distinct()
        kept = found if kept is None else kept.unionByName(found)
        inner = hit.where("nested is not null").select(F.col("nested").alias("type"), (F.col("at") - F.col("off")).alias("off")).distinct()
        new = stash(inner.join(seen, ["type", "off"], "left_anti"), "accesses")
        if not new.take(1):
            return kept.distinct()
        seen = seen.unionByName(new)
    raise RuntimeError(f"accesses did not settle in {max_rounds} rounds")


def trimmed(members: DataFrame, accesses: DataFrame) -> DataFrame:
    """``(type, off, size, name)``: accessed members of each accessed type, and padding (name null) for all between, before and after them."""
    kept = members.join(accessed_members(members, accesses), ["type", "off"]).select("type", "off", "size", "name")
    whole = members.groupBy("type").agg(F.max(F.col("off") + F.col("size")).alias("_end"))
    order = Window.partitionBy("type").orderBy("off")
    k = kept.join(whole, "type").withColumns({"_before": F.coalesce(F.lag(F.col("off") + F.col("size")).over(order), F.lit(0)), "_last": F.lead("off").over(order).isNull()})
    pad = F.struct(F.col("_before").alias("off"), (F.col("off") - F.col("_before")).alias("size"), F.lit(None).cast("string").alias("name"))
    rest = F.struct((F.col("off") + F.col("size")).alias("off"), F.when(F.col("_last"), F.col("_end") - F.col("off") - F.col("size")).otherwise(0).alias("size"), F.lit(None).cast("string").alias("name"))
    rows = F.filter(F.array(pad, F.struct("off", "size", "name"), rest), lambda x: x["size"] > 0)
    return k.select("type", F.explode(rows).alias("r")).select("type", "r.*")
