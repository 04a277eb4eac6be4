"""Start functions from what a user names, and anchors of a ranking from these, entry points and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.names import is_entry_like
from graphloom.operators.edges import containing

_WHITE = "[ \\t\\r\\n]"


def address_of(spec: Column) -> Column:
    """The address that a spec spells: hexadecimal digits, with 0x before them or not; null for others and for more than 64 bits.

    A name made of hexadecimal digits alone is an address too, whatever is called so.
    """
    digits = F.regexp_extract(spec, "^(?:0[xX](?=.))?0*([0-9A-Fa-f]*)$", 1)
    spelt = spec.rlike("^(?:0[xX])?[0-9A-Fa-f]+$")
    return F.when(spelt & (F.length(digits) <= 16), F.conv(F.when(digits == "", "0").otherwise(digits), 16, -10).cast("long"))


def specs(requests: DataFrame) -> DataFrame:
    """``(request, pos, spec)`` of ``requests(request, text)``: what stands between commas and bars, without white space around it; none where nothing is left."""
    each = requests.select("request", F.posexplode(F.split("text", "[,|]")).alias("pos", "spec"))
    return each.withColumn("spec", F.regexp_replace("spec", f"^{_WHITE}+|{_WHITE}+$", "")).where("spec <> ''")


def resolved(wanted: DataFrame, functions: DataFrame, names: DataFrame) -> DataFrame:
    """``(request, pos, spec, address, func)`` of ``specs``' rows, every one of them.

    An address is spelt or looked up in ``names(name, address)``, the smallest where a name has several;
    ``func`` is the function of ``functions(id, start, end)`` around it, null where there is none.
    """
    spelt = wanted.withColumn("spelt", F.col("spec").rlike("^(?:0[xX])?[0-9A-Fa-f]+$")).withColumn("given", address_of(F.col("spec")))
    called = names.where("name is not null").groupBy(F.col("name").alias("spec")).agg(F.min("address").alias("known"))
    # a spelt address is not looked up, so it need not meet the names
    found = spelt.where("not spelt").join(called, "spec", "left").select("request", "pos", "spec", F.col("known").alias("address"))
    found = found.unionByName(spelt.where("spelt").select("request", "pos", "spec", F.col("given").alias("address")))
    points = found.where("address is not null").select("address").distinct()
    # functions do not overlap; of those that do the one that begins last counts
    holds = containing(points, functions, "address").groupBy("address").agg(F.max_by("func_id", F.struct("func_start", "func_id")).alias("func"))
    return found.join(holds, "address", "left").select("request", "pos", "spec", "address", "func")


def anchors(functions: DataFrame, seeds: DataFrame, entries: DataFrame) -> DataFrame:
    """``(node, seed, entry, named)``: functions that are ``seeds(node)``, hold one of ``entries(address)`` or are called like an entry."""
    f = functions.select("id", "start", "end", "name")
    known = seeds.select(F.col("node").alias("id")).distinct().join(f.select("id"), "id", "left_semi")
    at = containing(entries.where("address is not null").select("address").distinct(), f, "address").select(F.col("func_id").alias("id"))
    named = f.where(is_entry_like(F.col("name"))).select("id")
    kinds = [(known, "seed"), (at, "entry"), (named, "named")]
    rows = [df.select("id", *[F.lit(k == kind).alias(k) for _, k in kinds]) for df, kind in kinds]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy(F.col("id").alias("node")).agg(*[F.bool_or(k).alias(k) for _, k in kinds])
