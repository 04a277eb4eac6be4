"""Carrying a program's annotations to another build: export in order of discovery, and application in phases."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import annotations
from graphloom.operators.order import numbered
from graphloom.operators.transfer import PARTS
from graphloom.plans.stash import resumed, stash


def discovered(calls: DataFrame, root: DataFrame, depth: int) -> DataFrame:
    """``(node, id, depth)``: the functions within ``depth`` calls of ``root(node)``, numbered from 1 in order of discovery.

    ``calls(src, at, dst)``: direct calls of functions' starts, ``at`` the address
    of the call.  Layer by layer callers are opened in order of their numbers and
    their calls by address; of several calls the first counts.  Functions that
    those of the last layer call are no part of the export but have numbers too,
    after all others and without a depth, by the address of the first call.

    A layer's order is (caller's number, address), sorted in ranges; the driver
    sees only how many there are.
    """
    first = stash(calls.groupBy("src", "dst").agg(F.min("at").alias("at")), "calls")
    last = stash(root.select("node", F.lit(1).cast("long").alias("id"), F.lit(0).alias("depth")).distinct(), "discovered")
    done, numbers = last, last.count()
    for d in range(1, depth + 1):
        ways = first.join(last.select(F.col("node").alias("src"), "id"), "src").groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("id", "at")).alias("way"))
        new = numbered(ways.join(done.select("node"), "node", "left_anti"), "way", "node", name="place")
        last = stash(new.select("node", (F.col("place") + numbers + 1).alias("id"), F.lit(d).alias("depth")), "discovered")
        found = last.count()
        if not found:
            break
        numbers += found
        done = done.unionByName(last)
    known = done.select("node")
    outside = first.join(known.withColumnRenamed("node", "src"), "src", "left_semi").groupBy(F.col("dst").alias("node")).agg(F.min("at").alias("at")).join(known, "node", "left_anti")
    others = numbered(outside, "at", "node", name="place").select("node", (F.col("place") + numbers + 1).alias("id"), F.lit(None).cast("int").alias("depth"))
    return done.unionByName(others)


def called(calls: DataFrame, numbers: DataFrame) -> DataFrame:
    """``(id, at, callee)``: every call of an exported function, both ends by number."""
    inside = numbers.where("depth is not null").select(F.col("node").alias("src"), "id")
    return calls.join(inside, "src").join(numbers.select(F.col("node").alias("dst"), F.col("id").alias("callee")), "dst").select("id", "at", "callee")


def changes(rows: DataFrame, facts: DataFrame, mapping: DataFrame, ends: DataFrame, names: bool = True) -> DataFrame:
    """``(id, target, what, rva, key, value)``: what is set at the verified functions of ``mapping(id, target, verified)``.

    ``rows`` and ``facts``: ``annotations.read`` and ``function_facts`` of one file;
    ``ends(target, end)`` the other build's functions.  Names (unless ``names`` is
    false), prototypes (closed by a semicolon) and comments of functions are set where
    the file has them, comments at addresses where they lie before the function's
    end, variables where they have a name or a type.  ``key`` tells repeatable comments
    and places of variables; a variable without a place or definition has no ``rva``.
    """
    c = F.col
    ok = mapping.where("verified").select("id", "target")
    own = facts.withColumnRenamed("func", "id").join(ok, "id")
    said = lambda x: F.when(c(x) != "", c(x))
    closed = F.when(c("proto").endswith(";"), c("proto")).otherwise(F.concat("proto", F.lit(";")))
    one = lambda what, key, value: F.struct(F.lit(what).alias("what"), F.lit(key).alias("key"), value.alias("value"))
    heads = F.array(*([one("name", "", said("name"))] if names else []), one("prototype", "", F.when(c("proto") != "", closed)), one("function comment", "", said("comment")), one("function comment", "repeatable", said("repeatable")))
    whole = own.select("id", "target", F.explode(F.filter(heads, lambda x: x["value"].isNotNull())).alias("x")).select("id", "target", "x.what", F.lit(None).cast("long").alias("rva"), "x.key", "x.value")
    lines = rows.where("error is null and directive in ('cmt', 'lvar')").withColumnRenamed("func", "id").join(ok, "id")
    number, text = lambda i: F.get("numbers", F.lit(i)), lambda i: F.get("texts", F.lit(i))
    comments = lines.where("directive = 'cmt'").join(ends, "target").where(c("target") + number(0) < c("end"))
    comments = comments.select("id", "target", F.lit("comment").alias("what"), number(0).alias("rva"), F.when(number(1) == 1, "repeatable").otherwise("").alias("key"), text(0).alias("value"))
    nowhere = (text(0) == "none") & (number(1) == 0)
    variables = lines.where("directive = 'lvar'").where((text(1) != "") | (text(2) != "")).select(
        "id", "target", F.lit("variable").alias("what"), F.when(~nowhere, number(1)).alias("rva"), F.concat(text(0), F.lit(" "), number(0)).alias("key"), F.concat_ws(" ", F.when(text(2) != "", text(2)), F.when(text(1) != "", text(1))).alias("value")
    )
    return whole.unionByName(comments).unionByName(variables)


def applied(texts: DataFrame, target: DataFrame, sites: DataFrame, root: Column, names: bool = True, go_on: bool = True, run: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(mapping, types, changes)`` of one annotation file ``texts(file, text)`` on another build, in three phases.

    ``target(target, end, size, insns, blocks, shape)``: the other build's functions
    by their starts, ``sites(target, rva, to)`` its direct calls, ``root`` the start of
    the function that the file's root stands for.  First functions are found by
    replaying the recorded calls and verified, then types are taken, as functions
    refer to them, then the rest is set where verified.

    Each phase is a table of the run (``stash.resumed``): an application that was cut
    off goes on after its last finished phase when it is called with its name again.
    A file without functions gives empty tables.
    """
    spark = texts.sparkSession
    run = run or f"apply-{uuid.uuid4().hex}"
    rows = resumed(spark, run, "rows", lambda: annotations.read(texts))
    facts = resumed(spark, run, "functions", lambda: annotations.function_facts(rows))
    top = rows.where("directive = 'root_ea' and error is null").agg(F.max(F.get("numbers", F.lit(0))).alias("top"))
    starts = rows.where("directive = 'func' and error is null").groupBy("func").agg(F.min("line_no").alias("line"))
    # the function at the root's address, or the first of the file; one row
    head = facts.join(starts, "func").crossJoin(F.broadcast(top)).agg(F.min_by("func", F.struct((F.coalesce("ea", F.lit(-1)) != F.coalesce("top", F.lit(-2))).alias("other"), "line")).alias("id")).where("id is not null")
    callees = rows.where("directive = 'callee' and error is null").select(F.col("func").alias("id"), F.col("line_no").alias("pos"), F.get("numbers", F.lit(0)).alias("rva"), F.get("numbers", F.lit(1)).alias("callee"))
    source = facts.select(F.col("func").alias("id"), *PARTS)
    mapping = resumed(spark, run, "verify", lambda: annotations.replay(source, callees, target, sites, head.select("id", root.cast("long").alias("target")), go_on))
    types = resumed(spark, run, "types", lambda: rows.where("directive = 'type' and error is null").select(F.get("numbers", F.lit(0)).alias("id"), F.get("texts", F.lit(0)).alias("name"), F.get("texts", F.lit(1)).alias("decl")))
    return mapping, types, resumed(spark, run, "apply", lambda: changes(rows, facts, mapping, target.select("target", "end"), names))


def report(facts: int, mapping: DataFrame, types: DataFrame, made: DataFrame) -> DataFrame:
    """``(phase, what, n)``: counters of an application; ``facts`` is how many functions the file has."""
    n = F.count("*").alias("n")
    verify = mapping.groupBy(F.when(F.col("verified"), "matched").otherwise("mismatched").alias("what")).agg(n).union(mapping.agg(F.lit("not found").alias("what"), (F.lit(facts) - F.count("*")).alias("n")))
    out = verify.select(F.lit("verify").alias("phase"), "what", "n").union(types.agg(F.lit("types").alias("phase"), F.lit("type").alias("what"), n))
    return out.union(made.groupBy("what").agg(n).select(F.lit("apply"), "what", "n"))
