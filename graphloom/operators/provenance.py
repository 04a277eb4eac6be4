"""Where values come from: alias chains, forwarded parameters, shared globals, register liveness, types."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.traverse import layers
from graphloom.plans.stash import stash


def last_aliases(aliases: DataFrame) -> DataFrame:
    """The last definition of each variable: ``(func, var, to, offset)``."""
    w = Window.partitionBy("func", "var").orderBy(F.desc("seq"))
    return aliases.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("func", "var", "to", "offset")


def alias_chains(aliases: DataFrame, depth: int = 10) -> DataFrame:
    """``(func, var, origin, offset, steps, low)``: each variable followed through its last definitions.

    Offsets add up; ``low`` marks a chain that met a variable twice or was cut
    at ``depth`` steps.
    """
    a = stash(last_aliases(aliases), "alias")
    step = a.select("func", F.col("var").alias("origin"), F.col("to").alias("_to"), F.col("offset").alias("_more"))
    c = a.select("func", "var", F.col("to").alias("origin"), "offset", F.lit(1).alias("steps"), F.array("var").alias("path"), F.lit(False).alias("low"))
    done = None
    for k in range(depth):
        cycle = F.array_contains("path", F.col("origin"))
        c = c.withColumn("low", cycle)
        nxt = c.join(step, ["func", "origin"], "left")
        nxt = stash(nxt.withColumn("_go", F.col("_to").isNotNull() & ~F.col("low") & F.lit(k < depth - 1)).withColumn("low", F.col("low") | (F.col("_to").isNotNull() & F.lit(k == depth - 1))), "alias")
        end = nxt.where("not _go").select("func", "var", "origin", "offset", "steps", "low")
        done = end if done is None else done.unionByName(end)
        go = nxt.where("_go")
        c = go.select("func", "var", F.col("_to").alias("origin"), (F.col("offset") + F.col("_more")).alias("offset"), (F.col("steps") + 1).alias("steps"), F.concat("path", F.array("origin")).alias("path"), F.lit(False).alias("low"))
        if not go.take(1):
            break
    return done


def forwarded(calls: DataFrame, params: DataFrame) -> DataFrame:
    """``(func, param, callee, arg)``: arguments that are a parameter of the function that passes them; of two
    parameters of one name the first counts."""
    first = params.groupBy("func", "name").agg(F.min("idx").alias("param"))
    return calls.join(first, ["func", "name"]).select("func", "param", "callee", "arg").distinct()


def forward_chains(forwards: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """``(func, param, depth)``: parameters that a start's value reaches, each at its smallest depth."""
    node = lambda f, p: F.struct(F.col(f).alias("func"), F.col(p).alias("param"))
    e = forwards.select(node("func", "param").alias("src"), node("callee", "arg").alias("dst"))
    return layers(e, starts.select(node("func", "param").alias("node")), depth).select("node.func", "node.param", "depth")


def global_flow(accesses: DataFrame) -> DataFrame:
    """``(writer, name, reader)``: functions that write and read the same global, its first name that is not empty."""
    a = accesses.groupBy("global").agg(F.min_by("name", F.when(F.col("name") != "", F.col("seq"))).alias("name"))
    w = accesses.where("is_write").select("global", F.col("func").alias("writer")).distinct()
    r = accesses.where("not is_write").select("global", F.col("func").alias("reader")).distinct()
    return w.join(r, "global").where("writer <> reader").join(a, "global").select("writer", F.coalesce("name", F.lit("")).alias("name"), "reader").distinct()


def block_use_def(operands: DataFrame) -> DataFrame:
    """``(func, block, reg, used, defined)``: used if the first read is not after the first write (an instruction reads first)."""
    g = operands.groupBy("func", "block", "reg").agg(F.min(F.when(F.col("is_read"), F.col("pos"))).alias("r"), F.min(F.when(F.col("is_written"), F.col("pos"))).alias("w"))
    used = F.col("r").isNotNull() & (F.col("w").isNull() | (F.col("r") <= F.col("w")))
    return g.select("func", "block", "reg", used.alias("used"), F.col("w").isNotNull().alias("defined"))


def live_in(usedef: DataFrame, cfg: DataFrame, entry: DataFrame, rounds: int = 256) -> DataFrame:
    """``(func, reg)`` live at the entry of each function.

    A register is live there if a block that uses it can be reached from the
    entry through blocks that do not define it: a search over (block, register),
    all functions at once.
    """
    regs = usedef.where("used").select("func", "reg").distinct()
    front = stash(entry.select("func", "block").join(regs, "func"), "live")
    seen = front
    e = cfg.select("func", F.col("src").alias("block"), F.col("dst").alias("to")).distinct()
    defined = usedef.where("defined").select("func", "block", "reg")
    for _ in range(rounds):
        go = front.join(defined, ["func", "block", "reg"], "left_anti").join(e, ["func", "block"]).select("func", F.col("to").alias("block"), "reg").distinct()
        front = stash(go.join(seen, ["func", "block", "reg"], "left_anti"), "live")
        if not front.take(1):
            break
        seen = stash(seen.unionByName(front), "live")
    return seen.join(usedef.where("used"), ["func", "block", "reg"]).select("func", "reg").distinct()


def type_closure(deps: DataFrame, refs: DataFrame, depth: int) -> DataFrame:
    """``(ordinal, depth)``: types needed by the referenced ones, down to a depth."""
    return layers(deps, refs.select(F.col("ordinal").alias("node")), depth).withColumnRenamed("node", "ordinal")
