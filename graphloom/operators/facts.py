"""Facts about values: arguments, aliases, global accesses, and the annotations that are made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def argument_uses(calls: DataFrame) -> DataFrame:
    """``(func, addr, callee, arg, origin)``: one fact for each argument; calls without a callee (helpers) have none."""
    return calls.where("callee is not null and origin is not null").select("func", "addr", "callee", "arg", "origin").distinct()


def aliases(assignments: DataFrame) -> DataFrame:
    """``(func, addr, var, origin, conf)``: assignments to a variable; the value of a call is its return, others need a known origin.

    ``assignments(func, addr, var, is_call, callee, origin, conf)``.
    """
    a = assignments.where("var is not null and (is_call or origin is not null)")
    origin = F.when(F.col("is_call"), F.concat(F.lit("R"), F.coalesce(F.col("callee").cast("string"), F.lit("?")))).otherwise(F.col("origin"))
    return a.select("func", "addr", "var", origin.alias("origin"), F.when(F.col("is_call"), "high").otherwise(F.col("conf")).alias("conf")).distinct()


def global_accesses(objects: DataFrame, functions: DataFrame) -> DataFrame:
    """``(func, obj, access)``: an object on the left of an assignment is written; others are read unless they are functions."""
    writes = objects.where("is_left").select("func", "obj", F.lit("write").alias("access"))
    reads = objects.where("not is_left").join(functions.select(F.col("start").alias("obj")), "obj", "left_anti")
    return writes.unionByName(reads.select("func", "obj", F.lit("read").alias("access"))).distinct()


def incoming(uses: DataFrame, conf: str = "med") -> DataFrame:
    """``(callee, arg, origins)``: what callers pass as each argument: ``F<caller>:<origin>/<conf>``, distinct and in order."""
    said = F.concat(F.lit("F"), F.col("func").cast("string"), F.lit(":"), F.col("origin"), F.lit("/"), F.lit(conf))
    return uses.groupBy("callee", "arg").agg(F.array_join(F.array_sort(F.collect_set(said)), " ").alias("origins"))


def annotations(definitions: DataFrame, alias: DataFrame, uses: DataFrame, into: DataFrame, accesses: DataFrame) -> DataFrame:
    """``(func, text)``: a function's lines: its definition, aliases, calls out, values in, global accesses; each kind in order."""
    line = lambda df, func, kind, text: df.select(F.col(func).alias("func"), F.lit(kind).alias("kind"), text.alias("line"))
    c = lambda name: F.col(name).cast("string")
    all_of = line(definitions, "func", 0, F.concat(F.lit("D "), F.col("name")))
    all_of = all_of.unionByName(line(alias, "func", 1, F.concat(F.lit("A v"), c("var"), F.lit("="), F.col("origin"), F.lit("/"), F.col("conf"))))
    all_of = all_of.unionByName(line(into, "callee", 2, F.concat(F.lit("I "), c("arg"), F.lit(" "), F.col("origins"))))
    all_of = all_of.unionByName(line(uses, "func", 3, F.concat(F.lit("E F"), c("callee"), F.lit(":"), c("arg"), F.lit("="), F.col("origin"))))
    all_of = all_of.unionByName(line(accesses, "func", 4, F.concat(F.lit("G "), F.col("access"), F.lit(" "), c("obj"))))
    lines = F.array_sort(F.collect_set(F.struct("kind", "line")))
    text = all_of.join(definitions.select("func"), "func", "left_semi").groupBy("func").agg(lines.alias("l"))
    return text.select("func", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def hints(uses: DataFrame, alias: DataFrame) -> DataFrame:
    """``(func, addr, hint)``: the facts of each instruction on one line."""
    c = lambda name: F.col(name).cast("string")
    one = uses.select("func", "addr", F.concat(F.lit("F"), c("callee"), F.lit(":"), c("arg"), F.lit("="), F.col("origin")).alias("h"))
    two = alias.select("func", "addr", F.concat(F.lit("v"), c("var"), F.lit("="), F.col("origin")).alias("h"))
    return one.unionByName(two).groupBy("func", "addr").agg(F.array_join(F.array_sort(F.collect_set("h")), "; ").alias("hint"))


def touching(flows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Flows ``(writer, reader, ...)`` of which at least one end is wanted."""
    w = wanted.select(F.col("node"), F.lit(True).alias("_is"))
    f = flows.join(w.select(F.col("node").alias("writer"), F.col("_is").alias("_w")), "writer", "left").join(w.select(F.col("node").alias("reader"), F.col("_is").alias("_r")), "reader", "left")
    return f.where("_w or _r").select(*flows.columns)


def import_or_global(xrefs: DataFrame, imports: DataFrame, names: DataFrame) -> DataFrame:
    """``(src, target, name, is_import)``: an import's symbol wins over a global's name."""
    x = xrefs.join(imports.select("target", F.col("symbol")), "target", "left").join(names.select("target", F.col("name").alias("_n")), "target", "left")
    return x.where("symbol is not null or _n is not null").select("src", "target", F.coalesce("symbol", "_n").alias("name"), F.col("symbol").isNotNull().alias("is_import"))


def string_tokens(probes: DataFrame, most: int = 48, tokens: int = 8, long: int = 160) -> DataFrame:
    """``(func, token, w)`` of ``probes(func, seq, text)``: a function's first ``most`` different strings, the first ``tokens``
    words of each, half as much for strings over ``long`` characters."""
    first = probes.groupBy("func", "text").agg(F.min("seq").alias("seq"))
    place = F.row_number().over(Window.partitionBy("func").orderBy("seq", "text"))
    s = first.withColumn("_k", place).where(F.col("_k") <= most)
    words = F.slice(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda t: F.length(t) >= 3), 1, tokens)
    return s.select("func", F.explode(words).alias("token"), F.when(F.length("text") > long, 0.5).otherwise(1.0).alias("w"))


def evidence(*parts: DataFrame) -> DataFrame:
    """``(func, token, w)``: weights of all sources of tokens added up."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("func", "token").agg(F.sum("w").alias("w"))


def most_voted(votes: DataFrame, group: str, what: str) -> DataFrame:
    """The value that most rows of a group have, ties to the smaller one; with its count."""
    n = votes.groupBy(group, what).agg(F.count("*").alias("votes"))
    best = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("votes"), what))
    return n.withColumn("_k", best).where("_k = 1").drop("_k")


def first_by_name(types: DataFrame) -> DataFrame:
    """Of types of one name the first one (by ``ordinal``)."""
    return types.groupBy("name").agg(F.min(F.struct("ordinal", "decl")).alias("t")).select("name", "t.ordinal", "t.decl")


def table_report(runs: DataFrame) -> tuple[DataFrame, Column]:
    """``(region, table_start, entries)`` of ``table_runs``: each table's slots by offset; and a count of tables."""
    entry = F.concat(F.lit("+"), F.col("offset").cast("string"), F.lit(":"), F.col("func").cast("string"))
    at = F.transform(F.array_sort(F.collect_list(F.struct("offset", entry.alias("e")))), lambda x: x["e"])
    return runs.groupBy("region", "table_start").agg(F.array_join(at, " ").alias("entries")), F.count_if(F.col("offset") == 0)


def saved_locals(rows: DataFrame) -> DataFrame:
    """Local settings that say something: a name or a type."""
    return rows.where("coalesce(name, '') <> '' or coalesce(type, '') <> ''")


def locals_of(variables: DataFrame) -> DataFrame:
    """``(func, params, locals)``: names of parameters and of other variables, by index."""
    named = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("idx", "name")))), lambda x: x["name"]), ",")
    return variables.groupBy("func").agg(named(F.col("is_arg")).alias("params"), named(~F.col("is_arg")).alias("locals"))


def applicable_comments(comments: DataFrame, functions: DataFrame) -> DataFrame:
    """Comments of a function at addresses before its end."""
    f = functions.select(F.col("id").alias("func"), "end")
    return comments.join(f, "func").where("addr < end").drop("end")


def apply_counts(matches: DataFrame) -> DataFrame:
    """Counters of an application: ``matches(found, same, has_type, overwrite)``; types are set in the first phase, the rest only where verified."""
    c = F.count_if
    return matches.agg(c("found").alias("found"), c(F.col("found") & F.col("same")).alias("verified"), c(F.col("found") & ~F.col("same")).alias("mismatched"), c(~F.col("found")).alias("missing"),
                       c("has_type").alias("types"), c(F.col("found") & F.col("same") & F.col("overwrite")).alias("applied"))


def final_ids(members: DataFrame) -> DataFrame:
    """``(node, id)``: clusters numbered by their first node, utilities after the others, orphans (no cluster) -1."""
    first = members.where("cluster is not null").groupBy("cluster").agg(F.min("node").alias("first"), F.bool_and("utility").alias("utility"))
    number = first.select("cluster", (F.row_number().over(Window.orderBy("utility", "first")) - 1).cast("long").alias("id"))  # one row a cluster
    return members.join(number, "cluster", "left").select("node", F.coalesce("id", F.lit(-1).cast("long")).alias("id"))


def readable(functions: DataFrame) -> DataFrame:
    """``(id, shown)``: the short demangled name, or the raw one where there is none."""
    return functions.select("id", F.coalesce(F.expr("nullif(demangled, '')"), F.col("name")).alias("shown"))


def referenced_types(refs: DataFrame) -> DataFrame:
    """``(func, ordinals, offsets)``: the types a function refers to and the offsets it touches in each."""
    per_type = refs.groupBy("func", "ordinal").agg(F.array_sort(F.collect_set("offset")).alias("o"))
    said = F.concat(F.col("ordinal").cast("string"), F.lit("@"), F.array_join("o", "/"))
    whole = F.array_sort(F.collect_list(F.struct("ordinal", said.alias("s"))))
    out = per_type.groupBy("func").agg(whole.alias("w"))
    return out.select("func", F.array_join(F.transform("w", lambda x: x["ordinal"]), ",").alias("ordinals"), F.array_join(F.transform("w", lambda x: x["s"]), " ").alias("offsets"))
