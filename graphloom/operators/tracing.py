"""The whole program's facts on values as one text, a row a line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.notation import argument_node, function_node, hex_upper, node_of
from graphloom.operators.order import numbered
from graphloom.plans.stash import stash

#: Fixed value: the first line.
HEADER = "#PTN v1"


def program_text(functions: DataFrame, params: DataFrame, aliases: DataFrame, uses: DataFrame, accesses: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``(section, a, b, c, d, text)``: the text's parts; sorted by the five columns and put together they are the file.

    ``functions(id, start, name)``, ``params(func, idx, name)``, ``aliases(func,
    seq, kind, var, origin, name, offset)``, ``uses(func, seq, at, callee, arg,
    origin, name, offset, mode, member, conf)`` with ``callee`` a start,
    ``accesses(func, seq, obj, name, is_write)``; ``wanted(id)`` the functions that
    are told (all if not given).

    Functions are numbered by address, ``F?`` where there is none.  Sections: header
    line, dictionary (an entry a row, so no row grows with the program), definition
    and aliases of each function, values in by parameter, arguments out, and globals
    from each writer to each reader, of which one at least is wanted.  Of equal lines
    the first stays; empty names of functions are left out.
    """
    c, text = F.col, lambda x: x.cast("string")
    none = F.lit(0).cast("long")
    f = stash(numbered(functions.select("id", "start", "name"), "start").select("id", "start", F.coalesce("name", F.lit("")).alias("fname"), F.concat(F.lit("F"), c("idx") + 1).alias("fid"), c("idx").alias("place")), "functions")
    told = f if wanted is None else f.join(wanted.select("id").distinct(), "id", "left_semi")
    of = lambda rows, with_: rows.withColumnRenamed("func", "id").join(with_, "id")
    entry = F.concat(c("fid"), F.lit("="), hex_upper(c("start")))

    def lines(rows: DataFrame, section: int, a: Column, b: Column, d: Column, e: Column, line: Column) -> DataFrame:
        return rows.select(F.struct(F.lit(section).alias("section"), a.cast("long").alias("a"), b.cast("long").alias("b"), d.cast("long").alias("c"), e.cast("long").alias("d")).alias("at"), line.alias("line"))

    first = told.agg(F.min("place").alias("first"), F.max("place").alias("last"))  # one row
    alone = (c("first") == c("last")) & (c("fname") != "")  # its definition is the dictionary's line
    defined = lines(told.crossJoin(F.broadcast(first)).where(~alone), 2, c("place"), F.lit(-1), none, none, F.concat(F.lit("D:"), entry, F.lit(","), "fname"))
    empty = F.lit("")
    value = node_of(c("origin"), c("fid"), c("name"), c("offset"), empty, empty, F.lit(" {conf=med}"))
    known = lines(of(aliases, told), 2, c("place"), c("seq"), none, none, F.concat(F.lit("A:"), F.when(c("kind") == "L", "L(").otherwise("P("), F.coalesce("var", empty), F.lit("):="), value))

    site = F.when(c("at") != 0, F.concat(F.lit(",cs="), hex_upper(c("at")))).otherwise("")
    u = of(uses.where("callee is not null"), f)
    to = f.select(c("id").alias("to"), c("start").alias("callee"), c("fid").alias("to_fid"), c("fname").alias("to_name"), c("place").alias("to_place"))
    names = params.groupBy(c("func").alias("to"), c("idx").alias("arg")).agg(F.min("name").alias("pname"))
    inside = to.join(told.select(c("id").alias("to")), "to", "left_semi")
    into = u.join(inside, "callee").join(names, ["to", "arg"], "left")
    source = node_of(c("origin"), c("fid"), c("name"), c("offset"), c("mode"), empty, F.concat(F.lit(" {caller="), "fid", F.lit(",conf=med"), site, F.lit("}")))
    param = node_of(F.lit("P"), F.concat("to_fid", F.lit(","), text(c("arg"))), c("pname"), F.lit(0), empty, empty, empty)
    # a parameter without a name is told by its own index
    param = F.when(F.coalesce("pname", empty) != "", param).otherwise(F.concat(F.lit("P("), "to_fid", F.lit(","), text(c("arg")), F.lit(")")))
    incoming = lines(into, 3, c("to_place"), c("arg"), c("place"), c("seq"), F.concat(F.lit("I:"), source, F.lit(" -> "), param))
    out = of(uses.where("callee is not null"), told).join(to, "callee", "left")
    sent = node_of(c("origin"), c("fid"), c("name"), c("offset"), c("mode"), c("member"), F.concat(F.lit(" {conf="), "conf", site, F.lit("}")))
    callee = F.when(F.coalesce("to_name", empty) != "", c("to_name")).otherwise(F.coalesce("to_fid", F.lit("F?")))
    outgoing = lines(out, 4, c("place"), c("seq"), none, none, F.concat(F.lit("E:"), sent, F.lit(" -> "), argument_node(callee, c("arg"))))

    mark = f.join(told.select("id", F.lit(True).alias("told")), "id", "left")
    g = of(accesses.select("func", "obj", "is_write").distinct(), mark)
    end = lambda side: g.where("is_write" if side == "w" else "not is_write").select("obj", function_node(c("fid"), c("fname")).alias(side), c("place").alias(f"{side}_place"), c("told").alias(f"{side}_told"))
    title = of(accesses, f).groupBy("obj").agg(F.min_by("name", F.when(c("name") != "", F.struct("place", "seq"))).alias("gname"))
    through = F.concat(F.lit("G("), F.coalesce("gname", hex_upper(c("obj"))), F.lit(")"))
    shared = end("w").join(end("r"), "obj").where("w_told or r_told").join(title, "obj")
    globals_ = lines(shared, 5, c("obj"), c("w_place"), c("r_place"), none, F.concat(F.lit("G:"), "w", F.lit(" -> "), through, F.lit(" -> "), "r"))

    once = reduce(DataFrame.unionByName, (defined, known, incoming, outgoing, globals_)).groupBy("line").agg(F.min("at").alias("at"))
    once = once.select("at.*", F.concat("line", F.lit("\n")).alias("text"))
    piece = F.concat(F.when(c("place") == c("first"), "D:").otherwise(";"), entry, F.when(c("fname") != "", F.concat(F.lit(","), "fname")).otherwise(""), F.when(c("place") == c("last"), "\n").otherwise(""))
    dictionary = told.crossJoin(F.broadcast(first)).select(F.lit(1).alias("section"), c("place").alias("a"), none.alias("b"), none.alias("c"), none.alias("d"), piece.alias("text"))
    # without functions the dictionary is empty
    head = first.select(F.explode(F.array(F.struct(F.lit(0).alias("section"), F.lit(HEADER + "\n").alias("text")), F.struct(F.lit(1).alias("section"), F.when(c("first").isNull(), "D:\n").alias("text")))).alias("x"))
    head = head.where("x.text is not null").select("x.section", none.alias("a"), none.alias("b"), none.alias("c"), none.alias("d"), "x.text")
    return once.unionByName(dictionary).unionByName(head)
