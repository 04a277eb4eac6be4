"""Annotation files: one directive a line, written and read as columns, and replayed on another build.

A file is a header, facts on the program, types, and a block of directives for
each function between ``func <id>`` and ``end_func``.  Numbers are decimal or
hexadecimal with 0x; texts stand in quotes with backslash escapes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.notation import c_escape, c_unescape, hex_upper
from graphloom.operators.order import numbered
from graphloom.operators.render import as_files
from graphloom.operators.transfer import PARTS
from graphloom.plans.stash import stash

#: The directives and their operands in order (n number, s text, w word).
DIRECTIVES = {
    "image_base": "n", "root_ea": "n", "arch": "s", "created": "s", "type": "nss", "func": "n", "name": "s", "ea": "n", "rva": "n",
    "fp_size": "n", "fp_insns": "n", "fp_bbs": "n", "fp_hash": "n", "proto": "s", "func_cmt": "s", "func_cmt_rpt": "s", "cmt": "nns",
    "lvar": "wnnss", "callee": "nn", "end_func": "",
}
#: Directives between ``func`` and ``end_func``.
INNER = "name ea rva fp_size fp_insns fp_bbs fp_hash proto func_cmt func_cmt_rpt cmt lvar callee end_func".split()
MAGIC = "#annotations v"
_OPERAND = {"n": r"(?:0[xX][0-9A-Fa-f]{1,16}|-?[0-9]{1,18})", "s": r'"(?:[^"\\]|\\["\\nrt]|\\x[0-9A-Fa-f]{2})*"', "w": r"(?:reg|stk|none)"}


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c_escape(c), F.lit('"'))


def directive(name: str, *operands: Column, inner: bool = True) -> Column:
    """A line; null if an operand is null."""
    return F.concat(F.lit(f"  {name}" if inner else name), *[x for o in operands for x in (F.lit(" "), o)])


def written(programs: DataFrame, types: DataFrame, functions: DataFrame, comments: DataFrame, variables: DataFrame, callees: DataFrame) -> DataFrame:
    """``(file, section, owner, part, pos, line)``: the lines of all files; sorted by the middle columns within a file they are its text.

    ``programs(file, version, image_base, root, arch, created)``, ``types(file,
    id, name, decl)`` in order of id, ``functions(file, id, name, ea, rva, size,
    insns, blocks, shape, proto, comment, repeatable)``, ``comments(file, id, rva,
    repeatable, text)``, ``variables(file, id, pos, kind, place, rva, name,
    type)``, ``callees(file, id, pos, rva, callee)``.  Empty and null prototypes and
    comments of functions have no line.  One row makes one line, so nothing is gathered.
    """
    c = F.col
    number = lambda x: c(x).cast("string")
    filled = lambda x: F.when(c(x) != "", quoted(c(x)))

    def lines(rows: DataFrame, section: int, owner: Column, first: int, pos: Column, *made: Column) -> DataFrame:
        each = F.array(*[F.struct(F.lit(first + i).alias("part"), m.alias("line")) for i, m in enumerate(made)])
        return rows.select("file", F.lit(section).alias("section"), owner.cast("long").alias("owner"), pos.cast("long").alias("pos"), F.explode(each).alias("x")).select("file", "section", "owner", "x.part", "pos", "x.line").where("line is not null")

    zero = F.lit(0)
    head = lines(
        programs, 0, zero, 0, zero, F.concat(F.lit(MAGIC), number("version")), directive("image_base", hex_upper(c("image_base")), inner=False), directive("root_ea", hex_upper(c("root")), inner=False),
        directive("arch", quoted(c("arch")), inner=False), directive("created", quoted(c("created")), inner=False),
    )
    kinds = lines(types, 1, c("id"), 0, zero, directive("type", number("id"), quoted(c("name")), quoted(c("decl")), inner=False))
    block = lines(
        functions, 2, c("id"), 0, zero, directive("func", number("id"), inner=False), directive("name", quoted(c("name"))), directive("ea", hex_upper(c("ea"))), directive("rva", hex_upper(c("rva"))),
        directive("fp_size", number("size")), directive("fp_insns", number("insns")), directive("fp_bbs", number("blocks")), directive("fp_hash", hex_upper(c("shape"))),
        directive("proto", filled("proto")), directive("func_cmt", filled("comment")), directive("func_cmt_rpt", filled("repeatable")),
    )
    said = lines(comments, 2, c("id"), 20, c("rva"), directive("cmt", hex_upper(c("rva")), F.when(c("repeatable"), F.lit("1")).otherwise(F.lit("0")), quoted(c("text"))))
    held = lines(variables, 2, c("id"), 21, c("pos"), directive("lvar", c("kind"), number("place"), hex_upper(c("rva")), quoted(c("name")), quoted(c("type"))))
    called = lines(callees, 2, c("id"), 22, c("pos"), directive("callee", hex_upper(c("rva")), number("callee")))
    ends = lines(functions, 2, c("id"), 23, zero, directive("end_func", inner=False))
    out = head
    for part in (kinds, block, said, held, called, ends):
        out = out.unionByName(part)
    return out


def files(lines: DataFrame) -> DataFrame:
    """``(file, text)`` of ``written``; a file's lines meet in one row, as the file is one object."""
    return as_files(lines, "file", "section", "owner", "part", "pos")


def read(texts: DataFrame) -> DataFrame:
    """``(file, line_no, func, directive, numbers, texts, error)`` of ``texts(file, text)``, a row for each line that is not blank.

    ``func``: the function whose block the line stands in.  Numbers are signed 64
    bits.  A line whose directive is unknown, whose operands do not fit it, that stands
    outside of its place or before a header has ``error`` and no values; a word
    operand is the first of ``texts``.  Null texts have no lines.
    """
    lines = texts.where("text is not null").select("file", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)
    return decoded(lines, ["file"])


def decoded(lines: DataFrame, unit: list[str], headed: str | None = None) -> DataFrame:
    """``read``'s rows of ``lines(file, line_no, line, ...)``.

    No function's block runs over the border of a ``unit`` (columns), so each is
    decoded alone; ``headed`` names the column that says whether the file begins with a
    header, where a unit is less than a file.
    """
    lines = lines.where(F.trim("line") != "").withColumn("line", F.trim(F.regexp_replace("line", "\t", " ")))
    name = F.regexp_extract("line", "^([a-z_]+)", 1)
    lines = lines.withColumn("directive", F.when(F.col("line").startswith(MAGIC), "header").otherwise(name))
    fits = F.when(F.col("directive") == "header", F.col("line").rlike("^" + MAGIC + "[0-9]{1,9}$"))
    for d, operands in DIRECTIVES.items():
        fits = fits.when(F.col("directive") == d, F.col("line").rlike("^" + d + "".join(r"\s+" + _OPERAND[o] for o in operands) + "$"))
    in_unit = Window.partitionBy(*unit).orderBy("line_no")
    before = in_unit.rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when((F.col("directive") == "func") & F.col("_fits"), F.regexp_extract("line", r"^func\s+(\S+)", 1)).when((F.col("directive") == "func") | (F.lag("directive").over(in_unit) == "end_func"), "")
    lines = lines.withColumn("_fits", F.coalesce(fits, F.lit(False))).withColumn("_mark", mark)
    lines = lines.withColumn("_func", F.last("_mark", ignorenulls=True).over(before)).withColumn("_headed", F.col(headed) if headed else F.first("directive").over(before) == "header")
    inner = F.col("directive").isin(INNER)
    within = F.coalesce(F.col("_func"), F.lit("")) != ""
    error = F.when(~F.col("_headed"), "no header").when(~F.col("directive").isin("header", *DIRECTIVES), "unknown directive").when(~F.col("_fits"), "bad operands")
    error = error.when(inner & ~within, "outside of a function").when(~inner & within & (F.col("directive") != "func"), "inside of a function")
    parts = F.slice(F.regexp_extract_all("line", F.lit(r'"(?:[^"\\]|\\.)*"|[^\s"]+'), 0), 2, 100)
    number = lambda t: F.when(t.rlike("^0[xX]"), F.conv(F.substr(t, F.lit(3)), 16, -10).cast("long")).otherwise(t.cast("long"))
    digits = F.transform(F.filter(parts, lambda t: t.rlike("^-?[0-9]")), number)
    words = F.transform(F.filter(parts, lambda t: ~t.rlike("^-?[0-9]")), lambda t: F.when(t.startswith('"'), c_unescape(F.substr(t, F.lit(2), F.length(t) - 2))).otherwise(t))
    header = F.array(F.regexp_extract("line", "([0-9]+)$", 1).cast("long"))
    fine = error.isNull()
    return lines.select(
        "file", "line_no", F.when(fine & within, number(F.col("_func"))).alias("func"), "directive",
        F.when(fine, F.when(F.col("directive") == "header", header).otherwise(digits)).alias("numbers"),
        F.when(fine, F.when(F.col("directive") == "header", F.array().cast("array<string>")).otherwise(words)).alias("texts"), error.alias("error"),
    )


def function_facts(rows: DataFrame) -> DataFrame:
    """``(file, func, name, ea, rva, size, insns, blocks, shape, proto, comment, repeatable, comments, variables, callees)`` of ``read``'s rows.

    The first line of a kind counts; the last three are numbers of lines.
    """
    first = lambda d, values: F.min_by(F.when(F.col("directive") == d, F.get(values, F.lit(0))), F.when(F.col("directive") == d, F.col("line_no")))
    many = lambda d: F.count_if(F.col("directive") == d)
    return rows.where("error is null and func is not null").groupBy("file", "func").agg(
        first("name", "texts").alias("name"), *[first(d, "numbers").alias(n) for d, n in (("ea", "ea"), ("rva", "rva"), ("fp_size", "size"), ("fp_insns", "insns"), ("fp_bbs", "blocks"), ("fp_hash", "shape"))],
        *[first(d, "texts").alias(n) for d, n in (("proto", "proto"), ("func_cmt", "comment"), ("func_cmt_rpt", "repeatable"))],
        many("cmt").alias("comments"), many("lvar").alias("variables"), many("callee").alias("callees"),
    )


def replay(source: DataFrame, callees: DataFrame, target: DataFrame, sites: DataFrame, root: DataFrame, go_on: bool = True, max_rounds: int = 10_000) -> DataFrame:
    """``(id, target, verified)``: annotated functions found in another build by following recorded call sites from ``root(id, target)``.

    ``source(id, size, insns, blocks, shape)`` and ``target(target, ...)`` are
    fingerprints; ``callees(id, pos, rva, callee)`` recorded calls, ``sites(target,
    rva, to)`` the other build's.  Layer by layer: a function whose fingerprint
    differs is not verified and nothing is looked for below it, or without ``go_on``
    an error is raised.  Of several ways to a function the first counts, by the
    order of discovery of the caller and the place of the call.  Call sites that the
    other build lacks lead nowhere.

    Each round joins the layer's rows alone and writes its result.
    """
    same = F.lit(True)
    for p in PARTS:
        same = same & F.col(f"s_{p}").eqNullSafe(F.col(f"t_{p}"))
    s = source.select("id", *[F.col(p).alias(f"s_{p}") for p in PARTS], F.lit(True).alias("_s"))
    t = target.select("target", *[F.col(p).alias(f"t_{p}") for p in PARTS], F.lit(True).alias("_t"))

    def verified(found: DataFrame) -> DataFrame:
        both = found.join(s, "id").join(t, "target", "left")
        return stash(both.select("id", "target", "ord", (F.col("_t").isNotNull() & same).alias("verified")), "replay")

    layer = verified(root.select("id", "target").distinct().withColumn("ord", F.lit(0).cast("long")))
    done = layer
    for _ in range(max_rounds):
        if not go_on and layer.where("not verified").take(1):
            raise ValueError("fingerprints differ")
        calls = layer.where("verified").select("id", "target", "ord").join(callees, "id").join(done.select(F.col("id").alias("callee")), "callee", "left_anti")
        reached = calls.join(sites, ["target", "rva"]).groupBy("callee").agg(F.min_by("to", F.struct("ord", "pos")).alias("target"), F.min(F.struct("ord", "pos")).alias("way"))
        new = numbered(reached.select(F.col("callee").alias("id"), "target", "way"), "way", "id", name="ord").drop("way")
        layer = verified(new)
        if not layer.take(1):
            return done.select("id", "target", "verified")
        done = stash(done.unionByName(layer), "replayed")
    raise RuntimeError(f"replay did not end in {max_rounds} rounds")
