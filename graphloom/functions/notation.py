"""Text notations: hexadecimal addresses, slices, nodes, escapes and graph styles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_upper(c: Column) -> Column:
    return F.concat(F.lit("0x"), F.hex(c))


def hex_lower(c: Column) -> Column:
    return F.lower(F.hex(c))


def rva(address: Column, image_base: Column) -> Column:
    return address - image_base


def slice_of(member: Column, offset: Column, length: Column) -> Column:
    """``.member``, or ``@[0xOFF:0xLEN]`` with ``?`` for what is unknown; nothing if both are.

    A negative offset prints as 32-bit two's complement.
    """
    off = F.when(offset < 0, offset.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(offset)
    part = lambda x: F.coalesce(F.concat(F.lit("0x"), F.hex(x)), F.lit("?"))
    both = F.concat(F.lit("@["), part(off), F.lit(":"), part(length), F.lit("]"))
    return F.when(F.coalesce(member, F.lit("")) != "", F.concat(F.lit("."), member)).when(offset.isNull() & length.isNull(), "").otherwise(both)


def meta_of(pairs: Column) -> Column:
    """`` {k=v,...}`` of a map, keys in order; nothing for an empty one."""
    parts = F.transform(F.array_sort(F.map_entries(pairs)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.when(F.size(parts) > 0, F.concat(F.lit(" {"), F.array_join(parts, ","), F.lit("}"))).otherwise("")


def origin_of(kind: Column, name: Column) -> Column:
    """Notation of an origin: L(v), P(v), G(g), R(f); constants have no value; U() if unknown or derived."""
    named = F.coalesce(name, F.lit(""))
    wrap = lambda letter: F.concat(F.lit(f"{letter}("), named, F.lit(")"))
    return (
        F.when(kind == "L", wrap("L")).when(kind == "P", wrap("P")).when(kind == "G", F.when(named == "", "G(0x0)").otherwise(wrap("G")))
        .when(kind == "R", wrap("R")).when(kind == "C", "C(0x0)").otherwise("U()")
    )


def c_escape(c: Column) -> Column:
    """Backslash escapes for quotes, backslashes, line ends and tabs; \\xHH for the other characters below a space."""
    named = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}
    steps = [("\\", "\\\\"), ('"', '\\"'), *[(chr(k), named.get(chr(k), f"\\x{k:02X}")) for k in range(32)]]
    return reduce(lambda s, p: F.replace(s, F.lit(p[0]), F.lit(p[1])), steps, c)


def c_unescape(c: Column) -> Column:
    """The text that ``c_escape`` was given; an escape that it does not write stands for its second character."""
    piece = lambda p: (
        F.when(p.rlike(r"^\\x[0-9A-Fa-f]{2}$"), F.char(F.conv(F.substr(p, F.lit(3)), 16, 10).cast("long")))
        .when(p.startswith("\\"), F.translate(F.substr(p, F.lit(2)), "nrt", "\n\r\t")).otherwise(p)
    )
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(?s)\\x[0-9A-Fa-f]{2}|\\.|[^\\]+"), 0), piece), "")


def html_escape(c: Column) -> Column:
    return reduce(lambda s, p: F.replace(s, F.lit(p[0]), F.lit(p[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")], c)


def strip_count_suffix(c: Column) -> Column:
    return F.regexp_replace(c, r" \([0-9]+ funcs\)$", "")


def file_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_.-]", "_")


def rank_direction(c: Column) -> Column:
    u = F.upper(c)
    return F.when(u.isin("TB", "BT", "LR", "RL"), u).otherwise("TB")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def node_font(n: Column) -> Column:
    return clamp(11 + 3 * F.log2(n.cast("double")), 11.0, 24.0).cast("int")


def node_pen(n: Column) -> Column:
    return clamp(1.2 + 0.1 * F.sqrt(n.cast("double")), 1.2, 4.2)


def edge_pen(count: Column) -> Column:
    return F.least(F.lit(6.0), 0.8 + 0.9 * F.log2(1.0 + count))


def edge_alpha(count: Column, largest: Column) -> Column:
    return clamp(64 + 140 * F.log2(1.0 + count) / F.log2(1.0 + largest), 64.0, 204.0).cast("int")


def comment_to_assembly(c: Column) -> Column:
    """A line of C for an assembly listing: comments begin with a semicolon, and so does all else."""
    return F.when(c.startswith("// "), F.concat(F.lit("; "), F.substr(c, F.lit(4)))).when(c.startswith("//"), F.concat(F.lit(";"), F.substr(c, F.lit(3)))).otherwise(F.concat(F.lit("; "), c))


def node_of(kind: Column, function: Column, name: Column, offset: Column, mode: Column, member: Column, meta: Column) -> Column:
    """A node of a value with its slice, mode and notes: locals and parameters without a name are told by function and index 0, globals by 0x0, returns by function.

    ``offset`` null or 0 has no slice, ``meta`` is text as ``meta_of`` gives.
    """
    part = slice_of(member, F.nullif(offset, F.lit(0)), F.lit(None).cast("int"))
    named = lambda other: F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(other)
    held = F.concat(kind, F.lit("("), named(F.concat(function, F.lit(",0"))), F.lit(")"), part, F.coalesce(mode, F.lit("")))
    body = F.when(kind.isin("L", "P"), held).when(kind == "G", F.concat(F.lit("G("), named(F.lit("0x0")), F.lit(")"), part)).when(kind == "C", "C(0x0)").when(kind == "R", F.concat(F.lit("R("), named(function), F.lit(")")))
    return F.concat(F.coalesce(body, F.lit("U()")), meta)


def argument_node(callee: Column, arg: Column) -> Column:
    return F.concat(F.lit("A("), callee, F.lit(","), arg.cast("string"), F.lit(")"))


def function_node(function: Column, name: Column) -> Column:
    return F.concat(F.lit("F("), F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(function), F.lit(")"))
