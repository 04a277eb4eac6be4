"""Queries that carry annotations from one build to another by file, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import annotations, carry
from graphloom.plans import decoding
from graphloom.plans.collect import collector
from graphloom.plans.decoding import _ROWS, ROOM
from graphloom.plans.stash import stash
from graphloom.sources import star

QUERIES, SQL, query = collector()

#: How far the other build lies, and how deep exports go.
AWAY, DEPTH = 1 << 40, 3


def _layer(d: int) -> str:
    done = " UNION ALL ".join(f"SELECT node FROM d{i}" for i in range(d))
    return f"""d{d} AS (SELECT node, (SELECT count(*) FROM ({done})) + row_number() OVER (ORDER BY way) AS id, {d} AS depth
  FROM (SELECT dst AS node, min([id, at_]) AS way FROM d{d - 1} JOIN c ON src = node WHERE dst NOT IN ({done}) GROUP BY dst))"""


_FOUND = f"""{_ROWS},
site AS (SELECT src, addr AS at_, t // {ROOM} AS dst FROM ins WHERE k BETWEEN 3 AND 6 AND t IN (SELECT a FROM fn)),
c AS (SELECT src, dst, min(at_) AS at_ FROM site GROUP BY src, dst),
d0 AS (SELECT min(id) AS node, CAST(1 AS BIGINT) AS id, 0 AS depth FROM fn),
{", ".join(_layer(d) for d in range(1, DEPTH + 1))},
inner_ AS ({" UNION ALL ".join(f"SELECT * FROM d{d}" for d in range(DEPTH + 1))}),
found AS (
  SELECT * FROM inner_
  UNION ALL SELECT node, (SELECT count(*) FROM inner_) + row_number() OVER (ORDER BY at_), NULL
  FROM (SELECT dst AS node, min(at_) AS at_ FROM c WHERE src IN (SELECT node FROM inner_) AND dst NOT IN (SELECT node FROM inner_) GROUP BY dst))"""

_SET = f"""RECURSIVE {_FOUND},
m(node) AS (SELECT node FROM d0 UNION SELECT dst FROM m JOIN c ON src = node WHERE node % 7 <> 3 AND dst % 11 <> 0 AND dst IN (SELECT node FROM inner_)),
map_ AS (SELECT id, node, node % 7 <> 3 AS verified FROM m JOIN inner_ USING (node)),
ok AS (SELECT map_.id AS id, node, node * {ROOM} + {AWAY} AS target, (b - a) // 2 AS len FROM map_ JOIN fn ON fn.id = node WHERE verified),
note AS (SELECT DISTINCT src AS node, addr - src * {ROOM} AS rva, k, q FROM ins WHERE k IN (1, 2)),
made AS (
  SELECT id, target, 'name' AS what, CAST(NULL AS BIGINT) AS rva, '' AS key, 'fn_' || node AS value FROM ok
  UNION ALL SELECT id, target, 'prototype', NULL, '', 'int f' || node || '();' FROM ok WHERE node % 3 = 0
  UNION ALL SELECT id, target, 'function comment', NULL, CASE WHEN node % 8 = 0 THEN 'repeatable' ELSE '' END, 'says "' || node || '"' FROM ok WHERE node % 4 = 0
  UNION ALL SELECT id, target, 'comment', rva, CASE WHEN q % 2 = 1 THEN 'repeatable' ELSE '' END, 'c' || q || chr(10) FROM ok JOIN note USING (node) WHERE k = 1 AND rva < len
  UNION ALL SELECT id, target, 'variable', CASE WHEN q % 3 = 0 AND rva = 0 THEN NULL ELSE rva END, ['none', 'reg', 'stk'][1 + q % 3] || ' ' || q, trim(CASE WHEN q % 5 <> 0 THEN 'int ' ELSE '' END || CASE WHEN q % 4 <> 0 THEN 'v' || q ELSE '' END)
  FROM ok JOIN note USING (node) WHERE k = 2 AND (q % 5 <> 0 OR q % 4 <> 0))"""


def _calls(spark, sf_dir):
    functions, li = decoding.bodies(spark, sf_dir)
    sites = li.where("k between 3 and 6").select("src", F.col("addr").alias("at"), "t").join(functions.select(F.col("start").alias("t"), F.col("id").alias("dst")), "t").drop("t")
    return functions, li, stash(sites, "sites")


def _number_all(functions, calls):
    return stash(carry.discovered(calls, functions.agg(F.min("id").alias("node")), DEPTH), "numbers")


@query(f"WITH {_FOUND} SELECT node, id, depth FROM found")
def export_order(spark, sf_dir):
    """Exported functions by number, in order of discovery, and those they call beyond."""
    functions, _, calls = _calls(spark, sf_dir)
    return _number_all(functions, calls)


def exported(spark, sf_dir):
    """``(texts, functions, calls, numbers)``: the annotation file of a program, and what it was made of."""
    c = F.col
    functions, li, calls = _calls(spark, sf_dir)
    numbers = _number_all(functions, calls)
    one = F.lit(1).alias("file")
    node = numbers.where("depth is not null").select("node", c("id").alias("number"))
    f = functions.join(node, functions["id"] == node["node"]).select(
        one, c("number").alias("id"), F.concat(F.lit("fn_"), "node").alias("name"), c("start").alias("ea"), c("start").alias("rva"), (c("end") - c("start")).alias("size"), ((c("end") - c("start")) / 2).cast("long").alias("insns"),
        F.lit(1).alias("blocks"), (c("node") * 2654435761).alias("shape"), F.when(c("node") % 3 == 0, F.concat(F.lit("int f"), "node", F.when(c("node") % 2 == 0, "();").otherwise("()"))).alias("proto"),
        *[F.when((c("node") % 4 == 0) & ((c("node") % 8 == 0) == again), F.concat(F.lit('says "'), "node", F.lit('"'))).alias(name) for name, again in (("comment", False), ("repeatable", True))],
    )
    notes = li.join(node, li["src"] == node["node"]).select(one, c("number").alias("id"), (c("addr") - c("src") * ROOM).alias("rva"), "k", "q")
    comments = notes.where("k = 1").select("file", "id", "rva", (c("q") % 2 == 1).alias("repeatable"), F.concat(F.lit("c"), "q", F.lit("\n")).alias("text"))
    kind = F.element_at(F.array(F.lit("none"), F.lit("reg"), F.lit("stk")), (1 + c("q") % 3).cast("int"))
    variables = notes.where("k = 2").select(
        "file", "id", c("rva").alias("pos"), kind.alias("kind"), c("q").alias("place"), "rva", F.when(c("q") % 4 != 0, F.concat(F.lit("v"), "q")).otherwise("").alias("name"), F.when(c("q") % 5 != 0, "int").otherwise("").alias("type")
    )
    callees = carry.called(calls, numbers).join(node.select(c("number").alias("id"), "node"), "id").select(one, "id", c("at").alias("pos"), (c("at") - c("node") * ROOM).alias("rva"), "callee")
    programs = f.where("id = 1").select("file", F.lit(1).alias("version"), F.lit(0).cast("long").alias("image_base"), c("ea").alias("root"), F.lit("x64").alias("arch"), F.lit("now").alias("created"))
    types = star.table(spark, sf_dir, "supplier").select(one, c("s_suppkey").alias("id"), c("s_name").alias("name"), F.concat(F.lit("struct "), "s_name", F.lit(" {};")).alias("decl"))
    return annotations.files(annotations.written(programs, types, f, comments, variables, callees)), functions, calls, numbers


def _carried(spark, sf_dir):
    """The file on a build that lies elsewhere, changed every seventh function, moved all ends, and lacks calls of every eleventh."""
    c = F.col
    texts, functions, calls, _ = exported(spark, sf_dir)
    n, size = c("id"), c("end") - c("start")
    target = functions.select(
        (c("start") + AWAY).alias("target"), (c("start") + AWAY + F.floor(size / 2)).alias("end"), size.alias("size"), ((size / 2).cast("long") + F.when(n % 7 == 3, 1).otherwise(0)).alias("insns"), F.lit(1).cast("long").alias("blocks"), (n * 2654435761).alias("shape")
    )
    sites = calls.where("dst % 11 <> 0").select((c("src") * ROOM + AWAY).alias("target"), (c("at") - c("src") * ROOM).alias("rva"), (c("dst") * ROOM + AWAY).alias("to"))
    first = functions.agg(F.min("start").alias("s")).head()["s"] or 0
    return texts, carry.applied(texts, target, sites, F.lit(first + AWAY))


@query(f"WITH {_SET} SELECT id, target, what, rva, key, value FROM made")
def carried_annotations(spark, sf_dir):
    """What a written, read and replayed file sets in another build."""
    return _carried(spark, sf_dir)[1][2]


@query(f"""
WITH {_SET}
SELECT 'verify' AS phase, CASE WHEN verified THEN 'matched' ELSE 'mismatched' END AS what, count(*) AS n FROM map_ GROUP BY ALL
UNION ALL SELECT 'verify', 'not found', (SELECT count(*) FROM inner_) - (SELECT count(*) FROM map_)
UNION ALL SELECT 'types', 'type', count(*) FROM supplier
UNION ALL SELECT 'apply', what, count(*) FROM made GROUP BY what
""")
def carried_counts(spark, sf_dir):
    """Counters of that application by phase."""
    texts, (mapping, types, made) = _carried(spark, sf_dir)
    functions = annotations.function_facts(annotations.read(texts)).count()
    return carry.report(functions, mapping, types, made)
