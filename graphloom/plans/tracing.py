"""The query on the whole text of facts, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import tracing
from graphloom.plans import decoding
from graphloom.plans.collect import collector
from graphloom.plans.decoding import _ROWS, ROOM

QUERIES, SQL, query = collector()

_NODE = """CASE og WHEN 'L' THEN 'L(' || {who} || ')' || {slice} || {mode} WHEN 'P' THEN 'P(' || {who} || ')' || {slice} || {mode} WHEN 'G' THEN 'G(' || CASE WHEN nm = '' THEN '0x0' ELSE nm END || ')' || {slice}
    WHEN 'C' THEN 'C(0x0)' WHEN 'R' THEN 'R(' || CASE WHEN nm = '' THEN fid ELSE nm END || ')' ELSE 'U()' END"""
_WHO = "CASE WHEN nm = '' THEN fid || ',0' ELSE nm END"
_AT = "CASE WHEN off_ = 0 THEN '' ELSE '@[0x' || upper(to_hex(off_)) || ':?]' END"


@query(f"""
WITH {_ROWS},
f AS (SELECT id, a AS start_, CASE WHEN id % 10 = 0 THEN '' ELSE 'fn_' || id END AS fname, row_number() OVER (ORDER BY a) - 1 AS place FROM fn),
g AS (SELECT *, 'F' || place + 1 AS fid, id % 3 <> 0 AS told FROM f),
x AS (
  SELECT ins.*, (addr - src * {ROOM}) // 2 AS seq, ['L', 'P', 'G', 'C', 'R', 'D'][1 + q % 6] AS og, CASE WHEN s % 4 = 0 THEN '' ELSE 'v' || s % 4 END AS nm, q % 3 * 4 AS off_, CASE WHEN q % 7 = 0 THEN '*' ELSE '' END AS mode,
    CASE WHEN q % 11 = 0 THEN 'm' ELSE '' END AS member, o % 3 AS arg, g.* EXCLUDE (id), (src + s + q % 9) * {ROOM} AS callee FROM ins JOIN g ON g.id = src),
acc AS (SELECT DISTINCT o AS obj, k = 5 AS w, place, told, 'F(' || CASE WHEN fname = '' THEN fid ELSE fname END || ')' AS node FROM x WHERE k BETWEEN 5 AND 6),
title AS (SELECT o AS obj, min(CASE WHEN o % 3 <> 0 THEN 'g' || o END) AS gname FROM x GROUP BY o),
line AS (
  SELECT 2 AS section, place AS a, -1 AS b, 0 AS c, 0 AS d, 'D:' || fid || '=0x' || upper(to_hex(start_)) || ',' || fname AS line FROM g WHERE told
  UNION ALL SELECT 2, place, seq, 0, 0, 'A:' || CASE WHEN r % 2 = 0 THEN 'L' ELSE 'P' END || '(w' || r || '):=' || {_NODE.format(who=_WHO, slice=_AT, mode="''")} || ' {{conf=med}}' FROM x WHERE told AND k = 1
  UNION ALL SELECT 3, y.place, x.arg, x.place, seq, 'I:' || {_NODE.format(who=_WHO.replace("fid", "x.fid"), slice=_AT, mode="mode").replace("THEN fid", "THEN x.fid")} || ' {{caller=' || x.fid || ',conf=med,cs=0x' || upper(to_hex(addr)) || '}} -> P(' ||
    CASE WHEN x.arg < 2 THEN 'p' || y.id || '_' || x.arg ELSE y.fid || ',' || x.arg END || ')' FROM x JOIN g y ON y.start_ = callee WHERE y.told AND k IN (2, 3)
  UNION ALL SELECT 4, x.place, seq, 0, 0, 'E:' || {_NODE.format(who=_WHO.replace("fid", "x.fid"), slice="CASE WHEN member <> '' THEN '.' || member ELSE " + _AT + " END", mode="mode").replace("THEN fid", "THEN x.fid")} || ' {{conf=' || CASE WHEN q % 2 = 0 THEN 'high' ELSE 'low' END
    || ',cs=0x' || upper(to_hex(addr)) || '}} -> A(' || CASE WHEN y.id IS NULL THEN 'F?' WHEN y.fname = '' THEN y.fid ELSE y.fname END || ',' || x.arg || ')' FROM x LEFT JOIN g y ON y.start_ = callee WHERE x.told AND k IN (2, 3)
  UNION ALL SELECT 5, v.obj, v.place, z.place, 0, 'G:' || v.node || ' -> G(' || coalesce(gname, '0x' || upper(to_hex(v.obj))) || ') -> ' || z.node FROM acc v JOIN acc z USING (obj) JOIN title USING (obj) WHERE v.w AND NOT z.w AND (v.told OR z.told)),
once AS (SELECT min([section, a, b, c, d]) AS at_, line FROM line GROUP BY line)
SELECT at_[1] AS section, at_[2] AS a, at_[3] AS b, at_[4] AS c, at_[5] AS d, line || chr(10) AS text FROM once
UNION ALL SELECT 0, 0, 0, 0, 0, '#PTN v1' || chr(10)
UNION ALL SELECT 1, place, 0, 0, 0, CASE WHEN place = (SELECT min(place) FROM g WHERE told) THEN 'D:' ELSE ';' END || fid || '=0x' || upper(to_hex(start_)) || CASE WHEN fname <> '' THEN ',' || fname ELSE '' END
  || CASE WHEN place = (SELECT max(place) FROM g WHERE told) THEN chr(10) ELSE '' END FROM g WHERE told
""")
def program_facts(spark, sf_dir):
    """The whole text of facts on values of two thirds of the functions: dictionary, aliases, values in and out, globals."""
    c = F.col
    functions, x = decoding.bodies(spark, sf_dir)
    functions = functions.select("id", "start", F.when(c("id") % 10 != 0, F.concat(F.lit("fn_"), "id")).alias("name"))
    q = c("q")
    kinds = F.array(*[F.lit(k) for k in "LPGCRD"])
    x = x.select(
        c("src").alias("func"), ((c("addr") - c("src") * ROOM) / 2).cast("long").alias("seq"), "k", "o", "r", q, c("addr").alias("at"), F.element_at(kinds, (1 + q % 6).cast("int")).alias("origin"),
        F.when(c("s") % 4 == 0, "").otherwise(F.concat(F.lit("v"), c("s") % 4)).alias("name"), (q % 3 * 4).alias("offset"), F.when(q % 7 == 0, "*").otherwise("").alias("mode"), F.when(q % 11 == 0, "m").otherwise("").alias("member"),
        (c("o") % 3).alias("arg"), F.when(q % 2 == 0, "high").otherwise("low").alias("conf"), ((c("src") + c("s") + q % 9) * ROOM).alias("callee"),
    )
    aliases = x.where("k = 1").select("func", "seq", F.when(c("r") % 2 == 0, "L").otherwise("P").alias("kind"), F.concat(F.lit("w"), "r").alias("var"), "origin", "name", "offset")
    uses = x.where("k in (2, 3)").select("func", "seq", "at", "callee", "arg", "origin", "name", "offset", "mode", "member", "conf")
    accesses = x.where("k between 5 and 6").select("func", "seq", c("o").alias("obj"), F.when(c("o") % 3 != 0, F.concat(F.lit("g"), "o")).otherwise("").alias("name"), (c("k") == 5).alias("is_write"))
    params = functions.select(c("id").alias("func"), F.explode(F.array(F.lit(0), F.lit(1))).alias("idx"))
    params = params.select("func", c("idx").cast("long").alias("idx"), F.concat(F.lit("p"), "func", F.lit("_"), "idx").alias("name"))
    return tracing.program_text(functions, params, aliases, uses, accesses, functions.where("id % 3 <> 0"))
