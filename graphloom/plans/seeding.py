"""Queries on start functions and anchors, each with its SQL.

Each order asks for functions by what its lines spell; suppliers export entry points, and parts of one size are called like entries.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import seeds
from graphloom.plans.collect import collector
from graphloom.sources import star
from graphloom.sources.star import BASE, FUNC, STEP

QUERIES, SQL, query = collector()


def _requests(spark, sf_dir):
    c = F.col
    f = star.functions(spark, sf_dir).select(c("id").alias("l_partkey"), "name", "start")
    at = F.hex(c("start") + c("l_quantity").cast("long"))
    kind = c("l_linenumber")
    spec = F.when(kind == 1, F.concat(F.lit("0x"), at)).when(kind == 2, F.concat(F.lit(" "), F.lower(at))).when(kind == 3, F.concat(F.lit("\t"), "name", F.lit("\n")))
    spec = spec.when(kind == 4, c("name")).when(kind == 5, F.concat(F.lit("0X"), "name")).when(kind == 6, F.lit("0x")).otherwise(F.concat(F.lit("FFFFFFFFFFFFFFFF0"), at))
    lines = star.table(spark, sf_dir, "lineitem").join(f, "l_partkey").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", spec.alias("spec")).alias("x"))
    told = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["spec"])
    # odd orders use bars and end with specs of no length
    text = F.when(c("l_orderkey") % 2 == 0, F.array_join("told", ",")).otherwise(F.concat(F.array_join("told", "|"), F.lit("|, ")))
    return lines.groupBy("l_orderkey").agg(told.alias("told")).select(c("l_orderkey").alias("request"), text.alias("text"))


def _called(spark, sf_dir, found):
    """Arguments of ``seeds.anchors``: functions, some called like entries, ``found`` seeds, and suppliers' entry points."""
    c = F.col
    f = star.functions(spark, sf_dir)
    entries = star.table(spark, sf_dir, "supplier").select((F.lit(BASE) + STEP * 3 * c("s_suppkey") + c("s_nationkey")).alias("address"))
    told = F.when(c("size") == 7, F.element_at(F.array(F.lit("_main"), F.lit("WinMain"), F.lit("start")), (1 + c("id") % 3).cast("int"))).otherwise(c("name"))
    return f.withColumn("name", told), found, entries


def entry_anchors(spark, sf_dir):
    """``node``: anchors where nobody asks for any function."""
    nobody = star.functions(spark, sf_dir).where("false").select(F.col("id").alias("node"))
    return seeds.anchors(*_called(spark, sf_dir, nobody)).select("node")


#: SQL of ``entry_anchors``; needs ``func``.
ENTRY_ANCHORS = f"SELECT id FROM func JOIN supplier ON {BASE} + {STEP} * 3 * s_suppkey + s_nationkey BETWEEN start_ AND end_ - 1 UNION SELECT id FROM func WHERE size = 7"


_RESOLVED = f"""{FUNC},
l AS (SELECT l_orderkey AS request, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos, l_linenumber AS kind, name, id, start_ + CAST(l_quantity AS BIGINT) AS place FROM lineitem JOIN func ON id = l_partkey),
told AS (
  SELECT request, pos, CASE kind WHEN 1 THEN '0x' || upper(to_hex(place)) WHEN 2 THEN lower(to_hex(place)) WHEN 3 THEN name WHEN 4 THEN name WHEN 5 THEN '0X' || name WHEN 6 THEN '0x' ELSE 'FFFFFFFFFFFFFFFF0' || upper(to_hex(place)) END AS spec,
    CASE WHEN kind <= 2 THEN place WHEN kind <= 4 THEN {BASE} + {STEP} * id END AS address FROM l),
res AS (SELECT request, CAST(pos AS INT) AS pos, spec, address, id AS func FROM told LEFT JOIN func ON id = (address - {BASE}) // {STEP} AND address < end_)"""


@query(f"WITH {_RESOLVED} SELECT * FROM res")
def resolved_seeds(spark, sf_dir):
    """What every order asks for, as addresses with and without 0x, names, and specs that lead nowhere."""
    f = star.functions(spark, sf_dir)
    return seeds.resolved(seeds.specs(_requests(spark, sf_dir)), f, f.select("name", F.col("start").alias("address")))


@query(f"""
WITH {_RESOLVED}, entry_ AS (SELECT {BASE} + {STEP} * 3 * s_suppkey + s_nationkey AS place FROM supplier),
a AS (
  SELECT func AS node, true AS seed, false AS entry, false AS named FROM res JOIN orders ON o_orderkey = request WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' AND func IS NOT NULL
  UNION ALL SELECT id, false, true, false FROM entry_ JOIN func ON place BETWEEN start_ AND end_ - 1
  UNION ALL SELECT id, false, false, true FROM func WHERE size = 7)
SELECT node, bool_or(seed) AS seed, bool_or(entry) AS entry, bool_or(named) AS named FROM a GROUP BY node
""")
def anchors(spark, sf_dir):
    """Functions that urgent pending orders ask for, that hold a supplier's entry point, or that are called like an entry."""
    c = F.col
    f = star.functions(spark, sf_dir)
    urgent = star.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'").select(c("o_orderkey").alias("request"))
    wanted = seeds.specs(_requests(spark, sf_dir).join(urgent, "request", "left_semi"))
    found = seeds.resolved(wanted, f, f.select("name", c("start").alias("address"))).where("func is not null").select(c("func").alias("node"))
    return seeds.anchors(*_called(spark, sf_dir, found))
