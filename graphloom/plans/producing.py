"""Queries on the producers of reference edges and the filters around them, each with its SQL.

Line items stand for instructions: the line number says what kind of operand
there is, the part in which function it stands; targets are addresses near the
starts of other parts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import edges, facts, producers
from graphloom.plans.collect import collector
from graphloom.sources import star
from graphloom.sources.star import BASE, FUNC, STEP

QUERIES, SQL, query = collector()

_REFS = f"""{FUNC},
x AS (
  SELECT l_partkey AS src, l_linenumber AS k, {BASE} + {STEP} * (l_partkey + 3 * l_suppkey + 1) + CASE WHEN l_quantity < 25 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS target
  FROM lineitem),
seg AS (SELECT {BASE} + 5120 * n_nationkey AS a, {BASE} + 5120 * (n_nationkey + 1) AS b, n_regionkey < 3 AS executable FROM nation),
ptr AS (SELECT {BASE} + 8 * o_orderkey AS slot, CASE WHEN o_custkey % 50 = 0 THEN 0 ELSE {BASE} + {STEP} * o_custkey END AS value FROM orders)"""

_AT_START = "JOIN func ON start_ = target WHERE src <> id"
_PRODUCED = f"""{_REFS},
virt AS (SELECT p_partkey * 8 AS off_, p_partkey AS func FROM part UNION SELECT (p_partkey + 1) * 8, p_partkey FROM part),
r AS (
  SELECT src, id AS dst, 0 AS ref FROM x {_AT_START} AND k IN (1, 5)
  UNION ALL SELECT src, id, 2 FROM x {_AT_START} AND k = 2
  UNION ALL SELECT src, id, 3 FROM x {_AT_START} AND k = 3
  UNION ALL SELECT src, id, 4 FROM x {_AT_START} AND k = 5
  UNION ALL SELECT src, id, 1 FROM (
    SELECT DISTINCT src, value AS target FROM x JOIN ptr ON slot = target
    WHERE k = 4 AND slot % 8 = 0 AND value NOT IN (0, -1) AND EXISTS (SELECT 1 FROM seg WHERE NOT executable AND a <= slot AND slot < b)) {_AT_START}
  UNION ALL SELECT src, func, 5 FROM (SELECT DISTINCT src, (target - {BASE}) // 8 AS off_ FROM x WHERE k = 6) JOIN virt USING (off_) WHERE src <> func
  UNION ALL SELECT src, id, 6 FROM x JOIN func ON start_ <= target AND target < end_ WHERE k = 7 AND src <> id)"""


def _references(spark, sf_dir):
    quantity = F.when(F.col("l_quantity") < 25, 0).otherwise(F.col("l_quantity").cast("long"))
    target = F.lit(BASE) + STEP * (F.col("l_partkey") + 3 * F.col("l_suppkey") + 1) + quantity
    return star.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_linenumber").alias("k"), target.alias("target"))


def _segments(spark, sf_dir):
    start = F.lit(BASE) + 5120 * F.col("n_nationkey")
    return star.table(spark, sf_dir, "nation").select(start.alias("start"), (start + 5120).alias("end"), (F.col("n_regionkey") < 3).alias("executable"))


def _pointers(spark, sf_dir):
    value = F.when(F.col("o_custkey") % 50 == 0, F.lit(0)).otherwise(F.lit(BASE) + STEP * F.col("o_custkey"))
    return star.table(spark, sf_dir, "orders").select((F.lit(BASE) + 8 * F.col("o_orderkey")).alias("slot"), value.alias("value"))


def _produced(spark, sf_dir):
    x, f = _references(spark, sf_dir), star.functions(spark, sf_dir)
    code = x.where(F.col("k").isin(1, 2, 5)).select("src", "target", (F.col("k") != 2).alias("is_code"))
    jumps = x.where("k = 5").select("src", "target")
    p = star.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("func"))
    slots = p.select((F.col("func") * 8).alias("offset"), "func").union(p.select((F.col("func") + 1) * 8, "func"))
    virtual = edges.virtual_dispatch(x.where("k = 6").select("src", F.floor((F.col("target") - BASE) / 8).alias("offset")), slots)
    return [
        producers.direct_calls(code, f), producers.data_references(code, f), producers.immediates(x.where("k = 3").select("src", F.col("target").alias("value")), f), producers.tail_calls(jumps, f),
        producers.indirect_calls(x.where("k = 4").select("src", F.col("target").alias("slot")), _pointers(spark, sf_dir), _segments(spark, sf_dir), f),
        virtual.withColumn("ref", F.lit(5).cast("long")), producers.jump_targets(x.where("k = 7").select("src", "target"), f),
    ]


@query(f"WITH {_PRODUCED} SELECT src, dst, array_to_string(list_sort(list(DISTINCT ref)), ',') AS types FROM r GROUP BY src, dst")
def outbound_edges(spark, sf_dir):
    """All seven producers, one edge a pair."""
    return producers.union_of(_produced(spark, sf_dir)).select("src", "dst", F.array_join("types", ",").alias("types"))


@query(f"WITH {_PRODUCED} SELECT src, dst, array_to_string(list_sort(list(DISTINCT ref)), ',') AS types FROM r WHERE ref IN (0, 1, 4, 5) GROUP BY src, dst")
def followed_edges(spark, sf_dir):
    """Calls alone, as a mask of types asks for."""
    return producers.union_of(_produced(spark, sf_dir), {0, 1, 4, 5}).select("src", "dst", F.array_join("types", ",").alias("types"))


@query(f"""
WITH {_PRODUCED} SELECT ref AS type, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets
FROM (SELECT DISTINCT src, dst, CAST(ref AS BIGINT) AS ref FROM r) GROUP BY ref
""")
def producer_counts(spark, sf_dir):
    every = None
    for p in _produced(spark, sf_dir):
        every = p if every is None else every.unionByName(p)
    return every.distinct().groupBy(F.col("ref").alias("type")).agg(F.count("*").alias("edges"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


@query(f"""
WITH {_REFS}
SELECT DISTINCT slot, CASE WHEN value = 0 THEN NULL ELSE value END AS value FROM ptr
WHERE slot % 8 = 0 AND EXISTS (SELECT 1 FROM seg WHERE NOT executable AND a <= slot AND slot < b)
""")
def data_slots(spark, sf_dir):
    """Aligned pointer slots in data segments, zero pointers as null."""
    p = _pointers(spark, sf_dir).where("slot % 8 = 0").withColumn("value", F.nullif("value", F.lit(0)))
    return producers.outside_code(p, _segments(spark, sf_dir), "slot").select("slot", "value")


@query(f"WITH {_PRODUCED} SELECT DISTINCT dst AS node FROM r WHERE ref IN (2, 3) AND src NOT IN (SELECT id FROM func WHERE system)")
def address_taken(spark, sf_dir):
    refs = _produced(spark, sf_dir)
    system = star.functions(spark, sf_dir).where("system").select(F.col("id").alias("node"))
    return producers.address_taken(refs[1].unionByName(refs[2]), system, F.col("ref").isin(2, 3))


@query(f"WITH {_PRODUCED} SELECT DISTINCT src, dst FROM r WHERE ref = 0 AND src IN (SELECT id FROM func WHERE size > 20) AND dst IN (SELECT id FROM func WHERE size > 20)")
def shown_edges(spark, sf_dir):
    """Direct calls of which both ends are shown, here the larger functions."""
    shown = star.functions(spark, sf_dir).where("size > 20").select(F.col("id").alias("node"))
    return producers.between_shown(_produced(spark, sf_dir)[0].select("src", "dst"), shown)


@query(f"""
WITH {_REFS}, imp AS (SELECT {BASE} + {STEP} * s_suppkey AS target, s_name AS symbol FROM supplier), g AS (SELECT start_ AS target, name FROM func)
SELECT DISTINCT src, target, coalesce(symbol, name) AS name, symbol IS NOT NULL AS is_import FROM x LEFT JOIN imp USING (target) LEFT JOIN g USING (target)
WHERE symbol IS NOT NULL OR name IS NOT NULL
""")
def referenced_names(spark, sf_dir):
    """The name behind each reference: an import's before a global's."""
    s = star.table(spark, sf_dir, "supplier").select((F.lit(BASE) + STEP * F.col("s_suppkey")).alias("target"), F.col("s_name").alias("symbol"))
    names = star.functions(spark, sf_dir).select(F.col("start").alias("target"), "name")
    return facts.import_or_global(_references(spark, sf_dir).select("src", "target").distinct(), s, names)
