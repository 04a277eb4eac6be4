"""The star tables read as program snapshots: parts are functions, orders call sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BASE, STEP = 4194304, 64
#: Reference types in their order.
REF_TYPES = ("direct_call", "indirect_call", "data_ref", "immediate_ref", "tail_call", "virtual_call", "jump_table")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, start, end, name, size, system)``: a function for each part."""
    start = F.lit(BASE) + F.col("p_partkey") * STEP
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), start.alias("start"), (start + F.col("p_size")).alias("end"),
        F.concat_ws("_", F.regexp_replace("p_name", " ", "_"), "p_partkey").alias("name"), F.col("p_size").cast("long").alias("size"),
        (F.col("p_brand") == "Brand#11").alias("system"),
    )


def flow(spark: SparkSession, sf_dir: str, quantity: float) -> DataFrame:
    """``(src, dst, ref)``: each part of an order refers to the next.

    All line items take part, or for ``quantity`` > 0 the returned ones of at
    least that quantity (a sparse graph, mostly without cycles).
    """
    lines = table(spark, sf_dir, "lineitem")
    if quantity:
        lines = lines.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= quantity))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    refs = lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"), (F.col("l_linenumber") - 1).alias("ref"))
    return refs.where(F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))


def links(spark: SparkSession, sf_dir: str, quantity: float) -> DataFrame:
    """Distinct ``(src, dst)`` of ``flow``."""
    return flow(spark, sf_dir, quantity).select("src", "dst").distinct()


FUNC = f"""func AS (
  SELECT p_partkey AS id, {BASE} + {STEP} * p_partkey AS start_, {BASE} + {STEP} * p_partkey + p_size AS end_,
         replace(p_name, ' ', '_') || '_' || p_partkey AS name, CAST(p_size AS BIGINT) AS size, p_brand = 'Brand#11' AS system
  FROM part)"""


def flow_sql(quantity: float) -> str:
    chosen = f"WHERE l_returnflag = 'R' AND l_quantity >= {quantity}" if quantity else ""
    return f"""flow AS (
  SELECT src, dst, ref FROM (
    SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst, l_linenumber - 1 AS ref
    FROM lineitem {chosen})
  WHERE dst IS NOT NULL AND src <> dst),
edge AS (SELECT DISTINCT src, dst FROM flow)"""


def order_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(src, dst, ref)`` of a sparse graph of orders.

    An order calls its customer's next one, the last one the first; the first
    line of an order calls the order numbered as its part, and the seventh
    refers indirectly to the order numbered as its order and supplier together.
    """
    turn, last = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_custkey")
    o = table(spark, sf_dir, "orders")
    first = F.min(F.struct("o_orderdate", "o_orderkey")).over(last)["o_orderkey"]
    ring = o.select(F.col("o_orderkey").alias("src"), F.coalesce(F.lead("o_orderkey").over(turn), first).alias("dst"), F.lit(0).alias("ref"))
    li = table(spark, sf_dir, "lineitem")
    shared = li.where("l_linenumber = 1").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit(0).alias("ref"))
    aside = li.where("l_linenumber = 7").select(F.col("l_orderkey").alias("src"), (F.col("l_orderkey") + F.col("l_suppkey")).alias("dst"), F.lit(5).alias("ref"))
    known = o.select(F.col("o_orderkey").alias("dst")).distinct()
    return ring.unionByName(shared.unionByName(aside).join(known, "dst", "left_semi")).where("src <> dst")


ORDER_CALLS = """oc AS (
  SELECT o_orderkey AS src, coalesce(lead(o_orderkey) OVER w, first_value(o_orderkey) OVER w) AS dst, 0 AS ref FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
  UNION ALL SELECT l_orderkey, l_partkey, 0 FROM lineitem WHERE l_linenumber = 1 AND l_partkey IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT l_orderkey, l_orderkey + l_suppkey, 5 FROM lineitem WHERE l_linenumber = 7 AND l_orderkey + l_suppkey IN (SELECT o_orderkey FROM orders)),
call_ AS (SELECT src, dst, ref FROM oc WHERE src <> dst)"""
