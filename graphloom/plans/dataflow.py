"""Queries on provenance, liveness and transfer, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions.notation import origin_of
from graphloom.operators import provenance, render, transfer
from graphloom.plans.collect import collector
from graphloom.plans.stash import stash
from graphloom.sources import star
from graphloom.sources.star import FUNC, flow_sql

QUERIES, SQL, query = collector()


_ALIAS = """al AS (SELECT o_custkey AS func, o_orderkey % 7 AS var, (o_orderkey // 7) % 9 AS to_, o_orderkey % 16 AS off_ FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderkey % 7 ORDER BY o_orderkey DESC) = 1)"""


@query(f"""
WITH RECURSIVE {_ALIAS},
c(func, var, origin, off_, steps, path, low) AS (
  SELECT func, var, to_, off_, 1, [var], to_ = var FROM al
  UNION ALL
  SELECT c.func, c.var, a.to_, c.off_ + a.off_, steps + 1, list_append(path, c.origin), list_contains(list_append(path, c.origin), a.to_)
  FROM c JOIN al a ON a.func = c.func AND a.var = c.origin WHERE NOT low AND steps < 10)
SELECT func, var, origin, off_ AS "offset", steps, low OR (steps = 10 AND EXISTS (SELECT 1 FROM al a WHERE a.func = c.func AND a.var = c.origin)) AS low
FROM c WHERE low OR steps = 10 OR NOT EXISTS (SELECT 1 FROM al a WHERE a.func = c.func AND a.var = c.origin)
""")
def alias_chain(spark, sf_dir):
    k = F.col("o_orderkey")
    a = star.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("func"), (k % 7).alias("var"), (F.floor(k / 7) % 9).alias("to"), (k % 16).alias("offset"), k.alias("seq"))
    return provenance.alias_chains(a)


@query("""
WITH RECURSIVE f AS (SELECT DISTINCT l_partkey AS func, l_linenumber % 3 AS param, l_suppkey * 20 AS callee, CAST(l_quantity AS INT) % 3 AS arg FROM lineitem),
w(func, param, depth) AS (
  SELECT func, param, 0 FROM f WHERE func = (SELECT min(func) FROM f)
  UNION SELECT callee, arg, depth + 1 FROM w JOIN f USING (func, param) WHERE depth < 3)
SELECT func, CAST(param AS INT) AS param, CAST(min(depth) AS INT) AS depth FROM w GROUP BY func, param
""")
def param_forward_chains(spark, sf_dir):
    li = star.table(spark, sf_dir, "lineitem")
    f = li.select(F.col("l_partkey").alias("func"), (F.col("l_linenumber") % 3).alias("param"), (F.col("l_suppkey") * 20).alias("callee"), (F.col("l_quantity").cast("int") % 3).alias("arg")).distinct()
    f = stash(f, "forwards")
    return provenance.forward_chains(f, f.join(f.agg(F.min("func").alias("func")), "func").select("func", "param"), 3)


@query("""
WITH a AS (SELECT l_partkey AS func, l_orderkey AS g, l_linenumber = 1 AS is_write, CASE WHEN l_linenumber = 2 THEN 'g' || l_suppkey ELSE '' END AS name, l_suppkey * 10 + l_linenumber AS seq
           FROM lineitem),
n AS (SELECT g, arg_min(name, seq) FILTER (name <> '') AS name FROM (SELECT g, seq, min(name) AS name FROM a WHERE name <> '' GROUP BY g, seq) GROUP BY g)
SELECT DISTINCT w.func AS writer, coalesce(n.name, '') AS name, r.func AS reader
FROM (SELECT DISTINCT func, g FROM a WHERE is_write) w JOIN (SELECT DISTINCT func, g FROM a WHERE NOT is_write) r USING (g) LEFT JOIN n USING (g) WHERE w.func <> r.func
""")
def global_flow(spark, sf_dir):
    n = F.col("l_linenumber")
    li = star.table(spark, sf_dir, "lineitem")
    a = li.select(F.col("l_partkey").alias("func"), F.col("l_orderkey").alias("global"), (n == 1).alias("is_write"), F.when(n == 2, F.concat(F.lit("g"), F.col("l_suppkey"))).otherwise("").alias("name"), (F.col("l_suppkey") * 10 + n).alias("seq"))
    return provenance.global_flow(a)


_CFG = """o AS (SELECT user_id AS func, event_id % 5 AS block, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos,
         (event_id * 7) % 11 AS reg, event_id % 3 <> 0 AS r, event_id % 3 <> 1 AS w FROM events),
ud AS (SELECT func, block, reg, min(CASE WHEN r THEN pos END) AS fr, min(CASE WHEN w THEN pos END) AS fw FROM o GROUP BY func, block, reg),
cfg AS (SELECT DISTINCT func, block AS src, (block * 2 + func) % 5 AS dst FROM o UNION SELECT DISTINCT func, block, (block + 1) % 5 FROM o)"""


@query(f"""
WITH RECURSIVE {_CFG},
live(func, block, reg) AS (
  SELECT DISTINCT func, 0, reg FROM ud WHERE fr IS NOT NULL AND (fw IS NULL OR fr <= fw)
  UNION
  SELECT l.func, c.dst, l.reg FROM live l JOIN cfg c ON c.func = l.func AND c.src = l.block
  WHERE NOT EXISTS (SELECT 1 FROM ud d WHERE d.func = l.func AND d.block = l.block AND d.reg = l.reg AND d.fw IS NOT NULL))
SELECT DISTINCT func, reg FROM live JOIN ud USING (func, block, reg) WHERE fr IS NOT NULL AND (fw IS NULL OR fr <= fw)
""")
def liveness(spark, sf_dir):
    e = star.table(spark, sf_dir, "events")
    i = F.col("event_id")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    ops = e.select(F.col("user_id").alias("func"), (i % 5).alias("block"), pos.alias("pos"), (i * 7 % 11).alias("reg"), (i % 3 != 0).alias("is_read"), (i % 3 != 1).alias("is_written"))
    blocks = ops.select("func", "block").distinct()
    cfg = blocks.select("func", F.col("block").alias("src"), ((F.col("block") * 2 + F.col("func")) % 5).alias("dst")).union(blocks.select("func", "block", (F.col("block") + 1) % 5))
    usedef = stash(provenance.block_use_def(ops), "usedef")
    return provenance.live_in(usedef, stash(cfg.distinct(), "cfg"), usedef.select("func", F.lit(0).cast("long").alias("block")).distinct())


@query(f"WITH {_CFG} SELECT func, string_agg(DISTINCT CAST(reg AS VARCHAR), ',' ORDER BY CAST(reg AS VARCHAR)) AS outgoing FROM ud WHERE fw IS NOT NULL GROUP BY func")
def outgoing_registers(spark, sf_dir):
    """Registers that any block of a function defines."""
    e = star.table(spark, sf_dir, "events").withColumn("is_written", F.col("event_id") % 3 != 1)
    regs = F.array_sort(F.collect_set((F.col("event_id") * 7 % 11).cast("string")))
    return e.where("is_written").groupBy(F.col("user_id").alias("func")).agg(F.array_join(regs, ",").alias("outgoing"))


_PRINT = """s AS (SELECT p_partkey AS func, p_size AS size, p_partkey % 5 AS insns, p_partkey % 3 AS blocks, len(p_name) AS shape FROM part),
t AS (SELECT p_partkey AS func, p_size AS size, (p_partkey + CAST(p_partkey % 4 = 0 AS INT)) % 5 AS insns, p_partkey % 3 AS blocks, len(p_name) AS shape FROM part)"""


def _prints(spark, sf_dir):
    p = star.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    cols = lambda insns: [k.alias("func"), F.col("p_size").alias("size"), insns.alias("insns"), (k % 3).alias("blocks"), F.length("p_name").cast("long").alias("shape")]
    return p.select(*cols(k % 5)), p.select(*cols((k + (k % 4 == 0).cast("int")) % 5))


@query(f"WITH {_PRINT} SELECT s.func AS source, t.func AS target FROM s JOIN t USING (size, insns, blocks, shape)")
def fingerprint_match(spark, sf_dir):
    return transfer.match_fingerprints(*_prints(spark, sf_dir))


@query(f"""
WITH {_PRINT} SELECT s.func, CASE WHEN s.insns <> t.insns THEN 'insns: ' || s.insns || ' -> ' || t.insns ELSE '' END AS why FROM s JOIN t USING (func)
""")
def fingerprint_mismatch(spark, sf_dir):
    s, t = _prints(spark, sf_dir)
    pairs = s.select("func", *[F.col(p).alias(f"s_{p}") for p in transfer.PARTS]).join(t.select("func", *[F.col(p).alias(f"t_{p}") for p in transfer.PARTS]), "func")
    return transfer.mismatch(pairs).select("func", "why")


@query(f"""
WITH t AS (SELECT l_orderkey AS func, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey)::UHUGEINT[] AS tags FROM lineitem GROUP BY l_orderkey),
h AS (SELECT func, list_reduce(list_prepend({transfer.START}::UHUGEINT, tags), lambda h, t: (xor(h, t) * {transfer.TIMES}::UHUGEINT) % 18446744073709551616::UHUGEINT)::HUGEINT AS u FROM t)
SELECT func, CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) AS shape FROM h
""")
def shape_hashes(spark, sf_dir):
    """Order-sensitive 64-bit folds with wrapping multiplication."""
    e = star.table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return transfer.shape_hash(e.select(F.col("l_orderkey").alias("func"), F.row_number().over(order).alias("pos"), F.col("l_partkey").alias("tag")))


@query("""
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN o.label ELSE c_name END AS name, CASE WHEN c_mktsegment <> '' THEN c_mktsegment ELSE o.seg END AS segment
FROM customer LEFT JOIN (SELECT o_custkey, 'order_' || max(o_orderkey) AS label, max(o_orderpriority) AS seg FROM orders GROUP BY o_custkey) o ON o.o_custkey = c_custkey
WHERE c_custkey % 3 <> 0 OR o.label IS NOT NULL
""")
def metadata_upsert(spark, sf_dir):
    c = star.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    o = star.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.concat(F.lit("order_"), F.max("o_orderkey")).alias("label"), F.max("o_orderpriority").alias("segment"))
    named = transfer.upsert(c.where("id % 3 = 0"), o.select("id", F.col("label").alias("name")), "id", ["name"])
    named = named.join(o.select("id"), "id", "left_semi").unionByName(c.where("id % 3 <> 0"))
    return transfer.upsert(named, o.select("id", "segment"), "id", ["segment"], overwrite=False)


@query(f"""
WITH RECURSIVE {flow_sql(0)}, {FUNC}, w(node, depth) AS (SELECT DISTINCT src, 0 FROM edge JOIN func ON id = src AND system UNION SELECT dst, depth + 1 FROM w JOIN edge ON src = node WHERE depth < 3)
SELECT node AS ordinal, CAST(min(depth) AS INT) AS depth FROM w GROUP BY node
""")
def type_closure(spark, sf_dir):
    e = stash(star.links(spark, sf_dir, 0), "types")
    used = star.functions(spark, sf_dir).where("system").select(F.col("id").alias("src"))
    return provenance.type_closure(e, e.join(used, "src").select(F.col("src").alias("ordinal")), 3)


@query(f"""
WITH {FUNC}, {flow_sql(0)},
l AS (
  SELECT a.name || ' A:' || CASE ref % 4 WHEN 0 THEN 'L(' || b.name || ')' WHEN 1 THEN 'P(' || b.name || ')' WHEN 2 THEN 'C(0x0)' ELSE 'U()' END AS line, src * 1000000 + dst AS seq
  FROM flow JOIN func a ON a.id = src JOIN func b ON b.id = dst)
SELECT line, min(seq) AS seq FROM l GROUP BY line
""")
def ptn_lines(spark, sf_dir):
    f = star.functions(spark, sf_dir).select("id", "name")
    x = star.flow(spark, sf_dir, 0).join(f.select(F.col("id").alias("src"), F.col("name").alias("a")), "src").join(f.select(F.col("id").alias("dst"), F.col("name").alias("b")), "dst")
    kind = F.element_at(F.array(F.lit("L"), F.lit("P"), F.lit("C"), F.lit("D")), (F.col("ref") % 4 + 1).cast("int"))
    return render.first_lines(x.select(F.concat(F.col("a"), F.lit(" A:"), origin_of(kind, F.col("b"))).alias("line"), (F.col("src") * 1000000 + F.col("dst")).alias("seq")))
