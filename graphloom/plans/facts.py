"""Queries on values, annotations and their bookkeeping, each with its SQL.

A line item stands for an argument of a call: its part is the calling function,
its order the address, its supplier the callee.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import facts
from graphloom.plans.collect import collector
from graphloom.sources import star
from graphloom.sources.star import BASE, FUNC, STEP

QUERIES, SQL, query = collector()

_ORIGIN = "CASE l_returnflag WHEN 'R' THEN 'L' || CAST(l_quantity AS BIGINT) WHEN 'A' THEN 'P' || l_linenumber WHEN 'N' THEN CASE WHEN l_quantity < 10 THEN NULL ELSE 'G' || CAST(l_quantity AS BIGINT) END END"
_FACTS = f"""{FUNC},
l AS (
  SELECT l_partkey AS func, l_orderkey AS addr, CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE l_suppkey END AS callee, CAST(l_linenumber - 1 AS BIGINT) AS arg,
         {_ORIGIN} AS origin, l_linestatus = 'F' AS closed, l_tax < 0.02 AS is_call, {BASE} + {STEP} * l_suppkey + CAST(l_linenumber - 1 AS BIGINT) AS obj
  FROM lineitem),
use AS (SELECT DISTINCT func, addr, callee, arg, origin FROM l WHERE callee IS NOT NULL AND origin IS NOT NULL),
ali AS (
  SELECT DISTINCT func, addr, arg AS var, CASE WHEN is_call THEN 'R' || coalesce(CAST(callee AS VARCHAR), '?') ELSE origin END AS origin, CASE WHEN is_call THEN 'high' ELSE 'med' END AS conf
  FROM l WHERE closed AND (is_call OR origin IS NOT NULL)),
acc AS (
  SELECT DISTINCT func, obj, 'write' AS access FROM l WHERE closed
  UNION SELECT func, obj, 'read' FROM l WHERE NOT closed AND obj NOT IN (SELECT start_ FROM func)),
inc AS (
  SELECT callee, arg, string_agg(DISTINCT 'F' || func || ':' || origin || '/med', ' ' ORDER BY 'F' || func || ':' || origin || '/med') AS origins FROM use GROUP BY callee, arg)"""


def _items(spark, sf_dir):
    c = F.col
    quantity = c("l_quantity").cast("long")
    origin = F.when(c("l_returnflag") == "R", F.concat(F.lit("L"), quantity)).when(c("l_returnflag") == "A", F.concat(F.lit("P"), c("l_linenumber")))
    origin = origin.when((c("l_returnflag") == "N") & (c("l_quantity") >= 10), F.concat(F.lit("G"), quantity))
    return star.table(spark, sf_dir, "lineitem").select(
        c("l_partkey").alias("func"), c("l_orderkey").alias("addr"), F.when(c("l_suppkey") % 10 != 0, c("l_suppkey")).alias("callee"), (c("l_linenumber") - 1).cast("long").alias("arg"),
        origin.alias("origin"), (c("l_linestatus") == "F").alias("closed"), (c("l_tax") < 0.02).alias("is_call"), (F.lit(BASE) + STEP * c("l_suppkey") + c("l_linenumber") - 1).cast("long").alias("obj"),
    )


def _all(spark, sf_dir):
    items, f = _items(spark, sf_dir), star.functions(spark, sf_dir)
    uses = facts.argument_uses(items)
    alias = facts.aliases(items.where("closed").select("func", "addr", F.col("arg").alias("var"), "is_call", "callee", "origin", F.lit("med").alias("conf")))
    accesses = facts.global_accesses(items.select("func", "obj", F.col("closed").alias("is_left")), f)
    return f, uses, alias, accesses


@query(f"WITH {_FACTS} SELECT * FROM use")
def argument_uses(spark, sf_dir):
    return _all(spark, sf_dir)[1]


@query(f"WITH {_FACTS} SELECT * FROM ali")
def value_aliases(spark, sf_dir):
    return _all(spark, sf_dir)[2]


@query(f"WITH {_FACTS} SELECT * FROM acc")
def global_accesses(spark, sf_dir):
    return _all(spark, sf_dir)[3]


@query(f"WITH {_FACTS} SELECT * FROM inc")
def incoming_origins(spark, sf_dir):
    return facts.incoming(_all(spark, sf_dir)[1])


@query(f"""
WITH {_FACTS},
t AS (
  SELECT id AS func, 0 AS kind, 'D ' || name AS line FROM func
  UNION SELECT func, 1, 'A v' || var || '=' || origin || '/' || conf FROM ali
  UNION SELECT callee, 2, 'I ' || arg || ' ' || origins FROM inc
  UNION SELECT func, 3, 'E F' || callee || ':' || arg || '=' || origin FROM use
  UNION SELECT func, 4, 'G ' || access || ' ' || obj FROM acc)
SELECT func, string_agg(line, chr(10) ORDER BY kind, line) AS text FROM t WHERE func IN (SELECT id FROM func) GROUP BY func
""")
def function_annotations(spark, sf_dir):
    f, uses, alias, accesses = _all(spark, sf_dir)
    return facts.annotations(f.select(F.col("id").alias("func"), "name"), alias, uses, facts.incoming(uses), accesses)


@query(f"""
WITH {_FACTS}, h AS (SELECT func, addr, 'F' || callee || ':' || arg || '=' || origin AS h FROM use UNION SELECT func, addr, 'v' || var || '=' || origin FROM ali)
SELECT func, addr, string_agg(h, '; ' ORDER BY h) AS hint FROM h GROUP BY func, addr
""")
def instruction_hints(spark, sf_dir):
    _, uses, alias, _ = _all(spark, sf_dir)
    return facts.hints(uses, alias)


@query(f"""
WITH {_FACTS}, w AS (SELECT id FROM func WHERE system),
fl AS (SELECT DISTINCT a.func AS writer, b.func AS reader, obj FROM acc a JOIN acc b USING (obj) WHERE a.access = 'write' AND b.access = 'read' AND a.func <> b.func)
SELECT * FROM fl WHERE writer IN (FROM w) OR reader IN (FROM w)
""")
def wanted_flows(spark, sf_dir):
    """Flows through globals from or to chosen functions; the choice comes before the pairs are made."""
    f, _, _, accesses = _all(spark, sf_dir)
    wanted = f.where("system").select(F.col("id").alias("node"))
    writes, reads = (accesses.where(F.col("access") == a).select(F.col("func").alias(n), "obj") for a, n in (("write", "writer"), ("read", "reader")))
    from_them = writes.join(wanted.withColumnRenamed("node", "writer"), "writer", "left_semi").join(reads, "obj")
    to_them = writes.join(reads.join(wanted.withColumnRenamed("node", "reader"), "reader", "left_semi"), "obj")
    flows = from_them.unionByName(to_them).where("writer <> reader").distinct()
    return facts.touching(flows.select("writer", "reader", "obj"), wanted)


@query("""
WITH s AS (SELECT conv_id AS func, text, min(turn) AS seq FROM conversations WHERE text IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY min(turn), text) <= 48),
t AS (SELECT func, unnest(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: len(x) >= 3)[1 : 8]) AS token, CASE WHEN len(text) > 160 THEN 0.5 ELSE 1.0 END AS w FROM s),
d AS (SELECT conv_id AS func, lower(role) AS token, 3.0 AS w FROM (SELECT DISTINCT conv_id, role FROM conversations WHERE role IS NOT NULL))
SELECT func, token, CAST(sum(w) AS DOUBLE) AS w FROM (SELECT * FROM t UNION ALL SELECT * FROM d) GROUP BY func, token
""")
def token_evidence(spark, sf_dir):
    """Weighted tokens of each function, here a conversation: its strings with their caps, and names that count three times."""
    c = star.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("func"), F.col("turn").alias("seq"), "text", "role")
    names = c.where("role is not null").select("func", F.lower("role").alias("token")).distinct().withColumn("w", F.lit(3.0))
    return facts.evidence(facts.string_tokens(c.where("text is not null")), names)


@query("""
SELECT o_custkey % 50 AS cluster, o_orderpriority AS stem, count(*) AS votes FROM orders GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY count(*) DESC, o_orderpriority) = 1
""")
def stem_votes(spark, sf_dir):
    o = star.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("cluster"), F.col("o_orderpriority").alias("stem"))
    return facts.most_voted(o, "cluster", "stem")


@query("SELECT p_type AS name, min(p_partkey) AS ordinal, arg_min(p_name, p_partkey) AS decl FROM part GROUP BY p_type")
def types_first_by_name(spark, sf_dir):
    p = star.table(spark, sf_dir, "part").select(F.col("p_type").alias("name"), F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("decl"))
    return facts.first_by_name(p)


@query("""
WITH s AS (SELECT 0 AS region, (o_orderkey // 3) * 8 AS slot, min(o_custkey) AS func FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2),
t AS (SELECT *, slot - row_number() OVER (PARTITION BY region ORDER BY slot) * 8 AS island FROM s),
u AS (SELECT *, count(*) OVER (PARTITION BY island) AS n, min(slot) OVER (PARTITION BY island) AS table_start FROM t)
SELECT table_start, string_agg('+' || (slot - table_start) || ':' || func, ' ' ORDER BY slot) AS entries FROM u WHERE n >= 3 GROUP BY table_start
""")
def vtable_report(spark, sf_dir):
    """Each virtual table on a line; runs are found over the whole range of addresses."""
    from graphloom.operators import edges

    o = star.table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    slots = o.select(F.lit(0).alias("region"), (F.floor(F.col("o_orderkey") / 3) * 8).alias("slot"), F.col("o_custkey").alias("func"))
    return facts.table_report(edges.table_runs(slots))[0].select("table_start", "entries")


@query("""
SELECT o_custkey AS func, coalesce(string_agg(o_orderkey % 97, ',' ORDER BY o_orderkey) FILTER (WHERE o_orderstatus = 'F'), '') AS params,
       coalesce(string_agg(o_orderkey % 97, ',' ORDER BY o_orderkey) FILTER (WHERE o_orderstatus <> 'F'), '') AS locals
FROM orders GROUP BY o_custkey
""")
def local_variables(spark, sf_dir):
    o = star.table(spark, sf_dir, "orders")
    v = o.select(F.col("o_custkey").alias("func"), F.col("o_orderkey").alias("idx"), (F.col("o_orderkey") % 97).cast("string").alias("name"), (F.col("o_orderstatus") == "F").alias("is_arg"))
    return facts.locals_of(v)


@query("SELECT event_id, user_id, event_type AS name, CASE WHEN value < 50 THEN '' ELSE 'double' END AS type FROM events WHERE event_type <> 'view' OR value >= 50")
def saved_local_settings(spark, sf_dir):
    e = star.table(spark, sf_dir, "events")
    rows = e.select("event_id", "user_id", F.col("event_type").alias("kind"), F.when(F.col("value") < 50, "").otherwise("double").alias("type"))
    rows = rows.withColumn("name", F.when(F.col("kind") == "view", "").otherwise(F.col("kind")))
    return facts.saved_locals(rows).select("event_id", "user_id", F.col("kind").alias("name"), "type")


@query(f"""
WITH {FUNC}, c AS (SELECT DISTINCT l_partkey AS func, {BASE} + {STEP} * l_partkey + CAST(l_quantity AS BIGINT) AS addr, l_returnflag AS text FROM lineitem)
SELECT c.* FROM c JOIN func ON id = func WHERE addr < end_
""")
def comments_inside(spark, sf_dir):
    li = star.table(spark, sf_dir, "lineitem")
    c = li.select(F.col("l_partkey").alias("func"), (F.lit(BASE) + STEP * F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("addr"), F.col("l_returnflag").alias("text")).distinct()
    return facts.applicable_comments(c, star.functions(spark, sf_dir)).select("func", "addr", "text")


@query("""
WITH m AS (SELECT t.p_partkey IS NOT NULL AS f, t.p_size = s.p_size AS same, s.p_type IS NOT NULL AS ty, s.p_retailprice > 950 AS ow FROM part s LEFT JOIN part t ON t.p_partkey = s.p_partkey * 2)
SELECT count_if(f) AS found, count_if(f AND same) AS verified, count_if(f AND NOT same) AS mismatched, count_if(NOT f) AS missing, count_if(ty) AS types, count_if(f AND same AND ow) AS applied FROM m
""")
def apply_counters(spark, sf_dir):
    p = star.table(spark, sf_dir, "part")
    t = p.select((F.col("p_partkey")).alias("k"), F.col("p_size").alias("size"))
    m = p.join(t, F.col("p_partkey") * 2 == F.col("k"), "left")
    m = m.select(F.col("k").isNotNull().alias("found"), (F.col("p_size") == F.col("size")).alias("same"), F.col("p_type").isNotNull().alias("has_type"), (F.col("p_retailprice") > 950).alias("overwrite"))
    return facts.apply_counts(m)


@query("""
WITH m AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE (p_size * 7) % 31 END AS cluster FROM part),
f AS (SELECT cluster, min(node) AS first_, cluster >= 28 AS utility FROM m WHERE cluster IS NOT NULL GROUP BY cluster),
n AS (SELECT cluster, row_number() OVER (ORDER BY utility, first_) - 1 AS id FROM f)
SELECT node, coalesce(id, -1) AS id FROM m LEFT JOIN n USING (cluster)
""")
def final_cluster_ids(spark, sf_dir):
    p = star.table(spark, sf_dir, "part")
    m = p.select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") % 9 != 0, (F.col("p_size") * 7) % 31).alias("cluster"))
    return facts.final_ids(m.withColumn("utility", F.col("cluster") >= 28))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment || '::' || c_custkey END AS shown FROM customer")
def readable_names(spark, sf_dir):
    c = star.table(spark, sf_dir, "customer")
    demangled = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat("c_mktsegment", F.lit("::"), "c_custkey"))
    return facts.readable(c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), demangled.alias("demangled")))


@query("""
WITH r AS (SELECT DISTINCT l_partkey AS func, l_suppkey % 20 AS ordinal, l_linenumber * 8 AS off_ FROM lineitem),
p AS (SELECT func, ordinal, string_agg(off_, '/' ORDER BY off_) AS o FROM r GROUP BY func, ordinal)
SELECT func, string_agg(ordinal, ',' ORDER BY ordinal) AS ordinals, string_agg(ordinal || '@' || o, ' ' ORDER BY ordinal) AS offsets FROM p GROUP BY func
""")
def referenced_types(spark, sf_dir):
    li = star.table(spark, sf_dir, "lineitem")
    return facts.referenced_types(li.select(F.col("l_partkey").alias("func"), (F.col("l_suppkey") % 20).alias("ordinal"), (F.col("l_linenumber") * 8).alias("offset")))
