"""Queries on the structure of the reference graph, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import edges, render, traverse
from graphloom.plans.collect import collector
from graphloom.plans.stash import stash
from graphloom.sources import star
from graphloom.sources.star import BASE, FUNC, STEP, flow_sql

QUERIES, SQL, query = collector()


_TYPES = "['direct_call', 'indirect_call', 'data_ref', 'immediate_ref', 'tail_call', 'virtual_call', 'jump_table']"


@query(f"""
WITH RECURSIVE {flow_sql(0)}, {FUNC},
seed AS (SELECT min(src) AS node FROM edge),
hop(node, depth) AS (SELECT node, 0 FROM seed UNION SELECT e.dst, depth + 1 FROM hop JOIN edge e ON e.src = hop.node WHERE depth < 2),
near AS (SELECT node, min(depth) AS depth FROM hop GROUP BY node),
typed AS (SELECT src, dst, list_sort(list(DISTINCT ref)) AS types FROM flow GROUP BY src, dst)
SELECT CAST(n.depth AS INT) AS depth, a.name AS src_name, b.name AS dst_name,
       array_to_string(list_transform(types, lambda t: {_TYPES}[t + 1]), '/') AS types_label, n.depth = 0 AS is_seed
FROM near n JOIN typed t ON t.src = n.node JOIN func a ON a.id = t.src JOIN func b ON b.id = t.dst WHERE n.depth < 2
""")
def typed_neighbourhood(spark, sf_dir):
    """The flagship: typed edges within two steps of the first function that refers to another."""
    refs = star.flow(spark, sf_dir, 0)
    typed = edges.dedup_types(refs)
    seed = typed.agg(F.min("src").alias("node"))
    near = traverse.layers(typed, seed, 1)
    f = star.functions(spark, sf_dir).select("id", "name")
    out = typed.join(near.withColumnRenamed("node", "src"), "src")
    out = out.join(f.select(F.col("id").alias("src"), F.col("name").alias("src_name")), "src").join(f.select(F.col("id").alias("dst"), F.col("name").alias("dst_name")), "dst")
    return out.select("depth", "src_name", "dst_name", render.type_label(F.col("types")).alias("types_label"), (F.col("depth") == 0).alias("is_seed"))


@query(f"WITH {flow_sql(0)} SELECT src, dst, array_to_string(list_sort(list(DISTINCT ref)), ',') AS types FROM flow GROUP BY src, dst")
def edge_dedup_types(spark, sf_dir):
    return edges.dedup_types(star.flow(spark, sf_dir, 0)).select("src", "dst", F.array_join("types", ",").alias("types"))


@query(f"""
WITH {flow_sql(0)}
SELECT DISTINCT dst AS func, src AS caller, CASE WHEN ref = 4 THEN 'tail_call' ELSE 'direct_call' END AS type FROM flow WHERE ref IN (0, 4)
""")
def inbound_direct_tail(spark, sf_dir):
    refs = star.flow(spark, sf_dir, 0).where(F.col("ref").isin(0, 4))
    return refs.select(F.col("dst").alias("func"), F.col("src").alias("caller"), F.when(F.col("ref") == 4, "tail_call").otherwise("direct_call").alias("type")).distinct()


@query(f"""
WITH {FUNC}, p AS (SELECT DISTINCT {BASE} + {STEP} * l_partkey + l_suppkey % 80 AS addr FROM lineitem)
SELECT addr, start_ AS func_start, id AS func_id FROM p JOIN func ON start_ <= addr AND addr < end_
""")
def func_containing(spark, sf_dir):
    lines = star.table(spark, sf_dir, "lineitem")
    points = lines.select((F.lit(BASE) + F.col("l_partkey") * STEP + F.col("l_suppkey") % 80).alias("addr")).distinct()
    return edges.containing(points, star.functions(spark, sf_dir)).select("addr", "func_start", "func_id")


@query(f"""
WITH {FUNC}, x AS (SELECT {BASE} + {STEP} * l_partkey + l_linenumber * 5 AS src_addr, {BASE} + {STEP} * (l_suppkey * 20) AS dst_addr, l_linenumber - 1 AS ref FROM lineitem)
SELECT DISTINCT a.id AS src, b.id AS dst, CAST(ref AS INT) AS ref FROM x JOIN func a ON a.start_ <= src_addr AND src_addr < a.end_ JOIN func b ON b.start_ = dst_addr WHERE a.id <> b.id
""")
def outbound_by_address(spark, sf_dir):
    """References from instructions: each belongs to the function that holds its address and leads to one that starts at its target."""
    li = star.table(spark, sf_dir, "lineitem")
    x = li.select((F.lit(BASE) + F.col("l_partkey") * STEP + F.col("l_linenumber") * 5).alias("addr"), (F.lit(BASE) + F.col("l_suppkey") * 20 * STEP).alias("start"), (F.col("l_linenumber") - 1).alias("ref")).distinct()
    f = star.functions(spark, sf_dir)
    out = edges.containing(x, f).withColumnRenamed("func_id", "src").join(f.select("start", F.col("id").alias("dst")), "start")
    return out.where("src <> dst").select("src", "dst", F.col("ref").cast("int").alias("ref")).distinct()


@query("""
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS def_id
FROM events QUALIFY event_type = 'click'
""")
def def_lookback(spark, sf_dir):
    rows = star.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    out = edges.last_definition(rows, "user_id", ["ts", "event_id"], F.col("event_type") == "click", F.col("event_type") == "view", F.col("event_id"))
    return out.select("event_id", "user_id", F.col("found").alias("def_id"))


@query("""
SELECT event_id, user_id FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
WHERE event_type = 'view' AND n = 'click'
""")
def push_ret_adjacent(spark, sf_dir):
    rows = star.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return edges.followed_by(rows, "user_id", ["ts", "event_id"], "event_type", "view", "click").select("event_id", "user_id")


@query("""
WITH c AS (SELECT DISTINCT l_partkey AS src, (l_suppkey * 20 + l_linenumber) * 8 AS off_ FROM lineitem),
s AS (SELECT p_partkey * 8 AS off_, p_partkey AS func FROM part UNION SELECT (p_partkey + 1) * 8, p_partkey FROM part)
SELECT DISTINCT src, func AS dst FROM c JOIN s USING (off_) WHERE src <> func
""")
def virtual_dispatch(spark, sf_dir):
    calls = star.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), ((F.col("l_suppkey") * 20 + F.col("l_linenumber")) * 8).alias("offset"))
    p = star.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("func"))
    return edges.virtual_dispatch(calls, p.select((F.col("func") * 8).alias("offset"), "func").union(p.select((F.col("func") + 1) * 8, "func")))


@query("""
WITH s AS (SELECT o_custkey % 5 AS region, (o_orderkey // 3) * 8 AS slot, min(o_custkey) AS func FROM orders GROUP BY 1, 2),
t AS (SELECT *, slot - row_number() OVER (PARTITION BY region ORDER BY slot) * 8 AS island FROM s),
u AS (SELECT *, count(*) OVER (PARTITION BY region, island) AS n, min(slot) OVER (PARTITION BY region, island) AS table_start FROM t)
SELECT CAST(region AS BIGINT) AS region, table_start, slot - table_start AS offset, func FROM u WHERE n >= 3
""")
def vtable_runs(spark, sf_dir):
    o = star.table(spark, sf_dir, "orders")
    slots = o.select((F.col("o_custkey") % 5).alias("region"), (F.floor(F.col("o_orderkey") / 3) * 8).alias("slot"), F.col("o_custkey").alias("func"))
    return edges.table_runs(slots)


@query("""
WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx, event_type = 'purchase' AS bad FROM events),
b AS (SELECT *, min(CASE WHEN bad THEN idx END) OVER (PARTITION BY user_id) AS fb FROM e)
SELECT user_id, event_id, idx FROM b WHERE idx <= 20 AND (fb IS NULL OR idx < fb)
""")
def jump_table_prefix(spark, sf_dir):
    e = star.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    e = e.withColumn("idx", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long"))
    return edges.until_bad(e, "user_id", "idx", F.col("event_type") == "purchase").select("user_id", "event_id", "idx")


def _bfs(forward: bool) -> str:
    a, b = ("src", "dst") if forward else ("dst", "src")
    return f"""
WITH RECURSIVE {flow_sql(0)}, seed AS (SELECT min({a}) AS node FROM edge),
hop(node, depth) AS (SELECT node, 0 FROM seed UNION SELECT e.{b}, depth + 1 FROM hop JOIN edge e ON e.{a} = hop.node WHERE depth < 4)
SELECT node, CAST(min(depth) AS INT) AS depth FROM hop GROUP BY node"""


@query(_bfs(False))
def caller_bfs(spark, sf_dir):
    e = star.links(spark, sf_dir, 0)
    return traverse.layers(e, e.agg(F.min("dst").alias("node")), 4, backwards=True)


@query(_bfs(True))
def callee_bfs(spark, sf_dir):
    e = star.links(spark, sf_dir, 0)
    return traverse.layers(e, e.agg(F.min("src").alias("node")), 4)


def condensed_sql(anchors: str = "SELECT node FROM n WHERE false") -> str:
    """Strong components by mutual reachability, and their graph without cycles."""
    return f"""{flow_sql(0)}, n AS (SELECT src AS node FROM edge UNION SELECT dst FROM edge),
path(a, b) AS (SELECT src, dst FROM edge UNION SELECT a, dst FROM path JOIN edge ON src = b),
comp AS (
  SELECT node, least(node, coalesce(min(r.b), node)) AS scc
  FROM n LEFT JOIN (SELECT x.a, x.b FROM path x JOIN path y ON x.a = y.b AND x.b = y.a) r ON r.a = node GROUP BY node),
csize AS (SELECT scc, count(*) AS size FROM comp GROUP BY scc),
dag AS (SELECT DISTINCT a.scc AS src, b.scc AS dst FROM edge JOIN comp a ON a.node = src JOIN comp b ON b.node = dst WHERE a.scc <> b.scc),
root AS (SELECT scc AS node FROM csize WHERE scc NOT IN (SELECT dst FROM dag) UNION SELECT scc FROM comp WHERE node IN ({anchors})),
creach(a, b) AS (SELECT src, dst FROM dag UNION SELECT a, dst FROM creach JOIN dag ON src = b),
long_(scc, k) AS (SELECT scc, 0 FROM csize WHERE scc NOT IN (SELECT dst FROM dag) UNION SELECT dst, k + 1 FROM long_ JOIN dag ON src = scc),
short_(scc, k) AS (SELECT node, 1 FROM root UNION SELECT dst, k + 1 FROM short_ JOIN dag ON src = scc),
away(d, scc) AS (SELECT c.scc, r.node FROM csize c, root r WHERE c.scc <> r.node UNION SELECT d, dst FROM away JOIN dag ON src = scc WHERE dst <> d),
sig AS (
  SELECT comp.node, comp.scc, (SELECT size FROM csize c WHERE c.scc = comp.scc) + coalesce((SELECT sum(size) FROM creach JOIN csize c ON c.scc = b WHERE a = comp.scc), 0) AS reach,
         (SELECT count(*) FROM n) - coalesce((SELECT sum(size) FROM away w JOIN csize c ON c.scc = w.scc WHERE d = comp.scc), 0) AS dom,
         (SELECT max(k) FROM long_ w WHERE w.scc = comp.scc) AS level, (SELECT min(k) FROM short_ w WHERE w.scc = comp.scc) AS depth
  FROM comp)"""


@query(f"WITH RECURSIVE {condensed_sql()} SELECT node, scc FROM comp")
def scc_members(spark, sf_dir):
    return traverse.strong_components(star.links(spark, sf_dir, 0))


def _condensed(spark, sf_dir):
    e = stash(star.links(spark, sf_dir, 0), "graph")
    return traverse.condensation(e, e.select(F.col("src").alias("node")).union(e.select("dst")).distinct())


@query(f"WITH RECURSIVE {condensed_sql()} SELECT node, CAST(reach AS BIGINT) AS reach FROM sig")
def reach_size(spark, sf_dir):
    """Nodes that can be reached, the node's component included."""
    scc, size, dag = _condensed(spark, sf_dir)
    return scc.join(traverse.reach_exact(dag, size), "scc").select("node", "reach")


#: The flow of line items is one large component; a customer's orders make a deep graph without cycles.
_LATER = """o AS (SELECT o_orderkey AS id, lead(o_orderkey) OVER w AS n1, lead(o_orderkey, 3) OVER w AS n3 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
dag AS (SELECT DISTINCT id AS src, n AS dst FROM (SELECT id, unnest([n1, n3]) AS n FROM o) WHERE n IS NOT NULL)"""


def _later_orders(spark, sf_dir):
    """Each order leads to its customer's next one and to the third after it."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    e = star.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.array(F.lead("o_orderkey").over(order), F.lead("o_orderkey", 3).over(order)).alias("to"))
    return e.select("src", F.explode("to").alias("dst")).where("dst is not null").distinct()


@query(f"""
WITH RECURSIVE {_LATER},
total AS (SELECT count(*) AS n FROM orders),
depth(node, k) AS (SELECT o_orderkey, 0 FROM orders UNION SELECT src, k + 1 FROM depth JOIN dag ON dst = node),
h AS (SELECT node, max(k) AS h FROM depth GROUP BY node),
r(node, est, k) USING KEY (node) AS (
  SELECT node, CAST(1 AS DOUBLE), 0 FROM h WHERE h = 0
  UNION
  SELECT h.node, least(1 + sum(y.est), max(total.n)), h.h
  FROM (SELECT DISTINCT k + 1 AS k FROM r) x JOIN h ON h.h = x.k JOIN dag ON dag.src = h.node JOIN recurring.r y ON y.node = dag.dst, total GROUP BY h.node, h.h)
SELECT node, CAST(est AS BIGINT) AS estimate FROM r
""")
def reach_estimate(spark, sf_dir):
    """What each order leads to, estimated by levels without pairs (what several paths lead to counts several times, up to the number of orders)."""
    e = stash(_later_orders(spark, sf_dir), "later")
    size = star.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scc")).distinct().withColumn("size", F.lit(1).cast("long"))
    return traverse.reach_estimate(e, stash(size, "later")).select(F.col("scc").alias("node"), F.col("reach").alias("estimate"))


@query(f"WITH RECURSIVE {condensed_sql()} SELECT node, CAST(level AS INT) AS level FROM sig")
def topo_level(spark, sf_dir):
    """The longest path of components that ends at a node's own."""
    scc, size, dag = _condensed(spark, sf_dir)
    at = traverse.levels(dag, size.select(F.col("scc").alias("node"))).withColumnRenamed("node", "scc")
    return scc.join(at, "scc").select("node", "level")


@query(f"WITH RECURSIVE {condensed_sql()} SELECT node, CAST(dom AS BIGINT) AS subtree FROM sig")
def dominator_subtree(spark, sf_dir):
    """Nodes in components that a node's own dominates."""
    scc, size, dag = _condensed(spark, sf_dir)
    pairs = traverse.dominators(dag, size.select(F.col("scc").alias("node")))
    return scc.join(traverse.dominated(pairs, size), "scc").select("node", F.col("dom").alias("subtree"))
