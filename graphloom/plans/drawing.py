"""Queries on subsystems and on what is drawn, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import notation
from graphloom.operators import centrality, cluster, edges, metagraph, render
from graphloom.plans.collect import collector
from graphloom.plans.stash import stash
from graphloom.sources import star
from graphloom.sources.star import FUNC, ORDER_CALLS, flow_sql

QUERIES, SQL, query = collector()


_AFFINITY = f"""{flow_sql(0)}, {FUNC},
c AS (SELECT DISTINCT src, dst FROM flow WHERE ref = 0),
few AS (SELECT src FROM c GROUP BY src HAVING count(*) <= 40),
t AS (SELECT DISTINCT l_partkey AS node, l_orderkey AS r FROM lineitem),
d AS (SELECT r, count(*) AS df FROM t GROUP BY r HAVING count(*) >= 2 AND count(*) <= greatest(8, (SELECT count(*) FROM part) // 20)),
f AS (SELECT id, start_ FROM func),
nx AS (SELECT id AS a, start_, unnest([lead(id, 1) OVER w, lead(id, 2) OVER w, lead(id, 3) OVER w, lead(id, 4) OVER w, lead(id, 5) OVER w, lead(id, 6) OVER w]) AS b FROM f WINDOW w AS (ORDER BY start_, id)),
p AS (
  SELECT src AS a, dst AS b, CAST(1.0 AS DOUBLE) AS w FROM flow WHERE ref = 0
  UNION ALL SELECT src, dst, 0.5 FROM flow WHERE ref IN (1, 6) UNION ALL SELECT src, dst, 0.35 FROM flow WHERE ref = 5
  UNION ALL SELECT x.dst, y.dst, 0.35 FROM c x JOIN c y ON x.src = y.src AND x.dst < y.dst WHERE x.src IN (FROM few)
  UNION ALL SELECT x.node, y.node, ln((SELECT count(*) FROM part)::DOUBLE / df) FROM t x JOIN t y ON x.r = y.r AND x.node < y.node JOIN d ON d.r = x.r
  UNION ALL SELECT a, b, 0.6 * exp(-pow(g.start_ - nx.start_, 2) / (2 * 16384.0 * 16384.0)) FROM nx JOIN f g ON g.id = b WHERE b IS NOT NULL)"""


def _affinity(spark, sf_dir):
    refs = stash(star.flow(spark, sf_dir, 0), "refs")
    n = star.table(spark, sf_dir, "part").count()
    calls = refs.where("ref = 0")
    site = F.when(F.col("ref") == 0, 1.0).when(F.col("ref").isin(1, 6), 0.5).when(F.col("ref") == 5, 0.35)
    touches = star.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_orderkey").alias("resource"))
    f = star.functions(spark, sf_dir).select("id", "start")
    parts = [refs.select(F.col("src").alias("a"), F.col("dst").alias("b"), site.alias("w")).where("w is not null"), cluster.co_called(calls), cluster.shared_resources(touches, n), cluster.nearby(f)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return cluster.undirected(out)


@query(f"WITH {_AFFINITY} SELECT least(a, b) AS a, greatest(a, b) AS b, round(sum(w), 6) AS w FROM p WHERE a <> b GROUP BY 1, 2")
def affinity_edges(spark, sf_dir):
    return _affinity(spark, sf_dir).select("a", "b", F.round("w", 6).alias("w"))


@query(f"""
WITH RECURSIVE {flow_sql(0)}, {FUNC},
fan AS (SELECT dst AS node, count(DISTINCT src) AS callers FROM edge GROUP BY dst),
lim AS (SELECT greatest(3, list_sort(list(callers))[1 + CAST(floor(0.98 * (count(*) - 1)) AS INT)]) AS l FROM fan),
u AS (SELECT src AS a, dst AS b FROM edge UNION SELECT dst, src FROM edge),
k(k, node, v) AS (
  SELECT 0, a, count(*) FROM u GROUP BY a
  UNION ALL SELECT k, a, max(least(v, i)) FROM (
    SELECT k + 1 AS k, u.a, c.v, row_number() OVER (PARTITION BY u.a ORDER BY c.v DESC) AS i FROM k c JOIN u ON u.b = c.node WHERE k < 60)
  GROUP BY k, a)
SELECT node FROM fan JOIN k USING (node), lim WHERE k = 60 AND callers >= l AND v <= 2 UNION SELECT id FROM func WHERE system
""")
def utility_hubs(spark, sf_dir):
    e = stash(star.links(spark, sf_dir, 0), "hubs")
    system = star.functions(spark, sf_dir).where("system").select(F.col("id").alias("node"))
    return cluster.utility_hubs(stash(cluster.fan_in(e), "fans"), centrality.coreness(e), system)


_SINGLE = f"""{ORDER_CALLS},
entry_ AS (SELECT o_orderkey AS node FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'),
direct AS (SELECT DISTINCT src, dst FROM call_ WHERE ref = 0),
util AS (SELECT dst AS node FROM direct GROUP BY dst HAVING count(*) >= 12),
held AS (SELECT node FROM entry_ UNION SELECT node FROM util UNION SELECT dst FROM call_ WHERE ref = 5),
link AS (SELECT dst AS node, min(src) AS caller FROM direct GROUP BY dst HAVING count(*) = 1 AND dst NOT IN (FROM held) AND min(src) NOT IN (FROM util))"""


def _single(spark, sf_dir):
    """Single callers in the graph of orders: urgent pending ones are entries, those with 12 callers utilities."""
    refs = stash(star.order_calls(spark, sf_dir), "calls")
    direct = refs.where("ref = 0")
    entry = star.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'").select(F.col("o_orderkey").alias("node"))
    utilities = stash(cluster.fan_in(direct).where("callers >= 12").select("node"), "utilities")
    return cluster.single_callers(direct, entry.union(refs.where("ref = 5").select("dst")), utilities)


@query(f"WITH {_SINGLE} SELECT node, caller FROM link")
def single_caller_groups(spark, sf_dir):
    """Orders that belong to their only caller: neither entries nor targets of indirect references nor utilities."""
    return _single(spark, sf_dir)


@query(f"""
WITH RECURSIVE {_SINGLE},
walk_(node, up) AS (SELECT node, caller FROM link UNION SELECT w.node, link.caller FROM walk_ w JOIN link ON link.node = w.up),
cyc AS (SELECT node, max(up) AS root FROM walk_ WHERE node IN (SELECT node FROM walk_ WHERE node = up) GROUP BY node),
every AS (SELECT node FROM link UNION SELECT caller FROM link),
rooted AS (
  SELECT e.node, coalesce((SELECT root FROM cyc WHERE cyc.node = e.node), (SELECT min(root) FROM walk_ w JOIN cyc ON cyc.node = w.up WHERE w.node = e.node),
    (SELECT min(up) FROM walk_ w WHERE w.node = e.node AND up NOT IN (SELECT node FROM link)), e.node) AS root FROM every e)
SELECT r.node, CASE WHEN r.node <> r.root THEN caller END AS caller, r.root, min(r.node) OVER (PARTITION BY r.root) AS grp FROM rooted r LEFT JOIN link ON link.node = r.node
""")
def collapsed_groups(spark, sf_dir):
    """Orders gathered at the root of their single callers; a ring is cut at its largest order."""
    return cluster.collapse(_single(spark, sf_dir))


@query()
def louvain(spark, sf_dir):
    """Communities of the affinity graph, tiny ones merged; moves in turns are beyond SQL (tests look at modularity)."""
    e = stash(_affinity(spark, sf_dir), "affinity")
    return cluster.merge_tiny(cluster.communities(e), e)


_TIES = """g AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 7 = 0 THEN p_partkey ELSE p_size % 12 END AS cluster, p_brand AS module FROM part),
e AS (SELECT DISTINCT src AS a, dst AS b FROM flow)"""


def _members(spark, sf_dir):
    cluster_of = F.when(F.col("p_partkey") % 7 == 0, F.col("p_partkey")).otherwise(F.col("p_size") % 12)
    return star.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), cluster_of.alias("cluster"), F.col("p_brand").alias("module"))


@query(f"""
WITH {flow_sql(0)}, {_TIES}, tiny AS (SELECT cluster FROM g GROUP BY cluster HAVING count(*) < 2),
w AS (SELECT x, y, count(*) AS w FROM (
  SELECT p.cluster AS x, q.cluster AS y FROM e JOIN g p ON p.node = a JOIN g q ON q.node = b UNION ALL SELECT q.cluster, p.cluster FROM e JOIN g p ON p.node = a JOIN g q ON q.node = b) WHERE x <> y GROUP BY x, y),
t AS (SELECT x AS cluster, y AS into_ FROM w WHERE x IN (FROM tiny) QUALIFY row_number() OVER (PARTITION BY x ORDER BY w DESC, y) = 1)
SELECT node, coalesce(into_, cluster) AS cluster FROM g LEFT JOIN t USING (cluster)
""")
def merged_tiny(spark, sf_dir):
    """Clusters of one node join the cluster they are tied to most."""
    e = star.links(spark, sf_dir, 0).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1.0).alias("w"))
    return cluster.merge_tiny(_members(spark, sf_dir), e)


@query("""
WITH g AS (SELECT p_partkey AS node, p_size % 12 AS cluster, CASE WHEN p_size % 12 = 5 THEN 'one' ELSE p_brand END AS module FROM part),
n AS (SELECT cluster, sum(n) AS n, max(n) AS top, count(*) AS modules FROM (SELECT cluster, module, count(*) AS n FROM g GROUP BY 1, 2) GROUP BY cluster),
m AS (SELECT g.*, n > 40 AS large, modules >= 2 AND top < floor(0.95 * n) AS by_module, ceil(n / greatest(2, ceil(n / 40))) AS run FROM g JOIN n USING (cluster))
SELECT node, CAST(cluster AS BIGINT) AS cluster, CASE WHEN NOT large THEN 0 WHEN by_module THEN dense_rank() OVER (PARTITION BY cluster ORDER BY module) - 1
  ELSE CAST(floor((row_number() OVER (PARTITION BY cluster ORDER BY node) - 1) / run) AS BIGINT) END AS part FROM m
""")
def split_clusters(spark, sf_dir):
    """Large clusters by module, or where one module is nearly all of them in runs of addresses."""
    size = (F.col("p_size") % 12).cast("long")
    g = star.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), size.alias("cluster"), F.when(size == 5, "one").otherwise(F.col("p_brand")).alias("module"))
    return cluster.split_large(g, 40)


@query()
def subdivided_clusters(spark, sf_dir):
    """Clusters divided until none has more than 120 functions, on the whole affinity graph; local moves in turns are beyond SQL (tests have a plain version)."""
    size = (F.col("p_size") % 12).cast("long")
    g = star.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), size.alias("cluster"), F.when(size == 5, "one").otherwise(F.col("p_brand")).alias("module"))
    return cluster.subdivide(g, stash(_affinity(spark, sf_dir), "affinity"), 120)


_META = f"""{flow_sql(0)}, g AS (SELECT p_partkey AS node, p_size % 12 AS cluster FROM part),
m AS (SELECT a.cluster AS src_cluster, b.cluster AS dst_cluster, count(DISTINCT (src, dst)) AS count, array_to_string(list_sort(list(DISTINCT ref)), ',') AS types
      FROM flow JOIN g a ON a.node = src JOIN g b ON b.node = dst WHERE a.cluster <> b.cluster GROUP BY 1, 2)"""


def _meta(spark, sf_dir):
    of = star.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size") % 12).alias("cluster"))
    return cluster.meta_edges(star.flow(spark, sf_dir, 0), of)


@query(f"WITH {_META} SELECT * FROM m")
def meta_edges(spark, sf_dir):
    return _meta(spark, sf_dir).select("src_cluster", "dst_cluster", "count", F.array_join("types", ",").alias("types"))


@query(f"""
WITH {_META}, k AS (SELECT * FROM m WHERE src_cluster <> 3 AND dst_cluster <> 3),
e AS (SELECT *, unnest([src_cluster, dst_cluster]) AS node FROM k),
best AS (SELECT src_cluster, dst_cluster FROM e QUALIFY row_number() OVER (PARTITION BY node ORDER BY count DESC, src_cluster, dst_cluster) = 1)
SELECT src_cluster, dst_cluster, count FROM k WHERE count >= greatest(3, (SELECT max(count) * 6 // 100 FROM k)) OR (src_cluster, dst_cluster) IN (FROM best)
""")
def meta_backbone(spark, sf_dir):
    m = stash(_meta(spark, sf_dir), "meta")
    return cluster.backbone(m, m.sparkSession.createDataFrame([(3,)], "cluster int"))


@query(f"""
WITH {_META}
SELECT src_cluster, dst_cluster, round(least(6, 0.8 + 0.9 * log2(1.0 + count)), 6) AS pen,
  CAST(trunc(round(greatest(64, least(204, 64 + 140 * log2(1.0 + count) / log2(1.0 + max(count) OVER ()))), 6)) AS INT) AS alpha FROM m
""")
def meta_styles(spark, sf_dir):
    m = stash(_meta(spark, sf_dir), "meta")
    top = m.agg(F.max("count").alias("top"))
    alpha = F.floor(F.round(notation.clamp(64 + 140 * F.log2(1.0 + F.col("count")) / F.log2(1.0 + F.col("top")), 64.0, 204.0), 6)).cast("int")
    return m.crossJoin(F.broadcast(top)).select("src_cluster", "dst_cluster", F.round(notation.edge_pen(F.col("count")), 6).alias("pen"), alpha.alias("alpha"))


_KINDS = sorted(metagraph.STYLES) + ["", "unknown"]
_STYLES = ", ".join(f"('{k}', '{f}', '{b}', '{n}')" for k, (f, b, n) in metagraph.STYLES.items())


@query(f"""
WITH {_META}, style(k, fill, border, called) AS (VALUES {_STYLES}),
brand AS (SELECT p_size % 12 AS cluster, p_brand, count(*) AS n FROM part GROUP BY ALL),
ev AS (SELECT cluster, p_brand AS said, sum(n) OVER (PARTITION BY cluster) AS n FROM brand QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY brand.n DESC, p_brand) = 1),
kind AS (SELECT *, cluster = 3 AS utility, [{", ".join(f"'{k}'" for k in _KINDS)}][1 + cluster * 7 % {len(_KINDS)}] AS given FROM ev),
shown AS (SELECT *, CASE WHEN utility THEN 'stl_util' WHEN given = '' THEN 'other' ELSE given END AS category FROM kind),
drawn AS (SELECT shown.*, coalesce(s.fill, o.fill) AS fill, coalesce(s.border, o.border) AS border, coalesce(s.called, o.called) AS called FROM shown LEFT JOIN style s ON s.k = category, style o WHERE o.k = 'other'),
kept AS (SELECT * FROM m WHERE src_cluster <> 3 AND dst_cluster <> 3),
ends AS (SELECT *, unnest([src_cluster, dst_cluster]) AS node FROM kept),
best AS (SELECT src_cluster, dst_cluster FROM ends QUALIFY row_number() OVER (PARTITION BY node ORDER BY count DESC, src_cluster, dst_cluster) = 1),
top AS (SELECT max(count) AS t FROM m),
line AS (
  SELECT 0 AS section, 0 AS a, 0 AS b, '' AS key, '{metagraph.HEAD % ("LR", "ortho")}' AS line UNION ALL SELECT 2, 0, 0, '', '' UNION ALL SELECT 7, 0, 0, '', '}}'
  UNION ALL SELECT 1, cluster, 0, '', '    c_' || cluster || ' [label=<<B>size ' || cluster || ' &lt;&amp;&gt;</B><BR/><FONT POINT-SIZE="9" COLOR="#5a6270">' || n || ' funcs</FONT><BR/><FONT POINT-SIZE="8" COLOR="#8a94a6">'
    || said || '</FONT>> fillcolor="' || fill || '" color="' || border || '" fontsize=' || CAST(trunc(least(24, greatest(11, 11 + 3 * log2(n)))) AS INT)
    || ' penwidth=' || regexp_replace(CAST(round(least(4.2, greatest(1.2, 1.2 + 0.1 * sqrt(n))), 5) AS VARCHAR), '[.]0$', '') || CASE WHEN utility THEN ' style="rounded,filled,dashed"' ELSE '' END || '];' FROM drawn
  UNION ALL SELECT 3, src_cluster, dst_cluster, '', '    c_' || src_cluster || ' -> c_' || dst_cluster || ' [penwidth=' || regexp_replace(CAST(round(least(6, 0.8 + 0.9 * log2(1.0 + count)), 5) AS VARCHAR), '[.]0$', '')
    || ' color="#334155' || upper(to_hex(CAST(trunc(greatest(64, least(204, 64 + 140 * log2(1.0 + count) / log2(1.0 + t)))) AS BIGINT))) || '" weight=' || count || '];' FROM kept, top
    WHERE count >= greatest(3, (SELECT max(count) * 6 // 100 FROM kept)) OR (src_cluster, dst_cluster) IN (FROM best)
  UNION ALL SELECT DISTINCT 5, 0, 0, category, '          <TR><TD BGCOLOR="' || fill || '" WIDTH="16"></TD><TD ALIGN="LEFT"><FONT POINT-SIZE="9">' || called || '</FONT></TD></TR>' FROM drawn
  UNION ALL SELECT DISTINCT 4, 0, 0, '', '{metagraph.LEGEND}' FROM drawn UNION ALL SELECT DISTINCT 6, 0, 0, '', '{metagraph.LEGEND_END}' FROM drawn)
SELECT CAST(section AS INT) AS section, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, key, line FROM line
""")
def meta_document(spark, sf_dir):
    """The graph of parts by size as a document: the commonest brand is evidence, one size is the runtime."""
    c = F.col
    of = star.table(spark, sf_dir, "part").select((c("p_size") % 12).alias("cluster"), "p_brand").groupBy("cluster", "p_brand").agg(F.count("*").alias("n"))
    said = F.min(F.struct(-c("n"), "p_brand"))["p_brand"]
    kinds = F.array(*[F.lit(k) for k in _KINDS])
    clusters = of.groupBy("cluster").agg(F.sum("n").alias("functions"), said.alias("evidence")).select(
        "cluster", F.concat(F.lit("size "), "cluster", F.lit(" <&> ("), "functions", F.lit(" funcs)")).alias("label"), F.element_at(kinds, (1 + c("cluster") * 7 % len(_KINDS)).cast("int")).alias("category"),
        (c("cluster") == 3).alias("utility"), "functions", "evidence",
    )
    return metagraph.meta_document(clusters, _meta(spark, sf_dir), "LR", True)


@query("""
SELECT o_orderkey AS id, o_custkey AS grp FROM (
  SELECT *, sum(s) OVER (PARTITION BY o_custkey) AS total, coalesce(sum(s) OVER (PARTITION BY o_custkey, seed ORDER BY s, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT *, CAST(o_totalprice AS BIGINT) AS s, o_orderkey % 5 = 0 AS seed FROM orders))
WHERE seed OR before >= total - 500000
""")
def budget_prune(spark, sf_dir):
    o = star.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("grp"), F.round("o_totalprice").cast("long").alias("size"), (F.col("o_orderkey") % 5 == 0).alias("seed"))
    return render.within_budget(o, "grp", 500000).select("id", "grp")


_NAMES = "['direct_call', 'indirect_call', 'data_ref', 'immediate_ref', 'tail_call', 'virtual_call', 'jump_table']"


@query(f"""
WITH {flow_sql(0)}, {FUNC}, t AS (SELECT src, dst, list_sort(list(DISTINCT ref)) AS types FROM flow GROUP BY src, dst)
SELECT src, string_agg(name || ' (0x' || upper(to_hex(start_)) || ') [' || array_to_string(list_transform(types, lambda x: {_NAMES}[x + 1]), '/') || ']', ', ' ORDER BY dst) AS refs
FROM t JOIN func ON id = dst GROUP BY src
UNION ALL SELECT id, 'None' FROM func WHERE id NOT IN (SELECT src FROM t)
""")
def xref_summary(spark, sf_dir):
    e = edges.dedup_types(star.flow(spark, sf_dir, 0))
    return render.reference_list(e, star.functions(spark, sf_dir), "src", "dst")


@query(f"""
WITH {flow_sql(0)}, t AS (SELECT src, dst, list_sort(list(DISTINCT ref)) AS types FROM flow GROUP BY src, dst)
SELECT 'f_' || lower(to_hex(src)) || ' -> f_' || lower(to_hex(dst)) AS line, ['black', 'blue', 'green', 'orange', 'red', 'purple', 'brown'][types[1] + 1] AS colour,
  CASE WHEN list_contains(types, 1) OR list_contains(types, 5) THEN 'dashed' ELSE 'solid' END AS style, array_to_string(list_transform(types, lambda x: {_NAMES}[x + 1]), ',') AS label
FROM t
""")
def dot_rows(spark, sf_dir):
    return render.graph_rows(edges.dedup_types(star.flow(spark, sf_dir, 0)))
