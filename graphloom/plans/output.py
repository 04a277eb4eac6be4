"""Queries on rendered text, annotation transfer and cluster clean-up, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import notation
from graphloom.operators import dump, edges, expressions, paths, traverse, types
from graphloom.plans.collect import collector
from graphloom.plans.stash import stash
from graphloom.sources import star
from graphloom.sources.star import BASE, FUNC, flow_sql

QUERIES, SQL, query = collector()


@query(f"""
WITH {FUNC}, {flow_sql(0)},
h AS (SELECT src, string_agg(DISTINCT 'arg ' || dst, '; ' ORDER BY 'arg ' || dst) AS hint FROM flow GROUP BY src)
SELECT id, '0x' || lower(to_hex(start_)) || ': push ' || size || coalesce('  ; ' || hint, '') AS line FROM func LEFT JOIN h ON src = id
""")
def asm_listing(spark, sf_dir):
    """Listing lines with hints joined by the address that stands in the text."""
    f = star.functions(spark, sf_dir)
    lines = f.select("id", F.concat(F.lit("0x"), notation.hex_lower(F.col("start")), F.lit(": push "), F.col("size")).alias("text"))
    lines = lines.withColumn("addr", F.conv(F.regexp_extract("text", "^0x([0-9a-f]+):", 1), 16, 10).cast("long"))
    hints = star.links(spark, sf_dir, 0).groupBy("src").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("arg "), "dst"))), "; ").alias("hint"))
    hints = hints.select((F.lit(star.BASE) + F.col("src") * star.STEP).alias("addr"), "hint")
    return lines.join(hints, "addr", "left").select("id", F.concat("text", F.coalesce(F.concat(F.lit("  ; "), "hint"), F.lit(""))).alias("line"))


@query(f"""
WITH {FUNC}
SELECT CAST(id % 50 AS BIGINT) AS file, '// included: ' || count(*) || chr(10) || string_agg('/* 0x' || upper(to_hex(start_)) || ' */ void ' || name || '() {{}}', chr(10) ORDER BY start_) AS code
FROM func WHERE NOT system GROUP BY id % 50
""")
def code_dump(spark, sf_dir):
    """Blocks of functions in order of address, one text for each output file."""
    f = star.functions(spark, sf_dir).where("not system")
    block = F.concat(F.lit("/* "), notation.hex_upper(F.col("start")), F.lit(" */ void "), F.col("name"), F.lit("() {}"))
    parts = F.array_sort(F.collect_list(F.struct("start", block.alias("b"))))
    g = f.groupBy((F.col("id") % 50).alias("file")).agg(F.count("*").alias("n"), F.transform(parts, lambda x: x["b"]).alias("b"))
    return g.select("file", F.concat(F.lit("// included: "), F.col("n"), F.lit("\n"), F.array_join("b", "\n")).alias("code"))


_REF_NAMES = "['direct_call', 'indirect_call', 'data_ref', 'immediate_ref', 'tail_call', 'virtual_call', 'jump_table']"


def _refs_sql(of: str, other: str) -> str:
    entry = f"g.name || ' (0x' || upper(to_hex(g.start_)) || ') [' || array_to_string(list_transform(types, lambda x: {_REF_NAMES}[x + 1]), '/') || ']'"
    return f"(SELECT {of} AS id, string_agg({entry}, ', ' ORDER BY {other}) AS refs FROM t JOIN func g ON g.id = {other} GROUP BY {of})"


@query(f"""
WITH {flow_sql(0)}, {FUNC}, t AS (SELECT src, dst, list_sort(list(DISTINCT ref)) AS types FROM flow GROUP BY src, dst),
nm AS (SELECT id, start_, size, system, name || ' (0x' || upper(to_hex(start_)) || ')' AS n FROM func),
b AS (
  SELECT nm.id, nm.start_ AS place, nm.system AS seed, '// Incoming xrefs for ' || n || ': ' || coalesce(i.refs, 'None') || chr(10) || '// Outgoing xrefs for ' || n || ': ' || coalesce(o.refs, 'None') || chr(10)
    || '// --- Function: ' || n || ' ---' || chr(10) || '// offset: RVA 0x' || upper(to_hex(nm.start_ - {BASE})) || ' EA 0x' || upper(to_hex(nm.start_)) || chr(10)
    || CASE WHEN size % 9 = 0 THEN '// (decompilation failed)' ELSE 'int f' || nm.id || '() {{ return ' || repeat('1', CAST(size AS INT)) || '; }}' END || chr(10) || '// --- End Function: ' || n || ' ---' || chr(10) || chr(10) AS text
  FROM nm LEFT JOIN {_refs_sql("dst", "src")} i ON i.id = nm.id LEFT JOIN {_refs_sql("src", "dst")} o ON o.id = nm.id),
h AS (
  SELECT 0 AS section, CAST(0 AS BIGINT) AS place, '// Decompiled code' || chr(10) || chr(10) || '// Start functions: ' || (SELECT count(*) FROM func WHERE system) || chr(10) || chr(10) AS text
  UNION ALL SELECT 1, dense_rank() OVER (ORDER BY p_type), 'struct ' || lower(p_type) || ';' || chr(10) FROM (SELECT DISTINCT p_type FROM part)),
x AS (SELECT (SELECT sum(strlen(text)) FROM h) + sum(strlen(text)) AS whole FROM b),
k AS (SELECT *, coalesce(sum(strlen(text)) OVER (PARTITION BY seed ORDER BY strlen(text), place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
SELECT * FROM h UNION ALL SELECT 2, place, text FROM k, x WHERE seed OR before >= whole - whole * 6 // 10
""")
def code_dump_budget(spark, sf_dir):
    """The whole program as a code dump of three fifths of its size: functions of one brand are seeds, the smallest others go."""
    f = star.functions(spark, sf_dir)
    body = F.concat(F.lit("int f"), F.col("id"), F.lit("() { return "), F.repeat(F.lit("1"), F.col("size").cast("int")), F.lit("; }"))
    f = stash(f.select("id", "name", "start", "system", F.when(F.col("size") % 9 != 0, body).alias("code")), "functions")
    e = edges.dedup_types(star.flow(spark, sf_dir, 0))
    blocks = dump.function_blocks(f.select("id", "name", "start", "code"), e, star.BASE).join(f.select("id", F.col("start").alias("place"), F.col("system").alias("seed")), "id")
    blocks = stash(blocks, "blocks")
    kinds = star.table(spark, sf_dir, "part").select("p_type").distinct()
    types = kinds.select(F.dense_rank().over(Window.orderBy("p_type")).alias("place"), F.concat(F.lit("struct "), F.lower("p_type"), F.lit(";\n")).alias("text"))  # one row a type
    seeds = f.where("system").count()
    whole = dump.code_dump(spark, blocks, types, seeds).agg(F.sum(F.octet_length("text"))).first()[0]
    return dump.code_dump(spark, blocks, types, seeds, whole * 6 // 10)


@query(f"""
WITH {flow_sql(0)}, l AS (SELECT src % 20 AS graph, src, dst FROM edge)
SELECT graph, 'digraph {{' || chr(10) || string_agg('  f_' || lower(to_hex(src)) || ' -> f_' || lower(to_hex(dst)) || ';', chr(10) ORDER BY src, dst) || chr(10) || '}}' AS dot FROM l GROUP BY graph
""")
def dot_graphs(spark, sf_dir):
    """Call graphs as DOT text, one for each part of the program."""
    e = star.links(spark, sf_dir, 0)
    line = F.concat(F.lit("  f_"), notation.hex_lower(F.col("src")), F.lit(" -> f_"), notation.hex_lower(F.col("dst")), F.lit(";"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("src", "dst", line.alias("l")))), lambda x: x["l"])
    return e.groupBy((F.col("src") % 20).alias("graph")).agg(F.concat(F.lit("digraph {\n"), F.array_join(parts, "\n"), F.lit("\n}")).alias("dot"))


@query(f"""
WITH {FUNC} SELECT id, '{{"id":"F' || row_number() OVER (ORDER BY start_) || '","name":"' || name || '","size":' || size || '}}' AS json FROM func
""")
def ptn_json(spark, sf_dir):
    """One JSON object for each function, numbered by address.

    The number is the count of functions in earlier regions plus the place in
    the own one, so no window spans all functions.
    """
    f = star.functions(spark, sf_dir).withColumn("region", F.floor(F.col("id") / 1000))
    before = Window.orderBy("region").rowsBetween(Window.unboundedPreceding, -1)  # one row a region
    base = f.groupBy("region").count().select("region", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    f = f.join(base, "region").withColumn("n", F.row_number().over(Window.partitionBy("region").orderBy("start")) + F.col("base"))
    return f.select("id", F.to_json(F.struct(F.concat(F.lit("F"), F.col("n")).alias("id"), "name", "size")).alias("json"))


@query("""
SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL
""")
def metadata_round_trip(spark, sf_dir):
    """Annotation lines written with escapes and read again."""
    c = star.table(spark, sf_dir, "conversations").where("text is not null")
    lines = c.select(F.concat(F.lit("comment "), F.col("conv_id"), F.lit(" "), F.col("turn"), F.lit(' "'), notation.c_escape(F.col("text")), F.lit('"')).alias("line"))
    part = lambda k: F.regexp_extract("line", r'(?s)^comment (\d+) (\d+) "(.*)"$', k)
    return lines.select(part(1).cast("long").alias("conv_id"), part(2).cast("long").alias("turn"), notation.c_unescape(part(3)).alias("text"))


#: Operators that an event applies to what its user's events before it have made, by event_id.
_CHAIN = ("add", "sub", "mul", "shl", "sshr", "member", "index", "deref", "ref", "bor", "band", "bxor", "neg", "comma", "lnot", "ternary")


def _event_trees(spark, sf_dir):
    """A tree a user: the first event is a parameter, each later one an operator over the one before and a number or variable."""
    e = star.table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("i"), F.count("*").over(Window.partitionBy("user_id")).alias("n"))
    k, i = F.col("event_id"), F.col("i")
    op = F.when(i == 1, "param").otherwise(F.element_at(F.array(*[F.lit(o) for o in _CHAIN]), (k % len(_CHAIN) + 1).cast("int")))
    is_num = k % 3 != 0
    # a comma's second operand and a ternary's branches are what counts
    flip = F.when(op == "ternary", 1).otherwise(0)
    up = F.when(i < F.col("n"), 2 * i + 2)
    row = lambda node, parent, ord_, o, name, num: F.struct(node.alias("node"), parent.alias("parent"), ord_.cast("int").alias("ord"), o.alias("op"), name.alias("name"), num.cast("long").alias("num"), F.lit(4).alias("width"))
    after = F.lead(F.when(op == "ternary", 1).otherwise(0)).over(Window.partitionBy("user_id").orderBy("i"))
    e = e.withColumn("place", F.coalesce(after, F.lit(0)))
    chain = row(2 * i, up, F.col("place"), op, F.when(i == 1, F.concat(F.lit("u"), "user_id")).when(op == "member", F.concat(F.lit("m"), k % 9)), F.when(op == "member", k % 16).when(op == "index", F.lit(8)))
    other = row(2 * i + 1, 2 * i, flip + 1, F.when(is_num, "num").otherwise("var"), F.when(is_num, F.concat(F.lit("n"), k % 5)).otherwise(F.concat(F.lit("y"), k)), F.when(is_num, k % 5))
    return e.select(F.col("user_id").alias("tree"), F.col("n"), F.explode(F.when(i == 1, F.array(chain)).otherwise(F.array(chain, other))).alias("r")).select("tree", "n", "r.*")


@query(f"""
WITH RECURSIVE e AS (
  SELECT user_id, event_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, [{", ".join(f"'{o}'" for o in _CHAIN)}][1 + event_id % {len(_CHAIN)}] AS op,
    event_id % 3 <> 0 AS isnum, event_id % 5 AS v FROM events),
f(tree, i, kind, name, off_, mode, member, conf) AS (
  SELECT user_id, i, 'P', 'u' || user_id, CAST(0 AS BIGINT), '', '', 2 FROM e WHERE i = 1
  UNION ALL
  SELECT tree, i, CASE WHEN pick = 'r' THEN CASE WHEN isnum THEN 'C' ELSE 'L' END WHEN pick = 'd' THEN 'D' ELSE kind END,
    CASE WHEN pick = 'r' THEN CASE WHEN isnum THEN 'n' || v ELSE 'y' || k END ELSE name END,
    CASE WHEN pick = 'r' THEN 0 ELSE ((CASE WHEN op = 'add' AND isnum THEN off_ + v WHEN op = 'sub' AND isnum THEN off_ - v WHEN op = 'mul' AND isnum THEN off_ * v WHEN op = 'shl' AND isnum THEN off_ * (1 << v)
      WHEN op = 'sshr' AND isnum THEN off_ >> v WHEN op = 'member' THEN off_ + k % 16 WHEN op = 'index' AND isnum THEN off_ + 8 * v WHEN op = 'neg' THEN -off_ ELSE off_ END + 2147483648) & 4294967295) - 2147483648 END,
    CASE WHEN pick = 'r' THEN '' WHEN op = 'deref' THEN '*' WHEN op = 'ref' THEN '&' ELSE mode END, CASE WHEN pick = 'r' THEN '' WHEN op = 'member' THEN 'm' || k % 9 ELSE member END,
    CASE WHEN pick = 'd' OR op IN ('lnot', 'ternary') OR (NOT isnum AND op IN ('sub', 'index')) OR (NOT isnum AND op = 'mul' AND NOT second) THEN 0 WHEN pick = 'r' THEN CASE WHEN op = 'mul' THEN 2 ELSE 2 END ELSE conf END
  FROM (
    SELECT f.tree, e.*, f.kind, f.name, f.off_, f.mode, f.member, f.conf, f.kind = 'C' AND NOT isnum AND f.isleaf AS second,
      CASE WHEN op = 'comma' THEN 'r' WHEN op = 'add' AND NOT isnum THEN 'd' WHEN op = 'bor' AND kind <> 'C' AND NOT isnum THEN 'd' WHEN op IN ('bor', 'bxor') AND kind = 'C' THEN 'r' WHEN op = 'band' AND kind = 'C' AND NOT isnum THEN 'r' ELSE 'l' END AS pick
    FROM (SELECT *, false AS isleaf FROM f) f JOIN e ON e.user_id = f.tree AND e.i = f.i + 1))
SELECT tree, kind, name, off_ AS "offset", mode, member, CAST(conf AS INT) AS confidence FROM f QUALIFY row_number() OVER (PARTITION BY tree ORDER BY i DESC) = 1
""")
def expression_origins(spark, sf_dir):
    """What each user's events, read as one deep expression, come from in the end."""
    nodes = stash(_event_trees(spark, sf_dir), "nodes")
    top = nodes.where("parent is null").select("tree", "node")
    return expressions.origins(nodes.drop("n")).join(top, ["tree", "node"]).select("tree", "kind", "name", "offset", "mode", "member", "confidence")


def _order_trees(spark, sf_dir):
    """A tree an order: a variable is assigned the result of a call, whose arguments are the order's line items."""
    li = star.table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    li = li.select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", F.row_number().over(order).alias("k"))
    row = lambda node, parent, ord_, op, name, num: F.struct(node.cast("long").alias("node"), parent.cast("long").alias("parent"), ord_.cast("int").alias("ord"), op.alias("op"), name.alias("name"), num.cast("long").alias("num"), F.lit(8).alias("width"))
    none, k, lit = F.lit(None), F.col("k"), F.lit
    arg = F.col("l_returnflag")
    at = 10 * k
    top = row(at, lit(2), k, F.when(arg == "R", "add").when(arg == "A", "deref").otherwise("num"), none.cast("string"), F.when(arg == "N", F.col("l_suppkey")))
    one = row(at + 1, at, lit(0), F.when(arg == "R", "param").otherwise("obj"), F.concat(lit("p"), "l_partkey"), none)
    two = row(at + 2, at, lit(1), F.when(F.col("l_suppkey") % 4 != 0, "num").otherwise("var"), F.concat(lit("s"), "l_suppkey"), F.col("l_suppkey"))
    args = li.select(F.col("l_orderkey").alias("tree"), F.explode(F.when(arg == "R", F.array(top, one, two)).when(arg == "A", F.array(top, one)).otherwise(F.array(top))).alias("r")).select("tree", "r.*")
    o = star.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tree"), "o_custkey")
    head = F.array(
        row(lit(0), none, lit(0), lit("assign"), none.cast("string"), none), row(lit(1), lit(0), lit(0), lit("var"), F.concat(lit("v"), F.col("o_custkey") % 7), none),
        row(lit(2), lit(0), lit(1), F.when(F.col("tree") % 3 == 0, "cast").otherwise("call"), F.concat(lit("f"), F.col("o_custkey") % 50), none),
        row(lit(3), lit(2), lit(0), F.when(F.col("tree") % 3 == 0, "param").when(F.col("tree") % 5 == 0, "var").otherwise("obj"), F.concat(lit("f"), F.col("o_custkey") % 50), none),
    )
    return stash(o.select("tree", F.explode(head).alias("r")).select("tree", "r.*").unionByName(args), "nodes")


_ORDER_ARGS = """l AS (SELECT l_orderkey AS tree, l_partkey AS p, l_suppkey AS s, l_returnflag AS flag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem)"""


@query(f"""
WITH {_ORDER_ARGS}
SELECT tree, 'f' || o_custkey % 50 AS callee, CAST(k - 1 AS INT) AS arg, CASE WHEN flag = 'R' THEN CASE WHEN s % 4 = 0 THEN 'D' ELSE 'P' END WHEN flag = 'A' THEN 'G' ELSE 'C' END AS kind,
  CASE WHEN flag = 'N' THEN '' ELSE 'p' || p END AS name, CAST(CASE WHEN flag = 'R' AND s % 4 <> 0 THEN s ELSE 0 END AS BIGINT) AS "offset", CASE WHEN flag = 'A' THEN '*' ELSE '' END AS mode,
  CAST(CASE WHEN flag = 'R' AND s % 4 = 0 THEN 0 ELSE 2 END AS INT) AS confidence
FROM l JOIN orders ON o_orderkey = tree WHERE tree % 3 <> 0 AND tree % 5 <> 0
""")
def call_arguments(spark, sf_dir):
    """Origins of the arguments of each call, taken from its tree."""
    nodes = _order_trees(spark, sf_dir)
    return expressions.call_arguments(nodes, expressions.origins(nodes)).select("tree", "callee", "arg", "kind", "name", "offset", "mode", "confidence")


@query("""
SELECT o_orderkey AS tree, 'v' || o_custkey % 7 AS var, CASE WHEN o_orderkey % 3 = 0 THEN 'P' ELSE 'R' END AS kind, 'f' || o_custkey % 50 AS name,
  CASE WHEN o_orderkey % 3 = 0 THEN 'f' || o_custkey % 50 ELSE '' END AS cast_, 2 AS confidence FROM orders
""")
def assigned_values(spark, sf_dir):
    """Where the value of each assigned variable comes from, taken from its tree."""
    nodes = _order_trees(spark, sf_dir)
    return expressions.assigned_values(nodes, expressions.origins(nodes)).select("tree", "var", "kind", "name", F.col("cast").alias("cast_"), "confidence")


@query(f"""
WITH RECURSIVE {flow_sql(0)}, seed AS (SELECT min(src) AS node FROM edge),
hop(node, depth) AS (SELECT node, 0 FROM seed UNION SELECT e.dst, depth + 1 FROM hop JOIN edge e ON e.src = hop.node WHERE depth < 4),
d AS (SELECT node, min(depth) AS depth FROM hop GROUP BY node)
SELECT node, row_number() OVER (ORDER BY depth, node) - 1 AS id FROM d
""")
def export_ids(spark, sf_dir):
    """Functions reached by direct calls, numbered in order of discovery (a bounded result of a bounded depth)."""
    e = star.links(spark, sf_dir, 0)
    found = traverse.layers(e, e.agg(F.min("src").alias("node")), 4)
    inside = found.withColumn("n", F.row_number().over(Window.partitionBy("depth").orderBy("node")))
    before = found.groupBy("depth").count().withColumn("base", F.coalesce(F.sum("count").over(Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(before, "depth").select("node", (F.col("base") + F.col("n") - 1).alias("id"))


@query(f"""
WITH RECURSIVE {flow_sql(0)}, {FUNC},
p AS (SELECT id, size % 7 <> 0 AS same FROM func),
m(node) AS (SELECT src FROM edge JOIN p ON id = src AND same WHERE src IN (SELECT id FROM func WHERE system) UNION SELECT e.dst FROM m JOIN edge e ON e.src = m.node JOIN p ON p.id = e.dst AND same)
SELECT node FROM m
""")
def apply_mapping(spark, sf_dir):
    """Functions that annotations reach: call sites replayed from verified ones; a mismatch drops what hangs below."""
    f = star.functions(spark, sf_dir)
    e = star.links(spark, sf_dir, 0)
    good = f.where("size % 7 <> 0").select(F.col("id").alias("node"))
    verified = stash(e.join(good.withColumnRenamed("node", "dst"), "dst"), "verified")
    seeds = e.select(F.col("src").alias("node")).distinct().join(good, "node").join(f.where("system").select(F.col("id").alias("node")), "node")
    return traverse.layers(verified, seeds, 10_000).select("node")


@query("""
WITH g AS (SELECT p_partkey AS node, p_size % 12 AS cluster FROM part),
e AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
w AS (SELECT a.cluster AS a, b.cluster AS b, count(*) AS w FROM e x JOIN e y ON x.l_orderkey = y.l_orderkey AND x.l_partkey <> y.l_partkey JOIN g a ON a.node = x.l_partkey JOIN g b ON b.node = y.l_partkey WHERE a.cluster <> b.cluster GROUP BY 1, 2)
SELECT a AS cluster, b AS into_cluster FROM w QUALIFY row_number() OVER (PARTITION BY a ORDER BY w DESC, b) = 1
""")
def merge_targets(spark, sf_dir):
    """The cluster that each cluster would join: the one it is tied to most, the smaller number of equal ones."""
    g = star.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size") % 12).alias("cluster"))
    e = star.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("node")).distinct().join(g, "node")
    pair = e.select("l_orderkey", F.col("node").alias("x"), F.col("cluster").alias("a")).join(e.select("l_orderkey", F.col("node").alias("y"), F.col("cluster").alias("b")), "l_orderkey")
    w = pair.where("x <> y and a <> b").groupBy("a", "b").agg(F.count("*").alias("w"))
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("w"), "b"))
    return w.withColumn("_k", best).where("_k = 1").select(F.col("a").alias("cluster"), F.col("b").alias("into_cluster"))


@query(f"""
WITH {flow_sql(0)}, t AS (SELECT src, dst, list_sort(list(DISTINCT ref)) AS types FROM flow GROUP BY src, dst)
SELECT src, dst, greatest(CASE WHEN list_contains(types, 1) OR list_contains(types, 6) THEN 0.6::DOUBLE ELSE 0 END, CASE WHEN list_contains(types, 5) THEN 0.4::DOUBLE ELSE 0 END) AS confidence,
  list_contains(types, 0) OR list_contains(types, 4) AS strong, list_contains(types, 2) OR list_contains(types, 3) AS taken FROM t
""")
def edge_classes(spark, sf_dir):
    """How sure an edge is, and whether it calls or takes an address."""
    t = edges.dedup_types(star.flow(spark, sf_dir, 0))
    has = lambda *k: F.arrays_overlap("types", F.array(*[F.lit(x) for x in k]))
    sure = F.greatest(F.when(has(1, 6), 0.6).otherwise(0.0), F.when(has(5), 0.4).otherwise(0.0))
    return t.select("src", "dst", sure.alias("confidence"), has(0, 4).alias("strong"), has(2, 3).alias("taken"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT p_size AS src, 1 + (p_size * 3) % 50 AS dst FROM part WHERE p_size <> 1 + (p_size * 3) % 50),
w(root, node, depth) AS (SELECT DISTINCT src, src, 0 FROM e UNION SELECT root, dst, depth + 1 FROM w JOIN e ON src = node WHERE depth < 2),
d AS (SELECT root, node, min(depth) AS depth FROM w GROUP BY root, node)
SELECT CAST(root AS BIGINT) AS root, string_agg('struct T' || node || ';', ' ' ORDER BY depth DESC, node) AS header FROM d GROUP BY root
""")
def type_headers(spark, sf_dir):
    """Declarations of a type and what it needs two levels down, needed ones first."""
    p = star.table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("src"), (1 + F.col("p_size") * 3 % 50).cast("long").alias("dst")).where("src <> dst").distinct()
    sources = p.select(F.col("src").alias("node")).distinct()
    d = reduce(DataFrame.unionAll, [x.select(F.col("source").alias("root"), F.col("node").alias("t"), F.col("dist").alias("depth")) for x in paths.search(p, sources, depth=2)])
    parts = F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "t")))
    return d.groupBy("root").agg(F.array_join(F.transform(parts, lambda x: F.concat(F.lit("struct T"), x["t"], F.lit(";"))), " ").alias("header"))


@query("""
WITH RECURSIVE m0 AS (SELECT p_partkey AS k, CAST(substr(p_brand, 7) AS BIGINT) AS type, CAST(1 + p_size % 8 AS BIGINT) AS size, p_name || '_' || p_partkey AS name FROM part),
m AS (SELECT type, coalesce(sum(size) OVER (PARTITION BY type ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off_, size, name, CASE WHEN k % 5 = 0 THEN 1 + (type * 7 + k) % 25 END AS nested FROM m0),
w AS (SELECT type, max(off_ + size) AS e FROM m GROUP BY type),
a(type, off_) AS (
  SELECT DISTINCT w.type, CAST((l_orderkey * 13 + l_suppkey) % (w.e * 3) AS BIGINT) FROM lineitem JOIN m0 ON k = l_partkey JOIN w ON w.type = m0.type WHERE (l_orderkey * 13 + l_suppkey) % (w.e * 3) < w.e AND l_orderkey % 10 = 0
  UNION SELECT m.nested, a.off_ - m.off_ FROM a JOIN m ON m.type = a.type AND m.off_ <= a.off_ AND a.off_ < m.off_ + m.size WHERE nested IS NOT NULL),
kept AS (SELECT DISTINCT m.* FROM a JOIN m ON m.type = a.type AND m.off_ <= a.off_ AND a.off_ < m.off_ + m.size),
k AS (SELECT *, coalesce(lag(off_ + size) OVER o, 0) AS before, lead(off_) OVER o IS NULL AS last FROM kept WINDOW o AS (PARTITION BY type ORDER BY off_))
SELECT type, off_, size, name FROM k UNION ALL SELECT type, before, off_ - before, NULL FROM k WHERE off_ > before UNION ALL SELECT type, off_ + size, e - off_ - size, NULL FROM k JOIN w USING (type) WHERE last AND e > off_ + size
""")
def trimmed_types(spark, sf_dir):
    """Brands as structures of their parts, some of them structures themselves, trimmed to the offsets that every tenth order accesses; the rest is padding."""
    k = F.col("p_partkey")
    m = star.table(spark, sf_dir, "part").select(k.alias("k"), F.substring("p_brand", F.lit(7), F.lit(9)).cast("long").alias("type"), (1 + F.col("p_size") % 8).cast("long").alias("size"), F.concat_ws("_", "p_name", k).alias("name"))
    before = Window.partitionBy("type").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumns({"off": F.coalesce(F.sum("size").over(before), F.lit(0)), "nested": F.when(F.col("k") % 5 == 0, 1 + (F.col("type") * 7 + F.col("k")) % 25)})
    m = stash(m, "members")
    whole = m.groupBy("type").agg((F.max(F.col("off") + F.col("size"))).alias("e"))
    li = star.table(spark, sf_dir, "lineitem").where("l_orderkey % 10 = 0").select(F.col("l_partkey").alias("k"), (F.col("l_orderkey") * 13 + F.col("l_suppkey")).alias("x"))
    a = li.join(m.select("k", "type"), "k").join(whole, "type").select("type", (F.col("x") % (F.col("e") * 3)).alias("off"), "e").where("off < e").select("type", "off")
    return types.trimmed(m.select("type", "off", "size", "name", "nested"), a).withColumnRenamed("off", "off_")
