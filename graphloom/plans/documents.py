"""Queries on whole files (annotations, graphs) and on annotations replayed on another build, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import annotation_parts, annotations, edges, render
from graphloom.plans.collect import collector
from graphloom.plans.stash import fresh_path
from graphloom.sources import star
from graphloom.sources.star import BASE, FUNC, flow_sql

QUERIES, SQL, query = collector()

_NAMES = "['" + "', '".join(star.REF_TYPES) + "']"
_COLOURS = "['" + "', '".join(render.COLOURS) + "']"
#: A hundred parts make a program; each order of a part stands for a comment, a variable or a call in it.
_SITES = f"""{FUNC},
site AS (SELECT l_partkey AS id, l_orderkey AS k, min(l_linenumber) AS n, max(l_returnflag) AS flag, max(l_linestatus) = 'F' AS closed FROM lineitem GROUP BY 1, 2),
fn AS (SELECT func.*, id // 100 AS file, CASE WHEN size > 10 THEN p_type ELSE '' END AS proto, CASE WHEN size % 2 = 0 THEN '"' || p_brand || chr(92) END AS said FROM func JOIN part ON p_partkey = id)"""


def _program(spark, sf_dir):
    c = F.col
    p = star.table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), "p_type", "p_brand")
    file = F.floor(c("id") / 100).alias("file")
    f = star.functions(spark, sf_dir).join(p, "id").select(
        file, "id", "name", c("start").alias("ea"), (c("start") - star.BASE).alias("rva"), "size", (c("size") % 7).alias("insns"), F.lit(1).alias("blocks"), (c("id") * 2654435761).alias("shape"),
        F.when(c("size") > 10, c("p_type")).otherwise("").alias("proto"), F.when(c("size") % 2 == 0, F.concat(F.lit('"'), "p_brand", F.lit("\\"))).alias("comment"), F.lit("").alias("repeatable"),
    )
    sites = star.table(spark, sf_dir, "lineitem").groupBy(c("l_partkey").alias("id"), c("l_orderkey").alias("rva")).agg(
        F.min("l_linenumber").alias("n"), F.max("l_returnflag").alias("flag"), (F.max("l_linestatus") == "F").alias("repeatable")
    ).select(file, "*")
    kind = F.element_at(F.array(F.lit("none"), F.lit("reg"), F.lit("stk")), (1 + c("rva") % 3).cast("int"))
    programs = f.groupBy("file").agg(F.min("ea").alias("root")).select("file", F.lit(1).alias("version"), F.lit(star.BASE).cast("long").alias("image_base"), "root", F.lit("x64").alias("arch"), F.lit('day "1"').alias("created"))
    types = star.table(spark, sf_dir, "supplier").select(F.floor(c("s_suppkey") / 5).alias("file"), c("s_suppkey").alias("id"), c("s_name").alias("name"), F.concat(F.lit("struct "), "s_name", F.lit("\n{};")).alias("decl"))
    comments = sites.where("n = 1").select("file", "id", "rva", "repeatable", F.concat("flag", F.lit("\t")).alias("text"))
    variables = sites.where("n = 2").select("file", "id", c("rva").alias("pos"), kind.alias("kind"), (c("n") * 4).alias("place"), "rva", F.concat(F.lit("v"), "rva").alias("name"), F.lit("int").alias("type"))
    callees = sites.where("n >= 3").select("file", "id", c("rva").alias("pos"), "rva", (c("id") + c("rva")).alias("callee"))
    return programs, types, f, comments, variables, callees


_LINES = f"""{_SITES}, x AS (SELECT id // 100 AS file, * FROM site),
line AS (
  SELECT file, 0 AS s, CAST(0 AS BIGINT) AS o, 0 AS p, CAST(0 AS BIGINT) AS q, concat_ws(chr(10), '#annotations v1', 'image_base 0x{BASE:X}', 'root_ea 0x' || upper(to_hex(min(start_))), 'arch "x64"', 'created "day \\"1\\""') AS line FROM fn GROUP BY file
  UNION ALL SELECT s_suppkey // 5, 1, s_suppkey, 0, 0, 'type ' || s_suppkey || ' "' || s_name || '" "struct ' || s_name || '\\n{{}};"' FROM supplier
  UNION ALL SELECT file, 2, id, 0, 0, concat_ws(chr(10), 'func ' || id, '  name "' || name || '"', '  ea 0x' || upper(to_hex(start_)), '  rva 0x' || upper(to_hex(start_ - {BASE})), '  fp_size ' || size, '  fp_insns ' || size % 7,
    '  fp_bbs 1', '  fp_hash 0x' || upper(to_hex(id * 2654435761)), CASE WHEN proto <> '' THEN '  proto "' || proto || '"' END, '  func_cmt "' || replace(replace(said, chr(92), '\\\\'), '"', '\\"') || '"') FROM fn
  UNION ALL SELECT file, 2, id, 20, k, '  cmt 0x' || upper(to_hex(k)) || CASE WHEN closed THEN ' 1 "' ELSE ' 0 "' END || flag || '\\t"' FROM x WHERE n = 1
  UNION ALL SELECT file, 2, id, 21, k, '  lvar ' || ['none', 'reg', 'stk'][1 + k % 3] || ' ' || n * 4 || ' 0x' || upper(to_hex(k)) || ' "v' || k || '" "int"' FROM x WHERE n = 2
  UNION ALL SELECT file, 2, id, 22, k, '  callee 0x' || upper(to_hex(k)) || ' ' || id + k FROM x WHERE n >= 3
  UNION ALL SELECT file, 2, id, 23, 0, 'end_func' FROM fn),
whole AS (SELECT file, string_agg(line, chr(10) ORDER BY s, o, p, q) || chr(10) AS text FROM line GROUP BY file)"""


@query(f"WITH {_LINES} SELECT file, text FROM whole")
def annotation_files(spark, sf_dir):
    """Programs' annotations as whole files."""
    return annotations.files(annotations.written(*_program(spark, sf_dir)))


_FUNCTIONS = f"""
WITH {_SITES}, n AS (SELECT id, count_if(n = 1) AS comments, count_if(n = 2) AS variables, count_if(n >= 3) AS callees FROM site GROUP BY id)
SELECT file, id AS func, name, start_ AS ea, start_ - {BASE} AS rva, size, size % 7 AS insns, CAST(1 AS BIGINT) AS blocks, id * 2654435761 AS shape, nullif(proto, '') AS proto, said AS comment, CAST(NULL AS VARCHAR) AS repeatable,
  coalesce(comments, 0) AS comments, coalesce(variables, 0) AS variables, coalesce(callees, 0) AS callees
FROM fn LEFT JOIN n USING (id)
"""


@query(_FUNCTIONS)
def annotation_functions(spark, sf_dir):
    """What the files say of each function, read back from their text."""
    return annotations.function_facts(annotations.read(annotation_files(spark, sf_dir)))


def _in_parts(spark, sf_dir):
    """The rows of the programs' files, written as parts in the shared folder and read back in blocks."""
    path = fresh_path(spark, "annotation-parts")
    annotation_parts.write_parts(annotations.written(*_program(spark, sf_dir)), path)
    return annotation_parts.read_parts(spark, path).withColumn("file", F.col("file").cast("long"))


@query(_FUNCTIONS)
def annotation_parts_functions(spark, sf_dir):
    """What the files say of each function, where no row ever holds a file."""
    return annotations.function_facts(_in_parts(spark, sf_dir))


_OPERANDS = "MAP {" + ", ".join(f"'{d}': '{o}'" for d, o in (("header", "n"), *annotations.DIRECTIVES.items())) + "}"


@query(f"""
WITH {_LINES}, cut AS (SELECT file, string_split(text, chr(10)) AS rows FROM whole),
l AS (SELECT file, unnest(range(1, len(rows) + 1)) AS line_no, trim(unnest(rows)) AS line FROM cut),
d AS (SELECT *, CASE WHEN line LIKE '#%' THEN 'header' ELSE string_split(line, ' ')[1] END AS directive FROM l WHERE line <> '')
SELECT file, line_no, max(CASE WHEN directive = 'func' THEN CAST(string_split(line, ' ')[2] AS BIGINT) END) OVER (PARTITION BY file ORDER BY line_no) AS func, directive,
  len(replace(replace(operands, 's', ''), 'w', '')) AS numbers, len(replace(operands, 'n', '')) AS texts
FROM (SELECT *, map_extract_value({_OPERANDS}, directive) AS operands FROM d)
""")
def annotation_lines(spark, sf_dir):
    """Every line of the files with its number, its function and how many operands it has, read in blocks."""
    rows = _in_parts(spark, sf_dir).where("error is null")
    return rows.select("file", "line_no", "func", "directive", F.size("numbers").cast("long").alias("numbers"), F.size("texts").cast("long").alias("texts"))


@query("""
WITH e AS (
  SELECT o_orderkey AS file, o_orderkey % 5 = 0 AS bare, o_orderkey % 7 = 0 AS nameless, o_orderkey % 3 = 0 AS cut, o_orderkey % 2 = 0 AS even FROM orders),
l AS (
  SELECT file, unnest([
    {'line_no': 2, 'directive': 'func', 'error': CASE WHEN bare THEN 'no header' WHEN nameless THEN 'bad operands' END},
    {'line_no': 3, 'directive': 'name', 'error': CASE WHEN bare THEN 'no header' WHEN nameless THEN 'outside of a function' END},
    {'line_no': 4, 'directive': 'cmt', 'error': CASE WHEN bare THEN 'no header' WHEN cut THEN 'bad operands' WHEN nameless THEN 'outside of a function' END},
    {'line_no': 5, 'directive': 'end_func', 'error': CASE WHEN bare THEN 'no header' WHEN nameless THEN 'outside of a function' END},
    {'line_no': 6, 'directive': CASE WHEN even THEN 'callee' ELSE 'bogus' END, 'error': CASE WHEN bare THEN 'no header' WHEN even THEN 'outside of a function' ELSE 'unknown directive' END}]) AS x FROM e)
SELECT file, CAST(x.line_no AS BIGINT) AS line_no, x.directive AS directive, x.error AS error FROM l WHERE x.error IS NOT NULL
""")
def annotation_errors(spark, sf_dir):
    """Lines that cannot be read, with the reason, of files with several kinds of damage."""
    k = F.col("o_orderkey")
    some = lambda n, a, b: F.when(k % n == 0, a).otherwise(b)
    text = F.concat_ws(
        "\n", some(5, "", annotations.MAGIC + "1"), F.concat(F.lit("func "), some(7, "none", k.cast("string"))), F.concat(F.lit('  name "a\\n'), "o_custkey", F.lit('"')),
        some(3, "  cmt 0x1 9", '  cmt 0x1 1 "ok"'), F.lit("end_func"), some(2, "  callee 1 2", "bogus 1"),
    )
    rows = annotations.read(star.table(spark, sf_dir, "orders").select(k.alias("file"), text.alias("text")))
    return rows.where("error is not null").select("file", F.col("line_no").cast("long").alias("line_no"), "directive", "error")


@query(f"""
WITH RECURSIVE {flow_sql(0)},
m(node) AS (SELECT min(src) FROM edge WHERE src % 7 <> 0 UNION SELECT dst FROM m JOIN edge ON src = node WHERE node % 7 <> 0 AND dst % 11 <> 0)
SELECT node AS id, node + 100000 AS target, node % 7 <> 0 AS verified FROM m
""")
def replayed_targets(spark, sf_dir):
    """Functions found again in a build that changed every seventh and lacks calls of every eleventh."""
    c = F.col
    f = star.functions(spark, sf_dir).select("id", "size", F.lit(1).alias("insns"), F.lit(1).alias("blocks"), c("start").alias("shape"))
    other = f.select((c("id") + 100000).alias("target"), (c("size") + F.when(c("id") % 7 == 0, 1).otherwise(0)).alias("size"), "insns", "blocks", "shape")
    e = star.links(spark, sf_dir, 0)
    calls = e.select(c("src").alias("id"), c("dst").alias("pos"), (c("dst") * 8).alias("rva"), c("dst").alias("callee"))
    sites = e.where("dst % 11 <> 0").select((c("src") + 100000).alias("target"), (c("dst") * 8).alias("rva"), (c("dst") + 100000).alias("to"))
    root = e.where("src % 7 <> 0").agg(F.min("src").alias("id")).select("id", (c("id") + 100000).alias("target"))
    return annotations.replay(f, calls, other, sites, root)


@query(f"""
WITH {flow_sql(0)}, {FUNC}, n AS (SELECT *, id // 100 AS graph, CASE WHEN id % 5 < 4 THEN id % 5 END AS cluster FROM func WHERE NOT system),
t AS (SELECT src, dst, list_sort(list(DISTINCT ref)) AS types FROM flow GROUP BY src, dst),
b AS (SELECT *, 'f_' || lower(to_hex(id)) || ' [label="' || name || '"' || CASE WHEN id % 17 = 0 THEN ' style=filled fillcolor=lightblue' ELSE '' END || '];' AS box FROM n),
u AS (SELECT DISTINCT graph, cluster FROM n WHERE cluster IS NOT NULL),
line AS (
  SELECT DISTINCT graph, 0 AS s, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, concat_ws(chr(10), 'digraph callgraph {{', '    rankdir=TB;', '    compound=true;', '    node [shape=box fontname="Courier" fontsize=10];', '    edge [fontname="Courier" fontsize=8];', '') AS line FROM n
  UNION ALL SELECT graph, 1, cluster, -1, concat_ws(chr(10), '    subgraph cluster_' || cluster || ' {{', '        label="part ' || cluster || '";', '        style="' || CASE WHEN cluster = 3 THEN 'dashed,rounded' ELSE 'rounded' END || '";',
    '        color="' || CASE WHEN cluster = 3 THEN 'gray60' ELSE 'gray35' END || '";', '        fontname="Courier";', '        fontsize=10;') FROM u
  UNION ALL SELECT graph, 1, cluster, start_, '        ' || box FROM b WHERE cluster IS NOT NULL
  UNION ALL SELECT graph, 1, cluster, 4611686018427387904, '    }}' FROM u
  UNION ALL SELECT graph, 2, 0, start_, '    ' || box FROM b WHERE cluster IS NULL
  UNION ALL SELECT DISTINCT graph, 3, 0, 0, '' FROM n
  UNION ALL SELECT x.graph, 4, src, dst, '    f_' || lower(to_hex(src)) || ' -> f_' || lower(to_hex(dst)) || ' [style=' || CASE WHEN list_contains(types, 1) OR list_contains(types, 5) THEN 'dashed' ELSE 'solid' END ||
    ' color=' || {_COLOURS}[types[1] + 1] || ' label="' || array_to_string(list_transform(types, lambda x: {_NAMES}[x + 1]), ',') || '"];' FROM t JOIN n x ON x.id = src JOIN n y ON y.id = dst AND x.graph = y.graph
  UNION ALL SELECT DISTINCT graph, 5, 0, 0, '}}' FROM n)
SELECT graph, string_agg(line, chr(10) ORDER BY s, a, b) || chr(10) AS text FROM line GROUP BY graph
""")
def dot_documents(spark, sf_dir):
    """Whole graphs with boxes of clusters, filled seeds and styled edges, one for a hundred functions."""
    c = F.col
    graph = lambda x: F.floor(c(x) / 100).alias("graph")
    nodes = star.functions(spark, sf_dir).where("not system").select(
        graph("id"), c("id").alias("node"), "name", (c("id") % 17 == 0).alias("seed"), c("start").alias("place"), F.when(c("id") % 5 < 4, c("id") % 5).alias("cluster")
    )
    clusters = nodes.where("cluster is not null").select("graph", "cluster").distinct().select("graph", "cluster", F.concat(F.lit("part "), "cluster").alias("label"), (c("cluster") == 3).alias("utility"))
    e = edges.dedup_types(star.flow(spark, sf_dir, 0)).select(graph("src"), "src", "dst", "types")
    return render.graph_documents(nodes, clusters, e)
