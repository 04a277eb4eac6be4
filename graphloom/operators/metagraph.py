"""The graph of subsystems as a DOT document, a row a line: sized and coloured nodes, the backbone of edges, a legend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import notation
from graphloom.operators.cluster import backbone
from graphloom.plans.stash import stash

#: Fill, border and name in the legend of each category.
STYLES = {
    "decompiler": ("#DDEEDD", "#4F9E54", "decompiler"), "graph": ("#DCE6F5", "#4577C0", "graph / dot"), "types": ("#E7DDF2", "#8B5FBF", "types"),
    "output": ("#FCE9D6", "#D98A2B", "output / writer"), "xref": ("#FAD9D6", "#C84B3E", "xref"), "disasm": ("#E6E0CF", "#9C8A4E", "disasm"),
    "segment": ("#FBE7C9", "#C9962B", "segment / loader"), "register": ("#D9EEF0", "#3F9AA8", "register"), "io": ("#F6E3C5", "#BE8A2E", "i/o"),
    "cli": ("#E2E8D5", "#7E9A4E", "cli"), "provenance": ("#E9DCF2", "#8E63B5", "provenance / ptn"), "text": ("#EADAF0", "#9B59B6", "regex / text"),
    "crypto": ("#F8D7E4", "#C0397B", "crypto"), "network": ("#CFE3FF", "#2F6FD0", "network"), "compression": ("#E0E7D2", "#6B8C3E", "compression"),
    "database": ("#D6EAF8", "#2E86C1", "database"), "stl_util": ("#ECECEC", "#9E9E9E", "runtime / STL"), "other": ("#E6E6EA", "#8A8A96", "other"),
}
#: The document's beginning, and what stands around the rows of its legend.
HEAD = """digraph subsystems {
    bgcolor="#FAFBFD";
    rankdir=%s;
    newrank=true;
    pack=true;
    packmode="node";
    splines=%s;
    nodesep=0.35;
    ranksep=0.85;
    pad=0.35;
    node [shape=box style="rounded,filled" fontname="Helvetica" margin=0.14 penwidth=1.4];
    edge [fontname="Helvetica" arrowsize=0.7];
"""
LEGEND = """
    subgraph cluster_legend {
        label="subsystems"; labelloc=t; fontname="Helvetica"; fontsize=10;
        color="#d8dde5"; style="rounded";
        legend [shape=plaintext margin=0 label=<<TABLE BORDER="0" CELLBORDER="0" CELLSPACING="3">"""
LEGEND_END = """        </TABLE>>];
    }"""


def _style(category: Column, part: int) -> Column:
    known = F.create_map(*[F.lit(x) for k, v in STYLES.items() for x in (k, v[part])])
    return F.coalesce(F.element_at(known, category), F.lit(STYLES["other"][part]))


def short_number(c: Column) -> Column:
    """A number from 1 to 10 with six digits at most, without zeros at its end."""
    return F.regexp_replace(F.round(c, 5).cast("string"), r"\.0$", "")


def meta_document(clusters: DataFrame, meta: DataFrame, direction: str = "TB", ortho: bool = False) -> DataFrame:
    """``(section, a, b, key, line)``: lines which sorted by the other columns are the document.

    ``clusters(cluster, label, category, utility, functions, evidence)``; those without functions are left
    out, utilities are shown as the runtime, and categories that are null or empty as other ones; one that is not known keeps
    a row of its own in the legend, named as the other ones.  ``meta(src_cluster, dst_cluster,
    count)``: of its edges the ``backbone`` is drawn, its shades are relative to the largest count of all.  Without
    clusters there is no legend, as an empty table cannot be drawn.
    """
    c = F.col
    spark = clusters.sparkSession
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    zero = F.lit(0)
    row = lambda df, section, line, a=zero, b=zero, key=F.lit(""): df.select(F.lit(section).alias("section"), a.cast("long").alias("a"), b.cast("long").alias("b"), key.alias("key"), line.alias("line"))

    category = F.when(c("utility"), "stl_util").when(F.coalesce("category", F.lit("")) == "", "other").otherwise(c("category"))
    shown = clusters.where("functions > 0").withColumn("category", category)
    evidence = F.when(F.coalesce("evidence", F.lit("")) != "", text('<BR/><FONT POINT-SIZE="8" COLOR="#8a94a6">', notation.html_escape(c("evidence")), "</FONT>")).otherwise("")
    node = text(
        "    c_", c("cluster").cast("string"), " [label=<<B>", notation.html_escape(notation.strip_count_suffix(F.coalesce("label", F.lit("")))), '</B><BR/><FONT POINT-SIZE="9" COLOR="#5a6270">', c("functions").cast("string"),
        " funcs</FONT>", evidence, '> fillcolor="', _style(c("category"), 0), '" color="', _style(c("category"), 1), '" fontsize=', notation.node_font(c("functions")).cast("string"),
        " penwidth=", short_number(notation.node_pen(c("functions"))), F.when(c("utility"), ' style="rounded,filled,dashed"').otherwise(""), "];",
    )

    m = stash(meta.select("src_cluster", "dst_cluster", "count"), "meta")
    top = m.agg(F.greatest(F.max("count"), F.lit(1)).alias("_top"))
    drawn = backbone(m, clusters.where("utility").select("cluster")).crossJoin(F.broadcast(top))
    alpha = F.lpad(F.hex(notation.edge_alpha(c("count"), c("_top")).cast("long")), 2, "0")
    edge = text("    c_", c("src_cluster").cast("string"), " -> c_", c("dst_cluster").cast("string"), " [penwidth=", short_number(notation.edge_pen(c("count"))), ' color="#334155', alpha, '" weight=', c("count").cast("string"), "];")

    seen = shown.select("category").distinct()
    some = seen.agg(F.count("*").alias("n")).where("n > 0")
    swatch = text('          <TR><TD BGCOLOR="', _style(c("category"), 0), '" WIDTH="16"></TD><TD ALIGN="LEFT"><FONT POINT-SIZE="9">', notation.html_escape(_style(c("category"), 2)), "</FONT></TD></TR>")
    fixed = spark.createDataFrame([(0, HEAD % (direction, "ortho" if ortho else "spline")), (2, ""), (7, "}")], "section int, line string")
    lines = fixed.select("section", zero.cast("long").alias("a"), zero.cast("long").alias("b"), F.lit("").alias("key"), "line")
    for part in (
        row(shown, 1, node, c("cluster")), row(drawn, 3, edge, c("src_cluster"), c("dst_cluster")), row(some, 4, F.lit(LEGEND)), row(seen, 5, swatch, key=c("category")), row(some, 6, F.lit(LEGEND_END)),
    ):
        lines = lines.unionByName(part)
    return lines
