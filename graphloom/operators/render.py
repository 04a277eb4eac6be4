"""Text made from tables: cross-reference lists, graph rows, listings within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.notation import hex_upper
from graphloom.sources.star import REF_TYPES


#: Colours of the reference types in their order.
COLOURS = ("black", "blue", "green", "orange", "red", "purple", "brown")


def type_label(types: Column, separator: str = "/") -> Column:
    """Names of reference types given by their ordinals."""
    names = F.array(*[F.lit(n) for n in REF_TYPES])
    return F.array_join(F.transform(types, lambda t: F.element_at(names, (t + 1).cast("int"))), separator)


def reference_list(edges: DataFrame, names: DataFrame, of: str, other: str) -> DataFrame:
    """``(<of>, refs)``: "name (0xADDR) [types], ..." in order of address, and "None" for named functions without any; unknown functions are called so."""
    e = edges.join(names.select(F.col("id").alias(other), "name", "start"), other, "left")
    label = F.concat(F.coalesce("name", F.lit("unknown")), F.lit(" ("), hex_upper(F.coalesce(F.col("start"), F.col(other))), F.lit(") ["), type_label(F.col("types")), F.lit("]"))
    parts = F.array_sort(F.collect_list(F.struct(F.col(other).alias("k"), label.alias("label"))))
    refs = e.groupBy(of).agg(F.array_join(F.transform(parts, lambda x: x["label"]), ", ").alias("refs"))
    return refs.join(names.select(F.col("id").alias(of)), of, "full").select(of, F.coalesce("refs", F.lit("None")).alias("refs"))


def graph_rows(edges: DataFrame) -> DataFrame:
    """Edge rows of a DOT graph: colour by the first type, dashed for indirect and virtual ones, types as label."""
    colours = F.array(*[F.lit(c) for c in COLOURS])
    style = F.when(F.array_contains("types", 1) | F.array_contains("types", 5), "dashed").otherwise("solid")
    line = F.concat(F.lit("f_"), F.lower(F.hex("src")), F.lit(" -> f_"), F.lower(F.hex("dst")))
    return edges.select(line.alias("line"), F.element_at(colours, (F.col("types")[0] + 1).cast("int")).alias("colour"), style.alias("style"), type_label(F.col("types"), ",").alias("label"))


def within_budget(blocks: DataFrame, group: str, budget: int) -> DataFrame:
    """Blocks left after dropping the smallest ones (never seeds) of each group until the rest fits."""
    total = F.sum("size").over(Window.partitionBy(group))
    before = F.sum("size").over(Window.partitionBy(group, "seed").orderBy("size", "id").rowsBetween(Window.unboundedPreceding, -1))
    b = blocks.withColumn("_total", total).withColumn("_before", F.coalesce(before, F.lit(0)))
    return b.where(F.col("seed") | (F.col("_before") >= F.col("_total") - budget)).drop("_total", "_before")


def first_lines(lines: DataFrame) -> DataFrame:
    """Each line once, at its first place."""
    return lines.groupBy("line").agg(F.min("seq").alias("seq"))


def as_files(lines: DataFrame, of: str, *order: str) -> DataFrame:
    """``(<of>, text)``: each file's ``line`` column in the order of the others; a file is one object, so its lines meet in one row."""
    rows = F.array_sort(F.collect_list(F.struct(*order, "line")))
    return lines.groupBy(of).agg(F.concat(F.array_join(F.transform(rows, lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))


def graph_documents(nodes: DataFrame, clusters: DataFrame, edges: DataFrame, direction: str = "TB", labels: bool = True) -> DataFrame:
    """``(graph, text)``: whole DOT graphs of ``nodes(graph, node, name, seed, place, cluster)``.

    Nodes stand in order of ``place``, those with a cluster of ``clusters(graph,
    cluster, label, utility)`` inside its box; of ``edges(graph, src, dst, types)``
    those whose ends are both nodes of the graph.  Names of null or no length
    are "?"; seeds are filled; indirect and virtual edges dashed.
    """
    c = F.col
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    row = lambda df, section, a, b, line: df.select("graph", F.lit(section).alias("section"), a.cast("long").alias("a"), b.cast("long").alias("b"), line.alias("line"))
    dot = lambda x: text("f_", F.lower(F.hex(c(x))))
    zero, last = F.lit(0), F.lit(2**62)
    graphs = nodes.select("graph").distinct()
    head = "digraph callgraph {\n    rankdir=" + direction + ";\n    compound=true;\n    node [shape=box fontname=\"Courier\" fontsize=10];\n    edge [fontname=\"Courier\" fontsize=8];\n"
    n = nodes.join(clusters.select("graph", "cluster", F.lit(True).alias("_boxed")), ["graph", "cluster"], "left")
    label = F.when(c("name") != "", c("name")).otherwise("?")
    box = text(dot("node"), ' [label="', label, '"', F.when(c("seed"), " style=filled fillcolor=lightblue").otherwise(""), "];")
    used = clusters.join(nodes.select("graph", "cluster").distinct(), ["graph", "cluster"])
    opened = text(
        "    subgraph cluster_", c("cluster"), ' {\n        label="', c("label"), '";\n        style="', F.when(c("utility"), "dashed,rounded").otherwise("rounded"),
        '";\n        color="', F.when(c("utility"), "gray60").otherwise("gray35"), '";\n        fontname="Courier";\n        fontsize=10;',
    )
    e = edges.join(nodes.select("graph", c("node").alias("src")), ["graph", "src"]).join(nodes.select("graph", c("node").alias("dst")), ["graph", "dst"])
    has = lambda t: F.array_contains("types", t)
    colour = F.element_at(F.array(*[F.lit(x) for x in COLOURS]), (F.array_min("types") + 1).cast("int"))
    style = text("style=", F.when(has(1) | has(5), "dashed").otherwise("solid"), " color=", colour, *((' label="', type_label(F.array_sort("types"), ","), '"') if labels else ()))
    lines = row(graphs, 0, zero, zero, F.lit(head))
    for part in (
        row(used, 1, c("cluster"), F.lit(-1), opened), row(n.where("_boxed"), 1, c("cluster"), c("place"), text("        ", box)), row(used, 1, c("cluster"), last, F.lit("    }")),
        row(n.where("_boxed is null"), 2, zero, c("place"), text("    ", box)), row(graphs, 3, zero, zero, F.lit("")),
        row(e, 4, c("src"), c("dst"), text("    ", dot("src"), " -> ", dot("dst"), " [", style, "];")), row(graphs, 5, zero, zero, F.lit("}")),
    ):
        lines = lines.unionByName(part)
    return as_files(lines, "graph", "section", "a", "b")
