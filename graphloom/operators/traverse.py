"""Reachability: layered search, components, closure, levels and dominators, as loops of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.stash import stash


def layers(edges: DataFrame, seeds: DataFrame, depth: int, backwards: bool = False) -> DataFrame:
    """``(node, depth)``: nodes within ``depth`` steps of the seeds, each at its smallest depth.

    A layer is the neighbours of the last one that were not met before, so each
    node is opened once; the loop has ``depth`` joins at most.  Edges that several
    layers read are written first, so that what makes them is not done again for each.
    """
    if depth > 1 and not hasattr(edges, "stashed_at"):
        edges = stash(edges.select("src", "dst"), "edges")
    a, b = ("dst", "src") if backwards else ("src", "dst")
    e = edges.select(F.col(a).alias("node"), F.col(b).alias("to"))
    last = stash(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "layers")
    seen = last
    for d in range(1, depth + 1):
        new = e.join(last.select("node"), "node").select(F.col("to").alias("node")).distinct().join(seen, "node", "left_anti")
        last = stash(new.withColumn("depth", F.lit(d)), "layers")
        if not last.take(1):
            break
        # a table for each layer: nothing is written twice
        seen = seen.unionByName(last)
    return seen


def strong_components(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``(node, scc)``: strongly connected components, named after their smallest node.

    Rounds of colouring: nodes without an edge in or out among what is left are
    components of their own and go; then the smallest label that reaches each
    node spreads along the edges, and from each node that kept its own label
    the component is what reaches it back inside that label.
    """
    e = stash(edges.select("src", "dst").where("src <> dst").distinct(), "scc")
    nodes = stash(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct(), "scc")
    done = None
    for _ in range(max_rounds):
        # what cannot lie on a cycle
        while True:
            inside = stash(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"), "scc")
            if inside.count() == e.count():
                break
            e = inside
        alive = stash(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct(), "scc")
        single = nodes.join(alive, "node", "left_anti").withColumn("scc", F.col("node"))
        done = single if done is None else done.unionByName(single)
        done = stash(done, "scc")
        if not alive.take(1):
            return done
        colour = _spread(e, alive.withColumn("label", F.col("node")))
        same = e.join(colour.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst")
        same = stash(same.where("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst")), "scc")
        back = colour.where("node = label").select("node")
        reached = layers(same, back, max_rounds)
        found = stash(colour.join(reached.select("node"), "node").select("node", F.col("label").alias("scc")), "scc")
        done = done.unionByName(found)
        nodes = stash(alive.join(found, "node", "left_anti"), "scc")
        e = stash(e.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi"), "scc")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The smallest label that reaches each node."""
    while True:
        sent = edges.join(labels.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("more"))
        new = labels.join(sent, "node", "left").select("node", F.least("label", F.coalesce("more", "label")).alias("label"), (F.col("more") < F.col("label")).alias("moved"))
        new = stash(new, "spread")
        labels = new.select("node", "label")
        if not new.where("moved").take(1):
            return labels


def closure(edges: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """``(src, dst, dist)``: all pairs with a path, and its length; for graphs whose closure is small."""
    e = stash(edges.select("src", "dst").where("src <> dst").distinct(), "closure")
    step = e.select(F.col("src").alias("mid"), "dst")
    last = pairs = e.withColumn("dist", F.lit(1))
    for d in range(2, max_depth + 1):
        new = last.select("src", F.col("dst").alias("mid")).join(step, "mid").select("src", "dst").where("src <> dst").distinct()
        last = stash(new.join(pairs, ["src", "dst"], "left_anti").withColumn("dist", F.lit(d)), "closure")
        if not last.take(1):
            break
        pairs = pairs.unionByName(last)
    else:
        raise RuntimeError(f"paths are longer than {max_depth}")
    return pairs


def condensed(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Distinct edges ``(src, dst)`` between different components of ``components(node, scc)``: a graph without cycles."""
    c = components.select("node", "scc")
    e = edges.join(c.select(F.col("node").alias("src"), F.col("scc").alias("a")), "src").join(c.select(F.col("node").alias("dst"), F.col("scc").alias("b")), "dst")
    return e.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def levels(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(node, level)`` of an acyclic graph: the longest path that ends there (0 for nodes without edges in).

    ``nodes``: more nodes than edges tell.  With a cycle no path is the longest;
    that is noticed after as many rounds as there are nodes, and raises.
    """
    e = stash(edges.select("src", "dst").distinct(), "levels")
    known = e.select(F.col("src").alias("node")).union(e.select("dst"))
    known = stash((known.union(nodes.select("node")) if nodes is not None else known).distinct(), "levels")
    out, last = known.withColumn("level", F.lit(0)), known
    out.stashed_at = known.stashed_at
    out = stash(out, "levels")
    for level in range(1, known.count() + 1):
        last = stash(e.join(last.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct(), "levels")
        if not last.take(1):
            return out
        out = stash(out.join(last.withColumn("_on", F.lit(level)), "node", "left").select("node", F.coalesce("_on", "level").alias("level")), "levels", instead_of=out)
    if last.take(1):
        raise ValueError("the graph has a cycle: condense its strong components first")
    return out


def dominators(edges: DataFrame, nodes: DataFrame | None = None, anchors: DataFrame | None = None) -> DataFrame:
    """``(node, dominator)`` of an acyclic graph under a virtual root; every node dominates itself.

    The root leads to nodes without edges in and to ``anchors(node)``, which
    therefore have no other dominator.  By levels: what dominates a node
    dominates all nodes before it, so a candidate counts if as many predecessors
    have it as there are.
    """
    e = stash(edges.select("src", "dst").distinct(), "dom")
    at = stash(levels(e, nodes), "dom")
    free = at.where("level = 0").select("node")
    if anchors is not None:
        free = free.union(anchors.select("node")).distinct()
    free = stash(free, "dom")
    inner = stash(e.join(free.withColumnRenamed("node", "dst"), "dst", "left_anti"), "dom")
    preds = inner.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"))
    known = stash(free.join(at.select("node"), "node", "left_semi").select("node", F.col("node").alias("dominator")), "dom")
    top = at.agg(F.max("level")).first()[0] or 0
    for level in range(1, top + 1):
        here = at.where(F.col("level") == level).select("node").join(free, "node", "left_anti")
        shared = inner.join(here.withColumnRenamed("node", "dst"), "dst").join(known.withColumnRenamed("node", "src"), "src")
        shared = shared.groupBy(F.col("dst").alias("node"), "dominator").agg(F.count("*").alias("have")).join(preds, "node").where("have = n")
        new = shared.select("node", "dominator").unionByName(here.select("node", F.col("node").alias("dominator")))
        known = stash(known.unionByName(new), "dom", instead_of=known)
    return known


def condensation(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(node, scc)`` of all ``nodes``, ``(scc, size)``, and the edges between components (``condensed``), each a table."""
    scc = strong_components(edges)
    scc = stash(nodes.select("node").join(scc, "node", "left").select("node", F.coalesce("scc", "node").alias("scc")), "components")
    size = stash(scc.groupBy("scc").agg(F.count("*").alias("size")), "components")
    return scc, size, stash(condensed(edges, scc), "components")


def reach_exact(dag: DataFrame, size: DataFrame) -> DataFrame:
    """``(scc, reach)``: nodes in the components that a component reaches, its own included, from all pairs."""
    more = closure(dag).join(size.withColumnRenamed("scc", "dst"), "dst").groupBy(F.col("src").alias("scc")).agg(F.sum("size").alias("more"))
    return size.join(more, "scc", "left").select("scc", (F.col("size") + F.coalesce("more", F.lit(0))).alias("reach"))


def reach_estimate(dag: DataFrame, size: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """``(scc, reach)`` without pairs: a component's size and the estimates of its successors, at most the number of all nodes.

    What several paths lead to counts several times, so it is never too small.
    By levels from the last: one join a level, each component is summed once.
    ``at``: ``levels`` of the graph, if they are known.
    """
    at = stash((levels(dag, size.select(F.col("scc").alias("node"))) if at is None else at).select(F.col("node").alias("scc"), "level").join(size, "scc"), "estimate")
    total = at.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    e = stash(dag.select("src", "dst").join(at.select(F.col("scc").alias("src"), "level"), "src"), "estimate")
    known = None
    for level in range(at.agg(F.max("level")).first()[0] or 0, -1, -1):
        here = at.where(F.col("level") == level)
        if known is None:
            now = here.select("scc", F.col("size").alias("reach"))
        else:
            # a sum beyond 64 bits is beyond the total anyway
            got = e.where(F.col("level") == level).join(known.withColumnRenamed("scc", "dst"), "dst").groupBy(F.col("src").alias("scc")).agg(F.sum(F.col("reach").cast("decimal(38,0)")).alias("more"))
            now = here.join(got, "scc", "left").select("scc", F.least(F.col("size") + F.coalesce("more", F.lit(0)), F.lit(total)).cast("long").alias("reach"))
        now = stash(now, "estimate")
        known = now if known is None else known.unionByName(now)
    return size.select("scc", F.col("size").alias("reach")) if known is None else known


def component_signals(edges: DataFrame, nodes: DataFrame, anchors: DataFrame | None = None, exact: int = 8192) -> DataFrame:
    """``(node, scc, reach, dom, level, depth)`` of any graph, by its strong components.

    ``reach``: nodes that can be reached, its own component included (exact up to
    ``exact`` components, then ``reach_estimate``); ``dom``: nodes of the
    components that its component dominates; ``level``: longest path of
    components; ``depth``: steps of components from the virtual root (its
    successors have 1).
    """
    scc, size, dag = condensation(edges, nodes)
    points = size.select(F.col("scc").alias("node"))
    free = anchors.join(scc, "node").select(F.col("scc").alias("node")).distinct() if anchors is not None else None
    at = stash(levels(dag, points), "components")
    dom = dominated(dominators(dag, points, free), size)
    roots = at.where("level = 0").select("node")
    n = size.count()
    depth = layers(dag, roots.union(free).distinct() if free is not None else roots, n)
    reach = reach_exact(dag, size) if n <= exact else reach_estimate(dag, size, at)
    out = scc.join(reach, "scc").join(dom, "scc").join(at.withColumnRenamed("node", "scc"), "scc").join(depth.withColumnRenamed("node", "scc"), "scc")
    return out.select("node", "scc", "reach", "dom", "level", (F.col("depth") + 1).alias("depth"))


def dominated(pairs: DataFrame, size: DataFrame) -> DataFrame:
    """``(scc, dom)`` from ``dominators``: nodes in the components that each component dominates."""
    return pairs.join(size.withColumnRenamed("scc", "node"), "node").groupBy(F.col("dominator").alias("scc")).agg(F.sum("size").alias("dom"))
