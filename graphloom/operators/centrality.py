"""Importance of functions: degrees, ranks, paths, cores, and their fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.order import numbered
from graphloom.plans.stash import stash


def weighted_degrees(edges: DataFrame, system: DataFrame, damping: float = 0.1) -> DataFrame:
    """``(node, w_in, w_out)``: sums of edge weights, times ``damping`` for each end that is a system function."""
    s = system.select("node").distinct().withColumn("_s", F.lit(True))
    e = edges.join(s.select(F.col("node").alias("src"), F.col("_s").alias("_a")), "src", "left").join(s.select(F.col("node").alias("dst"), F.col("_s").alias("_b")), "dst", "left")
    w = F.col("w") * F.when(F.col("_a"), damping).otherwise(1.0) * F.when(F.col("_b"), damping).otherwise(1.0)
    e = e.select("src", "dst", w.alias("w"))
    both = e.select(F.col("src").alias("node"), F.lit(0.0).alias("i"), F.col("w").alias("o")).unionAll(e.select("dst", "w", F.lit(0.0)))
    return both.groupBy("node").agg(F.sum("i").alias("w_in"), F.sum("o").alias("w_out"))


def shared_state(touches: DataFrame) -> DataFrame:
    """``(node, coupling)``: for each resource of k >= 2 functions every one of them gains k - 1."""
    t = touches.select("node", "resource").distinct()
    k = t.groupBy("resource").agg((F.count("*") - 1).alias("k")).where("k > 0")
    return t.join(k, "resource").groupBy("node").agg(F.sum("k").alias("coupling"))


def pagerank(edges: DataFrame, nodes: DataFrame, rounds: int = 10, damping: float = 0.85, seeds: DataFrame | None = None, tolerance: float | None = None) -> DataFrame:
    """``(node, rank)``: weighted PageRank of ``edges(src, dst, w)`` after ``rounds`` rounds (or sooner, within ``tolerance``).

    ``seeds``: if given and not empty, jumps go to them alone.  What nodes
    without edges out hold goes where jumps go.  One join and one aggregation a
    round; the mass that hangs is a scalar.
    """
    n = nodes.count()
    jump = nodes.select("node").join(seeds.select("node").distinct().withColumn("_s", F.lit(1.0)), "node", "left") if seeds is not None else nodes.select("node").withColumn("_s", F.lit(1.0))
    total = jump.agg(F.sum("_s")).first()[0]
    jump = jump.select("node", (F.coalesce("_s", F.lit(0.0)) / total if total else F.lit(1.0 / max(n, 1))).alias("p"))
    out = edges.groupBy("src").agg(F.sum("w").alias("total"))
    share = stash(edges.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")), "pr")
    base = stash(jump.join(out.select(F.col("src").alias("node"), F.lit(False).alias("hangs")), "node", "left").select("node", "p", F.coalesce("hangs", F.lit(True)).alias("hangs")), "pr")
    rank = base.select("node", F.lit(1.0 / max(n, 1)).alias("rank"))
    for _ in range(rounds):
        lost = rank.join(base.where("hangs"), "node").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        sent = rank.join(share, rank["node"] == share["src"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = base.join(sent, "node", "left").select("node", ((1 - damping + damping * lost) * F.col("p") + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        new = stash(new, "pr")
        if tolerance is not None:
            apart = new.join(rank.withColumnRenamed("rank", "old"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
            if (apart or 0) < tolerance:
                return new
        rank = new
    return rank


def hits(edges: DataFrame, nodes: DataFrame, rounds: int = 10) -> DataFrame:
    """``(node, authority, hub)``: both updated at once from the round before, each of length 1."""
    n = max(nodes.count(), 1)
    score = nodes.select("node", F.lit(1.0 / n).alias("authority"), F.lit(1.0 / n).alias("hub"))
    e = edges.select("src", "dst", "w")
    for _ in range(rounds):
        auth = e.join(score.select(F.col("node").alias("src"), "hub"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("hub") * F.col("w")).alias("a"))
        hub = e.join(score.select(F.col("node").alias("dst"), "authority"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("authority") * F.col("w")).alias("h"))
        new = nodes.select("node").join(auth, "node", "left").join(hub, "node", "left")
        new = stash(new.select("node", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("h", F.lit(0.0)).alias("h")), "hits")
        la, lh = new.agg(F.sqrt(F.sum(F.col("a") * F.col("a"))), F.sqrt(F.sum(F.col("h") * F.col("h")))).first()
        score = new.select("node", (F.col("a") / (la or 1.0)).alias("authority"), (F.col("h") / (lh or 1.0)).alias("hub"))
    return score


def coreness(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``(node, core)`` of the undirected simple graph.

    From its degree on, each node's value becomes the largest h such that h
    neighbours have at least h; this settles at the core numbers (Lue et al.,
    2016) in far fewer rounds than peeling has.  Neighbours are counted by value
    before they meet at their node, so a node with very many is no large group.
    """
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    e = stash(e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select("b", "a")), "core")
    value = stash(e.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("core")), "core")
    for _ in range(max_rounds):
        own = value.select(F.col("node").alias("u"), F.col("core").alias("own"))
        near = e.join(value.select(F.col("node").alias("v"), "core"), "v").join(own, "u")
        counted = near.groupBy("u", "own", F.least("core", "own").alias("c")).agg(F.count("*").alias("n"))
        at_least = F.sum("n").over(Window.partitionBy("u").orderBy(F.desc("c")))
        new = counted.withColumn("h", F.least("c", at_least)).groupBy(F.col("u").alias("node"), "own").agg(F.max("h").alias("core"))
        new = stash(new, "core", instead_of=value)
        value = new.select("node", "core")
        value.stashed_at = new.stashed_at
        if not new.where("core < own").take(1):
            return value
    raise RuntimeError(f"cores did not settle in {max_rounds} rounds")


def reciprocal_rank_fusion(channels: DataFrame, weights: dict[str, float], k: int = 60) -> DataFrame:
    """``(node, score)`` from ``channels(node, channel, value)``: sum of weight / (k + place).

    Places are by value, largest first, equal values by node; a channel that is
    all zero is left out.  All channels are ranked in one global order
    (``numbered``), from which each channel's first place is taken off, so no
    task sees all nodes of a channel.
    """
    live = channels.groupBy("channel").agg(F.max(F.abs("value")).alias("m")).where("m > 0").select("channel")
    c = channels.join(live, "channel")
    c = stash(numbered(c, "channel", F.desc("value"), "node"), "places")
    c = c.join(F.broadcast(c.groupBy("channel").agg(F.min("idx").alias("_first"))), "channel")  # one row a channel
    place = F.col("idx") - F.col("_first") + 1
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("channel"))
    return c.select("node", (weight / (k + place)).alias("part")).groupBy("node").agg(F.sum("part").alias("score"))


#: Weights of the channels that make up a function's centrality.
CENTRALITY = {
    "indegree": 1.0, "outdegree": 1.0, "pagerank": 1.25, "reversed": 1.1, "seeded": 1.5, "authority": 1.2, "hub": 1.1, "betweenness": 1.25, "harmonic_in": 1.0, "harmonic_out": 1.0,
    "core": 1.0, "state": 0.8, "reach": 1.0, "dom": 1.1, "taken": 0.35, "anchor": 0.35, "size": 0.4,
}


def by_centrality(scored: DataFrame) -> list[Column]:
    """The order of functions by ``score``: system functions later, then by anchors, authority, hub, betweenness, degrees, size, address."""
    return [F.desc("score"), F.asc("system"), *[F.desc(c) for c in ("anchor", "authority", "hub", "betweenness", "indegree", "outdegree", "size")], F.asc("node")]


def by_entryness(scored: DataFrame) -> list[Column]:
    return [F.desc("score"), F.desc("anchor"), F.desc("free"), F.asc("system"), F.asc("callers"), F.desc("dom"), F.desc("reach"), F.desc("size"), F.asc("depth"), F.asc("node")]


def entryness() -> Column:
    """How much a function looks like an entry point, from its signals and the largest reach, dominated nodes and depth of all (at least 1)."""
    c = F.col
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    return (
        3 * flag(c("anchor")) + 1.5 * flag(c("taken") & (c("callers") == 0)) + 1 / (1 + c("callers")) + 2 * c("reach") / c("max_reach")
        + 3 * c("dom") / c("max_dom") + 0.25 * (1 - c("depth") / c("max_depth")) - 4 * flag(c("system"))
    )


ORDERS = {"centrality": by_centrality, "entryness": by_entryness}


def ranked(scored: DataFrame, order: str) -> DataFrame:
    """Adds ``place``, from 1, by one of ``ORDERS``."""
    return numbered(scored, *ORDERS[order](scored)).withColumn("place", F.col("idx") + 1).drop("idx")
