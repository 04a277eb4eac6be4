"""Labels of subsystems: telling terms, pairs of terms, claims on them, and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import names
from graphloom.plans.stash import stash


def term_scores(counts: DataFrame) -> DataFrame:
    """``(cluster, token, score)`` from ``counts(cluster, token, tf)``: class-based TF-IDF.

    ((tf + 1/2) / (mass + vocabulary / 2)) * ln(1 + C / df), with the mass and
    the vocabulary of the cluster.
    """
    mass = counts.groupBy("cluster").agg(F.sum("tf").alias("mass"), F.count("*").alias("v"))
    df = counts.groupBy("token").agg(F.count_distinct("cluster").alias("df"))
    x = counts.join(mass, "cluster").join(df, "token").crossJoin(F.broadcast(mass.agg(F.count("*").alias("c"))))  # one row
    score = (F.col("tf") + 0.5) / (F.col("mass") + 0.5 * F.col("v")) * F.log(1 + F.col("c") / F.col("df"))
    return x.select("cluster", "token", score.alias("score"))


def ranked_terms(counts: DataFrame, digits: int = 9) -> DataFrame:
    """``term_scores`` with each term's place ``k`` in its cluster, from 1; scores equal to ``digits`` decimals go by term."""
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), "token"))
    return term_scores(counts).withColumn("score", F.round("score", digits)).withColumn("k", place)


def phrases(ranked: DataFrame, tokens: DataFrame, share: float = 0.6) -> DataFrame:
    """``(cluster, term)``: the two best terms of a cluster as ``a-b``, if they stand together in enough of its functions that have either.

    ``tokens(node, cluster, token)``.  Only the two best terms of a cluster meet its functions.
    """
    best = ranked.where("k <= 2").select("cluster", "token", "k")
    has = tokens.select("node", "cluster", "token").distinct().join(best, ["cluster", "token"]).groupBy("cluster", "node").agg(F.count("*").alias("n"))
    met = has.groupBy("cluster").agg((F.count(F.when(F.col("n") == 2, 1)) / F.count("*")).alias("share")).where(F.col("share") >= share)
    pair = best.groupBy("cluster").agg(F.max(F.when(F.col("k") == 1, F.col("token"))).alias("a"), F.max(F.when(F.col("k") == 2, F.col("token"))).alias("b")).where("b is not null")
    return pair.join(met, "cluster").select("cluster", F.concat_ws("-", "a", "b").alias("term"))


def claims(options: DataFrame, order: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``(cluster, term)``: each cluster's first option that no cluster before it in ``order`` takes; clusters that find none are left out.

    ``options(cluster, k, term)``, ``order(cluster, place)``.  One cluster after
    the other would be as many steps as clusters.  Instead all choose at once,
    each term is held by the first cluster that wants it, and those who lost it
    choose again among terms not held by one before them (deferred acceptance).
    Holders only change for earlier ones, so what is settled is what the
    sequence gives, and rounds are as many as the longest chain of refusals.
    """
    o = stash(options.join(order, "cluster"), "options")
    held = None
    for _ in range(max_rounds):
        free = o
        if held is not None:
            free = o.join(held, "term", "left").where(F.col("first").isNull() | (F.col("first") >= F.col("place")))
        wish = stash(free.groupBy("cluster", "place").agg(F.min_by("term", "k").alias("term")), "wish")
        held = stash(wish.groupBy("term").agg(F.min("place").alias("first")), "held")
        if wish.count() == held.count():
            return wish.select("cluster", "term")
    raise RuntimeError(f"claims did not settle in {max_rounds} rounds")


def categories(ranked: DataFrame, modules: DataFrame, top: int = 8) -> DataFrame:
    """``(cluster, category)``: that of the best term among the first ``top`` that has one.

    A sensitive category needs a second term of the cluster of that category, or a
    module (``modules(cluster, module)``) whose name has it.
    """
    r = ranked.select("cluster", "k", names.token_category(F.col("token")).alias("category")).where("category is not null")
    backed = r.groupBy("cluster", "category").agg(F.count("*").alias("n"), F.min("k").alias("k")).where(F.col("k") <= top)
    hits = modules.select("cluster", names.token_category(names.import_module_token(F.col("module"))).alias("category")).where("category is not null").distinct().withColumn("hit", F.lit(True))
    sure = backed.join(hits, ["cluster", "category"], "left").where(~F.col("category").isin(*names.SENSITIVE) | (F.col("n") >= 2) | F.col("hit"))
    return sure.groupBy("cluster").agg(F.min_by("category", "k").alias("category"))


def labels(tokens: DataFrame, clusters: DataFrame, modules: DataFrame) -> DataFrame:
    """``(cluster, label, category)`` of all ``clusters(cluster, size, utility)``.

    ``tokens(node, cluster, token, weight)``.  A label is a first term, which no
    other cluster has while it finds another, and up to two more that are not part of it.
    First choice is the phrase of the two best terms, then terms by score; the
    cluster of the highest score chooses first, of equal ones the smaller.
    """
    plain = clusters.where("not utility")
    counts = tokens.groupBy("cluster", "token").agg(F.sum("weight").alias("tf"))
    ranked = stash(ranked_terms(counts), "ranked")
    own = ranked.join(plain.select("cluster"), "cluster")
    best = own.where("k = 1").select("cluster", F.col("score"), F.col("token").alias("best"))
    order = best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "cluster"))).select("cluster", "place")  # one row a subsystem
    options = own.select("cluster", F.col("k").cast("long").alias("k"), F.col("token").alias("term"))
    pairs = phrases(own, tokens).withColumn("k", F.lit(0).cast("long"))
    first = claims(options.unionByName(pairs), order)
    first = best.join(first, "cluster", "left").select("cluster", F.coalesce("term", "best").alias("first"))
    others = own.join(first, "cluster").where(~F.contains("first", "token"))
    others = others.withColumn("j", F.row_number().over(Window.partitionBy("cluster").orderBy("k"))).where("j <= 2")
    others = others.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("j", "token")))["token"].alias("more"))
    out = plain.join(first, "cluster", "left").join(others, "cluster", "left").join(categories(own, modules), "cluster", "left")
    empty = F.array().cast("array<string>")
    text = F.when(F.col("first").isNull(), F.concat(F.lit("cluster-"), F.col("cluster") + 1)).otherwise(F.array_join(F.concat(F.array("first"), F.coalesce("more", empty)), " · "))
    out = out.select("cluster", _with_size(text, F.col("size")).alias("label"), F.coalesce("category", F.lit("")).alias("category"))
    return out.unionByName(clusters.where("utility").select("cluster", _with_size(F.lit("Utilities"), F.col("size")).alias("label"), F.lit("stl_util").alias("category")))


def _with_size(text: Column, size: Column) -> Column:
    return F.concat(text, F.lit(" ("), size, F.lit(" funcs)"))
