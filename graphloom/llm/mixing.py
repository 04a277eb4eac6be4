"""Mix sources to target weights by hash-threshold histograms.

A document's place is a hash of its id, so a source's budget is a threshold on
that hash and a larger budget always contains a smaller one.  The threshold is
found from histograms: sizes are summed by source and hash bucket, the bucket
in which the running sum reaches the budget is opened with the next bits of
the hash, and so on; documents are never sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.stash import stash

WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of the hash that each level of histograms looks at.
LEVELS = (3, 3, 3, 3)
WEIGHTS = (3, 1, 2)
#: Total budget as halves of the corpus (3 halves are 150 %), and copies of a document at most.
HALVES, MOST = 3, 2


def word_count(text: Column) -> Column:
    """Words in a text as long; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """Targets of sources from ``(source, source_size)``, one row each.

    Sources in code point order, null last, weigh 3, 1, 2, repeating, and share
    1.5 times all sizes; a target stops at twice its source's size and the
    excess is shared again.  Sharing until none is above equals one level L with
    target = min(2 size, weight L), so sources are capped in order of 2 size /
    weight: a running sum over the source table, whose length is the number of
    sources.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1)
    s = sizes.withColumn("w", weight.cast("long"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = s.withColumn("c2", F.coalesce(F.sum(F.col("source_size") * 2 * MOST).over(before), F.lit(0)))
    s = s.withColumn("rest_w", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    s = s.withColumn("left2", F.sum(F.col("source_size") * HALVES).over(whole) - F.col("c2"))
    # the first source in this order that keeps below its cap fixes the level for all after it
    s = s.withColumn("free", F.col("w") * F.col("left2") <= F.col("source_size") * 2 * MOST * F.col("rest_w"))
    first = F.min(F.when(F.col("free"), F.struct(F.col("source_size") / F.col("w"), "rest_w", "left2"))).over(whole)
    s = s.withColumn("level", first)
    cap = (F.col("source_size") * MOST).cast("double")
    # F.try_divide: no source is free when all sizes are zero
    share = F.col("w") * F.col("level.left2") / (F.col("level.rest_w") * 2)
    return s.select("source", "source_size", F.least(cap, F.coalesce(share, cap)).alias("target"))


def _place(doc_id: Column) -> Column:
    return F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, sum(LEVELS))


def thresholds(sized: DataFrame) -> DataFrame:
    """``(source, source_size, target, full, edge, near)``: how far each source's budget reaches, one row a source.

    ``sized``: ``(doc_id, source, size)``.  ``full``: whether the source is taken
    whole before its rest; ``edge``: the place at which the rest is reached (null
    if it never is), ``near``: whether the documents at that very place are taken.
    """
    d = sized.select(_place(F.col("doc_id")).alias("_place"), F.col("source").isNull().alias("_no"), F.coalesce("source", F.lit("")).alias("_src"), "source", "size")
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = source_targets(sizes).withColumn("full", (F.col("target") >= F.col("source_size")).cast("int"))
    t = t.withColumn("_rest", F.col("target") - F.col("full") * F.col("source_size"))
    t = stash(t.select(F.col("source").isNull().alias("_no"), F.coalesce("source", F.lit("")).alias("_src"), "source", "source_size", "target", "full", "_rest"), "targets")
    edge = t.select("_no", "_src", "_rest", F.lit("").alias("_prefix"), F.lit(0).cast("long").alias("_below"))
    seen = 0
    for n in LEVELS:
        inside = d.select("_no", "_src", "size", "_place").withColumn("_prefix", F.substring("_place", 1, seen))
        inside = inside.join(edge, ["_no", "_src", "_prefix"])
        h = inside.groupBy("_no", "_src", "_prefix", "_rest", "_below", F.substring("_place", seen + 1, n).alias("_b")).agg(F.sum("size").alias("_sum"))
        run = Window.partitionBy("_no", "_src").orderBy("_b")
        h = h.withColumn("_upto", F.col("_below") + F.sum("_sum").over(run))
        h = h.where(F.col("_upto") >= F.col("_rest"))
        h = h.groupBy("_no", "_src").agg(F.min(F.struct("_b", "_prefix", "_rest", "_upto", "_sum")).alias("m"))
        edge = h.select("_no", "_src", "m._rest", F.concat("m._prefix", "m._b").alias("_prefix"), (F.col("m._upto") - F.col("m._sum")).alias("_below"), F.col("m._upto").alias("_upto"))
        edge = stash(edge, "edge")
        last, edge = edge, edge.drop("_upto")
        seen += n
    near = F.col("_upto") - F.col("_rest") < F.col("_rest") - F.col("_below")
    last = last.select("_no", "_src", F.col("_prefix").alias("edge"), near.alias("near"))
    # read back from its files, the join with the documents knows how small it is
    return stash(t.join(last, ["_no", "_src"], "left").select("source", "source_size", "target", "full", "edge", "near"), "thresholds")


def _taken(rows: DataFrame, t: DataFrame) -> DataFrame:
    """``(row, t, copies)`` of ``rows(row)``, whole input rows, whose names can therefore not clash with others."""
    t = t.select(F.struct("source_size", "target", "full", "edge", "near").alias("t"), F.col("source").alias("of"))
    place = _place(F.col("row.doc_id"))
    # no edge: the budget is not below the sum of all places
    extra = F.col("t.edge").isNull() | (place < F.col("t.edge")) | ((place == F.col("t.edge")) & F.col("t.near"))
    return rows.join(t, F.col("row.source").eqNullSafe(F.col("of"))).select("row", "t", (F.col("t.full") + extra.cast("int")).alias("copies"))


def _whole(df: DataFrame) -> DataFrame:
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def mix(sized: DataFrame) -> DataFrame:
    """Decide how often each document is taken.

    ``sized``: ``(doc_id, source, size)`` with any other columns.  Adds
    ``source_size``, ``target`` and ``copies`` (0, 1 or 2), in place of input
    columns of these names.  A source whose target is at least its size is taken
    whole and the rest of the target a second time.  Of the two sums around the
    target the nearer one is taken.  Rows of one source with the same id share
    their fate; in another source the same id has its own.  A null id is hashed
    like an empty one; sources may be null; an empty table gives an empty
    result.  The outcome depends on ids, sources and sizes only, so reruns agree.
    """
    new = ["source_size", "target", "copies"]
    out = _taken(_whole(sized), thresholds(sized.select("doc_id", "source", "size")))
    return out.select(*[F.col(f"row.`{c}`") for c in sized.columns if c not in new], "t.source_size", "t.target", "copies")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken (see :func:`mix`), with the columns of ``docs``."""
    key = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    out = _taken(_whole(docs), thresholds(stash(key, "sizes"))).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = stash(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    return mix(sized).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: The same by sorting each source by place.
OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS place,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, CAST(sum(3 * source_size) OVER () - coalesce(sum(4 * source_size) OVER b, 0) AS BIGINT) AS left2,
         CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS BIGINT) AS rest_w
  FROM s WINDOW b AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT left2 AS l2, rest_w AS rw FROM r WHERE w * left2 <= 4 * source_size * rest_w
  ORDER BY source_size / w, rest_w LIMIT 1),
t AS (
  SELECT source, source_size,
         least(CAST(2 * source_size AS DOUBLE), coalesce(CAST(w * l2 AS DOUBLE) / (rw * 2), CAST(2 * source_size AS DOUBLE))) AS target
  FROM r LEFT JOIN l ON true),
q AS (
  SELECT doc_id, size, source_size, target, CAST(target >= source_size AS INT) AS whole,
         target - CAST(target >= source_size AS INT) * source_size AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY place RANGE UNBOUNDED PRECEDING) AS upto,
         sum(size) OVER (PARTITION BY d.source, place) AS own
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN upto < rest THEN 1 WHEN upto - own >= rest THEN 0
                                 WHEN upto - rest < rest - (upto - own) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM q
"""
