"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Two lines are duplicates if their words are equal or differ by one edit (a word
replaced, inserted or left out; lines of at least ``MIN_WORDS`` words).  Every
line emits its variants with one word deleted as hashed keys, equal variants
meet in an aggregation, the edit distance is verified on the words, and the
earliest line (by document, then place) is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.stash import stash

#: Shorter lines are duplicates only if equal: one word is a large part of them.
MIN_WORDS = 5
_GAPS = " \t\x0b\f\r"


def _words(line: Column) -> Column:
    return F.split(F.btrim(line, F.lit(_GAPS)), r"[ \t\x0B\f\r]+", -1)


#: What tells one row from another: its id, its text, and its number among rows that share both.
ROW = ["doc_id", "text_key", "copy"]


def _keyed(docs: DataFrame) -> DataFrame:
    """``(*ROW, text, row)``: ``row`` holds the other columns of the input, so that no name of them can clash.

    Where all ids are different (one narrow aggregation tells) the other two are zero.
    """
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    if not docs.groupBy("doc_id").count().where("count > 1").take(1):
        return whole.select("doc_id", F.lit(0).cast("long").alias("text_key"), F.lit(0).alias("copy"), "text", "row")
    whole = whole.withColumn("text_key", F.xxhash64("text"))
    same = Window.partitionBy("doc_id", "text_key").orderBy(F.xxhash64(F.col("row").cast("string")))
    return whole.withColumn("copy", F.row_number().over(same) - 1).select(*ROW, "text", "row")


def _lines(docs: DataFrame) -> DataFrame:
    """``(*ROW, line_no, w)``: the words of each line that has some."""
    lines = docs.select(*ROW, F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.select(*ROW, "line_no", _words(F.col("line")).alias("w")).where("w[0] <> ''")


def _hash(kind: str, *parts: Column) -> Column:
    """Of arrays of words their words count, one after the other: two parts of an array give the whole's hash."""
    return F.xxhash64(F.lit(kind), *parts)


def _halves(n: Column, w: Column) -> Column:
    """Keys of the outer words, and the places where a partner with the same key can differ.

    Lines of m - 1 and m, or of m and m words, that are one edit apart agree in
    their first or last (m - 2) / 2 words; each line stands for m = n and m = n + 1.
    """
    out = []
    for m in (n, n + 1):
        k = F.floor((m - 2) / 2).cast("int")
        head = F.struct(_hash("head", F.slice(w, F.lit(1), k), m).alias("half"), (k + 1).alias("lo"), n.alias("hi"))
        tail = F.struct(_hash("tail", F.slice(w, n - k + 1, k), m).alias("half"), F.lit(1).alias("lo"), (n - k).alias("hi"))
        out += [head, tail]
    return F.array(*out)


def _without(w: Column, n: Column, i: Column) -> Column:
    return F.concat(F.slice(w, F.lit(1), i - 1), F.slice(w, i + 1, n - i))


def line_verdicts(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, n_words, kept, first_doc, first_line)`` of each line with words.

    ``kept`` is false if an earlier line is equal or one edit away; ``first_*``
    names one such line (the earliest equal one, or else the earliest found one
    edit away), null for kept lines.  One edit is allowed from ``MIN_WORDS``
    words on, none below.  Lines without words have no row.  Null texts have no
    lines.  Each row is a document of its own, also among rows that share an id
    or have none: they stand in the order of a hash of their texts, equal ones
    after each other.  An empty table gives an empty result.

    Equal lines are one class by a 128-bit hash, so a line repeated in a third
    of all documents is a single row from the first aggregation on.  Before
    variants are made, a line is dropped from the search if no other line shares
    the key of its first or last half, which any partner must; variants with the
    same deleted place are within one edit of each other, so each meets only the
    earliest of its key, never all others.
    """
    return _verdicts(_keyed(docs)).drop("text_key", "copy")


def _verdicts(docs: DataFrame) -> DataFrame:
    """:func:`line_verdicts` of keyed rows, with their keys."""
    words = _lines(docs)
    n = F.size("w")
    halves = F.when(n >= MIN_WORDS, _halves(n, F.col("w")))
    line = stash(words.select(*ROW, "line_no", n.alias("n_words"), _hash("a", F.col("w")).alias("h1"), _hash("b", F.col("w")).alias("h2"), halves.alias("halves")), "lines")
    # an exploded row for each (line, place); the earliest stands for the class
    at = F.struct(*ROW, "line_no")
    whole = stash(line.groupBy("h1", "h2").agg(F.min(at).alias("first")), "whole")
    half = line.where("halves is not null").select("h1", "h2", F.explode("halves").alias("x")).select("h1", "h2", "x.*")
    shared = half.groupBy("half").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).where("x <> y").select("half")
    alike = half.join(shared, "half").groupBy("h1", "h2").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).join(whole, ["h1", "h2"])
    places = stash(alike.select("h1", "h2", "lo", "hi", "first.*"), "alike")
    by_doc = places.groupBy(*ROW).agg(F.collect_set("line_no").alias("wanted"))
    # both sides grow with the corpus, so the join is a merge at every size, never a broadcast of what happens to be small
    text = _meet(docs.where("text is not null").select(*ROW, "text"), by_doc.hint("merge"))
    wanted = text.select("wanted", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).where(F.array_contains("wanted", F.col("line_no")))
    w = _words(F.col("line"))
    wanted = wanted.select(w.alias("w"), _hash("a", w).alias("h1"), _hash("b", w).alias("h2"), F.size(w).alias("n"))
    cand = places.join(wanted, ["h1", "h2"]).dropDuplicates(["h1", "h2"])
    cand = stash(cand.select(at.alias("id"), "h1", "h2", "lo", "hi", "w", "n"), "candidates")
    # variants: the same place deleted in lines of one length (s), or a line without one word equal to another (d)
    gone = cand.select("id", "n", "w", F.explode(F.sequence("lo", "hi")).alias("i"))
    i = F.col("i")
    gone = gone.select("id", "n", "i", _hash("d", F.slice("w", F.lit(1), i - 1), F.slice("w", i + 1, F.col("n") - i)).alias("key"))
    roles = F.array(F.struct(F.lit("s").alias("role"), _hash("s", F.col("key"), F.col("n"), i).alias("key")), F.struct(F.lit("d").alias("role"), "key"))
    gone = gone.select("id", "i", F.explode(roles).alias("r")).select("id", "r.role", "i", "r.key")
    o = cand.select("id", F.lit("o").alias("role"), F.lit(0).alias("i"), _hash("d", F.col("w")).alias("key"))
    variants = stash(gone.unionAll(o), "variants")
    first = lambda role: F.min(F.when(F.col("role") == role, F.struct("id", "i")))
    met = variants.groupBy("key").agg(first("s").alias("s"), first("d").alias("d"), first("o").alias("o"), F.count("*").alias("c")).where("c > 1")
    pair = variants.join(met, "key")
    other = F.when(F.col("role") == "s", F.col("s")).when(F.col("role") == "d", F.col("o")).otherwise(F.col("d"))
    pair = pair.select("id", "i", "role", other.alias("p")).where("p is not null and p.id < id")
    own = cand.select("id", "h1", "h2", "w", "n")
    pair = pair.select("id", "i", "role", F.col("p.id").alias("to"), F.col("p.i").alias("j")).join(own, "id")
    pair = pair.join(own.select(F.col("id").alias("to"), F.col("w").alias("x"), F.col("n").alias("m")), "to")
    # verified on the words: without the deleted places both are the same
    left = F.when(F.col("i") > 0, _without(F.col("w"), F.col("n"), F.col("i"))).otherwise(F.col("w"))
    right = F.when(F.col("j") > 0, _without(F.col("x"), F.col("m"), F.col("j"))).otherwise(F.col("x"))
    near = pair.where(left == right).groupBy("h1", "h2").agg(F.min("to").alias("near"))
    known = whole.select("h1", "h2", "first").join(near, ["h1", "h2"], "left")
    out = line.select(*ROW, "line_no", "n_words", "h1", "h2").join(known, ["h1", "h2"])
    same = F.when(F.col("first").eqNullSafe(at), F.col("near")).otherwise(F.col("first"))
    out = out.withColumn("by", same)
    return out.select(*ROW, "line_no", "n_words", F.col("by").isNull().alias("kept"), F.col("by.doc_id").alias("first_doc"), F.col("by.line_no").alias("first_line"))


def _meet(docs: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the key of rows, null ids included."""
    other = other.withColumnRenamed("doc_id", "other_id")
    same = F.col("doc_id").eqNullSafe(F.col("other_id")) & (docs["text_key"] == other["text_key"]) & (docs["copy"] == other["copy"])
    return docs.join(other, same, how).drop("other_id", other["text_key"], other["copy"])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Documents without their duplicate lines, with the columns of ``docs``.

    Lines without words stay.  A document that loses every line that had words
    goes, so of repeated rows one stays; one without words from the start (null
    or empty text) stays as it is.  ``n_chars``, if there, follows the new text.
    """
    keyed = _keyed(docs)
    verdicts = stash(_verdicts(keyed), "verdicts")
    lost = verdicts.groupBy(*ROW).agg(F.collect_set(F.when(~F.col("kept"), F.col("line_no"))).alias("lost"), F.bool_or("kept").alias("some"))
    d = _meet(keyed, lost.where("size(lost) > 0"), "left").where(F.coalesce("some", F.lit(True)))
    kept = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("lost", i))
    new = {"text": F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("lost").isNull(), F.col("row.n_chars")).otherwise(F.length(new["text"])).cast(docs.schema["n_chars"].dataType)
    return d.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "line_no", "n_words", "kept", "first_doc", "first_line")


#: The same with the words themselves as keys.
OP1_SQL = r"""
WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
y AS (SELECT doc_id, unnest(range(0, len(l))) AS line_no, unnest(l) AS line FROM x),
z AS (SELECT doc_id, CAST(line_no AS INT) AS line_no, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM y),
l AS (SELECT doc_id, line_no, w, CAST(len(w) AS INT) AS n, {'d': doc_id, 'l': line_no} AS id FROM z WHERE len(w) > 0),
c AS (SELECT w, n, min(id) AS id FROM l GROUP BY w, n),
g AS (
  SELECT id, n, i, w[1 : i - 1] || w[i + 1 : n] AS v
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM c WHERE n >= 5)),
p AS (
  SELECT id, min(id) OVER (PARTITION BY n, i, v) AS to_ FROM g
  UNION ALL SELECT greatest(g.id, c.id), least(g.id, c.id) FROM g JOIN c ON g.v = c.w WHERE c.n >= 5),
near AS (SELECT id, min(to_) AS near FROM p WHERE to_ < id GROUP BY id),
r AS (
  SELECT l.*, CASE WHEN c.id = l.id THEN near.near ELSE c.id END AS by_
  FROM l JOIN c ON l.w = c.w LEFT JOIN near ON near.id = c.id)
SELECT doc_id, line_no, n AS n_words, by_ IS NULL AS kept, by_.d AS first_doc, by_.l AS first_line FROM r
"""
