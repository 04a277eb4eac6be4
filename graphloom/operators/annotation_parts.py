"""Annotation files of any size, written as parts and read in blocks, without a row that holds a file.

A written file is a folder ``file=<name>`` of parts that follow each other by
name; no function's directives stand in two parts.  The reader lets the text
source cut files at the lines that begin a function, so a file of several GB is
read by as many tasks as it has splits, on any file system that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.annotations import MAGIC, decoded
from graphloom.plans.stash import stash

#: Where files are cut.  It starts with the only line end in it and cannot overlap itself, so every split finds the same cuts; a line
#: end within quotes is escaped, so each cut is a directive.  Indented ones are not cut, which makes blocks longer and no row differ.
CUT = "\nfunc "
_PLACE = ["file", "part", "name", "start"]


def write_parts(lines: DataFrame, path: str) -> None:
    """``annotations.written``'s lines as folders of parts below ``path``: ranges of (file, section, owner), sorted within.

    A null file and one whose name has no length are the same folder, which is read as null.
    """
    # not null: otherwise the writer would replace empty names and sort again by the file alone
    file = F.coalesce(F.col("file").cast("string"), F.lit("")).alias("file")
    key = ["file", "section", "owner"]
    rows = lines.select(file, "section", "owner", "part", "pos", "line").repartitionByRange(*key).sortWithinPartitions(*key, "part", "pos", "line")
    rows.select("line", "file").write.partitionBy("file").text(path)


def blocks(spark: SparkSession, path: str, folders: bool = True) -> DataFrame:
    """``(file, part, name, start, block, followed, text)``: the stretches of files between cuts.

    ``folders``: files are folders of parts as ``write_parts`` makes them; else each plain file
    stands for itself under its path.  ``start`` is the split a block begins in and ``block`` rises within it;
    ``followed`` says that a cut comes after it.  Files must not be compressed.
    """
    schema = "value string, file string" if folders else "value string"
    meta = lambda x: F.col(f"_metadata.{x}")
    found = spark.read.schema(schema).option("lineSep", CUT).text(path).select(
        (F.col("file") if folders else meta("file_path")).alias("file"), F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(meta("file_name"), r"^part-(\d+)", 1), F.lit("")), F.lit("9999999999")), F.lit(-1)).cast("long").alias("part"),
        meta("file_path").alias("name"), meta("file_block_start").alias("start"), F.monotonically_increasing_id().alias("block"), meta("file_size").alias("size"), F.octet_length("value").alias("bytes"), "value",
    )
    # written, as a second scan might be cut into other splits
    raw = stash(found, "annotation-blocks")
    whole = raw.groupBy("name").agg(F.max(F.struct("start", "block")).alias("_last"), (F.max("size") - F.sum("bytes") - len(CUT) * (F.count("*") - 1)).alias("_rest"))
    last = F.struct("start", "block") == F.col("_last")
    piece = lambda block, followed, text: F.struct(block.alias("block"), followed.alias("followed"), text.alias("text"))
    # a cut at the very end of a file gives no row of its own
    ends = piece(F.col("block"), F.lit(True), F.col("value")), piece(F.col("block") + 1, F.lit(False), F.lit(""))
    each = F.when(last & (F.col("_rest") >= len(CUT)), F.array(*ends)).otherwise(F.array(piece(F.col("block"), ~last, F.col("value"))))
    return raw.join(whole, "name").select(*_PLACE, F.explode(each).alias("x")).select(*_PLACE, "x.*")


def read_parts(spark: SparkSession, path: str, folders: bool = True) -> DataFrame:
    """The rows of ``annotations.read`` (file as text, line numbers as long), of files that ``blocks`` cuts.

    Line ends are counted block by block within a split and split by split
    within a file, so windows see one split, or one row a split; directives are decoded
    block by block.  A file that starts with an empty part is taken to start with the next.
    """
    within = Window.partitionBy(*_PLACE).orderBy("block")
    b = blocks(spark, path, folders)
    first_line = F.get(F.filter(F.split("text", "\r?\n"), lambda x: F.trim(x) != ""), F.lit(0))
    opens = F.coalesce(F.trim(F.regexp_replace(first_line, "\t", " ")).startswith(MAGIC), F.lit(False))
    b = b.withColumn("first", (F.col("start") == 0) & (F.row_number().over(within) == 1)).withColumn("own", (~F.col("first")).cast("long"))
    b = b.withColumn("ends", F.regexp_count("text", F.lit("\n")) + F.col("own"))
    b = b.withColumn("above", F.coalesce(F.sum("ends").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    in_file = Window.partitionBy("file").orderBy("part", "name", "start")
    splits = b.groupBy(*_PLACE).agg(F.sum("ends").alias("_ends"), F.min_by(opens & F.col("first"), "block").alias("_opens"))
    splits = splits.select(
        *_PLACE, F.coalesce(F.sum("_ends").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_above"),
        F.first("_opens").over(in_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_opened"),
    )
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"s.{c}")) for c in _PLACE]
    b = b.alias("b").join(splits.alias("s"), same).select("b.*", "_above", "_opened")
    text = F.when(F.col("followed"), F.regexp_replace("text", "\r\\z", "")).otherwise(F.col("text"))
    text = F.when(F.col("first"), text).otherwise(F.concat(F.lit(CUT[1:]), text))
    lines = b.select("file", "name", "start", "block", "_opened", (F.col("_above") + F.col("above") + F.col("own") + 1).alias("_top"), F.posexplode(F.split(text, "\r?\n")).alias("line_no", "line"))
    return decoded(lines.withColumn("line_no", F.col("line_no") + F.col("_top")), ["name", "start", "block"], "_opened")
