"""Annotation files in parts: the rows of the whole files, wherever splits fall."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import annotation_parts, annotations


def _rows(df):
    return sorted(((str(r["file"]), int(r["line_no"]), r["func"], r["directive"], r["numbers"], r["texts"], r["error"]) for r in df.collect()), key=str)


@pytest.fixture
def splits(spark, monkeypatch):
    """Sets the size of splits for the text files alone: the table of blocks is read as usual."""
    setting, stash = "spark.sql.files.maxPartitionBytes", annotation_parts.stash

    def write(df, name):
        out = stash(df, name)
        spark.conf.unset(setting)
        return out

    monkeypatch.setattr(annotation_parts, "stash", write)
    yield lambda size: spark.conf.set(setting, size)
    spark.conf.unset(setting)


def _damaged(r):
    """A file of good and bad lines, with cuts at odd places."""
    some = ["func 7", "func x", "  func 9", "func\t3", "func ", "func", "end_func", "  end_func", "end_functions", 'name "é\\nfunc 1"', "ea 0x10", "cmt 1 0 \"\\x41\"", "", " ", "\t", "bogus 1", "arch \"x\"", "type 1 \"a\" \"b\""]
    head = r.choice(["#annotations v1", "#annotations v1", "", "\n\n#annotations v2", "func 1", "\t"])
    return r.choice(["", "\n"]) + r.choice(["\n", "\r\n"]).join([head, *[r.choice(some) for _ in range(r.randint(0, 40))]]) + r.choice(["", "\n", "\nfunc ", "\r", "\nend_func"])


@pytest.mark.parametrize("split", [7, 64, 1 << 20])
def test_plain_files_read_in_splits(spark, splits, tmp_path, split):
    r = random.Random(split)
    texts = {f"f{i}.txt": t for i in range(8 if split < 10 else 30) if (t := _damaged(r))} | {"cut": "\nfunc ", "line": "\n", "stray": "#annotations v1\nfunc 1\nfunc 2\nfunc 3\nfunc \nfunc "}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "empty").write_bytes(b"")
    whole = spark.createDataFrame(list(texts.items()), "file string, text string")
    splits(split)
    got = annotation_parts.read_parts(spark, str(tmp_path), folders=False).withColumn("file", F.element_at(F.split("file", "/"), -1))
    assert _rows(got) == _rows(annotations.read(whole))


def test_written_parts_are_the_file(spark, splits, tmp_path):
    r = random.Random(3)
    sections = [(f, 0, 0, p, 0, line) for f in ("a b", "x=1/é", "q") for p, line in enumerate(["#annotations v1", "image_base 0x1"])]
    sections += [("q", 1, i, 0, 0, f'type {i} "t{i}" "d"') for i in range(200)]
    for f in ("a b", "x=1/é", "q"):
        for i in range(300):
            sections += [(f, 2, i, 0, 0, f"func {i}"), (f, 2, i, 1, 0, f'  name "n{i}"'), (f, 2, i, 23, 0, "end_func")]
            sections += [(f, 2, i, 20, k, f'  cmt 0x{k:X} 0 "\\nfunc 1"') for k in range(r.randint(0, 6))]
    r.shuffle(sections)
    lines = spark.createDataFrame(sections, "file string, section int, owner long, part int, pos long, line string")
    path = str(tmp_path / "out")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        annotation_parts.write_parts(lines, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "out" / "file=q").glob("part-*"))) > 1
    splits(1000)
    got = annotation_parts.read_parts(spark, path)
    want = annotations.read(annotations.files(lines))
    assert _rows(got) == _rows(want)
    assert not got.where("error is not null").take(1)


def test_names_without_length_meet_and_are_null(spark, tmp_path):
    rows = [(None, 0, 0, 0, 0, "#annotations v1"), ("", 2, 1, 0, 0, "func 1"), ("", 2, 1, 23, 0, "end_func")]
    path = str(tmp_path / "out")
    annotation_parts.write_parts(spark.createDataFrame(rows, "file string, section int, owner long, part int, pos long, line string"), path)
    got = annotation_parts.read_parts(spark, path).orderBy("line_no").collect()
    assert [(r["file"], r["line_no"], r["func"], r["error"]) for r in got] == [(None, 1, None, None), (None, 2, 1, None), (None, 3, 1, None)]
