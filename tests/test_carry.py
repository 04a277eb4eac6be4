"""Export in order of discovery and application in phases, against a plain walk and by hand."""

import random
import uuid

from pyspark.sql import functions as F

from graphloom.operators import annotations, carry

MAGIC = annotations.MAGIC + "1"


def _walk(calls, root, depth):
    """The numbers that opening one function after the other gives."""
    numbers, found, layer = {root: 1}, {root: 0}, [root]
    ordered = sorted(calls, key=lambda c: c[1])
    for d in range(1, depth + 1):
        new = []
        for f in layer:
            for src, _, dst in ordered:
                if src == f and dst not in numbers:
                    numbers[dst], found[dst] = len(numbers) + 1, d
                    new.append(dst)
        layer = new
    for src, _, dst in ordered:
        if src in found and dst not in numbers:
            numbers[dst] = len(numbers) + 1
    return {n: (i, found.get(n)) for n, i in numbers.items()}


def test_numbers_follow_discovery(spark):
    rng = random.Random(3)
    calls = [(s, 1000 * s + at, rng.randrange(60)) for s in range(60) for at in rng.sample(range(1000), 3)]
    frame = spark.createDataFrame(calls, "src long, at long, dst long")
    root = spark.createDataFrame([(7,)], "node long")
    for depth in (0, 2):
        got = {r.node: (r.id, r.depth) for r in carry.discovered(frame, root, depth).collect()}
        assert got == _walk(calls, 7, depth)
    assert carry.discovered(frame.limit(0), root.limit(0), 2).count() == 0


FILE = f"""{MAGIC}
root_ea 0x64
type 1 "S" "struct S {{}};"
func 2
  name "leaf"
  ea 0xC8
  fp_size 5
  fp_insns 1
  fp_bbs 1
  fp_hash 0x9
  proto "int leaf()"
  cmt 0x3 1 "seen"
  cmt 0x4 0 "past the end"
  lvar none 0 0x0 "" "int"
  lvar reg 3 0x2 "" ""
end_func
func 1
  name "top"
  ea 0x64
  fp_size 10
  fp_insns 2
  fp_bbs 1
  fp_hash 0x7
  func_cmt_rpt "again"
  callee 0x2 2
  callee 0x4 3
end_func
"""


def _apply(spark, text, **more):
    target = spark.createDataFrame([(1100, 1110, 10, 2, 1, 7), (1200, 1204, 5, 1, 1, 9)], "target long, end long, size long, insns long, blocks long, shape long")
    sites = spark.createDataFrame([(1100, 2, 1200), (1100, 4, 1300)], "target long, rva long, to long")
    return carry.applied(spark.createDataFrame([(1, text)], "file int, text string"), target, sites, F.lit(1100), **more)


def test_phases_and_their_resumption(spark):
    run = f"test-{uuid.uuid4().hex}"
    mapping, types, made = _apply(spark, FILE, run=run)
    assert sorted(tuple(r) for r in mapping.collect()) == [(1, 1100, True), (2, 1200, True)]
    assert [tuple(r) for r in types.collect()] == [(1, "S", "struct S {};")]
    want = [
        (1, 1100, "function comment", None, "repeatable", "again"), (1, 1100, "name", None, "", "top"), (2, 1200, "comment", 3, "repeatable", "seen"), (2, 1200, "name", None, "", "leaf"),
        (2, 1200, "prototype", None, "", "int leaf();"), (2, 1200, "variable", None, "none 0", "int"),
    ]
    assert sorted(map(tuple, made.collect()), key=str) == sorted(want, key=str)
    assert {(r.phase, r.what): r.n for r in carry.report(2, mapping, types, made).collect()} == {
        ("verify", "matched"): 2, ("verify", "not found"): 0, ("types", "type"): 1, ("apply", "name"): 2, ("apply", "prototype"): 1, ("apply", "function comment"): 1, ("apply", "comment"): 1, ("apply", "variable"): 1,
    }
    # phases that were finished are not made again, whatever the file says now
    assert _apply(spark, MAGIC, run=run)[2].count() == len(want)


def test_differing_functions_and_empty_files(spark):
    mapping, _, made = _apply(spark, FILE.replace("fp_hash 0x7", "fp_hash 0x8"), names=False)
    assert [tuple(r) for r in mapping.collect()] == [(1, 1100, False)] and made.count() == 0
    mapping, types, made = _apply(spark, MAGIC)
    assert (mapping.count(), types.count(), made.count()) == (0, 0, 0)
