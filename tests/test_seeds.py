"""Start functions and anchors on small tables."""

from graphloom.functions import notation
from graphloom.operators import seeds
from pyspark.sql import functions as F

FUNCTIONS = [(1, 0x100, 0x180, "_main"), (2, 0x180, 0x190, "face"), (3, 0x1000, 0x2000, "send"), (4, 0x1800, 0x1810, "inner"), (5, 0x5000, 0x5000, "empty"), (6, 0x7000, 0x7001, None)]


def _functions(spark):
    return spark.createDataFrame(FUNCTIONS, "id long, start long, end long, name string")


def test_specs_lead_to_functions(spark):
    rows = [
        (1, " 0x17F ,180|send,\t\n|face"), (2, "0X1805"), (3, "0x"), (4, "0xsend,Send,0x0000000000000000000100"), (5, None), (6, ""), (7, ",|"), (8, "FFFFFFFFFFFFFFFF,10000000000000000"), (9, "5000,0,a b"), (1, "twice"),
    ]
    names = spark.createDataFrame([("send", 0x1000), ("send", 0x7000), ("face", 0x180), ("twice", 0x7000), ("a b", 0x100), (None, 1)], "name string, address long")
    requests = spark.createDataFrame(rows, "request long, text string")
    got = sorted((r["request"], r["pos"], r["spec"], r["address"], r["func"]) for r in seeds.resolved(seeds.specs(requests), _functions(spark), names).where("spec <> 'twice'").fillna(-9).collect())
    assert got == [
        (1, 0, "0x17F", 0x17F, 1), (1, 1, "180", 0x180, 2), (1, 2, "send", 0x1000, 3), (1, 4, "face", 0xFACE, -9), (2, 0, "0X1805", 0x1805, 4), (3, 0, "0x", -9, -9),
        (4, 0, "0xsend", -9, -9), (4, 1, "Send", -9, -9), (4, 2, "0x0000000000000000000100", 0x100, 1), (8, 0, "FFFFFFFFFFFFFFFF", -1, -9), (8, 1, "10000000000000000", -9, -9),
        (9, 0, "5000", 0x5000, -9), (9, 1, "0", 0, -9), (9, 2, "a b", 0x100, 1),
    ]


def test_anchors_of_three_kinds(spark):
    given = spark.createDataFrame([(3,), (3,), (99,), (None,)], "node long")
    entries = spark.createDataFrame([(0x101,), (0x1FFF,), (0x99999,), (None,)], "address long")
    got = sorted(tuple(r) for r in seeds.anchors(_functions(spark), given, entries).collect())
    assert got == [(1, False, True, True), (3, True, True, False)]
    none = seeds.anchors(_functions(spark).limit(0), given, entries)
    assert none.columns == ["node", "seed", "entry", "named"] and not none.take(1)


def test_direction(spark):
    rows = spark.createDataFrame([("lr",), ("TB",), ("",), ("x",)], "d string").select(notation.rank_direction(F.col("d")).alias("d")).collect()
    assert [r["d"] for r in rows] == ["LR", "TB", "TB", "TB"]
