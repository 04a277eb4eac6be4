"""The whole text of facts, by hand."""

from graphloom.operators import tracing

FUNCTIONS = [(10, 0x200, "beta"), (11, 0x100, "alpha"), (12, 0x300, None)]
PARAMS = [(10, 0, "first"), (11, 0, "x")]
ALIASES = [(11, 2, "L", "v", "P", "x", -4), (11, 1, "P", "x", "C", "", 0), (11, 3, "P", "x", "C", "", 0), (99, 1, "L", "v", "C", "", 0)]
USES = [
    (11, 5, 0x110, 0x200, 0, "P", "x", 8, "*", "", "high"), (11, 6, 0, 0x200, 1, "L", "", 0, "", "m", "low"), (10, 1, 0x210, 0x300, 0, "G", "tab", 0, "", "", "med"), (12, 1, 0x310, 0x900, 2, "R", "", 0, "", "", "med"),
    (12, 2, 0x320, None, 0, "R", "", 0, "", "", "med"),
]
ACCESSES = [(10, 1, 0x5000, "", True), (11, 1, 0x5000, "tab", False), (12, 2, 0x5000, "late", False), (12, 3, 0x6000, "", True), (12, 4, 0x6000, "", False), (10, 9, 0x7000, "only", True)]
WHOLE = """#PTN v1
D:F1=0x100,alpha;F2=0x200,beta;F3=0x300
D:F1=0x100,alpha
A:P(x):=C(0x0) {conf=med}
A:L(v):=P(x)@[0xFFFFFFFC:?] {conf=med}
D:F2=0x200,beta
D:F3=0x300,
I:P(x)@[0x8:?]* {caller=F1,conf=med,cs=0x110} -> P(first)
I:L(F1,0) {caller=F1,conf=med} -> P(F2,1)
I:G(tab) {caller=F2,conf=med,cs=0x210} -> P(F3,0)
E:P(x)@[0x8:?]* {conf=high,cs=0x110} -> A(beta,0)
E:L(F1,0).m {conf=low} -> A(beta,1)
E:G(tab) {conf=med,cs=0x210} -> A(F3,0)
E:R(F3) {conf=med,cs=0x310} -> A(F?,2)
G:F(beta) -> G(tab) -> F(alpha)
G:F(beta) -> G(tab) -> F(F3)
G:F(F3) -> G(0x6000) -> F(F3)
"""


def _text(spark, functions=FUNCTIONS, wanted=None):
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    parts = tracing.program_text(
        make(functions, "id long, start long, name string"), make(PARAMS, "func long, idx long, name string"), make(ALIASES, "func long, seq long, kind string, var string, origin string, name string, offset long"),
        make(USES, "func long, seq long, at long, callee long, arg long, origin string, name string, offset long, mode string, member string, conf string"),
        make(ACCESSES, "func long, seq long, obj long, name string, is_write boolean"), None if wanted is None else make([(w,) for w in wanted], "id long"),
    ).collect()
    return "".join(r.text for r in sorted(parts, key=lambda r: tuple(r)[:5]))


def test_whole_text(spark):
    assert _text(spark) == WHOLE


ALONE = """#PTN v1
D:F2=0x200,beta
I:P(x)@[0x8:?]* {caller=F1,conf=med,cs=0x110} -> P(first)
I:L(F1,0) {caller=F1,conf=med} -> P(F2,1)
E:G(tab) {conf=med,cs=0x210} -> A(F3,0)
G:F(beta) -> G(tab) -> F(alpha)
G:F(beta) -> G(tab) -> F(F3)
"""


def test_wanted_function_alone(spark):
    # the dictionary of one function is its definition, and equal lines stand once
    assert _text(spark, wanted=[10]) == ALONE


def test_nothing(spark):
    assert _text(spark, functions=[]) == "#PTN v1\nD:\n"
