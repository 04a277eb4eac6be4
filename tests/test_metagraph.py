"""The document of subsystems against what it should say."""

from graphloom.operators import metagraph

CLUSTERS = "cluster long, label string, category string, utility boolean, functions long, evidence string"
META = "src_cluster long, dst_cluster long, count long"


def _text(df):
    return "\n".join(r["line"] for r in df.orderBy("section", "a", "b", "key").collect()) + "\n"


def test_document(spark):
    clusters = spark.createDataFrame(
        [(0, "net & io (4 funcs)", "network", False, 4, "send <1>"), (1, None, None, False, 1, None), (2, "rt", "crypto", True, 10_000, ""), (3, "void", "cli", False, 0, ""), (4, "odd", "bogus", False, 2, "")], CLUSTERS
    )
    meta = spark.createDataFrame([(0, 1, 100), (1, 0, 5), (4, 0, 2), (0, 2, 1000), (1, 4, 1)], META)
    text = _text(metagraph.meta_document(clusters, meta, "LR"))
    lines = text.split("\n")
    assert '    rankdir=LR;' in lines and "    splines=spline;" in lines and text.startswith("digraph subsystems {\n") and text.endswith("\n    }\n}\n")
    nodes = [x for x in lines if x.startswith("    c_") and "->" not in x]
    assert nodes == [
        '    c_0 [label=<<B>net &amp; io</B><BR/><FONT POINT-SIZE="9" COLOR="#5a6270">4 funcs</FONT><BR/><FONT POINT-SIZE="8" COLOR="#8a94a6">send &lt;1&gt;</FONT>> fillcolor="#CFE3FF" color="#2F6FD0" fontsize=17 penwidth=1.4];',
        '    c_1 [label=<<B></B><BR/><FONT POINT-SIZE="9" COLOR="#5a6270">1 funcs</FONT>> fillcolor="#E6E6EA" color="#8A8A96" fontsize=11 penwidth=1.3];',
        '    c_2 [label=<<B>rt</B><BR/><FONT POINT-SIZE="9" COLOR="#5a6270">10000 funcs</FONT>> fillcolor="#ECECEC" color="#9E9E9E" fontsize=24 penwidth=4.2 style="rounded,filled,dashed"];',
        '    c_4 [label=<<B>odd</B><BR/><FONT POINT-SIZE="9" COLOR="#5a6270">2 funcs</FONT>> fillcolor="#E6E6EA" color="#8A8A96" fontsize=14 penwidth=1.34142];',
    ]
    # at least 6 of 100, or the strongest of a node; nothing at the runtime, whose count still sets the shade
    assert [x.split(" [")[0].strip() for x in lines if "->" in x] == ["c_0 -> c_1", "c_4 -> c_0"]
    assert '    c_0 -> c_1 [penwidth=6 color="#3341559D" weight=100];' in lines
    assert [x.split('POINT-SIZE="9">')[1].split("<")[0] for x in lines if "<TR>" in x] == ["other", "network", "other", "runtime / STL"]


def test_nothing_to_draw(spark):
    text = _text(metagraph.meta_document(spark.createDataFrame([], CLUSTERS), spark.createDataFrame([], META)))
    assert "legend" not in text and "->" not in text and text.startswith("digraph subsystems {\n") and text.endswith("}\n")
