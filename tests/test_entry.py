"""The driver contract: queries and their SQL agree on the small tables, and llm can be taken away."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from graphloom.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries of several seconds, whose operators have tests of their own; ALL_QUERIES=1 compares them too.
SLOW = set("""
address_taken affinity_edges alias_chain annotation_files annotation_functions annotation_lines annotation_parts_functions apply_mapping assigned_values betweenness betweenness_pivots
call_arguments carried_annotations carried_counts callee_bfs caller_bfs centrality_rank cluster_labels code_dump_budget coreness dominator_subtree export_ids export_order expression_origins
followed_edges harmonic hits instruction_edges liveness meta_backbone meta_document outbound_edges pagerank pagerank_reverse pagerank_seeded param_forward_chains producer_counts program_facts
reach_estimate reach_size replayed_targets rrf_rank runtime_name scc_members shown_edges topo_level trimmed_types type_closure typed_neighbourhood
utility_hubs virtual_dispatch vtable_runs
""".split())
COMPARED = sorted(set(registry.SQL) - (set() if os.environ.get("ALL_QUERIES") else SLOW))


def _values(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("null" if x is None or x != x else f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in df.astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", COMPARED)
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    mine, theirs = entry.queries()[name](spark, DATA).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    mine = mine.astype({c: "Int64" for c in mine if mine[c].dtype == "float64" and str(theirs[c].dtype).startswith("Int")})
    fix = lambda df: df.astype(object).where(df.notna(), None)
    assert _values(fix(mine)) == _values(fix(theirs))


def test_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_llm(tmp_path):
    root = Path(entry.__file__).parent
    (tmp_path / "graphloom").mkdir()
    for p in (root / "graphloom").iterdir():
        if p.name != "llm":
            (tmp_path / "graphloom" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
