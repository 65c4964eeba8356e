"""The driver contract, and queries against their SQL on the smallest data."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from inkstone.plans import queries as core

DATA = "/root/testdata/sf0.001"
SOME = ("image_based_sources", "repeated_lines", "clean_pdf", "heading_sections", "table_dedup", "doc_years", "bm25_topk", "rrf_fusion", "rerank_topk", "dense_topk_filtered", "best_bullet", "context_build", "chart_route", "numbers_extract", "rouge2", "leaderboard", "stage_elapsed", "sliding_windows", "session_windows", "supplemented_pages", "multi_doc_merge", "br_table_dedup")


def plain(x):
    if isinstance(x, float):
        return f"{x:.9g}"
    return str(x)


@pytest.mark.parametrize("name", SOME)
def test_query_agrees_with_sql(spark, name):
    with duckdb.connect() as c:
        for p in Path(DATA).glob("*.parquet"):
            c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        r = c.sql(core.oracle_sql()[name])
        cols = sorted(r.columns)
        want = sorted(str([plain(x[r.columns.index(k)]) for k in cols]) for x in r.fetchall())
    df = core.queries()[name](spark, DATA)
    assert sorted(df.columns) == cols
    assert sorted(str([plain(x[k]) for k in cols]) for x in df.collect()) == want


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_queries_survive_a_missing_library():
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; q = e.queries(); assert 'clean_pdf' in q and 'p4_found' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=Path(entry.__file__).parent, check=True, timeout=120)
