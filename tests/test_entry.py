"""Registered queries against DuckDB on the smallest tables; all of them with FULL_ORACLE=1."""

import datetime
import decimal
import math
import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from newsloom.plans.queries import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["exact_clusters", "border_pairs", "filing_candidates", "canonical_urls", "injection_scan", "ingested_articles", "story_feed", "source_health", "budget_admission", "retention_counts", "filing_titles"]
NAMES = sorted(ORACLE_SQL) if os.environ.get("FULL_ORACLE") else QUICK


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return None if isinstance(v, float) and math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    df = QUERIES[name](spark, D)
    columns = sorted(df.columns)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    rows = want.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(map(repr, (plain(r) for r in got))) == sorted(map(repr, (plain(r) for r in rows)))


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(QUERIES) <= set(queries) and set(sql) <= set(queries) and len(QUERIES) >= 60


def test_library_stands_alone():
    """Nothing but the registry's guard needs the training-data operators."""
    code = "import sys; sys.modules['newsloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert set(e.queries()) == set(e.plan_queries.QUERIES)"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, env=os.environ | {"PYTHONPATH": root})
