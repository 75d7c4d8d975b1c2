"""The entry module: readable without a session, llm optional, names consistent, small queries against their SQL."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_need_no_session():
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q))"], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and int(out.stdout) > 60, out.stderr[-500:]


def test_core_never_imports_llm():
    for f in glob.glob(f"{ROOT}/pinfold/**/*.py", recursive=True):
        if "/llm/" not in f:
            assert "pinfold.llm" not in open(f).read(), f


def test_entry_runs(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["query_id", "doc_id", "ord", "season", "hit", "score", "rank"] and df.count() > 0


@pytest.mark.parametrize("name", ["version_order", "diversity_max2", "catalog_check", "latency_percentiles", "p2_found", "p3_report", "validate_rejects", "stream_counts"])
def test_query_equals_its_sql(spark, sf, name):
    import __spark_entry__ as e

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    df = e.queries()[name](spark, sf)
    cols = sorted(df.columns)
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    got = sorted([show(r[c]) for c in cols] for r in df.collect())
    rel = con.execute(e.oracle_sql()[name])
    at = [[d[0] for d in rel.description].index(c) for c in cols]
    assert got == sorted([show(r[i]) for i in at] for r in rel.fetchall())
