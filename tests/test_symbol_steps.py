"""Diffs of every step between seasons, on hand-made rows and against SQL."""

import duckdb
import pytest

from pinfold.operators import symbols
from pinfold.queries import registry


def test_each_library_is_diffed_by_itself_at_every_step(spark):
    rows = [("a", "1", "2", "p.X"), ("a", "2", "3", "q.X"), ("b", "1", "2", "p.Y")]
    new = [("a", "1", "2", "q.X"), ("a", "2", "3", "q.X"), ("b", "1", "2", "p.X"), ("b", "1", "2", "p.Y")]
    cols = "library string, season_from string, season_to string, fqn string"
    got = [sorted(map(tuple, d.collect())) for d in symbols.diff(spark.createDataFrame(rows, cols), spark.createDataFrame(new, cols), ("library", "season_from", "season_to"))]
    assert got == [[("a", "1", "2", "p.X")], [("a", "1", "2", "q.X"), ("b", "1", "2", "p.X")], [("a", "1", "2", "p.X", "q.X")]]


@pytest.mark.parametrize("name", ["diff_steps", "diff_counts"])
def test_every_step_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW symbol AS SELECT * FROM '{sf}/symbol.parquet'")
    df = registry.queries()[name](spark, sf)
    want = con.execute(registry.oracle_sql()[name]).fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want)) and len({r[2:4] for r in want}) > 1
