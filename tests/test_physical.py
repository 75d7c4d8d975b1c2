"""What the physical plans must show: pruned columns, pushed filters, early limits, no windows over everything."""

import __spark_entry__ as e

from pinfold.queries.common import chunks
from pinfold.session import table


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_is_asked_for(spark, sf):
    plan = _plan(chunks(spark, sf, "title"))
    assert "title:string" in plan and "body:string" not in plan and "source_url" not in plan


def test_filters_reach_the_files(spark, sf):
    plan = _plan(table(spark, sf, "symbol").filter("library = 'corelib' AND fqn LIKE 'dev.%'").select("fqn"))
    assert "EqualTo(library,corelib)" in plan and "StringStartsWith(fqn,dev.)" in plan


def test_top_k_is_cut_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in _plan(e.queries()["bm25_batch"](spark, sf))
    assert "TakeOrderedAndProject" in _plan(e.queries()["bm25_topk"](spark, sf))


def test_page_is_joined_by_broadcast(spark, sf):
    assert "BroadcastHashJoin" in _plan(e.queries()["late_hydrate"](spark, sf))


def test_no_cartesian_products(spark, sf):
    for name in ("search_batch", "diff_report", "catalog_check", "symbol_lookup", "p2_found", "reverse_replacement"):
        plan = _plan(e.queries()[name](spark, sf))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
