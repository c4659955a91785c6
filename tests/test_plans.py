"""Shapes of the plans: what is pruned, what is pushed down, what must not occur."""

import contextlib
import io
import re
import time

import pytest
from conftest import SMALL
from frames import rows_of

import __spark_entry__ as contract
from turnstile.plans import queries as registry
from turnstile.sources import tables

_ALL = sorted(registry.queries())


def _plan(df, mode: str = "simple") -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode=mode)
    return out.getvalue()


@pytest.mark.parametrize("name", _ALL)
def test_no_cross_join_no_python_no_single_partition_window(spark, name):
    plan = _plan(contract.queries()[name](spark, SMALL))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert node not in plan
    gathered = r"Window .*\n\W*(Project .*\n\W*)?Sort .*\n\W*Exchange SinglePartition"
    assert not re.search(gathered, plan)


@pytest.mark.parametrize("name", ["audience_top_cities", "audience_top_loyal"])
def test_top_k_needs_no_full_sort(spark, name):
    assert "TakeOrderedAndProject" in _plan(contract.queries()[name](spark, SMALL))


def test_only_date_filters_bound_the_scan(spark):
    plan = _plan(contract.queries()["revenue_by_show"](spark, SMALL), "formatted")
    assert "(o_orderdate," not in plan


def test_only_needed_tables_and_columns_are_read(spark):
    plan = _plan(contract.queries()["norm_money"](spark, SMALL), "formatted")
    assert "part.parquet" not in plan and "customer.parquet" not in plan
    plan = _plan(contract.queries()["status_distribution"](spark, SMALL), "formatted")
    read = [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<(.*?)>", plan)]
    lines = next(r for r in read if "l_orderkey" in r)
    assert lines == {"l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"}


def test_sort_merge_plans_give_the_same(spark):
    """Beyond the broadcast limit everything still works, by sort-merge."""
    names = ["kpis", "channel_by_show", "category_mix", "door_rows", "audience_age_gender"]
    usual = {n: rows_of(contract.queries()[n](spark, SMALL)) for n in names}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in names:
            df = contract.queries()[name](spark, SMALL)
            assert "BroadcastHashJoin" not in _plan(df)
            assert rows_of(df) == usual[name]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_derived_columns_do_not_depend_on_the_selection_of_columns(spark):
    whole = tables.tickets(spark, SMALL).select("ticket_id", "event_name", "contact_locality")
    part = tables.tickets(spark, SMALL, "ticket_id", "event_name", "contact_locality")
    assert rows_of(whole) == rows_of(part)


@pytest.mark.parametrize(
    "name",
    ["show_summary", "unique_buyers", "audience_top_loyal", "compare_loyalty", "sales_cumulative"],
)
def test_order_of_rows_does_not_matter(spark, name, monkeypatch):
    usual = rows_of(contract.queries()[name](spark, SMALL))
    given = tables.tickets

    def shuffled(*args, **kwargs):
        return given(*args, **kwargs).repartition(7).sortWithinPartitions("event_name")

    monkeypatch.setattr(registry.tables, "tickets", shuffled)
    assert rows_of(contract.queries()[name](spark, SMALL)) == usual


def test_one_distinct_column_does_not_multiply_rows(spark):
    assert "Expand" not in _plan(contract.queries()["kpis"](spark, SMALL))


def _scans_that_ran(spark, df, table: str) -> int:
    """Scans of a table in the final plan; copies that were reused do not appear there."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    df.write.format("noop").mode("overwrite").save()
    for _ in range(50):
        runs = store.executionsList()
        last = runs.apply(runs.size() - 1)
        if store.executionsCount() > before and last.completionTime().isDefined():
            break
        time.sleep(0.1)
    nodes = store.planGraph(last.executionId()).allNodes()
    found = [nodes.apply(i) for i in range(nodes.size())]
    return sum(n.name().startswith("Scan parquet") and table in n.desc() for n in found)


@pytest.mark.parametrize(
    "name",
    [
        "channel_by_medium",
        "channel_by_show",
        "category_mix",
        "kpis",
        "compare_leave_one_out",
        "audience_top_loyal",
    ],
)
def test_lines_are_scanned_once(spark, name):
    df = contract.queries()[name](spark, SMALL)
    assert _scans_that_ran(spark, df, "lineitem.parquet") == 1
