"""A bundle reads the tickets once and equals its metrics one by one."""

import pytest
from conftest import SMALL
from frames import rows_of

from turnstile.operators import audience, compare, marketing, onepass, operations, revenue, sales
from turnstile.plans import queries as registry

COLUMNS = (
    "event_name ticket_status ticket_id ordered_at event_start_time deal_price deal_title "
    "payment_method utm_source utm_medium ticket_scanned_at event_id contact_id contact_name "
    "contact_gender contact_locality contact_birthday contact_newsletter_optin"
)
SINGLE = {
    sales: {
        "by_weekday": sales.by_weekday,
        "heatmap": sales.heatmap,
        "heatmap_scale": sales.heatmap_scale,
        "lead_time": sales.lead_time,
        "show_summary": sales.show_summary,
    },
    revenue: {
        "by_show": revenue.by_show,
        "by_category": revenue.by_category,
        "by_payment": revenue.by_payment,
        "free_ticket_types": revenue.free_ticket_types,
        "paid_vs_free": revenue.paid_vs_free,
        "daily": revenue.daily,
    },
    marketing: {
        "by_channel": marketing.by_channel,
        "channel_by_medium": marketing.channel_by_medium,
        "channel_by_show": marketing.channel_by_show,
    },
    operations: {
        "attendance_by_show": operations.attendance_by_show,
        "cancellation_by_show": operations.cancellation_by_show,
        "status_distribution": operations.status_distribution,
        "category_mix": operations.category_mix,
    },
    audience: {
        "gender": audience.gender,
        "age": audience.age,
        "top_cities": audience.top_cities,
        "optin": audience.optin,
        "recurrence": audience.recurrence,
        "top_loyal": audience.top_loyal,
        "age_by_gender": audience.age_by_gender,
    },
    compare: {
        "ref_vs_avg": compare.ref_vs_avg,
        "revenue": compare.revenue,
        "tickets": compare.tickets_sold,
        "loyalty": compare.loyalty,
        "paid_free": compare.paid_free,
        "evolution": compare.evolution,
        "evolution_avg_others": compare.evolution_avg_others,
    },
}


@pytest.fixture(scope="module")
def tickets(spark):
    return registry.load(spark, SMALL, COLUMNS)


def _rounded(rows):
    """Means depend on the order of summing in their last places."""
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("topic", SINGLE, ids=lambda t: t.__name__.rsplit(".", 1)[1])
@pytest.mark.parametrize("name", ["ALL", "ONE", "DATED"])
def test_a_bundle_equals_its_metrics(tickets, topic, name):
    f = getattr(registry, name)
    found, wanted = topic.bundle(tickets, f), dict(SINGLE[topic])
    if topic is sales:
        multi = name != "ONE"
        wanted["cumulative"] = lambda t, f: sales.cumulative(t, f, "until" if multi else None)
        wanted["daily"] = (lambda t, f: sales.daily_by_axis(t, f, "until")) if multi else sales.daily
    for chart, df in found.items():
        single = wanted[chart](tickets, f)
        assert _rounded(rows_of(df, *single.columns)) == _rounded(rows_of(single)), chart
    if topic is compare and name == "ONE":
        assert found == {}
    else:
        assert len(found) >= len(wanted) - (2 if name == "ONE" else 1)


def _scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("lineitem.parquet")


@pytest.mark.parametrize("topic", SINGLE, ids=lambda t: t.__name__.rsplit(".", 1)[1])
def test_the_tickets_are_read_once(tickets, topic, monkeypatch):
    passes, inner = [], onepass.written
    for module in (onepass, audience):
        monkeypatch.setattr(module, "written", lambda rows, name: passes.append(rows) or inner(rows, name))
    out = topic.bundle(tickets, registry.Y98)
    assert len(passes) == 1 and _scans(passes[0]) == 1
    assert all(_scans(df) == 0 for df in out.values())


def test_rows_that_count_nowhere_make_no_cell(spark):
    rows = spark.createDataFrame([("a", 1), ("b", None), (None, 3)], "k string, v int")
    from pyspark.sql import functions as F

    groupings = {
        "x": onepass.Grouping(F.col("v") > 1, {"k": F.col("k")}),
        "y": onepass.Grouping(F.lit(True), {"v": F.col("v"), "k": F.col("k")}),
    }
    measures = {"n": F.count(F.lit(1)), "s": F.sum("v")}
    out = onepass.together(rows, groupings, measures)
    for name, g in groupings.items():
        single = onepass.alone(rows, g, measures)
        assert sorted(rows_of(out[name]), key=str) == sorted(rows_of(single), key=str)
        assert out[name].columns == single.columns
    empty = onepass.together(rows.limit(0), groupings, measures)
    assert all(df.isEmpty() for df in empty.values())
