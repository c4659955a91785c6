"""Identities between metrics on the driver tables."""

from conftest import SMALL
from pyspark.sql import functions as F

from turnstile.operators import audience, compare, operations, sales
from turnstile.plans import queries as registry


def _load(spark, columns):
    return registry.load(spark, SMALL, f"event_name ticket_status {columns}")


def test_first_time_and_returning_make_all_buyers(spark):
    t = _load(spark, "contact_id")
    both = compare.loyalty(t, registry.Y98).select(
        "event_name", (F.col("first_time") + F.col("returning")).alias("n")
    )
    kept = t.rows.filter("event_name like '% 1998Q_' and not (ticket_status <=> 'canceled')")
    direct = kept.groupBy("event_name").agg(F.count_distinct("contact_id").alias("n"))
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, direct.collect()))


def test_last_running_total_is_the_total(spark):
    t = _load(spark, "ordered_at event_start_time deal_price")
    last = sales.cumulative(t, registry.Y98).groupBy("event_name").agg(F.max("cum_tickets"))
    total = (
        sales.daily_by_axis(t, registry.Y98).groupBy("event_name").agg(F.sum("tickets"))
    )
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, total.collect()))


def test_present_and_absent_make_the_total(spark):
    t = _load(spark, "ticket_id deal_price ticket_scanned_at")
    out = operations.attendance_by_show(t, registry.ALL)
    assert out.filter("present + absent <> total").count() == 0
    uneven = out.groupBy("event_name").agg(F.sum("total").alias("s"), F.max("show_total").alias("t"))
    assert uneven.filter("s <> t").count() == 0


def test_heatmap_covers_dated_sales(spark):
    t = _load(spark, "ordered_at")
    cells = sales.heatmap(t, registry.ALL).agg(F.sum("tickets")).first()[0]
    week = sales.by_weekday(t, registry.ALL).agg(F.sum("tickets")).first()[0]
    dated = t.rows.filter("order_date is not null and not (ticket_status <=> 'canceled')").count()
    assert cells == week == dated


def test_unknown_buyers_count_once(spark):
    t = _load(spark, "ticket_id contact_id ordered_at")
    buyers = audience.unique_buyers(t, registry.ALL, "ticket_id")
    assert buyers.filter("contact_id is null").count() == 1
    assert buyers.count() == buyers.select("contact_id").distinct().count()
