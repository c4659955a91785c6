"""The rollup against the tickets themselves."""

from datetime import date

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from turnstile.filters import Filters
from turnstile.operators import rollup
from turnstile.plans import queries as registry


@pytest.fixture(scope="module")
def tickets(spark):
    return registry.load(spark, SMALL, "event_name ticket_status ticket_id ordered_at deal_price contact_id")


@pytest.fixture(scope="module")
def cells(spark, tickets, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rollup"))
    rollup.write(rollup.build(tickets), path)
    return rollup.read(spark, path)


def _kept(tickets, f):
    rows = tickets.rows.filter(F.col("event_name").isin(list(f.events)) if f.events else F.lit(True))
    if f.date_range:
        rows = rows.filter(F.col("order_date").between(*(F.lit(d) for d in f.date_range)))
    return rows.withColumn("kept", ~F.col("ticket_status").eqNullSafe("canceled"))


@pytest.mark.parametrize("name", ["ALL", "Y98", "ONE", "DATED"])
def test_any_selection_merges_to_its_own_figures(tickets, cells, name):
    f = getattr(registry, name)
    rows = _kept(tickets, f)
    wanted = rows.agg(
        F.count_if("kept"),
        F.sum(F.when(F.col("kept"), F.col("deal_price_cents"))),
        F.count("ticket_id"),
        F.count_if(F.col("ticket_status") == "canceled"),
    ).first()
    found = rollup.headline(cells, f).first()
    assert tuple(found)[:4] == tuple(wanted)
    # So few buyers fit into a sketch whole.
    assert found.buyers == rows.filter("kept").agg(F.count_distinct("contact_id")).first()[0] < rollup.NOMINAL


def test_returning_buyers_bought_before(tickets, cells):
    since = date(1998, 7, 1)
    rows = _kept(tickets, registry.Y98).filter("kept AND contact_id IS NOT NULL AND order_date IS NOT NULL")
    early = rows.filter(F.col("order_date") < F.lit(since)).select("contact_id").distinct()
    late = rows.filter(F.col("order_date") >= F.lit(since)).select("event_name", "contact_id").distinct()
    known = late.join(early.withColumn("known", F.lit(1)), "contact_id", "left").groupBy("event_name")
    wanted = {r.event_name: (r.b, r.k) for r in known.agg(F.count("*").alias("b"), F.count("known").alias("k")).collect()}
    found = {r.event_name: (r.buyers, r.returning) for r in rollup.returning(cells, registry.Y98, since).collect()}
    assert found == wanted
    none = rollup.returning(cells, registry.Y98, date(1900, 1, 1)).collect()
    assert all(r.returning == 0 for r in none)


def test_many_buyers_are_estimated_within_the_error(spark):
    buyers = 60_000
    rows = spark.range(3 * buyers).select(
        F.concat(F.lit("s"), F.col("id") % 3).alias("event_name"),
        F.date_add(F.lit(date(2024, 1, 1)), (F.col("id") % 50).cast("int")).alias("order_date"),
        F.lit(1).cast("long").alias("tickets"),
        *[F.lit(0).cast("long").alias(c) for c in ("revenue_cents", "total", "canceled")],
        (F.col("id") % buyers).cast("string").alias("buyer"),
    )
    cells = rows.groupBy("event_name", "order_date").agg(
        F.sum("tickets").alias("tickets"),
        *[F.sum(c).alias(c) for c in ("revenue_cents", "total", "canceled")],
        F.theta_sketch_agg("buyer", rollup.LG_NOMINAL).alias("buyers"),
    )
    found = rollup.headline(cells, Filters.of()).first()
    assert found.tickets == 3 * buyers
    assert abs(found.buyers - buyers) < 4 * buyers / rollup.NOMINAL**0.5


def test_a_month_can_be_rolled_up_again(spark, tickets, folder):
    whole = rollup.build(tickets)
    rollup.write(whole, folder)
    in_march = F.date_format("order_date", "yyyy-MM") == "1998-03"
    again = whole.filter(in_march).withColumn("tickets", F.lit(1000).cast("long"))
    rollup.write(again, folder)
    found = rollup.read(spark, folder)
    assert found.count() == whole.count()
    assert found.filter(in_march).agg(F.min("tickets")).first()[0] == 1000
    assert found.filter(~in_march).agg(F.max("tickets")).first()[0] < 1000
    assert found.filter("order_date IS NULL").count() == whole.filter("order_date IS NULL").count()
