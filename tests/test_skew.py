"""A buyer, a show and a channel with a third of all rows each, against brute force."""

from collections import defaultdict

import pytest
from conftest import SMALL
from frames import rows_of
from pyspark.sql import functions as F

from turnstile import Filters, Tickets
from turnstile.filters import kept_online
from turnstile.operators import audience, compare, marketing, sales
from turnstile.plans import queries
from turnstile.sources import ingest, tables

ANY = Filters.of()
_COLUMNS = (
    "ticket_id event_id event_name ticket_status ordered_at event_start_time contact_id deal_price "
    "utm_source"
).split()


@pytest.fixture(scope="module")
def skewed(spark):
    raw = tables.tickets(spark, SMALL, *_COLUMNS)

    def hot(column: str, value, seed: int):
        third = F.pmod(F.xxhash64("ticket_id", F.lit(seed)), F.lit(3)) == 0
        return F.when(third, value).otherwise(F.col(column)).alias(column)

    plain = [c for c in _COLUMNS if c not in ("contact_id", "event_name", "utm_source")]
    heavy = raw.select(
        *plain,
        hot("contact_id", 1, 1),
        hot("event_name", "ASIA 1998Q1", 2),
        hot("utm_source", "hot", 3),
    )
    return Tickets.from_raw(heavy.repartition(6), queries.AS_OF)


@pytest.fixture(scope="module")
def live(skewed):
    return kept_online(skewed, ANY).collect()


def test_some_group_is_hot(live):
    assert sum(r["contact_id"] == 1 for r in live) > len(live) / 4


def test_first_rows(skewed, live):
    first = {}
    for r in live:
        key = (r["ordered_at"] is None, str(r["ordered_at"]), r["ticket_id"])
        if r["contact_id"] not in first or key < first[r["contact_id"]]:
            first[r["contact_id"]] = key
    out = dict(rows_of(audience.unique_buyers(skewed, ANY, "ticket_id")))
    assert out == {buyer: key[2] for buyer, key in first.items()}


def test_loyalty(skewed, live):
    shows = defaultdict(set)
    for r in live:
        if r["contact_id"] is not None:
            shows[r["contact_id"]].add(r["event_name"])
    wanted = defaultdict(lambda: [0, 0])
    for names in shows.values():
        for name in names:
            wanted[name][len(names) > 1] += 1
    out = {r[0]: [r[1], r[2]] for r in rows_of(compare.loyalty(skewed, ANY))}
    assert {k: v for k, v in out.items() if v != [0, 0]} == dict(wanted)


def test_running_totals(skewed, live):
    per_day = defaultdict(int)
    for r in live:
        if r["order_date"] is not None:
            per_day[r["event_name"], r["order_date"]] += 1
    wanted, total = [], defaultdict(int)
    for (show, day), n in sorted(per_day.items()):
        total[show] += n
        wanted.append((show, day, total[show]))
    out = sorted(rows_of(sales.cumulative(skewed, ANY)))
    assert out == sorted(wanted)


def test_grid(skewed, live):
    counts = defaultdict(int)
    for r in live:
        counts[r["event_name"], r["utm_source"]] += 1
    shows = {s for s, _ in counts}
    channels = {c for _, c in counts}
    wanted = sorted((s, c, counts.get((s, c), 0)) for s in shows for c in channels)
    columns = ("event_name", "utm_source", "tickets")
    out = marketing.channel_by_show(skewed, ANY, sorted(channels)).select(*columns)
    assert sorted(rows_of(out)) == wanted
    sparse = marketing.channel_by_show(skewed, ANY).select(*columns)
    assert sorted(rows_of(sparse)) == [cell for cell in wanted if cell[2]]


def test_batch_of_mostly_one_id(spark):
    batch = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("ticket_id"),
        F.concat(F.lit("r"), F.col("id")).alias("raw"),
        F.col("id").alias("position"),
    )
    stored = spark.range(100).select(F.col("id").cast("string").alias("ticket_id"))
    new = ingest.new_tickets(batch, stored, F.col("position"))
    known = sum(1 for i in range(100) if i % 3)
    assert new.count() == 6000 + 1 - known
    assert new.filter("ticket_id = 'hot'").first()["raw"] == "r0"
