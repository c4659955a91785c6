"""Pages, store, ledger, statements, CSV files and the page stream on temporary folders."""

import json
import os
import re
from datetime import date, datetime, timezone
from decimal import Decimal

import pytest
from conftest import SMALL
from frames import AS_OF, at, raw, rows_of, tickets
from pyspark.sql import functions as F

from turnstile import Filters
from turnstile.operators import door, revenue
from turnstile.sources import csv, ingest, pages, statement, tables
from turnstile.sources.ledger import LedgerStore
from turnstile.sources.store import TicketStore
from turnstile.streaming import page_stream

NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)


def _page(folder, name, cursor, data, following):
    url = None if following is None else f"https://example.org/tickets?x=1&after={following}"
    path = os.path.join(folder, name)
    with open(path, "w") as out:
        json.dump({"cursor": cursor, "data": data, "pagination": {"next": url}}, out)


def _ticket(ticket_id, **more):
    return {"ticket_id": ticket_id, "event_name": "a", "ticket_status": "valid", **more}


# Pages --------------------------------------------------------------------------


def test_pages_to_records(spark, folder):
    _page(folder, "p1.json", None, [_ticket("1", deal_price=100), _ticket(2)], "c1")
    _page(folder, "p2.json", "c1", [_ticket("3", extra={"deep": [1]})], None)
    rows = pages.records(pages.read_pages(spark, folder))
    assert rows_of(rows, "ticket_id", "position") == [("1", 0), ("2", 1), ("3", 0)]
    kept = rows.filter("ticket_id = '3'").first()["raw"]
    assert json.loads(kept)["extra"] == {"deep": [1]}


def test_page_chain(spark, folder):
    _page(folder, "p1.json", None, [_ticket("1")], "c1")
    _page(folder, "p2.json", "c1", [_ticket("2")], "c2")
    _page(folder, "p3.json", "c1", [_ticket("2")], "c3")
    _page(folder, "p4.json", "c3", [], "c4")
    out = rows_of(pages.chain_gaps(pages.read_pages(spark, folder)))
    assert out == [("c1", "repeated"), ("c2", "missing")]


def test_bad_next_url_is_no_cursor(spark, folder):
    with open(os.path.join(folder, "p.json"), "w") as out:
        json.dump({"cursor": None, "data": [_ticket("1")], "pagination": {"next": "http://a b/%"}}, out)
    assert pages.read_pages(spark, folder).first()["next_cursor"] is None


def test_broken_json_is_a_record_without_fields(spark):
    rows = spark.createDataFrame([("1", "{broken"), ("2", '{"ticket_id": 2}')], "id string, raw string")
    out = rows_of(pages.parsed(rows), "id", "ticket_id", "raw")
    assert out == [("1", None, "{broken"), ("2", "2", '{"ticket_id": 2}')]


def test_raw_json_has_no_nan_and_iso_times(spark):
    df = spark.createDataFrame(
        [("1", float("nan"), float("inf"), 1.5, at("2024-01-02T03:04:05"), None)],
        "ticket_id string, a double, b double, c double, t timestamp, n string",
    )
    out = json.loads(pages.to_raw_json(df).first()["raw"])
    assert out == {
        "ticket_id": "1",
        "a": None,
        "b": None,
        "c": 1.5,
        "t": "2024-01-02T03:04:05+00:00",
        "n": None,
    }
    fine = df.withColumn("t", F.col("t") + F.expr("interval 250 milliseconds"))
    assert json.loads(pages.to_raw_json(fine).first()["raw"])["t"] == (
        "2024-01-02T03:04:05.250000+00:00"
    )


# Store --------------------------------------------------------------------------


def _records(spark, *tickets_given):
    rows = [(t.get("ticket_id"), json.dumps(t)) for t in tickets_given]
    return spark.createDataFrame(rows, "ticket_id string, raw string")


def test_incremental_ingest(spark, folder):
    store = TicketStore(spark, f"{folder}/store").create()
    first = _records(spark, _ticket("1", deal_price="100"), _ticket("2"), _ticket("2"))
    assert store.ingest("t1", first, NOW) == {"n_new": 2, "n_existing": 0}
    assert store.ingest("t1", first, NOW) == {"n_new": 0, "n_existing": 2}
    more = _records(
        spark,
        _ticket("2", ticket_status="canceled"),
        _ticket("3", deal_price=7.5),
        {"event_name": "no id"},
        _ticket("4"),
    )
    out = store.ingest("t1", more, NOW, quarantine=f"{folder}/rejected")
    assert out == {"n_new": 1, "n_existing": 2}
    rejected = spark.read.parquet(f"{folder}/rejected")
    assert rows_of(rejected, "reject_reason") == [("fractional cents",), ("no ticket_id",)]
    status = {r["ticket_id"]: r["ticket_status"] for r in store.rows("t1").collect()}
    assert status == {"1": "valid", "2": "valid", "4": "valid"}

    assert store.ingest("t2", first, NOW) == {"n_new": 2, "n_existing": 0}
    assert store.rows("t1").count() == 3

    refreshed = _records(spark, _ticket("2", ticket_status="canceled"), _ticket("5"))
    out = store.ingest("t1", refreshed, NOW, refresh=True)
    assert out == {"n_new": 1, "n_existing": 3}
    status = {r["ticket_id"]: r["ticket_status"] for r in store.rows("t1").collect()}
    assert status == {"1": "valid", "2": "canceled", "4": "valid", "5": "valid"}
    assert store.rows("t2").count() == 2

    store.clear("t1")
    assert store.rows("t1").count() == 0
    assert store.rows("t2").count() == 2
    assert store.ingest("t1", first, NOW) == {"n_new": 2, "n_existing": 0}


def test_store_types_and_metrics(spark, folder):
    store = TicketStore(spark, f"{folder}/store").create()
    batch = _records(
        spark,
        _ticket("1", deal_price="1500", contact_newsletter_optin=True, utm_source=" Direct "),
        _ticket("2", deal_price=250.0, ordered_at="2024-01-02T00:30:00+02:00"),
    )
    store.ingest("t1", batch, NOW)
    t = store.tickets("t1", AS_OF)
    assert rows_of(revenue.by_show(t, Filters.of())) == [("a", 1750)]
    one, two = t.rows.orderBy("ticket_id").collect()
    assert one["contact_newsletter_optin"] is True and one["utm_source"] == "direto"
    assert two["order_date"] == date(2024, 1, 1)


def test_tenant_names_are_checked(spark, folder):
    with pytest.raises(ValueError):
        TicketStore(spark, folder).rows("../other")


def test_only_the_tenant_s_folder_is_listed(spark, folder):
    store = TicketStore(spark, f"{folder}/store").create()
    store.ingest("t1", _records(spark, _ticket("1")), NOW)
    plan = store.rows("t1").select("event_name")._jdf.queryExecution().toString()
    assert re.search(r"InMemoryFileIndex\(1 paths\)\[[^\]]*tenant_id=t1", plan)
    assert "ReadSchema: struct<event_name:string>" in plan


def test_driver_tables_through_raw_json(spark, folder):
    """Tickets written as JSON pages and ingested give the same revenue per show."""
    given = tables.tickets(spark, SMALL)
    store = TicketStore(spark, f"{folder}/store").create()
    out = store.ingest("t1", pages.to_raw_json(given), NOW)
    assert out == {"n_new": given.count(), "n_existing": 0}
    from turnstile.plans import queries

    direct = revenue.by_show(queries.load(
        spark, SMALL, "event_name ticket_status deal_price"), Filters.of())
    assert rows_of(revenue.by_show(store.tickets("t1", AS_OF), Filters.of())) == rows_of(direct)


def test_fractional_and_missing_ids_are_split(spark):
    batch = spark.createDataFrame(
        [("1", "10"), ("2", "10.5"), (None, "10"), ("4", "x"), ("5", None)],
        "ticket_id string, deal_price string",
    )
    accepted, rejected = ingest.split_rejected(batch)
    assert [r[0] for r in rows_of(accepted)] == ["1", "4", "5"]
    assert rows_of(rejected, "reject_reason") == [("fractional cents",), ("no ticket_id",)]


# Ledger -------------------------------------------------------------------------


def test_ledger(spark, folder):
    store = LedgerStore(spark, f"{folder}/ledger").create()
    schema = (
        "event_name string, tickets int, revenue_brl decimal(18,6), prices array<decimal(18,6)>, "
        "source string, added_at timestamp"
    )
    entries = spark.createDataFrame(
        [
            ("b", 2, Decimal(30), [Decimal(10), Decimal(20)], "manual", at("2024-02-01T00:00:00")),
            ("a", 1, Decimal(5), [], "pagbank_csv", at("2024-01-01T00:00:00")),
            ("a", 1, Decimal(5), None, "gift", at("2024-01-01T00:00:00")),
            (None, 1, Decimal(5), None, "manual", at("2024-01-01T00:00:00")),
        ],
        schema,
    )
    store.append("t1", entries, quarantine=f"{folder}/rejected")
    store.append("t2", entries)
    loaded = store.load("t1").collect()
    assert [r["event_name"] for r in loaded] == ["a", "b"]
    assert loaded[0]["prices"] is None and loaded[0]["entry_date"] is None
    assert spark.read.parquet(f"{folder}/rejected").count() == 2
    assert rows_of(door.door_totals(store.load("t1"))) == [("a", 1, 500), ("b", 2, 3000)]
    store.clear("t1")
    assert store.load("t1").count() == 0
    assert store.load("t2").count() == 2


# Statements ---------------------------------------------------------------------

_PREAMBLE = "".join(f"line {i}\n" for i in range(8))
_BODY = """
 Data , Tipo , Entradas ,Saidas
1/2/2024,Vendas,10.50,
01/02/2024, Vendas ,20,
3/2/2024,Saque,99,
3/2/2024,Vendas,-5,
3/2/2024,Vendas,"1.234,56",
31/02/2024,Vendas,7,
2024-02-03,Vendas,7,

3/2/2024,Vendas,40.25,x
"""


def _statement(folder, name="s.csv"):
    with open(os.path.join(folder, name), "w", newline="") as out:
        out.write(_PREAMBLE + _BODY)


def test_statement_sales(spark, folder):
    _statement(folder)
    out = rows_of(statement.sales(spark, folder), "line_no", "sale_date", F.col("amount").cast("string"))
    assert out == [
        (11, date(2024, 2, 1), "10.500000"),
        (12, date(2024, 2, 1), "20.000000"),
        (19, date(2024, 2, 3), "40.250000"),
    ]
    comma = statement.sales(spark, folder, decimal_comma=True)
    assert Decimal("1234.56") in [r["amount"] for r in comma.collect()]


def test_statement_figures_and_assignment(spark, folder):
    _statement(folder, "one.csv")
    _statement(folder, "two.csv")
    sold = statement.sales(spark, folder)
    totals = statement.totals(sold).collect()
    assert [(r["tickets"], r["revenue_brl"], len(r["prices"])) for r in totals] == [
        (3, Decimal("70.75"), 3)
    ] * 2
    dated = statement.by_date(sold)
    assert dated.count() == 4
    assignments = spark.createDataFrame(
        [(date(2024, 2, 1), "show"), (date(2024, 2, 3), "(ignorar)")],
        "sale_date date, event_name string",
    )
    entries = statement.assigned_entries(dated, assignments, "t1", NOW)
    out = rows_of(entries, "event_name", "tickets", "entry_date", "source")
    assert out == [("show", 2, date(2024, 2, 1), "pagbank_csv")] * 2
    assert entries.first()["prices"] == [Decimal("10.50"), Decimal("20.00")]
    store = LedgerStore(spark, f"{folder}-ledger").create()
    store.append("t1", entries)
    assert rows_of(door.door_totals(store.load("t1"))) == [("show", 4, 6100)]


# CSV ----------------------------------------------------------------------------


def test_load_csv(spark, folder):
    path = os.path.join(folder, "t.csv")
    with open(path, "w") as out:
        out.write("ticket_id,event_name,deal_price,contact_newsletter_optin,ordered_at\n")
        out.write('1,"a, ""b""",1500.0,True,2024-01-02T10:00:00Z\n')
        out.write("2,c,,False,bad\n")
    t = csv.load_csv(spark, path, AS_OF)
    out = rows_of(
        t.rows, "event_name", "deal_price_cents", "contact_newsletter_optin", "order_date"
    )
    assert out == [('a, "b"', 1500, True, date(2024, 1, 2)), ("c", None, False, None)]
    assert not t.has("utm_source")


def test_consolidated_round_trip(spark, folder):
    online = tickets(
        spark,
        "ticket_id event_name ticket_status deal_price ordered_at contact_name "
        "contact_newsletter_optin",
        [
            ("1", "a", "valid", 100, at("2024-01-01T10:00:00"), 'x "y"\nz', True),
            ("2", "a", "canceled", 100, at("2024-01-01T10:00:00"), None, None),
            ("3", "b", None, 250, None, "", False),
        ],
    )
    ledger = spark.createDataFrame(
        [("a", 3, Decimal(10), None, None), ("b", 2, Decimal(3), [Decimal(1), Decimal(2)], None)],
        "event_name string, tickets int, revenue_brl decimal(18,6), "
        "prices array<decimal(18,6)>, entry_date date",
    )
    both = door.all_channels(online, door.door_rows(ledger, online, AS_OF))
    f = Filters.of(channels=["Shotgun", "Porta"])
    csv.export_consolidated(both, f, f"{folder}/out")
    back, entries, prices = csv.import_consolidated(spark, f"{folder}/out", AS_OF, "t1", NOW)
    columns = ("ticket_id", "deal_price_cents", "contact_name", "order_date")
    assert rows_of(back.rows, *columns, "contact_newsletter_optin") == [
        ("1", 100, 'x "y"\nz', date(2024, 1, 1), True),
        ("3", 250, None, None, False),  # CSV does not tell an empty text from none
    ]
    assert rows_of(door.door_totals(entries)) == [("a", 3, 1000), ("b", 2, 300)]
    assert {r["source"] for r in entries.collect()} == {"consolidated_upload"}
    again = door.door_rows(entries, back, AS_OF, prices)
    given = door.door_rows(ledger, online, AS_OF)
    assert rows_of(again, "event_name", "door_price") == rows_of(given, "event_name", "door_price")
    csv.export_consolidated(both, f, f"{folder}/full", full=True)
    assert csv.import_consolidated(spark, f"{folder}/full", AS_OF, "t1", NOW)[0].rows.count() == 3


def test_import_needs_the_source_column(spark, folder):
    path = os.path.join(folder, "t.csv")
    with open(path, "w") as out:
        out.write("ticket_id\n1\n")
    with pytest.raises(ValueError):
        csv.import_consolidated(spark, path, AS_OF, "t1", NOW)


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_an_import_does_not_depend_on_the_layout(spark, partitions):
    rows = [("Porta", "ab"[i % 2], f"{i}.5") for i in range(100)]
    frame = spark.createDataFrame(rows, "source string, event_name string, deal_price_brl string")
    frame = frame.repartition(partitions)
    _, entries, prices = csv.split_consolidated(frame, AS_OF, "t1", NOW)
    assert rows_of(entries, "event_name", "tickets", "prices") == [("a", 50, None), ("b", 50, None)]
    assert rows_of(door.door_totals(entries)) == [("a", 50, 247500), ("b", 50, 252500)]
    back = door.door_rows(entries, None, AS_OF, prices)
    assert rows_of(back.select("event_name", F.col("door_price").cast("double"))) == sorted(
        ((n, float(p)) for _, n, p in rows), key=lambda r: (r[0], str(r[1]))
    )


def test_a_truncated_page_fails(spark, folder):
    for name, end in (("a", "]}"), ("b", "")):
        with open(os.path.join(folder, f"{name}.json"), "w") as out:
            out.write('{"cursor": "%s", "data": [{"ticket_id": "1"}, {"ticket_id": "2"}%s' % (name, end))
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        pages.read_pages(spark, folder).collect()


def test_a_replay_does_not_fill_the_quarantine(spark, folder):
    store = TicketStore(spark, f"{folder}/store").create()
    batch = _records(spark, _ticket("1"), _ticket("2", deal_price="1.5"), {"event_name": "a"})
    for _ in range(3):
        store.ingest("t1", batch, NOW, quarantine=f"{folder}/rejected")
    assert spark.read.parquet(f"{folder}/rejected").count() == 2
    assert store.rows("t1").count() == 1
    assert store.rows("nobody").count() == 0


def test_a_date_mapped_to_two_shows_is_refused(spark):
    dated = spark.createDataFrame(
        [("f", date(2024, 1, 1), 2, Decimal(3), [Decimal(1), Decimal(2)])],
        "file string, sale_date date, tickets long, revenue_brl decimal(18,6), "
        "prices array<decimal(18,6)>",
    )

    def mapped(*shows):
        rows = [(date(2024, 1, 1), s) for s in shows]
        return spark.createDataFrame(rows, "sale_date date, event_name string")

    once = statement.assigned_entries(dated, mapped("a", "a"), "t1", NOW)
    assert rows_of(once, "event_name", "tickets") == [("a", 2)]
    with pytest.raises(Exception, match="two shows"):
        statement.assigned_entries(dated, mapped("a", "b"), "t1", NOW).collect()
    whole = statement.one_show_entries(dated, "z", "t1", NOW)
    assert rows_of(whole, "event_name", "tickets", "entry_date", "source") == [
        ("z", 2, None, "pagbank_csv")
    ]


# Stream -------------------------------------------------------------------------


def test_page_stream_resumes_and_replays(spark, folder):
    landing = os.path.join(folder, "landing")
    os.mkdir(landing)
    store = TicketStore(spark, f"{folder}/store").create()
    counts = []

    def run(checkpoint):
        query = page_stream.start(
            spark, landing, store, "t1", checkpoint, now=lambda: NOW, on_counts=counts.append
        )
        query.awaitTermination()

    _page(landing, "p1.json", None, [_ticket("1"), _ticket("2")], "c1")
    run(f"{folder}/checkpoint")
    _page(landing, "p2.json", "c1", [_ticket("2"), _ticket("3")], None)
    run(f"{folder}/checkpoint")
    assert counts == [{"n_new": 2, "n_existing": 0}, {"n_new": 1, "n_existing": 2}]
    run(f"{folder}/other-checkpoint")  # everything again
    assert counts[-1]["n_new"] == 0
    assert [r[0] for r in rows_of(store.rows("t1"), "ticket_id")] == ["1", "2", "3"]


def test_stream_needs_a_shared_folder(spark, folder):
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError):
            page_stream.start(spark, folder, TicketStore(spark, folder), "t1")


# Published tickets --------------------------------------------------------------


def test_published_tickets_answer_alike_and_push_filters_down(spark, folder):
    from test_plans import _plan

    from turnstile.operators import kpi
    from turnstile.plans import queries
    from turnstile.sources import published

    columns = (
        "ticket_id event_name ticket_status ordered_at contact_id deal_price ticket_scanned_at "
        "contact_newsletter_optin"
    )
    given = queries.load(spark, SMALL, columns)
    published.publish(given, f"{folder}/tickets", files=4)
    back = published.open_published(spark, f"{folder}/tickets")
    assert back.present == given.present - {"deal_price"}
    assert not back.has("utm_source") and back.rows.columns
    for f in (queries.ALL, queries.DATED):
        assert rows_of(kpi.headline(back, f)) == rows_of(kpi.headline(given, f))
    plan = _plan(kpi.headline(back, queries.DATED), "formatted")
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "event_name" in pushed
    plan = _plan(revenue.by_show(back, queries.DATED), "formatted")
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "In(event_name" in pushed and "GreaterThanOrEqual(ordered_at" in pushed
