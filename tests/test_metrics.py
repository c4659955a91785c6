"""Filter rules and metrics on hand-made tickets; expected values are typed by hand."""

from datetime import date

import pytest
from frames import AS_OF, at, rows_of, tickets
from pyspark.sql import functions as F

from turnstile import Filters, MetricUnavailable
from turnstile.filters import kept, kept_online, selected
from turnstile.operators import (
    audience,
    compare,
    curves,
    door,
    kpi,
    marketing,
    operations,
    revenue,
    sales,
    universe,
)

ANY = Filters.of()


# Filters ------------------------------------------------------------------------


def test_unknown_status_is_kept_and_canceled_is_not(spark):
    t = tickets(
        spark,
        "ticket_id event_name ticket_status",
        [("1", "a", "valid"), ("2", "a", None), ("3", "a", "canceled"), ("4", None, "valid")],
    )
    assert rows_of(kept(t, ANY), "ticket_id") == [("1",), ("2",)]
    assert rows_of(selected(t, ANY), "ticket_id") == [("1",), ("2",), ("3",)]


@pytest.mark.parametrize(
    "low, high, wanted",
    [
        ("2024-01-01", "2024-01-02", ["1", "2"]),
        ("2024-01-02", "2024-01-01", []),
        ("2024-01-02", None, ["1", "2", "3", "4"]),
        (None, "2024-01-02", ["1", "2", "3", "4"]),
        ("soon", "2024-01-02", ["1", "2", "3", "4"]),
    ],
)
def test_dates_count_only_as_a_pair(spark, low, high, wanted):
    t = tickets(
        spark,
        "ticket_id event_name ordered_at",
        [
            ("1", "a", at("2024-01-01T00:00:00")),
            ("2", "a", at("2024-01-02T23:59:59")),
            ("3", "a", at("2024-01-03T00:00:00")),
            ("4", "a", None),
        ],
    )
    f = Filters.of(date_from=low, date_to=high)
    assert [r[0] for r in rows_of(kept(t, f), "ticket_id")] == wanted


def test_channel_limits_kept_rows_only(spark):
    t = tickets(spark, "ticket_id event_name", [("1", "a")])
    f = Filters.of(channels=["Porta"])
    assert kept(t, f).count() == 0
    assert kept_online(t, f).count() == 0
    assert selected(t, f).count() == 1


def test_no_channel_means_online():
    assert Filters.of().channels == ("Shotgun",)


# Headline -----------------------------------------------------------------------


def test_headline_is_zero_without_sales(spark):
    t = tickets(
        spark,
        "event_name ticket_status deal_price contact_id",
        [("a", "canceled", 100, "x"), ("a", "canceled", 100, "y")],
    )
    out = kpi.headline(t, ANY).first()
    assert [out[c] for c in ("tickets", "buyers", "revenue_cents")] == [0, 0, 0]
    assert [out[c] for c in ("attendance_pct", "cancel_pct", "optin_pct")] == [0.0, 0.0, 0.0]


def test_headline_cancellation_ignores_dates(spark):
    day = at("2024-01-01T10:00:00")
    late = at("2024-02-01T10:00:00")
    t = tickets(
        spark,
        "event_name ticket_status deal_price contact_id ordered_at ticket_scanned_at "
        "contact_newsletter_optin",
        [
            ("a", "valid", 1000, "x", day, day, True),
            ("a", "valid", None, "x", day, None, False),
            ("a", None, 500, None, day, None, None),
            ("a", "canceled", 700, "y", late, None, True),
        ],
    )
    out = kpi.headline(t, Filters.of(date_from="2024-01-01", date_to="2024-01-02")).first()
    assert (out["tickets"], out["buyers"], out["revenue_cents"]) == (3, 1, 1500)
    assert out["attendance_pct"] == pytest.approx(100 / 3)
    assert out["cancel_pct"] == 25.0
    assert out["optin_pct"] == 50.0


def test_headline_can_estimate_buyers(spark):
    t = tickets(spark, "event_name contact_id", [("a", f"b{i}") for i in range(200)])
    exact = kpi.headline(t, ANY).first()["buyers"]
    assert exact == 200
    assert kpi.headline(t, ANY, approximate=True).first()["buyers"] == pytest.approx(200, rel=0.15)


# Sales --------------------------------------------------------------------------


def test_lead_time_buckets(spark):
    start = at("2024-03-31T00:00:00")
    orders = [
        at("2024-03-31T12:00:00"),  # half a day after the start
        at("2024-03-31T00:00:00"),  # 0
        at("2024-03-01T00:14:24"),  # 29.99
        at("2024-03-01T00:00:00"),  # 30
        at("2023-02-25T00:00:00"),  # 400
    ]
    t = tickets(spark, "event_name ordered_at event_start_time", [("a", o, start) for o in orders])
    assert rows_of(sales.lead_time(t, ANY)) == [(0, 1), (29, 1), (30, 2)]


def test_weekdays_are_dense(spark):
    t = tickets(spark, "event_name ordered_at", [("a", at("2024-03-04T10:00:00"))])
    out = rows_of(sales.by_weekday(t, ANY))
    assert out[0] == (0, "Seg", 1)
    assert [r[1] for r in out] == ["Seg", "Ter", "Qua", "Qui", "Sex", "Sáb", "Dom"]
    assert [r[2] for r in out[1:]] == [0] * 6


def test_curve_axes_and_running_total(spark):
    start = at("2024-01-10T22:00:00")
    t = tickets(
        spark,
        "event_name ordered_at event_start_time deal_price",
        [
            ("a", at("2024-01-01T23:00:00"), start, 100),
            ("a", at("2024-01-03T01:00:00"), start, 200),
            ("a", at("2024-01-03T02:00:00"), start, None),
            ("a", None, at("2024-01-09T00:00:00"), 900),
            ("b", at("2024-01-03T02:00:00"), None, 5),
        ],
    )
    out = rows_of(sales.daily_by_axis(t, ANY), "event_name", "order_date", "x", "tickets")
    # The undated order of show a moves its start to the 9th; show b has no start.
    assert out == [("a", date(2024, 1, 1), 8, 1), ("a", date(2024, 1, 3), 6, 2)]
    since = rows_of(sales.daily_by_axis(t, ANY, curves.SINCE_FIRST), "event_name", "x", "tickets")
    assert since == [("a", 0, 1), ("a", 2, 2), ("b", 0, 1)]
    assert rows_of(sales.cumulative(t, ANY), "event_name", "cum_tickets") == [
        ("a", 1),
        ("a", 3),
        ("b", 1),
    ]


def test_axis_falls_back_without_any_start(spark):
    rows = [("a", at("2024-01-01T00:00:00"), None), ("b", at("2024-01-02T00:00:00"), None)]
    t = tickets(spark, "event_name ordered_at event_start_time", rows)
    assert curves.choose_axis(kept(t, ANY), t) == curves.SINCE_FIRST
    bundle = sales.bundle(t, ANY)
    assert rows_of(bundle["daily"], "event_name", "x") == [("a", 0), ("b", 0)]


def test_show_summary_counts_canceled_revenue(spark):
    start = at("2024-01-10T22:00:00")
    t = tickets(
        spark,
        "ticket_id event_name ticket_status ordered_at event_start_time ticket_scanned_at deal_price",
        [
            ("1", "a", "canceled", at("2024-01-01T00:00:00"), start, None, 100),
            ("2", "a", "pending", at("2024-01-05T00:00:00"), start, start, 50),
            (None, "a", None, None, None, None, None),
        ],
    )
    out = sales.show_summary(t, ANY).first().asDict()
    assert out["total"] == 2 and out["valid"] == 0 and out["canceled"] == 1
    assert out["scanned"] == 1 and out["revenue_cents"] == 150 and out["days_on_sale"] == 9
    assert out["attendance_pct"] == 100.0 and out["cancel_pct"] == 50.0


def test_heatmap_scale_is_at_least_one(spark):
    t = tickets(spark, "event_name ordered_at", [("a", None)])
    assert sales.heatmap_scale(t, ANY).first()[0] == 1


# Shows side by side -------------------------------------------------------------


def _two_shows(spark):
    return tickets(
        spark,
        "ticket_id event_name ticket_status deal_price contact_id",
        [
            ("1", "a", "valid", 100, "x"),
            ("2", "a", "valid", 0, "y"),
            ("3", "b", "valid", 300, "x"),
            ("4", "b", "valid", None, None),
            ("5", "c", "canceled", 900, "z"),
        ],
    )


def test_selected_show_without_sales(spark):
    t = _two_shows(spark)
    f = Filters.of(events=["a", "b", "c", "nowhere"], ref_event="a")
    assert rows_of(compare.show_kpis(t, f), "event_name", "tickets", "revenue_cents", "paid_pct") == [
        ("a", 2, 100, 50.0),
        ("b", 2, 300, 50.0),
        ("c", 0, 0, None),
        ("nowhere", 0, 0, None),
    ]
    out = {r["metric"]: r for r in compare.ref_vs_avg(t, f).collect()}
    assert out["tickets"]["avg_others"] == pytest.approx(2 / 3)
    assert out["revenue_cents"]["delta"] == pytest.approx(0.0)
    assert out["paid_pct"]["avg_others"] == 50.0


def test_open_selection_knows_canceled_shows(spark):
    kpis = compare.show_kpis(_two_shows(spark), ANY)
    assert rows_of(kpis, "event_name", "tickets") == [("a", 2), ("b", 2), ("c", 0)]


def test_loyalty_counts_known_buyers_only(spark):
    f = Filters.of(events=["a", "b", "c"])
    out = rows_of(compare.loyalty(_two_shows(spark), f), "event_name", "first_time", "returning")
    assert out == [("a", 1, 1), ("b", 0, 1), ("c", 0, 0)]
    alone = rows_of(compare.loyalty(_two_shows(spark), Filters.of(events=["a"])))
    assert alone == [("a", 2, 0)]


def test_unknown_price_is_paid_by_zero_and_free_by_positive(spark):
    t = tickets(
        spark,
        "ticket_id event_name deal_price deal_title",
        [("1", "a", None, "vip"), ("2", "a", 0, "vip"), ("3", "a", 10, "vip"), ("4", "a", -5, "vip")],
    )
    assert rows_of(compare.paid_free(t, ANY)) == [("a", 3, 1)]
    assert rows_of(revenue.by_category(t, ANY)) == [("Gratuito", 3, -5), ("vip", 1, 10)]
    assert rows_of(revenue.paid_vs_free(t, ANY)) == [("Gratuito", 1), ("Pago", 3)]
    assert rows_of(revenue.free_ticket_types(t, ANY)) == [("vip", 1)]


def test_reference_show(spark):
    t = _two_shows(spark)
    assert compare.reference_show(t, Filters.of(events=["b", "c"], ref_event="a")) == "b"
    assert compare.reference_show(t, Filters.of(events=["b", "c"], ref_event="c")) == "c"
    assert compare.reference_show(t, Filters.of(ref_event="b")) == "b"
    assert compare.reference_show(t, Filters.of(ref_event="nowhere")) == "a"


def test_leave_one_out(spark):
    f = Filters.of(events=["a", "b", "c"])
    out = rows_of(
        compare.leave_one_out(_two_shows(spark), f).filter("metric = 'revenue_cents'"),
        "event_name",
        "value",
        "avg_others",
    )
    assert out == [("a", 100.0, 150.0), ("b", 300.0, 50.0), ("c", 0.0, 200.0)]


def test_mean_curve_has_no_fill(spark):
    start = at("2024-01-10T00:00:00")
    t = tickets(
        spark,
        "event_name ordered_at event_start_time deal_price",
        [
            ("a", at("2024-01-01T00:00:00"), start, 1),
            ("b", at("2024-01-01T00:00:00"), start, 10),
            ("b", at("2024-01-02T00:00:00"), start, 10),
            ("c", at("2024-01-02T00:00:00"), start, 30),
        ],
    )
    f = Filters.of(events=["a", "b", "c"], ref_event="a")
    out = rows_of(compare.evolution_avg_others(t, f), "dia", "avg_tickets", "avg_cum_revenue_cents")
    assert out == [(8, 1.0, 25.0), (9, 1.0, 10.0)]
    roles = rows_of(compare.evolution(t, f), "role", "event_name", "dia")
    assert roles[0] == ("other", "b", 8) and roles[-1] == ("ref", "a", 9)


# Sums over nothing --------------------------------------------------------------


def test_group_of_unknown_prices_sums_to_zero(spark):
    t = tickets(spark, "ticket_id event_name deal_price", [("1", "a", None)])
    assert rows_of(revenue.by_show(t, ANY)) == [("a", 0)]


# Audience -----------------------------------------------------------------------


def test_first_row_per_buyer(spark):
    t = tickets(
        spark,
        "ticket_id event_name contact_id ordered_at contact_gender",
        [
            ("2", "a", "x", None, "late"),
            ("9", "a", "x", at("2024-01-01T00:00:00"), None),
            ("3", "a", "x", at("2024-01-02T00:00:00"), "later"),
            ("5", "a", None, at("2024-01-02T00:00:00"), "p"),
            ("4", "a", None, at("2024-01-02T00:00:00"), "q"),
        ],
    )
    out = rows_of(audience.unique_buyers(t, ANY), "contact_id", "ticket_id", "contact_gender")
    assert out == [("x", "9", None), (None, "4", "q")]
    assert rows_of(audience.gender(t, ANY)) == [("q", 1)]


def test_top_cities_break_ties_by_name(spark):
    cities = [f"c{i:02d}" for i in range(20)]
    t = tickets(
        spark,
        "ticket_id event_name contact_id contact_locality",
        [(c, "a", c, c) for c in reversed(cities)],
    )
    assert [r[0] for r in rows_of(audience.top_cities(t, ANY))] == cities[:15]


def test_top_loyal_ties_and_labels(spark):
    rows = [(f"t{i}", "a", 1, f"b{i:02d}", f"name{i}" if i else None) for i in range(12)]
    rows.append(("t99", "b", 2, "b11", "other"))
    t = tickets(spark, "ticket_id event_name event_id contact_id contact_name", rows)
    out = rows_of(audience.top_loyal(t, ANY))
    assert [r[0] for r in out] == ["b00"] + [f"b{i:02d}" for i in range(1, 9)] + ["b11"]
    assert out[0] == ("b00", "b00", 1)
    # Ids order first rows of equal time: t11 stands before t99.
    assert out[-1] == ("b11", "name11", 2)
    assert rows_of(audience.recurrence(t, ANY)) == [(1, "1 evento", 11), (2, "2 eventos", 1)]


def test_age_range_is_dense_and_cut(spark):
    rows = [
        ("1", "a", "x", "2008-06-01", "f"),
        ("2", "a", "y", "2010-06-01", "f"),
        ("3", "a", "z", "1900-01-01", "m"),
        ("4", "a", "w", None, "m"),
        ("5", "a", "v", "1990-06-01", "-"),
    ]
    t = tickets(spark, "ticket_id event_name contact_id contact_birthday contact_gender", rows)
    ages = rows_of(audience.age(t, ANY).filter("buyers > 0"))
    assert ages == [(16, 1), (34, 1)]
    assert audience.age(t, ANY).count() == 65
    by_gender = audience.age_by_gender(t, ANY)
    assert by_gender.count() == 65 and {r[0] for r in rows_of(by_gender)} == {"f"}


# Operations, marketing ----------------------------------------------------------


def test_attendance_without_a_price_column_is_all_paid(spark):
    t = tickets(
        spark,
        "ticket_id event_name ticket_scanned_at",
        [("1", "a", at("2024-01-01T00:00:00")), ("2", "a", None)],
    )
    assert rows_of(operations.attendance_by_show(t, ANY)) == [("a", "Pago", 2, 1, 1, 2)]


def test_status_counts_include_canceled_but_not_unknown(spark):
    t = tickets(spark, "event_name ticket_status", [("a", "canceled"), ("a", None), ("a", "valid")])
    assert rows_of(operations.status_distribution(t, ANY)) == [("canceled", 1), ("valid", 1)]


def test_cancellation_without_ids_is_null(spark):
    t = tickets(spark, "ticket_id event_name ticket_status", [(None, "a", "canceled")])
    assert rows_of(operations.cancellation_by_show(t, ANY)) == [("a", 0, 1, None)]


def test_cross_tabs_are_sparse_and_dense_on_request(spark):
    t = tickets(
        spark,
        "event_name utm_source utm_medium",
        [("a", "x", "app"), ("b", "y", "web"), ("b", "y", "web")],
    )
    shown = ("event_name", "utm_source", "tickets")
    sparse = [("a", "x", 1), ("b", "y", 2)]
    assert rows_of(marketing.channel_by_show(t, ANY), *shown) == sparse
    assert rows_of(marketing.channel_by_show(t, ANY, ["y", "x", "y"]), *shown) == [
        ("a", "x", 1),
        ("a", "y", 0),
        ("b", "x", 0),
        ("b", "y", 2),
    ]
    columns = ("utm_source", "utm_medium", "tickets", "channel_total")
    assert rows_of(marketing.channel_by_medium(t, ANY), *columns) == [
        ("x", "app", 1, 1),
        ("y", "web", 2, 2),
    ]
    out = rows_of(marketing.channel_by_medium(t, ANY, ["app", "web"]), *columns)
    assert out == [("x", "app", 1, 1), ("x", "web", 0, 1), ("y", "app", 0, 2), ("y", "web", 2, 2)]


# Capabilities -------------------------------------------------------------------


def test_missing_column_makes_a_metric_unavailable(spark):
    t = tickets(spark, "event_name", [("a",)])
    for metric in (revenue.by_show, marketing.by_channel, audience.age, sales.lead_time):
        with pytest.raises(MetricUnavailable):
            metric(t, ANY)
    assert revenue.bundle(t, ANY) == {}
    assert marketing.bundle(t, ANY) == {}
    assert set(sales.bundle(t, ANY)) == {"show_summary"}
    assert compare.bundle(t, ANY) == {}
    assert audience.bundle(t, ANY) == {}


def test_bundles_follow_the_selection(spark):
    columns = "ticket_id event_name deal_price deal_title ordered_at"
    day = at("2024-01-01T00:00:00")
    t = tickets(spark, columns, [("1", "a", 1, "x", day), ("2", "b", 1, "x", day)])
    assert "by_show" in revenue.bundle(t, ANY) and "daily" not in revenue.bundle(t, ANY)
    one = Filters.of(events=["a"])
    assert "daily" in revenue.bundle(t, one) and "by_show" not in revenue.bundle(t, one)
    assert set(compare.bundle(t, Filters.of(events=["a", "b"]))) >= {"ref_vs_avg", "evolution"}


def test_universe(spark):
    t = tickets(
        spark,
        "event_id event_name ordered_at",
        [(2, "b", at("2024-01-05T00:00:00")), (1, "a", at("2024-01-02T00:00:00")), (1, "a", None)],
    )
    assert rows_of(universe.summary(t), "kind", "value") == [
        ("channel", "Shotgun"),
        ("date_max", "2024-01-05"),
        ("date_min", "2024-01-02"),
        ("event", "a"),
        ("event", "b"),
    ]
    assert [tuple(r) for r in universe.show_catalogue(t).collect()] == [(1, "a"), (2, "b")]


# Door ---------------------------------------------------------------------------


def _ledger(spark, rows):
    schema = (
        "event_name string, tickets int, revenue_brl decimal(18,6), "
        "prices array<decimal(18,6)>, entry_date date"
    )
    from decimal import Decimal

    typed = [
        (n, k, None if r is None else Decimal(r), None if p is None else [Decimal(x) for x in p], d)
        for n, k, r, p, d in rows
    ]
    return spark.createDataFrame(typed, schema)


def test_door_rows(spark):
    online = tickets(
        spark,
        "event_name event_start_time",
        [("a", at("2024-05-02T22:00:00")), ("a", at("2024-05-01T22:00:00"))],
    )
    ledger = _ledger(
        spark,
        [
            ("a", 2, "30", ["10", "20"], date(2024, 4, 1)),
            ("a", 3, "10", ["10"], None),
            ("b", 1, "5", [], None),
            ("a", 0, "99", None, None),
        ],
    )
    out = rows_of(
        door.door_rows(ledger, online, AS_OF).select(
            "event_name", "order_date", F.col("door_price").cast("string"), "ticket_status", "source"
        )
    )
    third = "3.333333"
    assert out == [
        ("a", date(2024, 4, 1), "10.000000", "valid", "Porta"),
        ("a", date(2024, 4, 1), "20.000000", "valid", "Porta"),
        ("a", date(2024, 5, 1), third, "valid", "Porta"),
        ("a", date(2024, 5, 1), third, "valid", "Porta"),
        ("a", date(2024, 5, 1), "3.333334", "valid", "Porta"),
        ("b", AS_OF, "5.000000", "valid", "Porta"),
    ]
    both = door.all_channels(online, door.door_rows(ledger, online, AS_OF))
    assert rows_of(universe.dataset_counts(both)) == [("Porta", 6), ("Shotgun", 2)]
    assert kpi.headline(both, Filters.of(channels=["Porta"])).first()["revenue_cents"] == 4500


def test_channel_comparison_fills_both_sides(spark):
    online = tickets(
        spark,
        "event_name ticket_status deal_price ordered_at",
        [("a", "valid", 100, at("2024-01-01T00:00:00")), ("c", "canceled", 5, None)],
    )
    ledger = _ledger(spark, [("b", 2, "1.5", None, None), ("z", 9, "9", None, None)])
    f = Filters.of(
        events=["a", "b", "c"],
        channels=["Shotgun", "Porta"],
        date_from="2024-01-01",
        date_to="2024-01-01",
    )
    out = rows_of(door.channel_comparison(online, ledger, f))
    assert out == [("a", 1, 100, 0, 0), ("b", 0, 0, 2, 150)]
    assert rows_of(door.channel_grand_totals(online, ledger, f)) == [
        ("Porta", 2, 150),
        ("Shotgun", 1, 100),
    ]
    assert set(door.bundle(online, ledger, f)) == {"comparison", "grand_totals", "revenue", "tickets"}
    assert door.bundle(online, ledger, ANY) == {}


def test_door_shares_add_up_to_the_ledger(spark):
    ledger = _ledger(spark, [("a", 30_000, "100", None, None), ("b", 7, "-0.01", None, None)])
    rows = door.door_rows(ledger, None, AS_OF)
    sums = rows.groupBy("event_name").agg(F.sum("door_price").cast("string"), F.count("*"))
    assert rows_of(sums) == [("a", "100.000000", 30_000), ("b", "-0.010000", 7)]


def test_dates_filter_a_union_without_online_moments(spark):
    online = tickets(spark, "event_name ticket_status", [("a", "valid")])
    ledger = _ledger(spark, [("a", 5, "10", None, date(2024, 4, 1))])
    both = door.all_channels(online, door.door_rows(ledger, online, AS_OF))
    at_door = Filters.of(channels=["Porta"], date_from="1999-01-01", date_to="1999-12-31")
    assert kpi.headline(both, at_door).first()["tickets"] == 0
    inside = Filters.of(channels=["Porta"], date_from="2024-04-01", date_to="2024-04-01")
    assert kpi.headline(both, inside).first()["tickets"] == 5


def test_large_door_entries_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(door, "_PART", 4)
    listed = [str(i) for i in range(1, 11)]
    ledger = _ledger(
        spark,
        [("a", 10, "55", listed, AS_OF), ("b", 9, "18", None, AS_OF), ("c", 4, "4", ["1"] * 4, AS_OF)],
    )
    out = rows_of(
        door.door_rows(ledger, None, AS_OF).select("event_name", F.col("door_price").cast("double"))
    )
    assert sorted(p for n, p in out if n == "a") == [float(i) for i in range(1, 11)]
    assert [p for n, p in out if n == "b"] == [2.0] * 9
    assert [p for n, p in out if n == "c"] == [1.0] * 4
