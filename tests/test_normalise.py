"""Row-level clean-up on hand-made values; expected values are typed by hand."""

from datetime import date, datetime

import pytest
from frames import raw, rows_of, tickets
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile import Tickets
from turnstile.functions import normalise as N
from turnstile.functions.rates import for_display


def _one(spark, value, expression, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(expression(F.col("v")).alias("out")).first()["out"]


@pytest.mark.parametrize(
    "given, wanted",
    [
        (None, "direto"),
        ("", "direto"),
        ("  ", "direto"),
        ("DIRECT", "direto"),
        ("\tInstagram.COM\n", "instagram"),
        ("facebook.com", "facebook"),
        ("x.com.br", "x.com.br"),
        ("direct.com", "direto"),
        (".com", "direto"),
        ("a.com.com", "a.com"),
        ("xcom", "xcom"),
        (" TikTok ", "tiktok"),
        ("direto", "direto"),
    ],
)
def test_acquisition_channel(spark, given, wanted):
    assert _one(spark, given, N.utm_source) == wanted


def test_medium_keeps_the_empty_string(spark):
    assert _one(spark, None, N.utm_medium) == "desconhecido"
    assert _one(spark, "", N.utm_medium) == ""


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("2024-01-02T03:04:05Z", "2024-01-02 03:04:05"),
        ("2024-01-02T00:30:00+02:00", "2024-01-01 22:30:00"),
        ("2024-01-02", "2024-01-02 00:00:00"),
        ("not a date", None),
        ("2024-02-31", None),
        (None, None),
    ],
)
def test_timestamps_are_utc_and_bad_ones_null(spark, given, wanted):
    out = _one(spark, given, lambda c: N.utc_timestamp(c, T.StringType()).cast("string"))
    assert out == wanted


@pytest.mark.parametrize(
    "given, wanted",
    [("1234", 1234), ("1234.0", 1234), ("-5", -5), ("abc", None), ("", None), (None, None)],
)
def test_cents_from_text(spark, given, wanted):
    assert _one(spark, given, lambda c: N.cents(c, T.StringType())) == wanted


@pytest.mark.parametrize("given, wanted", [(10.0, 10), (float("nan"), None), (float("inf"), None)])
def test_cents_from_floats(spark, given, wanted):
    assert _one(spark, given, lambda c: N.cents(c, T.DoubleType()), "double") == wanted


@pytest.mark.parametrize(
    "kind, given, wanted",
    [
        ("string", "True", True),
        ("string", "False", False),
        ("string", "true", None),
        ("string", "yes", None),
        ("string", None, None),
        ("boolean", True, True),
        ("int", 1, True),
        ("int", 0, False),
        ("int", 2, None),
    ],
)
def test_optin(spark, kind, given, wanted):
    dtype = {"string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType()}[kind]
    assert _one(spark, given, lambda c: N.optin(c, dtype), kind) is wanted


@pytest.mark.parametrize(
    "birthday, wanted",
    [
        ("1994-06-01", 30),
        ("1993-12-01", 30),  # 11140 days, 30.4997 years
        ("1993-11-30", 31),  # 11141 days, 30.5024 years
        ("2025-01-01", -1),
        ("1994-06-01T23:00:00-03:00", 30),
        ("garbage", None),
    ],
)
def test_age_rounds_years(spark, birthday, wanted):
    t = tickets(spark, "contact_birthday", [(birthday,)])
    assert t.rows.first()["age"] == wanted


def test_order_parts_and_lead_time(spark):
    t = tickets(
        spark,
        "ordered_at event_start_time",
        [
            (datetime.fromisoformat("2024-03-04T23:59:00+00:00"),
             datetime.fromisoformat("2024-03-06T11:59:00+00:00")),
            (None, datetime.fromisoformat("2024-03-06T11:59:00+00:00")),
        ],
    )
    names = ["order_date", "order_hour", "order_dow", "days_before_event"]
    assert rows_of(t.rows, *names) == [
        (date(2024, 3, 4), 23, "Monday", 1.5),
        (None, None, None, None),
    ]


def test_absent_columns_differ_from_null_ones(spark):
    given = tickets(spark, "event_name deal_price", [("a", None)])
    assert given.has("deal_price_cents", "deal_price_brl", "source")
    assert not given.has("utm_source") and not given.has("age") and not given.has("order_date")
    assert given.rows.first()["utm_source"] is None
    nulls = tickets(spark, "event_name utm_source", [("a", None)])
    assert nulls.rows.first()["utm_source"] == "direto"


def test_brl_is_exact(spark):
    t = tickets(spark, "deal_price", [(12345,)])
    assert str(t.rows.first()["deal_price_brl"]) == "123.45"


def test_normalising_starts_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    frame = raw(spark, "ticket_id deal_price", [("a", 1)])
    before = len(tracker.getJobIdsForGroup())
    Tickets.from_raw(frame, date(2024, 1, 1))
    assert len(tracker.getJobIdsForGroup()) == before


def test_display_rounds_half_even(spark):
    df = spark.createDataFrame([(12345, 0.25, 0.35)], "revenue_cents long, a_pct double, b_pct double")
    shown = for_display(df).first()
    assert str(shown["revenue"]) == "123.45"
    assert shown["a_pct"] == 0.2
    assert shown["b_pct"] == 0.4


@pytest.mark.parametrize("value, wanted", [("-", None), ("", None), ("female", "female"), (None, None)])
def test_gender_placeholders(spark, value, wanted):
    assert _one(spark, value, N.known_gender) == wanted


@pytest.mark.parametrize("value, wanted", [("01008-000", None), ("-", None), ("Santos", "Santos")])
def test_city_placeholders(spark, value, wanted):
    assert _one(spark, value, N.known_city) == wanted


@pytest.mark.parametrize("value, wanted", [(None, "outro"), ("", "outro"), ("pix", "pix")])
def test_payment_placeholders(spark, value, wanted):
    assert _one(spark, value, N.payment_method) == wanted
