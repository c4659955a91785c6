"""Tickets and a door ledger derived from the star-schema tables of a directory."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Declared, so that no job has to look the columns up first.
_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "part": "p_partkey bigint, p_type string",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, "
        "l_linestatus string"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
    ),
}

_SHOW_START = (
    "date_trunc('quarter', cast(o_orderdate as timestamp)) + interval 3 months - interval 2 hours"
)
# Prices hold whole cents, so any rounding gives the same; this one is the cheap one.
_CENTS = "cast(rint(l_extendedprice * 100) as bigint)"

# What every ticket of an order shares is worked out once per order, before line
# items are joined to it.
_PER_ORDER = {
    "sold_quarter": "concat(year(o_orderdate), 'Q', quarter(o_orderdate))",
    "sold_quarter_no": "(year(o_orderdate) * 4 + quarter(o_orderdate) - 1) * 10",
    "placed_at": (
        "cast(o_orderdate as timestamp)"
        " + make_dt_interval(0, 0, cast((o_orderkey * 37) % 1440 as int))"
    ),
    "event_start_time": _SHOW_START,
    "payment_method": """
        case o_orderpriority when '4-NOT SPECIFIED' then null when '5-LOW' then ''
             else lower(substr(o_orderpriority, 3)) end""",
    "contact_id": "case when o_custkey % 50 <> 49 then o_custkey end",
    "contact_name": "case when o_custkey % 10 <> 9 then c_name end",
    "contact_gender": """
        case o_custkey % 5 when 0 then 'female' when 1 then 'male' when 2 then 'other'
             when 3 then '-' end""",
    "contact_locality": """
        case o_custkey % 11 when 0 then '-' when 1 then '' when 2 then '01008-000'
             else buyer_nation end""",
    "contact_birthday": """
        case when o_custkey % 13 <> 0
             then date_add(date '1930-01-01', cast((o_custkey * 389) % 25000 as int)) end""",
    "contact_newsletter_optin": (
        "case o_custkey % 4 when 0 then 'True' when 1 then 'False' when 2 then 'True' end"
    ),
}

# The columns of a ticket over line item, order and dimensions.
_TICKET = {
    "ticket_id": f"concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, {_CENTS})",
    "tenant_id": "r_regionkey % 3",
    "event_id": "cast(sold_quarter_no + r_regionkey as bigint)",
    "event_name": "concat(r_name, ' ', sold_quarter)",
    "ticket_status": """
        case when l_returnflag = 'R' then 'canceled'
             when l_returnflag = 'N' and l_linestatus = 'F' then 'pending'
             when l_linenumber = 7 and l_quantity = 49 then null
             else 'valid' end""",
    "ordered_at": "case when l_linenumber = 6 and l_quantity = 48 then null else placed_at end",
    "event_start_time": "event_start_time",
    "ticket_scanned_at": """
        case when l_linestatus = 'F' and l_returnflag <> 'R'
             then event_start_time + make_dt_interval(0, 0, l_linenumber * 10) end""",
    "deal_price": f"""
        case when l_discount = 0 then 0
             when l_linenumber = 7 and l_quantity = 50 then null
             else {_CENTS} end""",
    "deal_title": "p_type",
    "payment_method": "payment_method",
    "utm_source": """
        case l_partkey % 8
             when 0 then null when 1 then '' when 2 then 'direct' when 3 then ' Instagram.COM '
             when 4 then 'facebook.com' when 5 then 'instagram' when 6 then lower(p_type)
             else 'App' end""",
    "utm_medium": "case l_linenumber % 3 when 0 then 'app' when 1 then 'web' end",
    "contact_id": "contact_id",
    "contact_name": "contact_name",
    "contact_gender": "contact_gender",
    "contact_locality": "contact_locality",
    "contact_birthday": "contact_birthday",
    "contact_newsletter_optin": "contact_newsletter_optin",
}

# Columns that need a table besides line items and orders.
_OF_PART = {"deal_title", "utm_source"}
_OF_ORGANISER = {"tenant_id", "event_id", "event_name"}
_OF_CUSTOMER = {"contact_name", "contact_locality"}


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{directory}/{name}.parquet")


def tickets(
    spark: SparkSession,
    directory: str,
    *columns: str,
    ordered_from: date | None = None,
    ordered_before: date | None = None,
) -> DataFrame:
    """One ticket per line item, with the asked-for columns (all by default).

    Orders come first, as the only join that can drop rows: bounds on the order
    day reach the scan of the orders. A dimension is joined only if a column needs
    it, and as a left join, so that a line whose part or customer is unknown keeps
    its row. Dimensions are joined one by one to keep their own size estimates,
    which decide between broadcast and sort-merge.
    """
    wanted = set(columns) or set(_TICKET)
    orders = table(spark, directory, "orders")
    if ordered_from is not None:
        orders = orders.filter(F.col("o_orderdate") >= F.lit(ordered_from).cast("timestamp_ntz"))
    if ordered_before is not None:
        orders = orders.filter(F.col("o_orderdate") < F.lit(ordered_before).cast("timestamp_ntz"))
    if wanted & _OF_CUSTOMER:
        buyer_nation = table(spark, directory, "nation").selectExpr(
            "n_nationkey as buyer_nationkey", "n_name as buyer_nation"
        )
        orders = orders.join(
            table(spark, directory, "customer"), F.expr("o_custkey = c_custkey"), "left"
        ).join(buyer_nation, F.expr("c_nationkey = buyer_nationkey"), "left")
    else:
        orders = orders.selectExpr("*", "null as c_name", "null as buyer_nation")
    orders = orders.selectExpr(
        "o_orderkey", *[f"{sql} as {name}" for name, sql in _PER_ORDER.items()]
    )

    rows = table(spark, directory, "lineitem").join(orders, F.expr("l_orderkey = o_orderkey"))
    if wanted & _OF_PART:
        rows = rows.join(table(spark, directory, "part"), F.expr("l_partkey = p_partkey"), "left")
    if wanted & _OF_ORGANISER:
        # Joined to each other first, so that a line item is looked up once.
        organisers = table(spark, directory, "supplier")
        for name, condition in (
            ("nation", "s_nationkey = n_nationkey"),
            ("region", "n_regionkey = r_regionkey"),
        ):
            organisers = organisers.join(table(spark, directory, name), F.expr(condition), "left")
        rows = rows.join(organisers, F.expr("l_suppkey = s_suppkey"), "left")
    return rows.selectExpr(*[f"{sql} as {name}" for name, sql in _TICKET.items() if name in wanted])


def ledger(spark: SparkSession, directory: str) -> DataFrame:
    """One ledger entry per purchase event."""
    purchases = table(spark, directory, "events").filter("event_type = 'purchase'")
    entries = purchases.join(
        table(spark, directory, "region"), F.expr("r_regionkey = cast(user_id % 5 as int)")
    ).selectExpr(
        "event_id as entry_id",
        "concat(r_name, ' ', 1995 + user_id % 6, 'Q', 1 + event_id % 4) as event_name",
        "cast(1 + event_id % 5 as int) as tickets",
        "cast(cast(rint(value * 100) as decimal(18, 0)) / 100 as decimal(18, 6)) as revenue_brl",
        "case when event_id % 7 = 0 then cast(ts as date) end as entry_date",
        "case when event_id % 3 = 0 then 'pagbank_csv' else 'manual' end as source",
    )
    n_prices = (
        "case when entry_id % 2 = 0 then tickets when entry_id % 9 = 0 then 1 else 0 end"
    )
    prices = f"array_repeat(cast(revenue_brl / tickets as decimal(18, 6)), {n_prices})"
    return entries.selectExpr("*", f"case when {n_prices} > 0 then {prices} end as prices")
