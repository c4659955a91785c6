"""The registered queries: one per metric, over the tables of a directory."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstile import constants as C
from turnstile import schema as S
from turnstile.filters import Filters, kept, kept_online, selected
from turnstile.frame import Tickets
from turnstile.operators import (
    audience,
    compare,
    curves,
    door,
    kpi,
    marketing,
    operations,
    revenue,
    rollup,
    sales,
    universe,
)
from turnstile.session import configure, scratch, shuffles_dropped, written
from turnstile.sources import chain, csv, ingest, ledger, pages, statement, tables
from turnstile.sources.store import TicketStore

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = date(2001, 8, 1)
_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
_SHOWS_1998 = [f"{region} 1998Q{quarter}" for region in _REGIONS for quarter in (1, 2, 3, 4)]
REFERENCE_SHOW = "AFRICA 1998Q1"

ALL = Filters.of()
Y98 = Filters.of(events=_SHOWS_1998, ref_event=REFERENCE_SHOW)
ONE = Filters.of(events=["ASIA 1997Q2"])
DATED = Filters.of(events=_SHOWS_1998, date_from="1998-02-01", date_to="1998-11-30")
BOTH = Filters.of(events=_SHOWS_1998, channels=[C.ONLINE, C.DOOR])

# Labels of the zero-filled cross-tabs; some occur nowhere.
_MEDIA = ["app", "web", "print"]
_CHANNELS = ["direto", "instagram", "facebook", "app", "newsletter"]
_CATEGORIES = [C.FREE, "STANDARD POLISHED TIN", "PROMO BRUSHED COPPER", "no such category"]

_SCOPE = "event_name ticket_status"


def load(spark: SparkSession, directory: str, columns: str) -> Tickets:
    """Normalised tickets with the columns a query reads."""
    configure(spark)
    return Tickets.from_raw(tables.tickets(spark, directory, *columns.split()), AS_OF)


def _metric(metric, f: Filters, columns: str, scope: str = _SCOPE, post=None, **options) -> Query:
    def run(spark: SparkSession, directory: str) -> DataFrame:
        out = metric(load(spark, directory, f"{scope} {columns}"), f, **options)
        return post(out) if post else out

    return run


def _columns(columns: str):
    names = columns.split()
    return lambda df: df.select(*names)


def _rounded(*rates: str, keep: str = ""):
    """Rates to four places, as they are compared."""

    def post(df: DataFrame) -> DataFrame:
        names = keep.split() or [c for c in df.columns if c not in rates]
        return df.select(*names, *[F.round(r, 4).alias(r) for r in rates])

    return post


def _normalised(columns: str, pick) -> Query:
    def run(spark: SparkSession, directory: str) -> DataFrame:
        return pick(load(spark, directory, columns).rows)

    return run


def _scope_ids(scope) -> Query:
    def run(spark: SparkSession, directory: str) -> DataFrame:
        rows = load(spark, directory, f"{_SCOPE} ticket_id ordered_at")
        return scope(rows, DATED).select("ticket_id")

    return run


def _naive(*names: str):
    return [F.col(n).cast("timestamp_ntz").alias(n) for n in names]


def _headline(f: Filters) -> Query:
    rates = ("attendance_pct", "cancel_pct", "optin_pct")
    return _metric(
        kpi.headline,
        f,
        "ordered_at contact_id deal_price ticket_scanned_at contact_newsletter_optin",
        post=_rounded(*rates, keep="tickets buyers revenue_cents"),
    )


def _tenant_tickets(spark: SparkSession, directory: str) -> DataFrame:
    configure(spark)
    rows = tables.tickets(spark, directory, "tenant_id", "event_name")
    mine = ingest.of_tenant(rows, 1)
    return mine.groupBy("event_name").agg(F.count(F.lit(1)).alias("tickets"))


def _batch_and_stored(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """A fetch that overlaps with what was stored before it by half a year."""
    configure(spark)
    rows = tables.tickets(spark, directory, "ticket_id", "ordered_at")
    ordered = F.col("ordered_at")
    stored = rows.filter(ordered.isNull() | (ordered < F.lit(date(1999, 1, 1))))
    return rows.filter(ordered >= F.lit(date(1998, 7, 1))).select("ticket_id"), stored


def _incremental(spark: SparkSession, directory: str) -> DataFrame:
    return ingest.incremental_counts(*_batch_and_stored(spark, directory))


def _upsert(spark: SparkSession, directory: str) -> DataFrame:
    return ingest.new_tickets(*_batch_and_stored(spark, directory))


def _ingest_pages(spark: SparkSession, directory: str) -> DataFrame:
    """Every ticket as JSON on a page, read back and summed per show."""
    configure(spark)
    columns = [*_SCOPE.split(), "ticket_id", "ordered_at", "deal_price", "contact_newsletter_optin"]
    raw = pages.to_raw_json(tables.tickets(spark, directory, *columns))
    landed = pages.pages(
        raw.select(
            F.col("ticket_id").alias("page_file"),
            F.col("ticket_id").alias("cursor"),
            F.array("raw").alias("data"),
            F.struct(F.lit(None).cast("string").alias("next")).alias("pagination"),
        )
    )
    parsed = pages.parsed(pages.records(landed).select("ticket_id", "raw"))
    return _per_show(Tickets.from_raw(parsed.drop("raw"), AS_OF))


def _per_show(back: Tickets) -> DataFrame:
    return (
        kept(back, ALL)
        .groupBy("event_name")
        .agg(
            F.count("ticket_id").alias("tickets"),
            F.sum("deal_price_cents").alias("revenue_cents"),
            F.count_if("contact_newsletter_optin").alias("optins"),
            F.min("order_date").alias("first_order"),
        )
    )


def _to_raw_json(spark: SparkSession, directory: str) -> DataFrame:
    """Every ticket as JSON text, and some of the texts in it."""
    configure(spark)
    columns = ["ticket_id", "ordered_at", "deal_price", "utm_source", "contact_birthday"]
    raw = pages.to_raw_json(tables.tickets(spark, directory, *columns))
    return raw.select(
        "ticket_id", *[F.get_json_object("raw", f"$.{c}").alias(c) for c in columns[1:]]
    )


def _page_chain_gaps(spark: SparkSession, directory: str) -> DataFrame:
    """Line items as pages: each announces the next line of its order."""
    configure(spark)
    host = "https://tickets.example.org/list?page_size=1"
    lines = tables.table(spark, directory, "lineitem").selectExpr(
        "cast(l_orderkey as string) as page_file",
        "concat(l_orderkey, '-', l_linenumber) as cursor",
        "array(l_returnflag) as data",
        f"named_struct('next', concat('{host}&after=', l_orderkey, '-', l_linenumber + 1))"
        " as pagination",
    )
    return pages.chain_gaps(pages.pages(lines))


_USER_PAGES = (
    "concat(user_id, '/', event_id) as page_file",
    "case when seq > 1 then concat('c', seq) end as cursor",
    "case when event_id % 89 = 7 then array() else array(cast(event_id as string)) end as data",
    "named_struct('next', concat('https://tickets.example.org/list?page_size=1&after=c', "
    "case when event_id % 101 = 11 then greatest(2, seq - 3) else seq + 1 end)) as pagination",
)


def _user_pages(spark: SparkSession, directory: str) -> DataFrame:
    """Every user's events as a chain of pages: some pages are lost, empty, or point back."""
    configure(spark)
    events = tables.table(spark, directory, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    landed = events.select("user_id", "event_id", seq.alias("seq")).filter("event_id % 97 <> 5")
    file = F.split("page_file", "/")
    shown = pages.pages(landed.selectExpr(*_USER_PAGES))
    return shown.select("*", file[0].alias("feed"), file[1].cast("long").alias("event_id"))


def _page_chain_walk(spark: SparkSession, directory: str) -> DataFrame:
    """Each walked page's place on its user's chain."""
    return chain.walk(_user_pages(spark, directory)).select("feed", "event_id", "arrival")


def _page_chain_audit(spark: SparkSession, directory: str) -> DataFrame:
    found = chain.audit(_user_pages(spark, directory))
    return found.groupBy("feed", "problem").agg(F.count(F.lit(1)).alias("cursors"))


def _statements(spark: SparkSession, directory: str) -> DataFrame:
    """A statement per event: two sales, one row of another kind and one refund."""
    configure(spark)
    preamble = "\\n".join(f"preamble {i}" for i in range(C.STATEMENT_PREAMBLE_LINES))
    day, next_day = "date_format(ts, 'd/M/yyyy')", "date_format(ts + interval 1 day, 'dd/MM/yyyy')"
    return tables.table(spark, directory, "events").selectExpr(
        "cast(event_id as string) as file",
        f"""concat('{preamble}', '\\n\\n Data , Tipo ,Entradas,Saldo\\n',
            {day}, ',Vendas,', format_number(value, '0.00'), ',1\\n',
            {next_day}, ', Vendas ,', event_id % 100, ',2\\r\\n',
            {day}, ',', event_type, ',7.00,3\\n',
            {day}, ',Vendas,-', event_id % 10, '.50,4\\n') as text""",
    )


def _statement_sales(spark: SparkSession, directory: str) -> DataFrame:
    sold = statement.sales_in(_statements(spark, directory))
    amount = F.col("amount").cast("double").alias("amount")
    return sold.select("file", "line_no", "sale_date", amount)


def _figures(df: DataFrame, *keys: str) -> DataFrame:
    """Ledger figures with the price list as its length and its first price."""
    return df.select(
        *keys,
        F.col("tickets").cast("long").alias("tickets"),
        F.col("revenue_brl").cast("double").alias("revenue"),
        F.size("prices").alias("n_prices"),
        F.get("prices", 0).cast("double").alias("first_price"),
    )


def _statement_totals(spark: SparkSession, directory: str) -> DataFrame:
    sold = statement.sales_in(_statements(spark, directory))
    return _figures(statement.totals(sold), "file")


def _statement_by_date(spark: SparkSession, directory: str) -> DataFrame:
    sold = statement.sales_in(_statements(spark, directory))
    return _figures(statement.by_date(sold), "file", "sale_date")


def _assign_statement_dates(spark: SparkSession, directory: str) -> DataFrame:
    """Dates of the statements go to the show of their weekday, Sundays to none."""
    dated = statement.by_date(statement.sales_in(_statements(spark, directory)))
    days = tables.table(spark, directory, "events").selectExpr(
        "explode(array(cast(ts as date), cast(ts as date) + 1)) as sale_date"
    )
    weekday = F.weekday("sale_date")
    show = F.when(weekday == 6, C.IGNORED_SHOW).otherwise(F.concat(F.lit("show "), weekday))
    assignments = days.distinct().select("sale_date", show.alias("event_name"))
    entries = statement.assigned_entries(dated, assignments, "1", datetime(2024, 1, 1))
    return door.door_totals(entries)


def _load_csv(spark: SparkSession, directory: str) -> DataFrame:
    """Every ticket written as CSV text, loaded again and summed per show."""
    configure(spark)
    columns = [*_SCOPE.split(), "ticket_id", "ordered_at", "deal_price", "contact_newsletter_optin"]
    flag = F.initcap(F.col("contact_newsletter_optin").cast("string"))
    raw = tables.tickets(spark, directory, *columns).withColumn("contact_newsletter_optin", flag)
    path = scratch(spark, "csv")
    raw.write.csv(path, header=True, escape='"')
    return _per_show(csv.load_csv(spark, path, AS_OF, multi_line=False))


def _export(spark: SparkSession, directory: str) -> DataFrame:
    """Both channels written as one consolidated file, summed from its text."""
    both = _both(spark, directory, f"{_SCOPE} deal_price")
    path = scratch(spark, "export")
    csv.export_consolidated(both, Filters.of(channels=[C.ONLINE, C.DOOR]), path)
    micros = F.col("deal_price_brl").cast(S.PRICE) * 1_000_000
    return (
        spark.read.csv(path, header=True, escape='"')
        .groupBy("source", "event_name")
        .agg(
            F.count(F.lit(1)).alias("tickets"),
            F.coalesce(F.sum(micros).cast("long"), F.lit(0)).alias("price_micros"),
        )
    )


def _ledger(spark: SparkSession, directory: str) -> DataFrame:
    """Every ledger entry appended to a store and loaded from it."""
    configure(spark)
    store = ledger.LedgerStore(spark, scratch(spark, "ledger")).create()
    store.append("1", tables.ledger(spark, directory))
    cents = (F.col("revenue_brl") * 100).cast("long").alias("revenue_cents")
    n_prices = F.coalesce(F.size("prices"), F.lit(0)).alias("n_prices")
    return store.load("1").select(
        "event_name", "tickets", cents, "entry_date", "source", n_prices
    )


def _clear_ledger(spark: SparkSession, directory: str) -> DataFrame:
    """Two tenants' entries after one of them is cleared."""
    configure(spark)
    store = ledger.LedgerStore(spark, scratch(spark, "ledger")).create()
    entries = tables.ledger(spark, directory)
    for tenant, rest in (("1", 0), ("2", 1)):
        store.append(tenant, entries.filter(F.col("entry_id") % 2 == rest))
    store.clear("1")
    left = [
        store.load(t).agg(F.lit(t).alias("tenant_id"), F.count(F.lit(1)).alias("entries"))
        for t in ("1", "2")
    ]
    return left[0].unionByName(left[1])


def _replayed_ledger(spark: SparkSession, directory: str) -> DataFrame:
    """Every ledger entry, each of an even number twice over, appended in two batches and replayed."""
    configure(spark)
    entries = tables.ledger(spark, directory)
    even = entries.filter("entry_id % 2 = 0")
    store = ledger.LedgerStore(spark, scratch(spark, "ledger")).create()
    for batch, rows in (("a", entries.unionByName(even)), ("b", even), ("a", entries)):
        store.append("1", rows, batch=batch)
    return store.load("1").groupBy("event_name").agg(F.count(F.lit(1)).alias("entries"))


def _fetches(spark: SparkSession, directory: str) -> tuple[TicketStore, DataFrame]:
    """A store after three fetches: early tickets, a later refresh of some, and a replayed old one."""
    configure(spark)
    columns = ["ticket_id", "event_name", "ticket_status", "ordered_at", "deal_price"]
    rows = written(tables.tickets(spark, directory, *columns), "fetched", "zstd")
    store = TicketStore(spark, scratch(spark, "tickets"), buckets=16).create()
    early = rows.filter("ordered_at < timestamp '1998-07-01'")
    status = F.when(F.col("ordered_at") >= F.lit(date(1998, 1, 1)), "refunded")
    changed = rows.filter("ordered_at >= timestamp '1998-01-01'").withColumn(
        "ticket_status", F.coalesce(status, "ticket_status")
    )
    spring = rows.filter("ordered_at >= timestamp '1998-04-01'").withColumn(
        "ticket_status", F.lit("stale")
    )
    for day, batch, refresh in ((1, early, False), (9, changed, True), (5, spring, True)):
        store.ingest("1", pages.to_raw_json(batch), datetime(2024, 1, day), refresh=refresh)
    return store, rows


def _refreshed_tickets(spark: SparkSession, directory: str) -> DataFrame:
    """What a store holds when the latest fetch of every ticket counts."""
    store, _ = _fetches(spark, directory)
    return store.rows("1").groupBy("event_name", "ticket_status").agg(
        F.count(F.lit(1)).alias("tickets"), F.sum("deal_price").alias("cents")
    )


def _ticket_lookup(spark: SparkSession, directory: str) -> DataFrame:
    """Stored tickets among those of the seventh lines, found through their buckets."""
    store, rows = _fetches(spark, directory)
    asked = rows.filter("ticket_id like '%-7-%'").select("ticket_id")
    return store.lookup("1", asked).select("ticket_id", "ticket_status")


def _stored_fields(spark: SparkSession, directory: str) -> DataFrame:
    """Fields of stored records that no column of the store holds, by their paths."""
    configure(spark)
    rows = tables.table(spark, directory, "lineitem").selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as int), l_returnflag) as ticket_id",
        "'show' as event_name",
        "named_struct('mode', l_returnflag, 'lines', array(l_linenumber, l_linenumber * 2)) as shipping",
        "l_quantity as seats",
    )
    store = TicketStore(spark, scratch(spark, "tickets"), buckets=8).create()
    store.ingest("1", pages.to_raw_json(rows), datetime(2024, 1, 1))
    found = store.fields(
        "1",
        mode=("$.shipping.mode", "string"),
        line=("$.shipping.lines[1]", "bigint"),
        seats=("$.seats", "double"),
        nothing=("$.shipping.none", "int"),
    )
    return found.groupBy("mode", "line").agg(
        F.count(F.lit(1)).alias("tickets"),
        F.sum("seats").alias("seats"),
        F.count("nothing").alias("nothing"),
    )


def _rolled_up(spark: SparkSession, directory: str) -> DataFrame:
    """A written rollup of all tickets, read back."""
    path = scratch(spark, "rollup")
    columns = f"{_SCOPE} ticket_id ordered_at deal_price contact_id"
    rollup.write(rollup.build(load(spark, directory, columns)), path)
    return rollup.read(spark, path)


def _rollup_by_show(spark: SparkSession, directory: str) -> DataFrame:
    """Exact figures of the dated selection from the rollup."""
    return rollup.by_show(_rolled_up(spark, directory), DATED).drop("buyers")


def _rollup_buyers(spark: SparkSession, directory: str) -> DataFrame:
    """Estimated buyers per show and how many of them had bought before; estimates have no SQL twin."""
    return rollup.returning(_rolled_up(spark, directory), Y98, date(1998, 7, 1))


def _clear_tenant(spark: SparkSession, directory: str) -> DataFrame:
    """Two tenants' stored tickets after one of them is cleared."""
    configure(spark)
    rows = tables.tickets(spark, directory, "ticket_id", "tenant_id", "event_name")
    rows = written(rows.filter(F.col("tenant_id").isin(1, 2)), "fetched", "zstd")
    store = TicketStore(spark, scratch(spark, "tickets"), buckets=8).create()
    for tenant in (1, 2):
        mine = ingest.of_tenant(rows, tenant).drop("tenant_id")
        store.ingest(str(tenant), pages.to_raw_json(mine), datetime(2024, 1, 1))
    store.clear("1")
    left = [
        store.rows(t).agg(F.lit(t).alias("tenant_id"), F.count(F.lit(1)).alias("tickets"))
        for t in ("1", "2")
    ]
    return left[0].unionByName(left[1])


def _append_ledger(spark: SparkSession, directory: str) -> DataFrame:
    """Every event offered to the ledger, with its type as the origin of all but two types."""
    configure(spark)
    offered = tables.table(spark, directory, "events").selectExpr(
        "case when user_id % 10 <> 0 then concat('show ', user_id % 7) end as event_name",
        "1 as tickets",
        "value as revenue_brl",
        "case event_type when 'purchase' then 'manual' when 'view' then 'pagbank_csv' "
        "else event_type end as source",
    )
    store = ledger.LedgerStore(spark, scratch(spark, "ledger")).create()
    refused = scratch(spark, "refused")
    store.append("1", offered, quarantine=refused)
    marked = (
        store.load("1")
        .select("source", F.lit(True).alias("accepted"))
        .unionByName(spark.read.parquet(refused).select("source", F.lit(False).alias("accepted")))
    )
    return marked.groupBy("source", "accepted").agg(F.count(F.lit(1)).alias("entries"))


def _sales_axis(spark: SparkSession, directory: str) -> DataFrame:
    """Daily tickets on the axis that the data allow, with its name."""
    tickets = load(spark, directory, f"{_SCOPE} ordered_at event_start_time")
    axis = curves.choose_axis(kept(tickets, Y98), tickets)
    return sales.daily_by_axis(tickets, Y98, axis).withColumn("axis", F.lit(axis))


def _import_consolidated(spark: SparkSession, directory: str) -> DataFrame:
    """Door totals, entries and prices after both channels went through one consolidated frame."""
    both = _both(spark, directory, f"{_SCOPE} deal_price")
    _, entries, prices = csv.split_consolidated(
        kept(both, Filters.of(channels=[C.ONLINE, C.DOOR])), AS_OF, "1", datetime(2024, 1, 1)
    )
    listed = prices.groupBy("entry_id").agg(
        F.count(F.lit(1)).alias("n_prices"), (F.sum("price") * 1_000_000).cast("long").alias("micros")
    )
    per_show = entries.join(listed, "entry_id", "left").groupBy("event_name").agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.sum("n_prices").alias("n_prices"),
        F.sum("micros").alias("price_micros"),
    )
    return door.door_totals(entries).join(per_show, "event_name", "left")


def _import_positions(spark: SparkSession, directory: str) -> DataFrame:
    """Positions of the door prices of each show after a consolidated file was written and read in pieces."""
    path = scratch(spark, "consolidated")
    both = _both(spark, directory, f"{_SCOPE} deal_price")
    csv.export_consolidated(both, Filters.of(channels=[C.ONLINE, C.DOOR]), path)
    online, entries, prices = csv.import_consolidated(spark, path, AS_OF, "1", datetime(2024, 1, 1))
    placed = prices.join(entries.select("entry_id", "event_name"), "entry_id")
    per_show = placed.groupBy("event_name").agg(
        F.count(F.lit(1)).alias("prices"),
        F.min("position").alias("first_position"),
        F.max("position").alias("last_position"),
        F.count_distinct("position").alias("positions"),
    )
    sold = online.rows.groupBy("event_name").agg(F.count(F.lit(1)).alias("online_tickets"))
    return per_show.join(sold, "event_name", "left")


_PAGE = 5000


def _pulled_pages(spark: SparkSession, directory: str) -> DataFrame:
    """Every ticket on a page file of some 5,000, pulled along the cursors into a store and summed per show."""
    configure(spark)
    with shuffles_dropped(spark):
        store = _pulled(spark, directory)
    return _per_show(store.tickets("1", AS_OF))


def _pulled(spark: SparkSession, directory: str) -> TicketStore:
    """The store after the pull.

    There are at least 40 pages; their number grows with the tickets, their size does not.
    """
    columns = [*_SCOPE.split(), "ticket_id", "ordered_at", "deal_price", "contact_newsletter_optin"]
    tickets = tables.tickets(spark, directory, *columns)
    n_pages = max(40, -(-tickets.count() // _PAGE))
    raw = pages.to_raw_json(tickets)
    page = F.floor(F.pmod(F.xxhash64("ticket_id"), F.lit(n_pages))).alias("page")
    cursor = F.when(F.col("page") > 0, F.concat(F.lit("c"), "page")).alias("cursor")
    following = F.when(F.col("page") < n_pages - 1, F.concat(F.lit("https://x.example/?after=c"), F.col("page") + 1))
    landed = raw.groupBy(page).agg(F.collect_list("raw").alias("data")).select(
        cursor,
        F.concat(F.lit("["), F.array_join("data", ","), F.lit("]")).alias("data"),
        following.alias("next"),
    )
    path = scratch(spark, "landing")
    shown = F.concat(
        F.lit('{"cursor": '),
        F.coalesce(F.concat(F.lit('"'), "cursor", F.lit('"')), F.lit("null")),
        F.lit(', "data": '),
        "data",
        F.lit(', "pagination": {"next": '),
        F.coalesce(F.concat(F.lit('"'), "next", F.lit('"')), F.lit("null")),
        F.lit("}}"),
    )
    landed.select(shown.alias("value")).write.option("maxRecordsPerFile", 1).text(path, compression="gzip")
    store = TicketStore(spark, scratch(spark, "tickets"), buckets=8).create()
    # The pages that were parsed are written already, so their tickets are not written once more.
    store.ingest("1", pages.pull(spark, path), datetime(2024, 1, 1))
    return store


def _statement_files(spark: SparkSession, directory: str) -> DataFrame:
    """The statements' rows written as files of a thousand statements each, and read from them."""
    path = scratch(spark, "statements")
    event = F.col("file").cast("long").alias("event")
    lines = _statements(spark, directory).select(event, F.posexplode(F.split("text", "\n")).alias("n", "value"))
    head = C.STATEMENT_PREAMBLE_LINES + 2  # an empty line and the header follow the preamble
    file_no = F.floor(F.col("event") / 1000).alias("file_no")
    rows = lines.filter((F.col("n") >= head) & (F.col("value") != "")).select(file_no, "event", "n", "value")
    above = [f"preamble {i}" for i in range(C.STATEMENT_PREAMBLE_LINES)] + ["", " Data , Tipo ,Entradas,Saldo"]
    heads = rows.select("file_no", F.lit(-1).cast("long").alias("event")).distinct().select(
        "file_no", "event", F.posexplode(F.array(*map(F.lit, above))).alias("n", "value")
    )
    placed = rows.unionByName(heads).repartition("file_no").sortWithinPartitions("file_no", "event", "n")
    placed.select("value", "file_no").write.partitionBy("file_no").text(path)
    sold = statement.sales(spark, path)
    return sold.groupBy("sale_date").agg(
        F.count(F.lit(1)).alias("tickets"), (F.sum("amount") * 100).cast("long").alias("cents")
    )


def _both(spark: SparkSession, directory: str, columns: str) -> Tickets:
    """Online tickets and door rows; the show dates of the door rows need every ticket."""
    online = load(spark, directory, columns)
    starts = load(spark, directory, "event_name event_start_time")
    return door.all_channels(online, door.door_rows(tables.ledger(spark, directory), starts, AS_OF))


def _dataset_counts(spark: SparkSession, directory: str) -> DataFrame:
    return universe.dataset_counts(_both(spark, directory, _SCOPE))


def _all_channels(spark: SparkSession, directory: str) -> DataFrame:
    both = _both(spark, directory, f"{_SCOPE} deal_price")
    brl = F.round(F.coalesce(F.sum("deal_price_brl"), F.lit(0)), 2).cast("double")
    return (
        kept(both, BOTH)
        .groupBy("source", "event_name")
        .agg(F.count(F.lit(1)).alias("tickets"), brl.alias("revenue"))
    )


def _door_rows(spark: SparkSession, directory: str) -> DataFrame:
    starts = load(spark, directory, "event_name event_start_time")
    rows = door.door_rows(tables.ledger(spark, directory), starts, AS_OF)
    price = F.round(F.col("door_price"), 6).cast("double")
    return rows.select("entry_id", "event_name", "order_date", price.alias("price"))


def _comparison(spark: SparkSession, directory: str) -> DataFrame:
    online = load(spark, directory, f"{_SCOPE} deal_price")
    return door.channel_comparison(online, tables.ledger(spark, directory), BOTH)


def _grand_totals(spark: SparkSession, directory: str) -> DataFrame:
    online = load(spark, directory, f"{_SCOPE} deal_price")
    return door.channel_grand_totals(online, tables.ledger(spark, directory), BOTH)


def _door_totals(spark: SparkSession, directory: str) -> DataFrame:
    configure(spark)
    return door.door_totals(tables.ledger(spark, directory), BOTH)


def queries() -> dict[str, Query]:
    """Name to query; every query reads whole tables and returns a lazy DataFrame."""
    curve = "ordered_at event_start_time"
    buyer = "contact_id ordered_at ticket_id"
    return {
        # Sources and channels.
        "tenant_tickets": _tenant_tickets,
        "ingest_pages": _ingest_pages,
        "to_raw_json": _to_raw_json,
        "page_chain_gaps": _page_chain_gaps,
        "page_chain_walk": _page_chain_walk,
        "page_chain_audit": _page_chain_audit,
        "incremental_new_tickets": _incremental,
        "upsert_tickets": _upsert,
        "refreshed_tickets": _refreshed_tickets,
        "ticket_lookup": _ticket_lookup,
        "clear_tenant": _clear_tenant,
        "stored_fields": _stored_fields,
        "rollup_by_show": _rollup_by_show,
        "rollup_buyers": _rollup_buyers,
        "statement_sales": _statement_sales,
        "statement_totals": _statement_totals,
        "statement_by_date": _statement_by_date,
        "assign_statement_dates": _assign_statement_dates,
        "load_csv": _load_csv,
        "export_consolidated": _export,
        "clear_ledger": _clear_ledger,
        "ledger": _ledger,
        "append_ledger": _append_ledger,
        "replayed_ledger": _replayed_ledger,
        "import_consolidated": _import_consolidated,
        "import_positions": _import_positions,
        "pulled_pages": _pulled_pages,
        "statement_files": _statement_files,
        "dataset_counts": _dataset_counts,
        # Row-level normalisation.
        "norm_timestamps": _normalised(
            "ticket_id ordered_at event_start_time ticket_scanned_at",
            lambda rows: rows.select(
                "ticket_id", *_naive("ordered_at", "event_start_time", "ticket_scanned_at")
            ),
        ),
        "norm_age": _normalised(
            "contact_id contact_birthday",
            lambda rows: rows.filter(F.col("contact_id").isNotNull())
            .select("contact_id", "age")
            .distinct(),
        ),
        "norm_money": _normalised("ticket_id deal_price", _columns("ticket_id deal_price_cents")),
        "norm_utm_source": _normalised("ticket_id utm_source", _columns("ticket_id utm_source")),
        "norm_utm_medium": _normalised("ticket_id utm_medium", _columns("ticket_id utm_medium")),
        "norm_optin": _normalised(
            "ticket_id contact_newsletter_optin",
            lambda rows: rows.select("ticket_id", F.col("contact_newsletter_optin").alias("optin")),
        ),
        "norm_days_before": _normalised(
            "ticket_id ordered_at event_start_time",
            lambda rows: rows.select(
                "ticket_id", F.round("days_before_event", 6).alias("days_before")
            ),
        ),
        "norm_order_parts": _normalised(
            "ticket_id ordered_at", _columns("ticket_id order_date order_hour order_dow")
        ),
        # Filter scopes and what there is to filter on.
        "filter_dff": _scope_ids(kept),
        "filter_df_sel": _scope_ids(selected),
        "filter_online": _scope_ids(kept_online),
        "data_summary": _metric(lambda t, f: universe.summary(t), ALL, "ordered_at"),
        "show_catalogue": _metric(lambda t, f: universe.show_catalogue(t), ALL, "event_id"),
        # Headline indicators.
        "kpis": _headline(ALL),
        "kpis_dated": _headline(DATED),
        # Sales.
        "sales_daily": _metric(sales.daily, ONE, "ordered_at"),
        "sales_daily_until": _metric(sales.daily_by_axis, Y98, curve),
        "sales_daily_since_first": _metric(
            lambda t, f: sales.daily_by_axis(t, f, axis="since_first"), Y98, curve
        ),
        "sales_axis": _sales_axis,
        "sales_cumulative": _metric(sales.cumulative, Y98, curve),
        "sales_by_weekday": _metric(sales.by_weekday, ALL, "ordered_at"),
        "sales_lead_time": _metric(sales.lead_time, ALL, curve),
        "sales_heatmap": _metric(sales.heatmap, ALL, "ordered_at"),
        "sales_heatmap_dense": _metric(sales.heatmap_dense, ALL, "ordered_at"),
        "sales_heatmap_scale": _metric(sales.heatmap_scale, ALL, "ordered_at"),
        "show_summary": _metric(
            sales.show_summary,
            ALL,
            f"ticket_id {curve} ticket_scanned_at deal_price",
            post=_rounded("attendance_pct", "cancel_pct"),
        ),
        # Shows side by side.
        "compare_show_kpis": _metric(
            compare.show_kpis,
            Y98,
            "deal_price ticket_scanned_at",
            post=_rounded("paid_pct", "attendance_pct"),
        ),
        "compare_ref_vs_avg": _metric(
            compare.ref_vs_avg,
            Y98,
            "deal_price ticket_scanned_at",
            post=_rounded("ref", "avg_others", "delta"),
        ),
        "compare_leave_one_out": _metric(
            compare.leave_one_out,
            Y98,
            "deal_price ticket_scanned_at",
            post=_rounded("value", "avg_others"),
        ),
        "compare_revenue": _metric(compare.revenue, Y98, "deal_price"),
        "compare_tickets": _metric(compare.tickets_sold, Y98, "ticket_id"),
        "compare_loyalty": _metric(compare.loyalty, Y98, "contact_id"),
        "compare_paid_free": _metric(compare.paid_free, Y98, "deal_price"),
        "evolution_tickets": _metric(
            compare.evolution, Y98, curve, post=_columns("role event_name dia tickets")
        ),
        "evolution_tickets_cum": _metric(
            compare.evolution, Y98, curve, post=_columns("role event_name dia cum_tickets")
        ),
        "evolution_revenue": _metric(
            compare.evolution,
            Y98,
            f"{curve} deal_price",
            post=_columns("role event_name dia revenue_cents"),
        ),
        "evolution_revenue_cum": _metric(
            compare.evolution,
            Y98,
            f"{curve} deal_price",
            post=_columns("role event_name dia cum_revenue_cents"),
        ),
        "evolution_avg_others": _metric(
            compare.evolution_avg_others,
            Y98,
            f"{curve} deal_price",
            post=_rounded(
                "avg_tickets", "avg_cum_tickets", "avg_revenue_cents", "avg_cum_revenue_cents"
            ),
        ),
        # Revenue.
        "revenue_by_show": _metric(revenue.by_show, Y98, "deal_price"),
        "revenue_by_category": _metric(revenue.by_category, ALL, "ticket_id deal_price deal_title"),
        "revenue_by_payment": _metric(
            revenue.by_payment, ALL, "ticket_id deal_price payment_method"
        ),
        "free_ticket_types": _metric(revenue.free_ticket_types, ALL, "deal_price deal_title"),
        "paid_vs_free": _metric(revenue.paid_vs_free, ALL, "deal_price"),
        "revenue_daily": _metric(revenue.daily, ONE, "ordered_at deal_price"),
        # Marketing.
        "channel_tickets": _metric(marketing.by_channel, ALL, "utm_source"),
        "channel_by_medium": _metric(marketing.channel_by_medium, ALL, "utm_source utm_medium"),
        "channel_by_medium_filled": _metric(
            marketing.channel_by_medium, ALL, "utm_source utm_medium", media=_MEDIA
        ),
        "channel_by_show_filled": _metric(
            marketing.channel_by_show, Y98, "utm_source", channels=_CHANNELS
        ),
        "category_mix_filled": _metric(
            operations.category_mix, Y98, "deal_price deal_title", categories=_CATEGORIES
        ),
        "channel_by_show": _metric(marketing.channel_by_show, Y98, "utm_source"),
        # Audience.
        "unique_buyers": _metric(
            lambda t, f: audience.unique_buyers(t, f, "ticket_id"), ALL, buyer
        ),
        "audience_gender": _metric(audience.gender, ALL, f"{buyer} contact_gender"),
        "audience_age": _metric(audience.age, ALL, f"{buyer} contact_birthday"),
        "audience_top_cities": _metric(audience.top_cities, ALL, f"{buyer} contact_locality"),
        "audience_optin": _metric(audience.optin, ALL, f"{buyer} contact_newsletter_optin"),
        "audience_recurrence": _metric(audience.recurrence, ALL, "contact_id event_id"),
        "audience_top_loyal": _metric(audience.top_loyal, ALL, f"{buyer} event_id contact_name"),
        "audience_age_gender": _metric(
            audience.age_by_gender, ALL, f"{buyer} contact_birthday contact_gender"
        ),
        # Operations.
        "attendance_by_show": _metric(
            operations.attendance_by_show, ALL, "ticket_id deal_price ticket_scanned_at"
        ),
        "cancellation_by_show": _metric(
            operations.cancellation_by_show, ALL, "ticket_id", post=_rounded("cancel_pct")
        ),
        "status_distribution": _metric(operations.status_distribution, ALL, ""),
        "category_mix": _metric(operations.category_mix, Y98, "deal_price deal_title"),
        # Door against online.
        "door_rows": _door_rows,
        "all_channels": _all_channels,
        "door_totals": _door_totals,
        "online_totals": _metric(door.online_totals, BOTH, "deal_price"),
        "channel_comparison": _comparison,
        "channel_grand_totals": _grand_totals,
        "channel_revenue_long": lambda spark, d: door.channel_revenue_long(_comparison(spark, d)),
        "channel_tickets_long": lambda spark, d: door.channel_tickets_long(_comparison(spark, d)),
    }
