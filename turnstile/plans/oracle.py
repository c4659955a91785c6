"""Equivalent SQL for each registered query, written against the tables themselves."""

from __future__ import annotations

_RAW = """
raw as (
  select
    concat_ws('-', cast(l_orderkey as varchar), cast(l_linenumber as varchar),
              cast(l_partkey as varchar), cast(l_suppkey as varchar),
              cast(cast(round(l_extendedprice * 100) as bigint) as varchar)) as ticket_id,
    cast(r_regionkey % 3 as int) as tenant_id,
    cast((year(o_orderdate) * 4 + quarter(o_orderdate) - 1) * 10 + r_regionkey as bigint) as event_id,
    concat(r_name, ' ', cast(year(o_orderdate) as varchar), 'Q',
           cast(quarter(o_orderdate) as varchar)) as event_name,
    case when l_returnflag = 'R' then 'canceled'
         when l_returnflag = 'N' and l_linestatus = 'F' then 'pending'
         when l_linenumber = 7 and l_quantity = 49 then null
         else 'valid' end as ticket_status,
    case when l_linenumber = 6 and l_quantity = 48 then null
         else o_orderdate + interval '1' minute * cast((o_orderkey * 37) % 1440 as int)
    end as ordered_at,
    cast(date_trunc('quarter', o_orderdate) as timestamp)
      + interval '3' month - interval '2' hour as event_start_time,
    case when l_linestatus = 'F' and l_returnflag <> 'R' then
      cast(date_trunc('quarter', o_orderdate) as timestamp) + interval '3' month
      - interval '2' hour + interval '1' minute * cast(l_linenumber * 10 as int)
    end as ticket_scanned_at,
    case when l_discount = 0 then 0
         when l_linenumber = 7 and l_quantity = 50 then null
         else cast(round(l_extendedprice * 100) as bigint) end as deal_price,
    p_type as deal_title,
    case o_orderpriority when '4-NOT SPECIFIED' then null when '5-LOW' then ''
         else lower(substr(o_orderpriority, 3)) end as payment_method,
    case cast(l_partkey % 8 as int)
         when 0 then null when 1 then '' when 2 then 'direct' when 3 then ' Instagram.COM '
         when 4 then 'facebook.com' when 5 then 'instagram' when 6 then lower(p_type)
         else 'App' end as utm_source,
    case cast(l_linenumber % 3 as int) when 0 then 'app' when 1 then 'web' end as utm_medium,
    case when c_custkey % 50 = 49 then null else c_custkey end as contact_id,
    case when c_custkey % 10 = 9 then null else c_name end as contact_name,
    case cast(c_custkey % 5 as int) when 0 then 'female' when 1 then 'male'
         when 2 then 'other' when 3 then '-' end as contact_gender,
    case cast(c_custkey % 11 as int) when 0 then '-' when 1 then '' when 2 then '01008-000'
         else n2.n_name end as contact_locality,
    case when c_custkey % 13 = 0 then null
         else date '1930-01-01' + cast((c_custkey * 389) % 25000 as int) end as contact_birthday,
    case cast(c_custkey % 4 as int) when 0 then 'True' when 1 then 'False' when 2 then 'True'
    end as contact_newsletter_optin
  from lineitem
  join orders on l_orderkey = o_orderkey
  join part on l_partkey = p_partkey
  join supplier on l_suppkey = s_suppkey
  join nation n1 on s_nationkey = n1.n_nationkey
  join region on n1.n_regionkey = r_regionkey
  join customer on o_custkey = c_custkey
  join nation n2 on c_nationkey = n2.n_nationkey
)"""

_TICKETS = """
cleaned as (
  select * replace (
    regexp_replace(
      regexp_replace(lower(coalesce(utm_source, 'direto')), '^\\s+|\\s+$', '', 'g'),
      '\\.com$', '') as utm_source,
    coalesce(utm_medium, 'desconhecido') as utm_medium,
    case contact_newsletter_optin when 'True' then true when 'False' then false end
      as contact_newsletter_optin)
  from raw
),
tickets as (
  select * replace (
    case when utm_source in ('', 'direct') then 'direto' else utm_source end as utm_source),
    cast(round(date_diff('day', contact_birthday, date '2001-08-01') / 365.25) as int) as age,
    cast(ordered_at as date) as order_date,
    cast(extract(hour from ordered_at) as int) as order_hour,
    dayname(ordered_at) as order_dow,
    cast(isodow(ordered_at) - 1 as int) as weekday_no,
    (epoch_us(event_start_time) - epoch_us(ordered_at)) / 86400000000e0 as days_before
  from cleaned
),
live as (select * from tickets where ticket_status is distinct from 'canceled'),
y98 as (select * from tickets where event_name like '% 1998Q_'),
live98 as (select * from live where event_name like '% 1998Q_')"""

_LEDGER = """
entries as (
  select event_id as entry_id,
    concat(r_name, ' ', cast(1995 + cast(user_id % 6 as int) as varchar), 'Q',
           cast(1 + cast(event_id % 4 as int) as varchar)) as event_name,
    1 + cast(event_id % 5 as int) as tickets,
    cast(round(value * 100) as bigint) as revenue_cents,
    case when event_id % 7 = 0 then cast(ts as date) end as entry_date
  from events join region on r_regionkey = cast(user_id % 5 as int)
  where event_type = 'purchase'
),
entries98 as (select * from entries where event_name like '% 1998Q_'),
starts as (
  select event_name, cast(min(event_start_time) as date) as show_date from tickets group by all
),
door as (
  select entry_id, e.event_name,
    coalesce(entry_date, show_date, date '2001-08-01') as order_date,
    cast(round(revenue_cents * 10000e0 / tickets) as bigint)
      + case when seat = 0 and entry_id % 2 <> 0
        then revenue_cents * 10000 - tickets * cast(round(revenue_cents * 10000e0 / tickets) as bigint)
        else 0 end as micros
  from (select *, unnest(range(tickets)) as seat from entries) e
  left join starts s on e.event_name = s.event_name
)"""

_STATEMENT = """
with lines as (
  select cast(event_id as varchar) as file, 11 as line_no, cast(ts as date) as sale_date,
    round(value, 2) as amount from events where round(value, 2) > 0
  union all
  select cast(event_id as varchar), 12, cast(ts + interval 1 day as date),
    cast(event_id % 100 as double) from events where event_id % 100 > 0
)
"""

_COMPARISON = """
online_side as (
  select event_name, count(*) as n, coalesce(sum(deal_price), 0) as cents
  from live98 group by event_name
),
door_side as (
  select event_name, sum(tickets) as n, sum(revenue_cents) as cents
  from entries98 group by event_name
),
comparison as (
  select coalesce(o.event_name, d.event_name) as event_name,
    cast(coalesce(o.n, 0) as bigint) as online_tickets,
    cast(coalesce(o.cents, 0) as bigint) as online_cents,
    cast(coalesce(d.n, 0) as bigint) as door_tickets,
    cast(coalesce(d.cents, 0) as bigint) as door_cents
  from online_side o full outer join door_side d on o.event_name = d.event_name
)"""

_BUYERS = """
ranked as (
  select *, row_number() over (
    partition by contact_id order by ordered_at nulls last, ticket_id) as rn
  from live
),
buyers as (select * from ranked where rn = 1)"""

_CURVE = """
starts98 as (
  select event_name, cast(min(event_start_time) as date) as show_date from live98 group by all
),
per_day as (
  select event_name, order_date, count(*) as tickets, coalesce(sum(deal_price), 0) as cents
  from live98 where order_date is not null group by all
),
curve as (
  select d.event_name, d.order_date, d.tickets,
    cast(d.cents as bigint) as revenue_cents,
    cast(sum(d.tickets) over so_far as bigint) as cum_tickets,
    cast(sum(d.cents) over so_far as bigint) as cum_revenue_cents,
    cast(date_diff('day', d.order_date, s.show_date) as int) as days_until,
    cast(date_diff('day', min(d.order_date) over (partition by d.event_name), d.order_date) as int)
      as days_since_first,
    case when d.event_name = 'AFRICA 1998Q1' then 'ref' else 'other' end as role
  from per_day d join starts98 s on d.event_name = s.event_name
  window so_far as (partition by d.event_name order by d.order_date
                    rows between unbounded preceding and current row)
)"""

_SHOW_KPIS = """
show_kpis as (
  select event_name, count(*) as tickets,
    cast(coalesce(sum(deal_price), 0) as bigint) as revenue_cents,
    100e0 * count(*) filter (deal_price > 0) / count(*) as paid_pct,
    100e0 * count(ticket_scanned_at) / count(*) as attendance_pct
  from live98 group by event_name
),
long_kpis as (
  select event_name, 'tickets' as metric, cast(tickets as double) as value from show_kpis
  union all select event_name, 'revenue_cents', cast(revenue_cents as double) from show_kpis
  union all select event_name, 'paid_pct', paid_pct from show_kpis
  union all select event_name, 'attendance_pct', attendance_pct from show_kpis
)"""

_WEEK = "(values (0,'Seg'),(1,'Ter'),(2,'Qua'),(3,'Qui'),(4,'Sex'),(5,'Sáb'),(6,'Dom'))"
_AGES = "(select cast(unnest(range(16, 81)) as bigint) as age)"


# Pages of every user's events, landed ones with the page that they announce, and the walk.
_USER_CHAINS = """
with recursive seqs as (
  select user_id, event_id, row_number() over (partition by user_id order by event_id) as seq from events
),
landed as (
  select cast(user_id as varchar) as feed, event_id,
    case when seq > 1 then concat('c', seq) else '' end as spot,
    case when event_id % 89 <> 7 then
      case when event_id % 101 = 11 then concat('c', greatest(2, seq - 3)) else concat('c', seq + 1) end
    end as following
  from seqs where event_id % 97 <> 5
),
walked as (
  select feed, spot, 0::bigint as arrival from landed where spot = ''
  union all
  select w.feed, n.spot, w.arrival + 1 from walked w
  join landed l on l.feed = w.feed and l.spot = w.spot
  join landed n on n.feed = w.feed and n.spot = l.following
  where w.arrival < 100
)"""


def _with(body: str, *more: str) -> str:
    return "with " + ",".join([_RAW, _TICKETS, *more]).strip() + "\n" + body.strip()


def _kpis(kept: str, selection: str) -> str:
    return _with(f"""
select (select count(*) from kept) as tickets,
  (select count(distinct contact_id) from kept) as buyers,
  cast((select coalesce(sum(deal_price), 0) from kept) as bigint) as revenue_cents,
  round((select coalesce(100e0 * count(ticket_scanned_at) / nullif(count(*), 0), 0) from kept), 4)
    as attendance_pct,
  case when (select count(*) from kept) = 0 then 0e0 else
    round((select coalesce(100e0 * count(*) filter (ticket_status = 'canceled')
                           / nullif(count(*), 0), 0) from {selection}), 4) end as cancel_pct,
  round((select coalesce(100e0 * count(*) filter (contact_newsletter_optin)
                         / nullif(count(contact_newsletter_optin), 0), 0) from kept), 4) as optin_pct
""", f"\nkept as ({kept})")


_DATED = "order_date between date '1998-02-01' and date '1998-11-30'"


def oracle_sql() -> dict[str, str]:
    sold = "select {0}, count(*) as tickets from {1} group by all"
    return {
        "tenant_tickets": _with(
            "select event_name, count(*) as tickets from raw where tenant_id = 1 group by all"
        ),
        "incremental_new_tickets": _with("""
select
  (select count(distinct ticket_id) from raw b
   where ordered_at >= timestamp '1998-07-01' and not exists (
     select 1 from raw s where s.ticket_id = b.ticket_id
     and (s.ordered_at < timestamp '1999-01-01' or s.ordered_at is null))) as n_new,
  (select count(*) from raw
   where ordered_at < timestamp '1999-01-01' or ordered_at is null) as n_existing
"""),
        "ingest_pages": _with("""
select event_name, count(ticket_id) as tickets, cast(sum(deal_price) as bigint) as revenue_cents,
  count(*) filter (contact_newsletter_optin) as optins, min(order_date) as first_order
from live group by event_name
"""),
        "to_raw_json": _with("""
select ticket_id, strftime(ordered_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' as ordered_at,
  cast(deal_price as varchar) as deal_price, utm_source,
  cast(contact_birthday as varchar) as contact_birthday
from raw
"""),
        "page_chain_gaps": """
with landed as (
  select concat(l_orderkey, '-', l_linenumber) as cursor, count(*) as n from lineitem group by all
),
announced as (
  select distinct concat(l_orderkey, '-', l_linenumber + 1) as cursor from lineitem
)
select cursor, 'missing' as problem from announced a
where not exists (select 1 from landed l where l.cursor = a.cursor)
union all
select cursor, 'repeated' from landed where n > 1
""",
        "page_chain_walk": _USER_CHAINS + """
select feed, event_id, min(arrival) as arrival
from walked join landed using (feed, spot) group by feed, event_id
""",
        "page_chain_audit": _USER_CHAINS + """,
ranks as (select feed, spot, min(arrival) as arrival from walked group by all),
announced as (
  select l.feed, l.following as spot, max(r.arrival) as last_announcer
  from landed l left join ranks r on r.feed = l.feed and r.spot = l.spot
  where l.following is not null group by l.feed, l.following
),
known as (
  select coalesce(l.feed, a.feed) as feed, coalesce(l.spot, a.spot) as spot, l.feed is not null as landed,
    a.feed is not null as told, r.arrival, a.last_announcer
  from landed l full join announced a on l.feed = a.feed and l.spot = a.spot
  left join ranks r on r.feed = l.feed and r.spot = l.spot
),
found as (
  select feed, 'missing' as problem from known where not landed
  union all select feed, 'unannounced' from known where landed and spot <> '' and not told
  union all select feed, 'unreached' from known where landed and spot <> '' and told and arrival is null
  union all select feed, 'cycle' from known where arrival is not null and last_announcer >= arrival
)
select feed, problem, count(*) as cursors from found group by all
""",
        "upsert_tickets": _with("""
select distinct ticket_id from raw b
where ordered_at >= timestamp '1998-07-01' and not exists (
  select 1 from raw s where s.ticket_id = b.ticket_id
  and (s.ordered_at < timestamp '1999-01-01' or s.ordered_at is null))
"""),
        "statement_sales": _STATEMENT + "select file, line_no, sale_date, amount from lines",
        "statement_totals": _STATEMENT + """
select file, count(*) as tickets,
  cast(sum(cast(amount as decimal(18, 2))) as double) as revenue,
  cast(count(*) as int) as n_prices, arg_min(amount, line_no) as first_price
from lines group by file
""",
        "statement_by_date": _STATEMENT + """
select file, sale_date, count(*) as tickets,
  cast(sum(cast(amount as decimal(18, 2))) as double) as revenue,
  cast(count(*) as int) as n_prices, arg_min(amount, line_no) as first_price
from lines group by file, sale_date
""",
        "assign_statement_dates": _STATEMENT + """
select concat('show ', isodow(sale_date) - 1) as event_name, count(*) as tickets,
  cast(sum(cast(amount as decimal(18, 2))) * 100 as bigint) as revenue_cents
from lines where isodow(sale_date) <> 7 group by all
""",
        "ledger": "with " + _RAW.strip() + "," + _TICKETS + "," + _LEDGER + """
select event_name, tickets, revenue_cents, entry_date,
  case when entry_id % 3 = 0 then 'pagbank_csv' else 'manual' end as source,
  cast(case when entry_id % 2 = 0 then tickets when entry_id % 9 = 0 then 1 else 0 end as int)
    as n_prices
from entries
""",
        "load_csv": _with("""
select event_name, count(ticket_id) as tickets, cast(sum(deal_price) as bigint) as revenue_cents,
  count(*) filter (contact_newsletter_optin) as optins, min(order_date) as first_order
from live group by event_name
"""),
        "export_consolidated": _with("""
select 'Shotgun' as source, event_name, count(*) as tickets,
  cast(coalesce(sum(deal_price), 0) * 10000 as bigint) as price_micros
from live group by event_name
union all
select 'Porta', event_name, count(*), cast(sum(micros) as bigint) from door group by event_name
""", _LEDGER),
        "clear_ledger": """
select '1' as tenant_id, cast(0 as bigint) as entries union all
select '2', count(*) from events join region on r_regionkey = cast(user_id % 5 as int)
where event_type = 'purchase' and event_id % 2 = 1
""",
        "replayed_ledger": "with " + _RAW.strip() + "," + _TICKETS + "," + _LEDGER + """
select event_name, cast(sum(case when entry_id % 2 = 0 then 3 else 1 end) as bigint) as entries
from entries group by event_name
""",
        "refreshed_tickets": _with("""
select event_name, case when ordered_at >= timestamp '1998-01-01' then 'refunded' else ticket_status end
  as ticket_status, count(*) as tickets, cast(sum(deal_price) as bigint) as cents
from (select distinct on (ticket_id) * from raw where ordered_at is not null) group by all
"""),
        "ticket_lookup": _with("""
select distinct ticket_id,
  case when ordered_at >= timestamp '1998-01-01' then 'refunded' else ticket_status end as ticket_status
from raw where ordered_at is not null and ticket_id like '%-7-%'
"""),
        "rollup_by_show": _with("""
select event_name, count(*) filter (ticket_status is distinct from 'canceled') as tickets,
  cast(coalesce(sum(deal_price) filter (ticket_status is distinct from 'canceled'), 0) as bigint) as revenue_cents,
  count(ticket_id) as total, count(*) filter (ticket_status = 'canceled') as canceled
from tickets where event_name like '% 1998Q_'
  and order_date between date '1998-02-01' and date '1998-11-30'
group by event_name
"""),
        "stored_fields": """
select l_returnflag as mode, cast(l_linenumber * 2 as bigint) as line, count(*) as tickets,
  cast(sum(l_quantity) as double) as seats, cast(0 as bigint) as nothing
from (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag from lineitem)
group by all
""",
        "clear_tenant": _with("""
select '1' as tenant_id, cast(0 as bigint) as tickets union all
select '2', count(distinct ticket_id) from raw where tenant_id = 2
"""),
        "append_ledger": """
select source, source in ('manual', 'pagbank_csv') and event_name is not null as accepted,
  count(*) as entries
from (
  select case event_type when 'purchase' then 'manual' when 'view' then 'pagbank_csv'
         else event_type end as source,
    case when user_id % 10 <> 0 then user_id % 7 end as event_name
  from events)
group by all
""",
        "import_consolidated": _with("""
select event_name, count(*) as tickets,
  cast((sum(micros) + 5000) // 10000 as bigint) as revenue_cents,
  cast(1 as bigint) as n_entries, count(*) as n_prices, cast(sum(micros) as bigint) as price_micros
from door group by event_name
""", _LEDGER),
        "import_positions": _with("""
select d.event_name, count(*) as prices, cast(0 as bigint) as first_position,
  count(*) - 1 as last_position, count(*) as positions, any_value(o.n) as online_tickets
from door d left join (select event_name, count(*) as n from live group by all) o
  on o.event_name = d.event_name
group by d.event_name
""", _LEDGER),
        "pulled_pages": _with("""
select event_name, count(ticket_id) as tickets, cast(sum(deal_price) as bigint) as revenue_cents,
  count(*) filter (contact_newsletter_optin) as optins, min(order_date) as first_order
from live group by event_name
"""),
        "statement_files": _STATEMENT + """
select sale_date, count(*) as tickets, cast(sum(cast(amount as decimal(18, 2))) * 100 as bigint) as cents
from lines group by sale_date
""",
        "dataset_counts": _with("""
select 'Shotgun' as source, count(*) as n_rows from tickets
union all select 'Porta', count(*) from door
""", _LEDGER),
        "norm_timestamps": _with(
            "select ticket_id, ordered_at, event_start_time, ticket_scanned_at from raw"
        ),
        "norm_age": _with(
            "select distinct contact_id, age from tickets where contact_id is not null"
        ),
        "norm_money": _with("select ticket_id, deal_price as deal_price_cents from raw"),
        "norm_utm_source": _with("select ticket_id, utm_source from tickets"),
        "norm_utm_medium": _with("select ticket_id, utm_medium from tickets"),
        "norm_optin": _with("select ticket_id, contact_newsletter_optin as optin from tickets"),
        "norm_days_before": _with(
            "select ticket_id, round(days_before, 6) as days_before from tickets"
        ),
        "norm_order_parts": _with(
            "select ticket_id, order_date, order_hour, order_dow from tickets"
        ),
        "filter_dff": _with(f"select ticket_id from live98 where {_DATED}"),
        "filter_df_sel": _with("select ticket_id from y98"),
        "filter_online": _with(f"select ticket_id from live98 where {_DATED}"),
        "data_summary": _with("""
select distinct 'event' as kind, event_name as value from tickets
union all select 'channel', 'Shotgun'
union all select 'date_min', cast(min(order_date) as varchar) from tickets
union all select 'date_max', cast(max(order_date) as varchar) from tickets
"""),
        "show_catalogue": _with("select distinct event_id, event_name from tickets"),
        "kpis": _kpis("select * from live", "tickets"),
        "kpis_dated": _kpis(f"select * from live98 where {_DATED}", "y98"),
        "sales_daily": _with("""
select order_date, event_name, count(*) as tickets from live
where event_name = 'ASIA 1997Q2' and order_date is not null group by all
"""),
        "sales_daily_until": _with(
            "select event_name, order_date, days_until as x, tickets from curve", _CURVE
        ),
        "sales_daily_since_first": _with(
            "select event_name, order_date, days_since_first as x, tickets from curve", _CURVE
        ),
        "sales_axis": _with(
            "select event_name, order_date, days_until as x, tickets, 'until' as axis from curve",
            _CURVE,
        ),
        "sales_cumulative": _with("select event_name, order_date, cum_tickets from curve", _CURVE),
        "sales_by_weekday": _with(f"""
select w.no as weekday_no, w.label as weekday, count(t.ticket_id) as tickets
from {_WEEK} w(no, label) left join live t on t.weekday_no = w.no group by all
"""),
        "sales_lead_time": _with("""
select cast(trunc(least(days_before, 30)) as int) as bucket, count(*) as tickets
from live where days_before >= 0 group by all
"""),
        "sales_heatmap": _with("""
select weekday_no, order_hour as hour, count(*) as tickets
from live where order_date is not null group by all
"""),
        "sales_heatmap_dense": _with(
            "select weekday_no, "
            + ", ".join(f"count(*) filter (order_hour = {h}) as h{h}" for h in range(24))
            + " from live where order_date is not null group by weekday_no"
        ),
        "sales_heatmap_scale": _with("""
select greatest(coalesce(max(n), 0), 1) as max_tickets from (
  select count(*) as n from live where order_date is not null group by weekday_no, order_hour)
"""),
        "show_summary": _with("""
select event_name, count(ticket_id) as total,
  count(*) filter (ticket_status = 'valid') as valid,
  count(*) filter (ticket_status = 'canceled') as canceled,
  count(ticket_scanned_at) as scanned,
  cast(coalesce(sum(deal_price), 0) as bigint) as revenue_cents,
  cast(date_diff('day', min(order_date), cast(min(event_start_time) as date)) as int)
    as days_on_sale,
  round(100e0 * count(ticket_scanned_at)
        / greatest(count(*) filter (ticket_status = 'valid'), 1), 4) as attendance_pct,
  round(100e0 * count(*) filter (ticket_status = 'canceled')
        / greatest(count(ticket_id), 1), 4) as cancel_pct
from tickets group by event_name
"""),
        "compare_show_kpis": _with("""
select event_name, tickets, revenue_cents, round(paid_pct, 4) as paid_pct,
  round(attendance_pct, 4) as attendance_pct
from show_kpis
""", _SHOW_KPIS),
        "compare_ref_vs_avg": _with("""
select metric,
  round(max(value) filter (event_name = 'AFRICA 1998Q1'), 4) as ref,
  round(avg(value) filter (event_name <> 'AFRICA 1998Q1'), 4) as avg_others,
  round(max(value) filter (event_name = 'AFRICA 1998Q1')
        - avg(value) filter (event_name <> 'AFRICA 1998Q1'), 4) as delta
from long_kpis group by metric
""", _SHOW_KPIS),
        "compare_leave_one_out": _with("""
select k.event_name, k.metric, round(k.value, 4) as value,
  round((select avg(o.value) from long_kpis o
         where o.metric = k.metric and o.event_name <> k.event_name), 4) as avg_others
from long_kpis k
""", _SHOW_KPIS),
        "compare_revenue": _with("""
select event_name, cast(coalesce(sum(deal_price), 0) as bigint) as revenue_cents
from live98 group by event_name
"""),
        "compare_tickets": _with(
            "select event_name, count(ticket_id) as tickets from live98 group by event_name"
        ),
        "compare_loyalty": _with("""
select event_name,
  count(*) filter (not elsewhere) as first_time, count(*) filter (elsewhere) as returning
from (
  select event_name, contact_id, exists (
    select 1 from pairs q where q.contact_id = p.contact_id and q.event_name <> p.event_name)
    as elsewhere
  from pairs p)
group by event_name
""", """
pairs as (
  select distinct event_name, contact_id from live98 where contact_id is not null)"""),
        "compare_paid_free": _with("""
select event_name, count(*) filter (deal_price is distinct from 0) as paid,
  count(*) filter (deal_price = 0) as free
from live98 group by event_name
"""),
        "evolution_tickets": _with(
            "select role, event_name, days_until as dia, tickets from curve", _CURVE
        ),
        "evolution_tickets_cum": _with(
            "select role, event_name, days_until as dia, cum_tickets from curve", _CURVE
        ),
        "evolution_revenue": _with(
            "select role, event_name, days_until as dia, revenue_cents from curve", _CURVE
        ),
        "evolution_revenue_cum": _with(
            "select role, event_name, days_until as dia, cum_revenue_cents from curve", _CURVE
        ),
        "evolution_avg_others": _with("""
select days_until as dia, round(avg(tickets), 4) as avg_tickets,
  round(avg(cum_tickets), 4) as avg_cum_tickets,
  round(avg(revenue_cents), 4) as avg_revenue_cents,
  round(avg(cum_revenue_cents), 4) as avg_cum_revenue_cents
from curve where role = 'other' group by days_until
""", _CURVE),
        "revenue_by_show": _with("""
select event_name, cast(coalesce(sum(deal_price), 0) as bigint) as revenue_cents
from live98 group by event_name
"""),
        "revenue_by_category": _with("""
select case when deal_price > 0 then deal_title else 'Gratuito' end as category,
  count(ticket_id) as tickets, cast(coalesce(sum(deal_price), 0) as bigint) as revenue_cents
from live group by all
"""),
        "revenue_by_payment": _with("""
select coalesce(nullif(payment_method, ''), 'outro') as payment_method,
  count(ticket_id) as tickets, cast(sum(deal_price) as bigint) as revenue_cents
from live where deal_price > 0 group by all
"""),
        "free_ticket_types": _with(
            "select deal_title, count(*) as tickets from live where deal_price = 0 group by all"
        ),
        "paid_vs_free": _with("""
select case when deal_price = 0 then 'Gratuito' else 'Pago' end as ticket_type,
  count(*) as tickets from live group by all
"""),
        "revenue_daily": _with("""
select order_date, cast(coalesce(sum(deal_price), 0) as bigint) as revenue_cents from live
where event_name = 'ASIA 1997Q2' and order_date is not null group by all
"""),
        "channel_tickets": _with(sold.format("utm_source", "live")),
        "channel_by_medium": _with("""
select utm_source, utm_medium, count(*) as tickets,
  cast(sum(count(*)) over (partition by utm_source) as bigint) as channel_total
from live where utm_source is not null and utm_medium is not null group by utm_source, utm_medium
"""),
        "channel_by_medium_filled": _with("""
select c.utm_source, m.utm_medium, count(l.utm_source) as tickets,
  cast(sum(count(l.utm_source)) over (partition by c.utm_source) as bigint) as channel_total
from (select distinct utm_source from live where utm_source is not null and utm_medium is not null) c
cross join (values ('app'), ('web'), ('print')) m(utm_medium)
left join live l on l.utm_source = c.utm_source and l.utm_medium = m.utm_medium
group by c.utm_source, m.utm_medium
"""),
        "channel_by_show_filled": _with("""
select s.event_name, c.utm_source, count(l.event_name) as tickets
from (select distinct event_name from live98 where utm_source is not null) s
cross join (values ('direto'), ('instagram'), ('facebook'), ('app'), ('newsletter')) c(utm_source)
left join live98 l on l.event_name = s.event_name and l.utm_source = c.utm_source
group by s.event_name, c.utm_source
"""),
        "category_mix_filled": _with("""
select s.event_name, c.category, count(l.event_name) as tickets
from (select distinct event_name from labelled where category is not null) s
cross join (values ('Gratuito'), ('STANDARD POLISHED TIN'), ('PROMO BRUSHED COPPER'), ('no such category')) c(category)
left join labelled l on l.event_name = s.event_name and l.category = c.category
group by s.event_name, c.category
""", """
labelled as (
  select *, case when deal_price > 0 then deal_title else 'Gratuito' end as category from live98)"""),
        "channel_by_show": _with("""
select event_name, utm_source, count(*) as tickets from live98
where utm_source is not null group by event_name, utm_source
"""),
        "unique_buyers": _with("select contact_id, ticket_id from buyers", _BUYERS),
        "audience_gender": _with("""
select contact_gender as label, count(*) as buyers from buyers
where contact_gender not in ('-', '') group by all
""", _BUYERS),
        "audience_age": _with(f"""
select a.age, count(b.ticket_id) as buyers
from {_AGES} a left join buyers b on b.age = a.age group by a.age
""", _BUYERS),
        "audience_top_cities": _with("""
select contact_locality as label, count(*) as buyers from buyers
where contact_locality not in ('-', '01008-000', '')
group by all order by buyers desc, label limit 15
""", _BUYERS),
        "audience_optin": _with("""
select case when contact_newsletter_optin then 'Inscrito' else 'Não Inscrito' end as label,
  count(*) as buyers
from buyers where contact_newsletter_optin is not null group by all
""", _BUYERS),
        "audience_recurrence": _with("""
select n_shows, concat(cast(n_shows as varchar), ' evento', case when n_shows > 1 then 's' else '' end)
  as label, count(*) as buyers
from (select contact_id, count(distinct event_id) as n_shows from live
      where contact_id is not null group by contact_id)
group by all
"""),
        "audience_top_loyal": _with("""
select t.contact_id, coalesce(b.contact_name, cast(t.contact_id as varchar)) as label, t.n_shows
from (select contact_id, count(distinct event_id) as n_shows from live
      where contact_id is not null group by contact_id
      order by n_shows desc, contact_id limit 10) t
join buyers b on b.contact_id = t.contact_id
""", _BUYERS),
        "audience_age_gender": _with(f"""
select g.gender, cast(a.age as int) as age, count(b.ticket_id) as buyers
from (select distinct contact_gender as gender from buyers
      where contact_gender not in ('-', '') and age between 16 and 80) g
cross join {_AGES} a
left join buyers b on b.contact_gender = g.gender and b.age = a.age
group by g.gender, a.age
""", _BUYERS),
        "attendance_by_show": _with("""
select event_name, ticket_type, count(ticket_id) as total, count(ticket_scanned_at) as present,
  count(ticket_id) - count(ticket_scanned_at) as absent,
  cast(sum(count(ticket_id)) over (partition by event_name) as bigint) as show_total
from (select *, case when deal_price = 0 then 'Gratuito' else 'Pago' end as ticket_type from live)
group by event_name, ticket_type
"""),
        "cancellation_by_show": _with("""
select event_name, count(ticket_id) as total,
  count(*) filter (ticket_status = 'canceled') as canceled,
  round(100e0 * count(*) filter (ticket_status = 'canceled') / count(ticket_id), 4) as cancel_pct
from tickets group by event_name
"""),
        "status_distribution": _with("""
select ticket_status, count(*) as tickets from tickets
where ticket_status is not null group by all
"""),
        "category_mix": _with("""
select event_name, category, count(*) as tickets from labelled
where category is not null group by event_name, category
""", """
labelled as (
  select *, case when deal_price > 0 then deal_title else 'Gratuito' end as category from live98)"""),
        "door_rows": _with("""
select entry_id, event_name, order_date, round(micros / 1000000e0, 6) as price from door
""", _LEDGER),
        "all_channels": _with("""
select 'Shotgun' as source, event_name, count(*) as tickets,
  cast(round(cast(coalesce(sum(deal_price), 0) as decimal(38, 6)) / 100, 2) as double) as revenue
from live98 group by event_name
union all
select 'Porta', event_name, count(*),
  cast(cast((sum(micros) + 5000) // 10000 as bigint) / 100e0 as double)
from door where event_name like '% 1998Q_' group by event_name
""", _LEDGER),
        "door_totals": _with("""
select event_name, cast(sum(tickets) as bigint) as tickets,
  cast(sum(revenue_cents) as bigint) as revenue_cents
from entries98 group by event_name
""", _LEDGER),
        "online_totals": _with("""
select event_name, count(*) as tickets,
  cast(coalesce(sum(deal_price), 0) as bigint) as revenue_cents
from live98 group by event_name
"""),
        "channel_comparison": _with("select * from comparison", _LEDGER, _COMPARISON),
        "channel_grand_totals": _with("""
select 'Shotgun' as channel, cast(sum(online_tickets) as bigint) as tickets,
  cast(sum(online_cents) as bigint) as revenue_cents from comparison
union all
select 'Porta', cast(sum(door_tickets) as bigint), cast(sum(door_cents) as bigint) from comparison
""", _LEDGER, _COMPARISON),
        "channel_revenue_long": _with("""
select event_name, 'Shotgun' as channel, online_cents as value from comparison
union all select event_name, 'Porta', door_cents from comparison
""", _LEDGER, _COMPARISON),
        "channel_tickets_long": _with("""
select event_name, 'Shotgun' as channel, online_tickets as value from comparison
union all select event_name, 'Porta', door_tickets from comparison
""", _LEDGER, _COMPARISON),
    }
