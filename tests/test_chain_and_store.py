"""The page chain, the bucketed store and the replayed ledger."""

import json
import os
import random
import re
import time
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from turnstile import session
from turnstile.plans import queries
from turnstile.sources import chain, ingest, pages
from turnstile.sources.ledger import LedgerStore
from turnstile.sources.store import TicketStore

NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)
PAGE = "page_file string, cursor string, data array<string>, next_cursor string"


def _walked(df):
    return {(r.page_file, r.arrival) for r in df.select("page_file", "arrival").collect()}


def _problems(df):
    return sorted((r.cursor or "", r.problem) for r in df.collect())


def test_a_walk_leaves_out_what_no_page_leads_to(spark, folder):
    def page(name, cursor, ids, after):
        following = f"https://x.org/?after={after}" if after else None
        with open(os.path.join(folder, name), "w") as out:
            rows = [{"ticket_id": i} for i in ids]
            out.write(json.dumps({"cursor": cursor, "data": rows, "pagination": {"next": following}}))

    page("z.json", None, ["1", "2"], "b")
    page("m.json", "b", ["3"], "c")
    page("a.json", "c", [], "d")  # an empty page ends the chain
    page("k.json", "d", ["9"], None)
    page("stray.json", "q", ["8"], "d")
    read = pages.read_pages(spark, folder)
    files = {(f.rsplit("/", 1)[1], n) for f, n in _walked(chain.walk(read))}
    assert files == {("z.json", 0), ("m.json", 1), ("a.json", 2)}
    pulled = pages.pull(spark, folder).orderBy("arrival", "position").collect()
    assert [r.ticket_id for r in pulled] == ["1", "2", "3"]
    assert _problems(chain.audit(read)) == [("d", "unreached"), ("q", "unannounced")]
    store = TicketStore(spark, f"{folder}-store").create()
    assert store.ingest("t", pages.pull(spark, folder), NOW) == {"n_new": 3, "n_existing": 0}


CASES = {
    "empty": [],
    "one": [("f", None, ["1"], None)],
    "no first page": [("f", "a", ["1"], "b"), ("g", "b", ["1"], None)],
    "announces itself": [("f", None, ["1"], "a"), ("g", "a", ["1"], "a")],
    "comes round": [("f", None, ["1"], "a"), ("g", "a", ["1"], "b"), ("h", "b", ["1"], "c"), ("i", "c", ["1"], "a")],
    "landed twice": [("f", None, ["1"], "a"), ("h", "a", ["1"], "x"), ("g", "a", ["1"], "b"), ("i", "b", ["1"], None)],
    "two lead to one": [("f", None, ["1"], "b"), ("g", "a", ["1"], "b"), ("h", "b", ["1"], "")],
    "missing": [("f", None, ["1"], "a"), ("h", "b", ["1"], "c"), ("i", "c", ["1"], None)],
}


def _by_hand(rows):
    at = {}
    for file, cursor, data, following in sorted(rows, key=lambda r: r[0]):
        at.setdefault(cursor or "", (file, following if data else None))
    seen, spot, out = set(), "", set()
    while spot in at and spot not in seen:
        seen.add(spot)
        out.add((at[spot][0], len(out)))
        spot = at[spot][1] or None
    return out


@pytest.mark.parametrize("name", CASES)
def test_odd_chains_equal_walking_by_hand(spark, name):
    rows = CASES[name]
    assert _walked(chain.walk(spark.createDataFrame(rows, PAGE))) == _by_hand(rows)


def test_problems_of_odd_chains(spark):
    wanted = {
        "empty": [],
        "one": [],
        "no first page": [("a", "unannounced"), ("b", "unreached")],
        "announces itself": [("a", "cycle")],
        "comes round": [("a", "cycle")],
        "landed twice": [("a", "repeated")],
        "two lead to one": [("a", "unannounced")],
        "missing": [("a", "missing"), ("b", "unannounced"), ("c", "unreached")],
    }
    for name, rows in CASES.items():
        assert _problems(chain.audit(spark.createDataFrame(rows, PAGE))) == wanted[name], name


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, rounds = 5000, []
    inner = chain.written
    monkeypatch.setattr(chain, "written", lambda rows, name: rounds.append(name) or inner(rows, name))
    cursor = F.when(F.col("id") > 0, F.concat(F.lit("c"), "id"))
    rows = spark.range(n).select(
        F.concat(F.lit("p"), F.col("id") * 7919 % n).alias("page_file"),
        cursor.alias("cursor"),
        F.array(F.col("id").cast("string")).alias("data"),
        F.concat(F.lit("c"), F.col("id") + 1).alias("next_cursor"),
    )
    out = chain.walk(rows)
    assert out.filter("arrival = cast(data[0] as long)").count() == n
    assert rounds.count("reached") <= 15


def test_feeds_are_walked_apart(spark):
    rows = [("x", *r) for r in CASES["one"]] + [("y", *r) for r in CASES["comes round"]] + [(None, *r) for r in CASES["missing"]]
    frame = spark.createDataFrame(rows, "feed string, " + PAGE)
    found = {(r.feed, r.page_file, r.arrival) for r in chain.walk(frame).collect()}
    wanted = {(feed, *p) for feed, name in (("x", "one"), ("y", "comes round"), ("", "missing")) for p in _by_hand(CASES[name])}
    assert found == wanted


# Store --------------------------------------------------------------------------


def _records(spark, *tickets):
    rows = [(t["ticket_id"], json.dumps(t), i) for i, t in enumerate(tickets)]
    return spark.createDataFrame(rows, "ticket_id string, raw string, position int")


def _ticket(ticket_id, status="valid"):
    return {"ticket_id": ticket_id, "event_name": "a", "ticket_status": status}


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def _statuses(store):
    return {r.ticket_id: r.ticket_status for r in store.rows("t").collect()}


def test_the_later_fetch_wins_and_an_older_replay_changes_nothing(spark, folder):
    store = TicketStore(spark, f"{folder}/store", buckets=8).create()
    old, new = NOW - timedelta(days=100), NOW
    first = _records(spark, _ticket("1"), _ticket("2"), _ticket("3"))
    store.ingest("t", first, old)
    assert store.ingest("t", _records(spark, _ticket("1", "canceled")), new, refresh=True) == {"n_new": 0, "n_existing": 3}
    held = _files(f"{folder}/store/tenant_id=t")
    assert store.ingest("t", first, old, refresh=True) == {"n_new": 0, "n_existing": 3}
    assert store.ingest("t", _records(spark, _ticket("1", "stale")), NOW - timedelta(days=1), refresh=True)["n_new"] == 0
    assert _statuses(store) == {"1": "canceled", "2": "valid", "3": "valid"}
    assert _files(f"{folder}/store/tenant_id=t") == held
    twice = _records(spark, _ticket("2", "first"), _ticket("4"), _ticket("2", "last"))
    assert store.ingest("t", twice, new, refresh=True) == {"n_new": 1, "n_existing": 3}
    assert _statuses(store) == {"1": "canceled", "2": "last", "3": "valid", "4": "valid"}


def _bucket_of(store, spark, ticket_id):
    return spark.createDataFrame([(ticket_id,)], "ticket_id string").select(store._bucket()).first()[0]


def test_only_the_buckets_of_a_batch_are_read_and_rewritten(spark, folder):
    store = TicketStore(spark, f"{folder}/store", buckets=16).create()
    store.ingest("t", _records(spark, *(_ticket(str(i)) for i in range(200))), NOW - timedelta(days=1))
    before = _files(f"{folder}/store/tenant_id=t")
    bucket = _bucket_of(store, spark, "7")
    assert store.ingest("t", _records(spark, _ticket("7", "canceled")), NOW, refresh=True) == {"n_new": 0, "n_existing": 200}
    after = _files(f"{folder}/store/tenant_id=t")
    changed = {os.path.basename(os.path.dirname(f)) for f in before.keys() ^ after.keys()}
    assert changed == {f"id_bucket={bucket}"}
    assert store.rows("t").count() == 200 and _statuses(store)["7"] == "canceled"
    # What lies in other buckets is not even opened.
    for f in after:
        if f"id_bucket={bucket}/" not in f:
            with open(f, "wb") as out:
                out.write(b"not parquet")
    ids = spark.createDataFrame([("7",), (None,)], "ticket_id string")
    assert [r.ticket_status for r in store.lookup("t", ids).collect()] == ["canceled"]
    again = store.ingest("t", _records(spark, _ticket("7")), NOW)
    assert again == {"n_new": 0, "n_existing": 200}


def test_records_are_put_in_order_only_where_ids_repeat(spark, folder, monkeypatch):
    asked, inner = [], ingest.one_per_id
    monkeypatch.setattr(ingest, "one_per_id", lambda *a, **k: asked.append(1) or inner(*a, **k))
    store = TicketStore(spark, f"{folder}/store", buckets=2).create()
    old = [_ticket(str(i)) for i in range(300)]
    assert store.ingest("t", _records(spark, *old), NOW - timedelta(days=1)) == {"n_new": 300, "n_existing": 0}
    third = [_ticket(str(i), "canceled") for i in range(0, 330, 3)]
    assert store.ingest("t", _records(spark, *third), NOW, refresh=True) == {"n_new": 10, "n_existing": 300}
    assert asked == []
    wanted = {str(i): "canceled" if i % 3 == 0 else "valid" for i in range(330) if i < 300 or i % 3 == 0}
    assert store.rows("t").count() == 310 and _statuses(store) == wanted
    assert store.ingest("t", _records(spark, *third, *third), NOW + timedelta(days=1), refresh=True)["n_new"] == 0
    assert asked and store.rows("t").count() == 310


def test_a_refused_record_replaces_nothing(spark, folder):
    store = TicketStore(spark, f"{folder}/store", buckets=2).create()
    store.ingest("t", _records(spark, _ticket("1"), _ticket("2")), NOW - timedelta(days=1), refresh=True)
    broken = _ticket("1", "broken") | {"deal_price": 7.5}
    fetched = _records(spark, broken, _ticket("2", "canceled"))
    assert store.ingest("t", fetched, NOW, refresh=True) == {"n_new": 0, "n_existing": 2}
    assert _statuses(store) == {"1": "valid", "2": "canceled"}


def test_a_table_keeps_its_buckets_and_its_counts_heal(spark, folder):
    TicketStore(spark, f"{folder}/store", buckets=4).create()
    store = TicketStore(spark, f"{folder}/store", buckets=32).create()
    assert store.buckets == 4
    ids = [str(i) for i in range(40)]
    batch = _records(spark, *map(_ticket, ids))
    note, store._note = store._note, lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        store.ingest("t", batch, NOW)
    store._note = note
    assert store.ingest("t", batch, NOW) == {"n_new": 0, "n_existing": 40}
    assert sum(store._noted("t").values()) == store.rows("t").count() == 40
    store.clear("t")
    assert store.ingest("t", batch, NOW) == {"n_new": 40, "n_existing": 0}


def test_many_random_fetches_equal_a_dictionary(spark, folder):
    rng, store, held = random.Random(1), TicketStore(spark, f"{folder}/store", buckets=3).create(), {}
    for _ in range(6):
        at, refresh = NOW + timedelta(days=rng.randint(0, 5)), rng.random() < 0.6
        batch = [_ticket(str(rng.randint(0, 12)), str(rng.random())) for _ in range(8)]
        store.ingest("t", _records(spark, *batch), at, refresh=refresh)
        picked = {}
        for t in batch:
            if refresh or t["ticket_id"] not in picked:
                picked[t["ticket_id"]] = t["ticket_status"]
        for i, status in picked.items():
            if i not in held or (refresh and held[i][0] <= at):
                held[i] = (at, status)
    assert _statuses(store) == {i: s for i, (_, s) in held.items()}


def test_fields_that_no_column_holds_keep_their_types(spark, folder):
    store = TicketStore(spark, f"{folder}/store").create()
    one = _ticket("1") | {"buyer": {"age": 30, "tags": ["a", "b"]}, "vip": True, "score": 1.5}
    rows = [("1", json.dumps(one)), ("2", '{"ticket_id": 2, "buyer": "none"}'), ("3", "{broken")]
    store.ingest("t", spark.createDataFrame(rows, "ticket_id string, raw string"), NOW)
    asked = {"age": ("$.buyer.age", "int"), "tag": ("$.buyer.tags[1]", "string"), "vip": ("$.vip", "boolean"), "score": ("$.score", "double")}
    out = store.fields("t", **asked)
    assert [t for _, t in out.dtypes] == ["string", "int", "string", "boolean", "double"]
    # What is no JSON has no id either and is refused.
    assert sorted(map(tuple, out.collect())) == [("1", 30, "b", True, 1.5), ("2", None, None, None, None)]
    whole = {r.ticket_id: r.j for r in store.rows("t").select("ticket_id", F.to_json("raw").alias("j")).collect()}
    assert json.loads(whole["1"]) == one


def test_the_number_of_pages_grows_with_the_tickets(spark, folder, monkeypatch):
    monkeypatch.setattr(queries, "_PAGE", 50)
    monkeypatch.setattr(queries, "scratch", lambda _, name: f"{folder}/{name}")
    found = queries._pulled_pages(spark, SMALL)
    landed = pages.read_pages(spark, f"{folder}/landing")
    assert landed.count() == 120 and landed.agg(F.max(F.size("data"))).first()[0] < 120
    assert found.agg(F.sum("tickets")).first()[0] > 0


def _shuffle_files(kept) -> set[str]:
    return set(re.findall(r"shuffle_\d+_\S+?\.data", kept.getAllFiles().mkString(" ")))


def _bytes(top) -> int:
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(top) for f in files)


def test_a_pull_keeps_few_copies_of_its_tickets_on_disk(spark, folder, monkeypatch):
    """Landed pages are compressed, written once more as they are parsed, and no job leaves its shuffle files."""
    monkeypatch.setattr(queries, "_PAGE", 500)
    for module in (queries, session):
        monkeypatch.setattr(module, "scratch", lambda _, name: f"{folder}/{name}-{len(os.listdir(folder))}")
    kept = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = _shuffle_files(kept)
    found = queries._pulled_pages(spark, SMALL)
    deadline = time.time() + 20  # files go a little after their job
    while _shuffle_files(kept) - before and time.time() < deadline:
        time.sleep(0.2)
    assert not _shuffle_files(kept) - before
    size = {name.split("-")[0]: _bytes(f"{folder}/{name}") for name in os.listdir(folder)}
    raw = pages.pull(spark, next(f"{folder}/{n}" for n in os.listdir(folder) if n.startswith("landing")))
    text = raw.agg(F.sum(F.length("raw"))).first()[0]
    assert "pulled" not in size and size["landing"] < text / 2 and size["landing"] + size["pages"] < text
    assert found.agg(F.sum("tickets")).first()[0] > 0


def test_pages_stay_where_they_are_read_when_the_walk_meets_them(spark, folder):
    path = f"{folder}/pages"
    rows = [("a", None, ["1"], "c1"), ("b", "c1", ["2"], None), ("c", "c9", ["3"], None)]
    schema = "page_file string, cursor string, data array<string>, next_cursor string"
    spark.createDataFrame(rows, schema).write.parquet(path)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        walked = chain.walk(spark.read.parquet(path))
        assert "SortMergeJoin" not in walked._jdf.queryExecution().toString()
        assert sorted((r.page_file, r.arrival) for r in walked.collect()) == [("a", 0), ("b", 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


# Ledger -------------------------------------------------------------------------


def test_a_replayed_ledger_batch_adds_nothing(spark, folder):
    store = LedgerStore(spark, f"{folder}/ledger").create()
    one = ("a", 1, Decimal(5), "manual")
    schema = "event_name string, tickets int, revenue_brl decimal(18,6), source string"
    batch = spark.createDataFrame([one, one, ("b", 2, Decimal(3), "manual"), (None, 1, Decimal(1), "manual"), (None, 1, Decimal(1), "manual")], schema)
    for _ in range(2):
        store.append("t", batch, quarantine=f"{folder}/refused")
    assert store.load("t").count() == 3 and spark.read.parquet(f"{folder}/refused").count() == 2
    store.append("t", batch.limit(1), batch="next day")
    assert store.load("t").count() == 4
    store.append("u", batch, quarantine=f"{folder}/refused")
    assert store.load("u").count() == 3 and spark.read.parquet(f"{folder}/refused").count() == 4
