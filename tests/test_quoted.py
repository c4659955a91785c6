"""CSV files with line breaks in quotes, read in parallel; price positions; prices of one huge show."""

import csv as plain_csv
import os
import random
from datetime import date, datetime, timezone
from decimal import Decimal

import pytest
from frames import rows_of
from pyspark.sql import functions as F

from turnstile.operators import door
from turnstile.sources import csv, quoted, statement

NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)
AS_OF = date(2024, 6, 1)


@pytest.fixture
def small_splits(spark):
    """Files are cut every few kilobytes."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def _write(path, rows, end="\n", header=("id", "text", "more")):
    with open(path, "w", newline="") as out:
        writer = plain_csv.writer(out, lineterminator=end)
        writer.writerow(header)
        writer.writerows(rows)


def _random_rows(seed, n):
    rng = random.Random(seed)
    cells = ["a", 'b "q" c', 'x\ny\n"z"', "", "é,漢\n", "\n\n", '"', "long " * 300]
    return [[str(i), rng.choice(cells) * rng.randint(0, 3), rng.choice(["", "v", ',"'])] for i in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_split_files_equal_one_task_per_file(spark, folder, small_splits, end):
    for name, seed, n in (("a.csv", 1, 400), ("b.csv", 2, 1), ("c.csv", 3, 90), ("d.csv", 4, 0)):
        _write(os.path.join(folder, name), _random_rows(seed, n), end)
    assert quoted._lines(spark, folder).select("file", "block").distinct().count() > 20
    found = quoted.read_csv(spark, folder, place=True)
    whole = spark.read.csv(folder, header=True, multiLine=True, escape='"')
    assert found.columns == [*quoted.PLACE, *whole.columns]
    assert rows_of(found.select(*whole.columns)) == rows_of(whole)
    order = found.filter(F.col("csv_file").endswith("a.csv")).orderBy("csv_position").collect()
    assert [r.id for r in order] == [str(i) for i in range(400)]


def test_odd_files(spark, folder, small_splits):
    path = os.path.join(folder, "t.csv")
    with open(path, "w") as out:
        out.write('\nid,text\n1,"a\n\nb"\n\n2,plain\n3,"open\nto the end')
    assert rows_of(quoted.read_csv(spark, path)) == [("1", "a\n\nb"), ("2", "plain"), ("3", "open\nto the end")]
    empty = os.path.join(folder, "none")
    os.mkdir(empty)
    open(os.path.join(empty, "e.csv"), "w").close()
    assert quoted.read_csv(spark, empty).isEmpty()
    _write(os.path.join(folder, "other.csv"), [["1"]], header=("x",))
    with pytest.raises(ValueError, match="different headers"):
        quoted.read_csv(spark, folder)


def test_load_csv_reads_broken_cells_in_pieces(spark, folder, small_splits):
    header = ("ticket_id", "event_name", "deal_price", "ordered_at")
    rows = [(str(i), f'show\n"{i % 3}"', "100.0", "2024-01-02T10:00:00Z") for i in range(500)]
    _write(os.path.join(folder, "t.csv"), rows, header=header)
    t = csv.load_csv(spark, folder, AS_OF)
    assert rows_of(t.rows.groupBy("event_name").count()) == [('show\n"0"', 167), ('show\n"1"', 167), ('show\n"2"', 166)]


def test_positions_follow_the_file(spark, folder, small_splits, monkeypatch):
    monkeypatch.setattr(csv, "_CHUNK", 7)
    header = ("source", "event_name", "deal_price_brl", "note")
    rng = random.Random(5)
    rows = [(rng.choice(["Porta", "Porta", "Shotgun"]), rng.choice("ab"), f"{rng.randint(1, 9)}.5", "x\ny" * rng.randint(0, 3)) for _ in range(600)]
    _write(os.path.join(folder, "t.csv"), rows, header=header)
    online, entries, prices = csv.import_consolidated(spark, folder, AS_OF, "t", NOW)
    named = prices.join(entries.select("entry_id", "event_name"), "entry_id")
    for show in "ab":
        wanted = [float(p) for s, e, p, _ in rows if s == "Porta" and e == show]
        found = named.filter(F.col("event_name") == show).orderBy("position").collect()
        assert [r.position for r in found] == list(range(len(wanted)))
        assert [float(r.price) for r in found] == wanted
    assert online.rows.count() == sum(s == "Shotgun" for s, *_ in rows)
    assert not set(quoted.PLACE) & set(online.rows.columns)


@pytest.mark.parametrize("partitions", [1, 9])
def test_positions_without_an_order_follow_the_price(spark, partitions, monkeypatch):
    monkeypatch.setattr(csv, "_CHUNK", 3)
    rows = [("Porta", "ab"[i % 2], ["2", "1", "x", "1"][i % 4]) for i in range(80)]
    frame = spark.createDataFrame(rows, "source string, event_name string, deal_price_brl string").repartition(partitions)
    _, entries, prices = csv.split_consolidated(frame, AS_OF, "t", NOW)
    named = prices.join(entries.select("entry_id", "event_name"), "entry_id").orderBy("event_name", "position")
    found = [(r.event_name, r.position, r.price and int(r.price)) for r in named.collect()]
    assert found == [("a", i, None if i < 20 else 2) for i in range(40)] + [("b", i, 1) for i in range(40)]


def test_prices_of_one_show_meet_it_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(door, "_PART", 50)
    threshold, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"
    before = {k: spark.conf.get(k) for k in (threshold, adaptive)}
    spark.conf.set(threshold, "-1")
    spark.conf.set(adaptive, "false")
    try:
        prices = spark.range(5000).select(
            F.lit("e").alias("entry_id"), F.col("id").alias("position"), F.col("id").cast("decimal(18,6)").alias("price")
        )
        entry = [("e", "show", 5000, Decimal(1), "consolidated_upload")]
        ledger = spark.createDataFrame(entry, "entry_id string, event_name string, tickets int, revenue_brl decimal(18,6), source string")
        ledger = ledger.withColumn("prices", F.lit(None).cast("array<decimal(18,6)>")).withColumn("entry_date", F.lit(AS_OF))
        out = door.door_rows(ledger, None, AS_OF, prices)
        assert out.agg(F.count("*"), F.sum("door_price").cast("long")).first() == (5000, 12497500)
        sizes = out.groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) > 2 and max(r["count"] for r in sizes) < 4000
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_a_statement_with_a_break_in_quotes(spark, folder):
    preamble = "".join(f"line {i}\n" for i in range(8))
    body = 'Data,Tipo,Entradas,Nota\n1/2/2024,Vendas,10.50,"two\nlines"\n1/2/2024,Vendas,20,\n2/2/2024,"Ven\ndas",5,\n3/2/2024,Vendas,"7",ok\n'
    for name, text in (("q.csv", body), ("p.csv", body.replace('"two\nlines"', "x").replace('"Ven\ndas"', "y").replace('"7"', "7"))):
        with open(os.path.join(folder, name), "w") as out:
            out.write(preamble + text)
    sold = statement.sales(spark, folder).withColumn("file", F.substring_index("file", "/", -1))
    found = [(f, n, float(a)) for f, n, _, a in rows_of(sold, "file", "line_no", "sale_date", "amount")]
    assert found == [("p.csv", 10, 10.5), ("p.csv", 11, 20.0), ("p.csv", 13, 7.0), ("q.csv", 10, 10.5), ("q.csv", 12, 20.0), ("q.csv", 15, 7.0)]


def test_lines_of_files_without_quotes_are_numbered_where_they_are_read(spark, folder):
    for name, text in (("a", "x,y\n1,2\n\n3,4\r\n"), ("b", 'x,y\n"1\n1",2\n5,6\n')):
        with open(f"{folder}/{name}.csv", "w", newline="") as out:
            out.write(text)
    marks = quoted._counted(quoted._text(spark, folder)).select(F.substring_index("file", "/", -1), "lines", "quoted")
    assert sorted(map(tuple, marks.collect())) == [("a.csv", 0, False), ("b.csv", 0, True)]
    found = quoted.records(spark, folder).select(F.substring_index("file", "/", -1), "position", "record")
    assert sorted(map(tuple, found.collect())) == [
        ("a.csv", 1, "x,y"), ("a.csv", 2, "1,2"), ("a.csv", 3, ""), ("a.csv", 4, "3,4"),
        ("b.csv", 1, "x,y"), ("b.csv", 2, '"1\n1",2'), ("b.csv", 3, "5,6"),
    ]


def test_a_statement_is_cut_up_in_one_way_only(spark):
    body = "\n Data , Tipo ,Entradas\n1/2/2024,Vendas,{}\n2/2/2024,Vendas,7.5\n"
    texts = [("plain", "p\n" * 8 + body.format("5.00")), ("above", 'p"q\n' * 8 + body.format("5.00")), ("in", "p\n" * 8 + body.format('"5.00"')), ("none", None)]
    found = statement.sales_in(spark.createDataFrame(texts, "file string, text string"))
    assert sorted((r.file, r.line_no, str(r.amount)) for r in found.collect()) == [
        (file, line, amount) for file in ("above", "in", "plain") for line, amount in ((11, "5.000000"), (12, "7.500000"))
    ]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert 'NOT Contains(text' in plan and "exists(" not in plan
