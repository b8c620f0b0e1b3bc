import json
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace import schemas
from millrace.operators import gate
from millrace.plans.arrival import arrival_job, read_manifest
from millrace.plans.customers import customers_job
from millrace.plans.gate import analyst_view, export_job, gate_job
from millrace.plans.sales import pos_job, sales_job
from millrace.plans.sqlpath import export_tables, reconcile_tables, sql_path_job
from millrace.session import shared_folder
from millrace.sinks import versions
from millrace.sinks.tables import append_batch, rebalanced, write_by_day
from millrace.sources import raw, tables
from millrace.streaming.conform import append_sales, stream_accepted, stream_sales
from test_arrival import put
from test_conform import ORDER

POS = ",".join(schemas.POS_HEADER) + "\n"
CUSTOMERS = "|".join(schemas.CUSTOMER_HEADER) + "\n"
NOT_COMPARED = ("source_file", "ingested_at")


def pos_line(number, date="09/17/2026", quantity="2", price="10.00", category="Packs", loyalty=""):
    return f'S001-{number},S001,ON,{date},TH-1,"a, b",{category},{quantity},{price},cash,{loyalty}\n'


RAW = {
    "pos/dt=2026-09-17/pos.csv": POS + pos_line(1) + pos_line(2, loyalty="L000123") + pos_line(2),
    "pos/dt=2026-09-18/pos.csv": POS + pos_line(3, date="") + pos_line(4, price="N/A"),
    "pos/undated/pos.csv": POS + pos_line(99),
    "quarantine/pos/dt=2026-09-18/pos.csv": "x\n" + pos_line(98),
    "ecommerce/dt=2026-09-17/o.json": "\n".join([
        json.dumps(ORDER), "not json", "", json.dumps({**ORDER, "items": []}),
        json.dumps([{**ORDER, "orderId": "EC-7"}, {**ORDER, "orderId": "EC-8", "channel": "app"}]),
        json.dumps({**ORDER, "orderId": "EC-9", "customer": {"customerId": "12", "guest": False}}),
        json.dumps({**ORDER, "orderId": "EC-5"}) + ' {"orderId": "ignored"}',
    ]),
    "ecommerce/flat.json": json.dumps({**ORDER, "orderId": "EC-50"}) + "\n",
    "customers/dt=2026-09-21/c.txt": CUSTOMERS + "000001|A|B|a@x|18-JAN-22|Ontario|NEW|Y\n",
    "customers/dt=2026-09-28/c.txt": CUSTOMERS + "000123|A|B|N/A|99-DEC-99|Ontario|NEW|?\n" * 2,
}


@pytest.fixture
def zones(tmp_path):
    put(str(tmp_path / "raw"), RAW)
    return str(tmp_path / "raw"), str(tmp_path / "trusted")


def content(frame):
    return sorted(str(tuple(row)) for row in frame.drop(*NOT_COMPARED).collect())


def days_of(spark, table):
    """Folders of the newest run of a table."""
    part = versions.current(spark, table).parts[-1]
    return sorted(name for name in os.listdir(os.path.join(os.path.dirname(table), part.folder)) if "=" in name)


def test_sales_job(spark, zones):
    run = sales_job(spark, *zones)
    assert run.rows == 10 and run.bad_lines == 2
    assert run.parse_errors == {"sale_date": 1, "quantity": 1, "unit_price": 2}
    assert [tuple(row) for row in run.by_channel().collect()] == [("app", 1), ("store", 5), ("web", 4)]
    assert run.sales.schema["dt"].dataType.simpleString() == "string"
    assert days_of(spark, zones[1] + "/sales_conformed") == ["dt=2026-09-17", "dt=2026-09-18"]
    rows = {row.sale_id: row for row in run.sales.collect()}
    assert rows["S001-1"].product_name == "a, b"
    assert rows["S001-1"].source_file.endswith("/pos/dt=2026-09-17/pos.csv") and rows["S001-1"].ingested_at
    assert {"EC-7-1", "EC-8-1", "EC-5-1"} < set(rows) and not {"S001-99", "S001-98", "EC-50-1"} & set(rows)


def test_sales_job_again_gives_the_same(spark, zones):
    first = content(sales_job(spark, *zones).sales)
    assert content(sales_job(spark, *zones, compact=True).sales) == first


def test_ranges_of_days_equal_one_run(spark, zones, tmp_path):
    manifest = arrival_job(spark, zones[0], str(tmp_path / "manifest"))
    want = content(sales_job(spark, zones[0], str(tmp_path / "one"), manifest=manifest).sales)
    sales_job(spark, *zones, manifest=manifest, last_day="2026-09-17")
    assert content(sales_job(spark, *zones, manifest=manifest, first_day="2026-09-18").sales) == want
    # A day of the range that has no rows any more goes, as in a whole run; the days outside stay.
    os.remove(os.path.join(zones[0], "pos/dt=2026-09-18/pos.csv"))
    put(zones[0], {"pos/dt=2026-09-19/pos.csv": POS + pos_line(5)})
    manifest = arrival_job(spark, zones[0], str(tmp_path / "manifest"))
    want = content(sales_job(spark, zones[0], str(tmp_path / "one"), manifest=manifest).sales)
    assert content(sales_job(spark, *zones, manifest=manifest, first_day="2026-09-18").sales) == want


def test_one_source_is_enough(spark, tmp_path):
    put(str(tmp_path / "raw"), {key: text for key, text in RAW.items() if key.startswith("pos/")})
    run = sales_job(spark, str(tmp_path / "raw"), str(tmp_path / "trusted"))
    assert (run.rows, run.bad_lines) == (5, 0)


def test_no_input_and_empty_input_fail_and_keep_the_output(spark, zones, tmp_path):
    sales_job(spark, *zones)
    with pytest.raises(RuntimeError, match="No input"):
        sales_job(spark, str(tmp_path / "nowhere"), zones[1])
    put(str(tmp_path / "hollow"), {"pos/dt=2026-09-17/a.csv": POS})
    with pytest.raises(RuntimeError, match="no rows"):
        sales_job(spark, str(tmp_path / "hollow"), zones[1])
    assert tables.read_trusted_sales(spark, zones[1]).count() == 10


def test_files_with_other_headers(spark, tmp_path):
    names = list(schemas.POS_HEADER)
    spaced = ",".join(f" {name} " for name in names) + "\n"
    fewer = [name for name in names if name != "payment_type"]
    turned = names[::-1]
    cells = dict(zip(names, pos_line(1).strip().replace('"a, b"', "ab").split(",")))
    put(str(tmp_path / "raw"), {
        "pos/dt=2026-09-17/spaced.csv": spaced + pos_line(1),
        "pos/dt=2026-09-18/fewer.csv": ",".join(fewer) + "\n" + ",".join(cells[n] for n in fewer) + "\n",
        "pos/dt=2026-09-19/turned.csv": ",".join(turned) + "\n" + ",".join(cells[n] for n in turned) + "\n",
    })
    sales = sales_job(spark, str(tmp_path / "raw"), str(tmp_path / "trusted"), pos_header=None).sales
    assert [tuple(r) for r in sales.select("sale_id", "quantity", "unit_price_cad", "store_id").distinct().collect()] == [
        ("S001-1", 2, Decimal("10.00"), "S001")]
    assert sales.count() == 3
    put(str(tmp_path / "raw"), {"pos/dt=2026-09-20/x.csv": "sku,txn_id\nTH-1,7\n"})
    with pytest.raises(ValueError, match="x.csv lacks the columns"):
        sales_job(spark, str(tmp_path / "raw"), str(tmp_path / "trusted"), pos_header=None)


def test_changed_file_is_checked_again_and_not_read_before(spark, tmp_path):
    zone, manifest = str(tmp_path / "landing"), str(tmp_path / "manifest")
    put(zone, {"pos/dt=2026-09-17/a.csv": POS + pos_line(1), "pos/dt=2026-09-17/b.csv": POS + pos_line(2)})
    arrival_job(spark, zone, manifest)
    turned = POS.replace("quantity,unit_price", "unit_price,quantity")
    path = os.path.join(zone, "pos/dt=2026-09-17/a.csv")
    size = os.path.getsize(path)
    put(zone, {"pos/dt=2026-09-17/a.csv": turned + pos_line(1)})
    os.utime(path, (2_000_000_000, 2_000_000_000))
    assert os.path.getsize(path) == size
    run = sales_job(spark, zone, str(tmp_path / "trusted"), manifest=read_manifest(spark, manifest))
    assert [r.sale_id for r in run.sales.collect()] == ["S001-2"]
    verdicts = arrival_job(spark, zone, manifest)
    assert sorted((r.key[-5:], r.status) for r in verdicts.collect()) == [
        ("a.csv", "accepted"), ("a.csv", "quarantined"), ("b.csv", "accepted")]
    run = sales_job(spark, zone, str(tmp_path / "trusted"), manifest=verdicts)
    assert [r.sale_id for r in run.sales.collect()] == ["S001-2"]


def test_rejected_newest_snapshot_keeps_the_customers(spark, tmp_path):
    zone, manifest, trusted = (str(tmp_path / name) for name in ("landing", "manifest", "trusted"))
    put(zone, {key: RAW[key] for key in RAW if key.startswith("customers/")})
    assert customers_job(spark, zone, trusted, arrival_job(spark, zone, manifest)).rows == 2
    path = os.path.join(zone, "customers/dt=2026-09-28/c.txt")
    put(zone, {"customers/dt=2026-09-28/c.txt": CUSTOMERS})
    os.utime(path, (2_000_000_000, 2_000_000_000))
    run = customers_job(spark, zone, trusted, arrival_job(spark, zone, manifest))
    assert (run.snapshot, run.rows) == ("2026-09-21", 1)
    put(str(tmp_path / "raw"), {"customers/dt=2026-09-28/c.txt": CUSTOMERS})
    with pytest.raises(RuntimeError, match="holds no rows"):
        customers_job(spark, str(tmp_path / "raw"), trusted)
    assert tables.read_trusted_customers(spark, trusted).count() == 1


def test_rejected_files_are_not_opened(spark, tmp_path):
    zone = str(tmp_path / "landing")
    put(zone, {"pos/dt=2026-09-17/a.csv": POS + pos_line(1), "pos/dt=2026-09-17/wide.csv": "," * 30_000 + "\n1\n"})
    run = sales_job(spark, zone, str(tmp_path / "trusted"), manifest=arrival_job(spark, zone, str(tmp_path / "manifest")))
    assert run.rows == 1


def test_batch_and_stream_share_a_table(spark, tmp_path):
    zone, trusted, offsets = (str(tmp_path / name) for name in ("raw", "trusted", "offsets"))
    put(zone, {"pos/dt=2026-09-17/a.csv": POS + pos_line(1) + pos_line(2)})
    sales_job(spark, zone, trusted)
    put(str(tmp_path / "more"), {"pos/dt=2026-09-18/b.csv": POS + pos_line(3)})
    target = trusted + "/sales_conformed"
    append_sales(stream_sales(spark, str(tmp_path / "more")), target, offsets).awaitTermination()
    assert sorted(r.sale_id for r in tables.read_trusted_sales(spark, trusted).collect()) == ["S001-1", "S001-2", "S001-3"]
    rows = tables.read_trusted_sales(spark, trusted).filter("sale_id = 'S001-3'").cache()
    rows.count()
    for _ in range(2):
        append_batch(rows, target, "again-1")
    assert tables.read_trusted_sales(spark, trusted).count() == 4
    os.makedirs(target + "/_spark_metadata")
    with pytest.raises(RuntimeError, match="belongs to a file stream"):
        sales_job(spark, zone, trusted)


def test_stream_of_accepted_files(spark, tmp_path):
    zone, manifest, trusted, offsets = (str(tmp_path / name) for name in ("landing", "manifest", "trusted", "offsets"))
    put(zone, {"pos/dt=2026-09-17/a.csv": POS + pos_line(1), "pos/dt=2026-09-17/bad.csv": "x" + POS + pos_line(9)})
    arrival_job(spark, zone, manifest)
    stream_accepted(spark, zone, manifest, trusted, offsets).awaitTermination()
    put(zone, {"ecommerce/dt=2026-09-18/o.json": json.dumps(ORDER)})
    arrival_job(spark, zone, manifest)
    stream_accepted(spark, zone, manifest, trusted, offsets).awaitTermination()
    stream_accepted(spark, zone, manifest, trusted, offsets).awaitTermination()
    assert sorted(r.dt for r in tables.read_trusted_sales(spark, trusted).select("dt").distinct().collect()) == ["2026-09-17", "2026-09-18"]
    assert tables.read_trusted_sales(spark, trusted).filter("channel = 'store'").count() == 1


def test_rejected_lines_keep_their_text(spark, zones):
    lines = raw.rejected_order_lines(raw.read_order_lines(spark, zones[0] + "/ecommerce"))
    assert sorted(row.line[:8] for row in lines.collect()) == ["not json", '{"orderI']


def test_counts_see_the_same_orders_as_full_reads(spark, zones):
    orders = raw.valid_orders(raw.read_order_lines(spark, zones[0] + "/ecommerce"))
    assert orders.count() == len(orders.collect()) == orders.groupBy("dt").count().first()["count"] == 5


def test_customers_job(spark, zones, tmp_path):
    run = customers_job(spark, *zones)
    assert (run.snapshot, run.rows, run.parse_errors) == ("2026-09-28", 2, {"signup_date": 2, "opt_in": 2})
    assert run.distinct().first().asDict() == dict(all_rows=2, distinct_ids=1, surplus_rows=1)
    first = content(run.customers)
    assert content(customers_job(spark, *zones).customers) == first
    assert customers_job(spark, str(tmp_path / "nowhere"), zones[1]) is None


def test_jobs_straight_from_landing(spark, zones, tmp_path):
    landing = {key: text for key, text in RAW.items() if not key.startswith("quarantine/")}
    put(str(tmp_path / "landing"), landing | {
        "pos/dt=2026-09-18/bad.csv": "x" + POS + pos_line(50) + pos_line(51),
        "ecommerce/dt=2026-09-18/bad.json": '{"order": 1}\n' + json.dumps({**ORDER, "orderId": "EC-99"}),
        "customers/dt=2026-10-05/c.txt": "",
        "customers/dt=2026-10-12/c.txt": "cust_no\n000001\n",
    })
    manifest = arrival_job(spark, str(tmp_path / "landing"), str(tmp_path / "manifest"))
    want = content(sales_job(spark, *zones).sales)
    got = sales_job(spark, str(tmp_path / "landing"), str(tmp_path / "direct"), manifest=manifest)
    assert content(got.sales) == want and got.bad_lines == 2
    run = customers_job(spark, str(tmp_path / "landing"), str(tmp_path / "direct"), manifest)
    assert (run.snapshot, run.rows) == ("2026-09-28", 2)


def test_snapshot_reads_one_folder(spark, zones):
    rows = raw.read_snapshot(spark, zones[0] + "/customers", "2026-09-21")
    assert rows.count() == 1
    assert "PartitionFilters: [isnotnull(dt" in rows._jdf.queryExecution().toString()


def test_gate_job(spark, zones):
    sales_job(spark, *zones)
    run = gate_job(spark, zones[1])
    assert run.balanced and (run.all_rows, run.curated_rows, run.quarantine_rows) == (10, 4, 6)
    assert sorted(row.sale_id for row in run.curated.collect()) == ["EC-5-1", "EC-7-1", "EC-8-1", "S001-1"]
    reasons = {row.sale_id: row.fail_reasons for row in run.quarantine.collect()}
    assert reasons["S001-2"] == "R4_duplicate_sale_id" and reasons["S001-3"] == "R1_sale_date"
    again = export_job(spark, tables.read_trusted_sales(spark, zones[1]), zones[1] + "/curated")
    assert content(again.curated) == content(run.curated)
    assert sorted(os.listdir(zones[1] + "/curated")) == ["quarantine", "sales_clean"]
    export_job(spark, tables.read_trusted_sales(spark, zones[1]), zones[1] + "/by_channel", ("channel",))
    assert "channel=store" in days_of(spark, zones[1] + "/by_channel/sales_clean")
    assert analyst_view(spark, run.curated).columns == list(schemas.SALES_COLUMNS)


def test_normal_business_is_not_an_issue(spark, tmp_path):
    guest = {**ORDER, "orderId": "EC-2", "customer": {"customerId": None, "guest": True}, "currency": "USD"}
    put(str(tmp_path / "raw"), {
        "pos/dt=2026-09-17/pos.csv": POS + pos_line(1, loyalty=""),
        "ecommerce/dt=2026-09-17/o.json": json.dumps(guest),
    })
    sales_job(spark, str(tmp_path / "raw"), str(tmp_path / "trusted"))
    run = gate_job(spark, str(tmp_path / "trusted"))
    assert (run.curated_rows, run.quarantine_rows) == (2, 0)


def test_curated_filters_reach_the_scan(spark, zones, capsys):
    sales_job(spark, *zones)
    sales = tables.read_trusted_sales(spark, zones[1])
    gate.curated(sales, gate.duplicate_sales(spark, sales)).explain("formatted")
    plan = capsys.readouterr().out
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line and "quantity" in line)
    assert "GreaterThan(quantity,0)" in pushed and "IsNotNull(sale_date)" in pushed
    assert "ingested_at" not in plan


def test_sql_path(spark, zones):
    pos_job(spark, *zones)
    counts = sql_path_job(spark, *zones, tables_path=zones[1] + "/tables").first()
    assert counts.asDict() == dict(all_rows=10, curated_rows=6, quarantine_rows=4)
    assert reconcile_tables(spark).first() == counts
    assert sorted(row.sale_id for row in spark.table("sales_ecommerce").collect()) == [
        "EC-1-1", "EC-5-1", "EC-50-1", "EC-7-1", "EC-8-1"]
    export_tables(spark, zones[1] + "/curated")
    export_tables(spark, zones[1] + "/curated")
    assert versions.read(spark, zones[1] + "/curated/sales_clean").count() == 6
    assert versions.read(spark, zones[1] + "/curated/quarantine").columns[-1] == "fail_reasons"


def test_paths_are_not_combined(spark, zones):
    sales_job(spark, *zones)
    with pytest.raises(ValueError, match="already holds e-commerce"):
        sql_path_job(spark, *zones)


def test_views(spark, zones):
    assert tables.register_raw(spark, zones[0]) == ["raw_pos", "raw_ecommerce", "raw_customers", "ecommerce_orders"]
    per_day = spark.sql("SELECT dt, count(*) AS n FROM raw_ecommerce GROUP BY dt ORDER BY dt").collect()
    assert [tuple(row) for row in per_day] == [("2026-09-17", 5)]
    assert spark.sql("SELECT count(*) FROM ecommerce_orders").first()[0] == 6
    assert spark.sql("SELECT count(DISTINCT dt) FROM raw_customers").first()[0] == 2
    items = spark.sql("SELECT o.orderid, i.sku, i.qty, i.pricecents FROM raw_ecommerce o LATERAL VIEW explode(o.items) t AS i")
    assert items.count() == 4
    sales_job(spark, *zones)
    customers_job(spark, *zones)
    tables.register_trusted(spark, zones[1])
    assert spark.sql("SELECT channel, count(*) FROM sales_conformed GROUP BY channel").count() == 3
    assert spark.sql("SELECT * FROM customers_conformed LIMIT 10").count() == 2


def test_date_range_prunes(spark, zones):
    rows = raw.in_date_range(raw.read_pos(spark, zones[0] + "/pos"), "2026-09-18", "2026-12-31")
    assert rows.count() == 2
    assert "PartitionFilters: [isnotnull(dt" in rows._jdf.queryExecution().toString()


def test_streamed_sales_equal_the_batch(spark, zones, tmp_path):
    put(zones[0], {"pos/dt=2026-09-19/more.csv": POS + pos_line(5)})
    batch = content(sales_job(spark, *zones).sales)
    target, offsets = str(tmp_path / "stream/sales_conformed"), str(tmp_path / "offsets")
    for _ in range(2):
        append_sales(stream_sales(spark, zones[0]), target, offsets).awaitTermination()
    assert content(tables.read_trusted_sales(spark, str(tmp_path / "stream"))) == batch


def test_large_days_are_split_when_compacting(spark, tmp_path):
    rows = spark.range(1000).select("id", F.lit("2026-09-17").alias("dt"))
    write_by_day(rebalanced(rows), str(tmp_path / "out"))
    assert versions.read(spark, str(tmp_path / "out")).count() == 1000


def test_shared_folder_is_the_checkpoint_folder(spark):
    assert shared_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir") + "/millrace/x-")


def test_each_day_apart_is_one_partition_of_narrow_rows(spark):
    from millrace import feeds

    days = [f"2026-{m:02d}-01" for m in range(1, 13) for _ in range(5)] + [None] * 5
    rows = spark.createDataFrame(list(enumerate(days)), "k int, day string").repartition(6)
    placed = feeds.days_apart(rows, "day").withColumn("p", F.spark_partition_id()).groupBy("day").agg(
        F.count_distinct("p").alias("parts"), F.first("p").alias("p"), F.count("*").alias("n")
    ).collect()
    assert len(placed) == 13 and {r.parts for r in placed} == {1} and {r.n for r in placed} == {5}
    assert len({r.p for r in placed}) == 13


def test_feeds_by_day_are_moved_once_and_hold_the_same_rows(spark, tmp_path, capsys):
    from datetime import datetime

    from millrace import feeds

    when = [datetime(1995 + i % 2, 1 + i % 12, 1) if i % 7 else None for i in range(40)]
    given = {
        "lineitem": spark.createDataFrame(
            [(i % 9 or None, i, i % 5, 1 + i % 3, 2.0, 9.5, "ANR"[i % 3], day) for i, day in enumerate(when)],
            """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double,
            l_returnflag string, l_shipdate timestamp"""),
        "orders": spark.createDataFrame(
            [(i, i % 9 or None, 10.25 * i, day) for i, day in enumerate(when)],
            "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp"),
        "customer": spark.createDataFrame(
            [(i % 30 or None, f"C{i}", i % 7, "BUILDING") for i in range(40)],
            "c_custkey bigint, c_name string, c_nationkey bigint, c_mktsegment string"),
    }
    for name, rows in given.items():
        rows.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    for feed in (feeds.raw_pos, feeds.order_documents, feeds.raw_customers):
        apart = feed(spark, str(tmp_path), apart=True)
        capsys.readouterr()
        apart.explain()
        assert capsys.readouterr().out.count("REPARTITION_BY") == 1
        assert content(apart) == content(feed(spark, str(tmp_path)))


def test_raw_zone_is_compressed_and_written_where_the_rows_lie(spark):
    from millrace import feeds, queries

    zone = queries.write_raw(spark, "/root/testdata/sf0.001", ("pos", "ecommerce"))
    names = [row.name for row in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(zone)
             .select(F.element_at(F.split("path", "/"), -1).alias("name")).collect()]
    assert names and all(name.endswith(".gz") for name in names)
    assert raw.read_pos(spark, f"{zone}/pos").count() == feeds.raw_pos(spark, "/root/testdata/sf0.001").count()


def test_landing_files_are_rewritten_chunk_by_chunk():
    import io

    from millrace.queries import _first_line, _first_replaced

    class Asked(io.BytesIO):
        def read(self, size=-1):
            assert 0 < size <= 4
            return super().read(size)

    for text in (b"", b"ab", b"xxabcdxxabcd", b"abcabcd" * 3, b"a" * 50 + b"abcd\nabcd", b"abc"):
        for chunk in (1, 2, 3, 4):
            made, cut = io.BytesIO(), io.BytesIO()
            _first_replaced(Asked(text), made, b"abcd", b"dcba", chunk)
            assert made.getvalue() == text.replace(b"abcd", b"dcba", 1)
            _first_line(Asked(text), cut, chunk)
            assert cut.getvalue() == text.split(b"\n", 1)[0] + b"\n"
