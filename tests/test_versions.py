"""Tables change in one step: what failed or killed runs leave, ranges of days, batches, compaction, and the gate kept up to date."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from millrace import queries, schemas
from millrace.plans import gate as gate_plans
from millrace.plans.arrival import arrival_job, compact_manifest, read_manifest
from millrace.plans.customers import customers_job
from millrace.plans.gate import gate_job, keep_gate, kept_gate, update_gate
from millrace.plans.sales import NoInput, day_ranges, sales_job, sales_job_in_ranges
from millrace.sinks import versions
from millrace.sinks.tables import write_outcomes
from millrace.sources import landing, raw, tables
from millrace.streaming import arrival as stream
from test_arrival import put
from test_jobs import CUSTOMERS, POS, content, pos_line

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows_of(spark, *pairs):
    return spark.createDataFrame([(k, d) for k, d in pairs], "k int, dt string")


def found(spark, table):
    return sorted(tuple(r) for r in versions.read(spark, table, rows_of(spark).schema).select("k", "dt").collect())


def failing(rows):
    return rows.withColumn("k", F.when(F.col("k") > 0, F.raise_error(F.lit("stop"))).otherwise(F.col("k")).cast("int"))


def test_failed_run_leaves_the_table(spark, tmp_path):
    table = str(tmp_path / "t")
    versions.replace(rows_of(spark, (1, "a"), (2, "b")), table, ("dt",))
    for act in (
        lambda bad: versions.replace(bad, table, ("dt",)), lambda bad: versions.replace_days(bad, table, "a", "a"),
        lambda bad: versions.append(bad, table, "x"),
    ):
        with pytest.raises(Exception, match="stop"):
            act(failing(rows_of(spark, (0, "a"), (5, "b"))))
        assert found(spark, table) == [(1, "a"), (2, "b")]
    assert len(os.listdir(tmp_path / "t/_runs")) == 1
    assert spark.read.schema("k int, dt string").parquet(table).count() == 0  # hidden from who does not look up the version


def test_days_are_replaced_and_pruned(spark, tmp_path):
    table = str(tmp_path / "t")
    versions.replace(rows_of(spark, *[(k, f"2026-01-0{k}") for k in range(1, 8)]), table, ("dt",))
    versions.replace_days(rows_of(spark, (30, "2026-01-03")), table, "2026-01-03", "2026-01-04")
    versions.replace_days(rows_of(spark, (70, "2026-01-07"), (80, "2026-01-08")), table, "2026-01-07", None)
    want = [(1, "2026-01-01"), (2, "2026-01-02"), (5, "2026-01-05"), (6, "2026-01-06"), (30, "2026-01-03"), (70, "2026-01-07"), (80, "2026-01-08")]
    assert found(spark, table) == want
    plan = versions.read(spark, table, rows_of(spark).schema)._jdf.queryExecution().toString()
    assert "DataFilters: []" in plan and "PartitionFilters: [" in plan
    versions.replace_days(rows_of(spark, (9, "2026-01-08")), table, "2026-01-08", "2026-01-08")
    versions.replace_days(rows_of(spark), table, None, "2026-01-02")
    assert found(spark, table) == sorted([(5, "2026-01-05"), (6, "2026-01-06"), (9, "2026-01-08"), (30, "2026-01-03"), (70, "2026-01-07")])
    versions.replace_days(rows_of(spark, (1, "2026-01-01")), table, None, None)
    assert found(spark, table) == [(1, "2026-01-01")] and len(versions.current(spark, table).parts) == 1


def test_batches_count_once_and_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "MOST_BATCHES", 3)
    table = str(tmp_path / "t")
    versions.replace(rows_of(spark, (0, "a")), table, ("dt",))
    for k in (1, 1, 2, 3, 4, 2, 5):
        versions.append(rows_of(spark, (k, "b")), table, f"label-{k}")
    assert found(spark, table) == [(0, "a")] + [(k, "b") for k in range(1, 6)]
    assert len(versions.current(spark, table).parts) <= 4


def test_old_versions_go_and_vacuum_takes_the_rest(spark, tmp_path):
    table = str(tmp_path / "t")
    held = None
    for k in range(6):
        versions.replace(rows_of(spark, (k, "a")), table)
        held = held or versions.read(spark, table)
        if k < versions.KEEP:
            assert held.collect()[0].k == 0  # planned with the first version, which is still kept
    assert len(os.listdir(tmp_path / "t/_runs")) == versions.KEEP == len(versions.numbers(spark, table))
    versions.write_run(rows_of(spark, (9, "a")), table)
    assert versions.vacuum(spark, table) == 0 and versions.vacuum(spark, table, older_than_hours=-1) == 1
    assert found(spark, table) == [(5, "a")]


def test_second_writer_of_a_number_fails(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "t")
    versions.replace(rows_of(spark, (1, "a")), table)
    monkeypatch.setattr(versions, "numbers", lambda *_: [])
    with pytest.raises(RuntimeError, match="another run has published version 1"):
        versions.replace(rows_of(spark, (2, "a")), table)


def test_outcomes_of_one_pass(spark, tmp_path):
    paths = {name: str(tmp_path / name) for name in ("good", "bad", "none")}
    rows = spark.range(10).select(F.col("id").cast("int").alias("k"), F.when(F.col("id") < 7, "good").otherwise("bad").alias("how"))
    write_outcomes(rows, "how", paths)
    assert [versions.read(spark, paths[n], spark.createDataFrame([], "k int").schema).count() for n in paths] == [7, 3, 0]


KILLED = """
import os, sys
sys.path[:0] = [{repo!r}, {repo!r} + "/tests"]
from pyspark.sql import SparkSession
from millrace.sinks import versions
from millrace.plans import customers, gate, sales
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
versions.publish = lambda *a, **b: os._exit(9)  # all rows are written, the version is not
job, args = {job!r}, {args!r}
dict(sales=sales.sales_job, customers=customers.customers_job, gate=gate.gate_job)[job](spark, *args)
"""


@pytest.mark.parametrize("job", ["sales", "customers", "gate"])
def test_killed_run_leaves_the_table(spark, tmp_path, job):
    zone, trusted = str(tmp_path / "raw"), str(tmp_path / "trusted")
    put(zone, {"pos/dt=2026-09-17/a.csv": POS + pos_line(1), "customers/dt=2026-09-21/c.txt": CUSTOMERS + "000001|A|B|a@x|18-JAN-22|Ontario|NEW|Y\n"})
    sales_job(spark, zone, trusted)
    customers_job(spark, zone, trusted)
    gate_job(spark, trusted)
    read = {
        "sales": lambda: tables.read_trusted_sales(spark, trusted), "customers": lambda: tables.read_trusted_customers(spark, trusted),
        "gate": lambda: versions.read(spark, trusted + "/sales", schemas.SALES),
    }[job]
    before = content(read())
    put(zone, {"pos/dt=2026-09-18/b.csv": POS + pos_line(2), "customers/dt=2026-09-28/c.txt": CUSTOMERS + "000002|A|B|a@x|18-JAN-22|Ontario|NEW|Y\n"})
    if job == "gate":
        sales_job(spark, zone, trusted)
    args = [trusted] if job == "gate" else [zone, trusted]
    text = KILLED.format(repo=REPO, shared=str(tmp_path / "shared"), job=job, args=args)
    assert subprocess.run([sys.executable, "-c", text], capture_output=True, timeout=300).returncode == 9
    assert content(read()) == before and len(before) == 1


def test_stream_lists_touched_folders_only(spark, tmp_path, monkeypatch):
    zone, manifest, offsets = (str(tmp_path / name) for name in ("landing", "manifest", "offsets"))
    listed = []
    real = landing.list_folders
    monkeypatch.setattr(landing, "list_folders", lambda s, base, folders: listed.append(folders) or real(s, base, folders))
    monkeypatch.setattr(landing, "list_files", lambda *_: pytest.fail("the whole zone was listed"))
    put(zone, {f"pos/dt=2026-09-{d}/a.csv": POS + "1\n" for d in range(10, 16)})
    stream.watch_landing(spark, zone, manifest, offsets).awaitTermination()
    put(zone, {"pos/dt=2026-09-12/b.csv": POS, "pos/dt=2026-09-12/empty.csv": "", "ecommerce/dt=2026-09-20/o.json": "x\n"})
    stream.watch_landing(spark, zone, manifest, offsets, files_per_batch=1).awaitTermination()
    assert listed[0] == [f"pos/dt=2026-09-{d}" for d in range(10, 16)]
    assert sorted(f for folders in listed[1:] for f in folders) == ["ecommerce/dt=2026-09-20", "pos/dt=2026-09-12"]
    got = sorted((r.key[-9:], r.status) for r in read_manifest(spark, manifest).where("dt IN ('2026-09-12', '2026-09-20')").collect())
    assert got == [("-12/a.csv", "accepted"), ("-12/b.csv", "quarantined"), ("20/o.json", "quarantined"), ("empty.csv", "quarantined")]


def test_compacted_manifest(spark, tmp_path):
    zone, manifest = str(tmp_path / "landing"), str(tmp_path / "manifest")
    assert compact_manifest(spark, manifest) == 0
    put(zone, {"pos/dt=2026-09-17/a.csv": POS + "1\n", "pos/dt=2026-09-18/b.csv": POS})
    arrival_job(spark, zone, manifest)
    put(zone, {"pos/dt=2026-09-18/b.csv": POS + "22\n"})
    arrival_job(spark, zone, manifest)
    assert read_manifest(spark, manifest).count() == 3 and compact_manifest(spark, manifest) == 2
    put(zone, {"pos/dt=2026-09-19/c.csv": POS + "1\n"})
    after = arrival_job(spark, zone, manifest)
    assert sorted((r.key[-5:], r.status) for r in after.collect()) == [("a.csv", "accepted"), ("b.csv", "accepted"), ("c.csv", "accepted")]
    assert compact_manifest(spark, manifest) == 3 and arrival_job(spark, zone, manifest).count() == 3
    plan = read_manifest(spark, manifest, "2026-09-18", "2026-09-18")._jdf.queryExecution().toString()
    assert plan.count("PartitionFilters: [") >= 2 and "(dt" in plan.split("PartitionFilters: [")[1][:80]


def test_ranges_by_number_of_files(spark, tmp_path):
    zone, trusted = str(tmp_path / "landing"), str(tmp_path / "trusted")
    put(zone, {f"pos/dt=2026-09-{d}/{n}.csv": POS + pos_line(f"{d}{n}") for d in range(10, 15) for n in range(d - 9)})
    manifest = arrival_job(spark, zone, str(tmp_path / "manifest"))
    spans = day_ranges(manifest, 5)
    assert spans == [(None, "2026-09-11"), ("2026-09-12", "2026-09-12"), ("2026-09-13", "2026-09-13"), ("2026-09-14", None)]
    run = sales_job_in_ranges(spark, zone, trusted, manifest, files_at_once=5)
    assert run.rows == 15 and content(run.sales) == content(sales_job(spark, zone, str(tmp_path / "one"), manifest=manifest).sales)
    for name in os.listdir(os.path.join(zone, "pos/dt=2026-09-14")):
        os.remove(os.path.join(zone, "pos/dt=2026-09-14", name))
    run = sales_job_in_ranges(spark, zone, trusted, manifest, files_at_once=5)
    assert run.rows == 10 and {r.dt for r in run.sales.collect()} == {f"2026-09-{d}" for d in range(10, 14)}
    with pytest.raises(NoInput):
        sales_job_in_ranges(spark, str(tmp_path / "nowhere"), trusted, manifest)


def test_newest_snapshot_is_looked_for_from_above(spark, tmp_path):
    zone = str(tmp_path)
    assert raw.latest_snapshot(spark, zone + "/customers") is None
    put(zone, {"customers/dt=2026-09-21/c.txt": "x", "customers/dt=2026-09-28/c.txt": "", "customers/dt=2026-10-05/_c.txt": "x"})
    assert raw.latest_snapshot(spark, zone + "/customers") == "2026-09-21"


def outcome(frames):
    return [content(frame) for frame in frames]


@pytest.mark.parametrize("most", [30, 1])
def test_gate_kept_up_to_date(spark, tmp_path, monkeypatch, most):
    """Ids that become repeated, and unique again, change rows of other days; the other days are left alone."""
    monkeypatch.setattr(gate_plans, "MOST_RUNS", most)
    zone, trusted = str(tmp_path / "raw"), str(tmp_path / "trusted")
    put(zone, {f"pos/dt=2026-09-{d}/a.csv": POS + pos_line(d) + pos_line(f"{d}x", date="") + pos_line("same" if d in (11, 12) else f"{d}y") for d in range(10, 15)})
    sales_job(spark, zone, trusted)
    keep_gate(spark, trusted)

    def after(day, text):
        put(zone, {f"pos/dt=2026-09-{day}/a.csv": POS + text})
        sales_job(spark, zone, trusted, first_day=f"2026-09-{day}", last_day=f"2026-09-{day}")
        update = update_gate(spark, trusted, f"2026-09-{day}", f"2026-09-{day}")
        sales = tables.read_trusted_sales(spark, trusted)
        full = gate_plans.split_sales(spark, sales, str(tmp_path / "full/sales"), str(tmp_path / "full/quarantine"))
        assert outcome(kept_gate(spark, trusted)) == outcome((full.curated, full.quarantine))
        return [d[-2:] for d in update.days], update.crossed

    assert after(14, pos_line(10) + pos_line(14)) == (["10", "14"], 1)
    assert after(11, pos_line(11)) == (["11", "12"], 1)
    assert after(14, pos_line(14) + pos_line(14)) == (["10", "14"], 2)
    assert after(13, pos_line("new")) == (["13"], 0)
    assert update_gate(spark, trusted, "2026-09-13", "2026-09-13").crossed == 0


def counts_of(spark, trusted):
    rows = versions.read(spark, f"{trusted}/{gate_plans.ID_COUNTS}", gate_plans.COUNTS)
    return sorted((row.sale_id, row.dt, row.n, row.bucket) for row in rows.collect())


def test_counts_of_ids_lie_in_hash_buckets(spark, tmp_path):
    """With each day's contribution; an update reads the buckets of ids with more rows or fewer, after counts in days were laid out anew."""
    zone, trusted = str(tmp_path / "raw"), str(tmp_path / "trusted")
    put(zone, {f"pos/dt=2026-09-{d}/a.csv": POS + "".join(pos_line(f"{d}-{i}") for i in range(40)) + pos_line("same") for d in (10, 11)})
    sales_job(spark, zone, trusted)
    keep_gate(spark, trusted)
    known = counts_of(spark, trusted)
    assert [(day, n) for sale_id, day, n, _ in known if sale_id == "S001-same"] == [("2026-09-10", 1), ("2026-09-11", 1)]
    assert len(known) == 82 and len({(sale_id, bucket) for sale_id, _, _, bucket in known}) == 81
    table = f"{trusted}/{gate_plans.ID_COUNTS}"
    folders = os.listdir(f"{trusted}/{versions.current(spark, table).parts[0].folder}")
    assert {f"bucket={bucket}" for *_, bucket in known} == {name for name in folders if "=" in name}

    one = next(row for row in known if row[0] == "S001-10-7")
    counts = versions.read(spark, table, gate_plans.COUNTS)
    few = gate_plans._in_buckets_of(counts, counts.where(F.col("sale_id") == one[0]))
    assert {row.bucket for row in few.collect()} == {one[3]}
    plan = few._jdf.queryExecution().toString()
    assert "DataFilters: []" in plan and "(bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]

    in_days = counts.select("sale_id", "n", "dt")
    versions.publish(spark, table, [versions.write_run(in_days, table, ("dt",))])  # as tables kept before buckets are
    put(zone, {"pos/dt=2026-09-11/a.csv": POS + pos_line("10-7")})
    sales_job(spark, zone, trusted, first_day="2026-09-11", last_day="2026-09-11")
    update = update_gate(spark, trusted, "2026-09-11", "2026-09-11")
    assert (update.days, update.crossed) == (["2026-09-10", "2026-09-11"], 2)
    now = counts_of(spark, trusted)
    assert [row for row in now if row[0] == one[0]] == [one, (one[0], "2026-09-11", 1, one[3])]
    assert len(now) == 42


def test_kept_gate_has_rows_without_an_id_and_without_a_day(spark, tmp_path):
    """A day of nothing but rows without an id is replaced like others, and rows without a day stay, also where their id becomes repeated."""
    zone, trusted = str(tmp_path / "raw"), str(tmp_path / "trusted")
    no_id = pos_line(0).replace("S001-0", " ", 1)
    put(zone, {
        "pos/dt=2026-09-10/a.csv": POS + pos_line(1) + pos_line(2), "pos/dt=2026-09-11/a.csv": POS + no_id,
        "pos/dt=2026-09-12/a.csv": POS + no_id, f"pos/dt={versions.NO_DAY}/a.csv": POS + pos_line(3) + pos_line(4) + no_id,
    })
    sales_job(spark, zone, trusted)
    keep_gate(spark, trusted)

    def after(files, first, last):
        put(zone, files)
        sales_job(spark, zone, trusted, first_day=first, last_day=last)
        update = update_gate(spark, trusted, first, last)
        sales = tables.read_trusted_sales(spark, trusted)
        full = gate_plans.split_sales(spark, sales, str(tmp_path / "full/sales"), str(tmp_path / "full/quarantine"))
        assert outcome(kept_gate(spark, trusted)) == outcome((full.curated, full.quarantine))
        return [d[-2:] for d in update.days], sales.count(), full.quarantine_rows

    assert after({"pos/dt=2026-09-11/a.csv": POS + no_id + no_id}, "2026-09-11", "2026-09-11") == (["11"], 8, 0)
    assert after({"pos/dt=2026-09-12/a.csv": POS + pos_line(3)}, "2026-09-12", None) == (["12", "__"], 8, 2)
    assert after({"pos/dt=2026-09-12/a.csv": POS + no_id}, None, "2026-09-12") == (["10", "11", "12", "__"], 8, 0)


def test_days_are_replaced_beside_rows_without_a_day(spark, tmp_path):
    table, whole = str(tmp_path / "t"), [(1, "2026-01-01"), (2, "2026-01-02"), (3, None)]
    versions.replace(rows_of(spark, *whole), table, ("dt",))

    def now():
        return sorted(versions.read(spark, table, rows_of(spark).schema).select("k", "dt").collect(), key=lambda row: row.k)

    versions.replace_days(rows_of(spark, (20, "2026-01-02")), table, "2026-01-02", "2026-01-02")
    assert now() == [(1, "2026-01-01"), (3, None), (20, "2026-01-02")]
    versions.replace_days(rows_of(spark, (10, "2026-01-01")), table, "2026-01-01", None)
    assert now() == [(3, None), (10, "2026-01-01")]
    versions.replace_days(rows_of(spark, (5, None)), table, None, None)
    assert now() == [(5, None)]


def test_gate_after_day_range_is_brought_up_to_date_each_time(spark, tmp_path, monkeypatch):
    """The whole table is kept first; then an update follows each of the two replacements of the days."""
    days = [f"{year}-02-03" for year in (1993, 1994, 1995, 1996)]
    lines = [(100 + i, 1 + k % 3, 1 + i % 9, 5 + i, day, 2.0, "A", 10.0) for k, day in enumerate([*days, days[0], days[1], None]) for i in range(k % 3, 30)]
    spark.createDataFrame(
        lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_shipdate string, l_quantity double, l_returnflag string, l_extendedprice double"
    ).withColumn("l_shipdate", F.to_timestamp("l_shipdate")).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    orders = [(200 + i, 7 + i, days[i % 4], 50.0 + i) for i in range(40)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate string, o_totalprice double").withColumn(
        "o_orderdate", F.to_timestamp("o_orderdate")).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    seen = []

    def watched(name):
        act = getattr(gate_plans, name)

        def run(spark, trusted, *span):
            act(spark, trusted, *span)
            sales = tables.read_trusted_sales(spark, trusted)
            rows = sales.groupBy("channel").count().collect()
            full = gate_plans.split_sales(spark, sales, str(tmp_path / "full/sales"), str(tmp_path / "full/quarantine"))
            assert outcome(kept_gate(spark, trusted)) == outcome((full.curated, full.quarantine))
            seen.append((name, dict(rows).get("store"), full.quarantine_rows, span))

        monkeypatch.setattr(gate_plans, name, run)

    watched("keep_gate"), watched("update_gate")
    rows = queries.gate_after_day_range(spark, str(tmp_path)).count()
    span, outside = ("1994-01-01", "1995-12-31"), sum(line[4] not in days[1:3] for line in lines)
    assert [(name, stores) for name, stores, _, _ in seen] == [("keep_gate", len(lines)), ("update_gate", outside), ("update_gate", len(lines))]
    assert [at for *_, at in seen] == [(), span, span]
    assert seen[0][2] == seen[2][2] > seen[1][2] and rows > len(lines)


def test_rows_of_many_days_are_written_without_a_sort(spark, tmp_path):
    rows = spark.range(2000).selectExpr("id", "concat('2026-01-', lpad(cast(id % 20 + 1 AS string), 2, '0')) AS dt")
    table, name = str(tmp_path / "t"), "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    part = versions.write_run(rows.coalesce(1), table, ("dt",))
    assert spark.conf.get(name) == before
    # A sorted writer closes each day's file before it opens the next: rows of a file then come with their day's only, in files of zstd.
    files = spark.read.parquet(f"{tmp_path}/{part.folder}").select(F.input_file_name().alias("f")).distinct().collect()
    assert len(files) == 20 and all(".zstd." in row.f for row in files)
    with versions.unsorted(spark):
        plan = rows._jdf.queryExecution().sparkSession().sessionState().conf().maxConcurrentOutputFileWriters()
    assert plan == versions.OPEN_FILES
