"""The registered queries: every operator and job over feeds derived from the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace import feeds, schemas
from millrace.functions.dates import file_name_date
from millrace.operators import arrival, conform, gate, profile, reports, sqlpath
from millrace.operators.keys import stored
from millrace.plans import arrival as arrival_plans
from millrace.plans import customers as customer_plans
from millrace.plans import gate as gate_plans
from millrace.plans import sales as sales_plans
from millrace.plans import sqlpath as sqlpath_plans
from millrace.session import pin_session, shared_folder
from millrace.sinks.versions import read, unsorted
from millrace.sources import landing, raw, tables
from millrace.streaming import arrival as arrival_stream
from millrace.streaming import conform as conform_stream

Query = Callable[[SparkSession, str], DataFrame]

NEWEST_SNAPSHOT = "2026-09-28"
LINEAGE = ("source_file", "ingested_at")
#: Files of raw zones are compressed and read by one task each, so their rows are bounded.
PACKED = {"compression": "gzip"}
ROWS_PER_FILE = 2_000_000
#: Bytes of a landing file in memory when it is rewritten.
CHUNK = 1 << 20


# ---- shared inputs

def pos_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform.conform_pos(feeds.raw_pos(spark, sf_dir)).drop(*LINEAGE)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.valid_orders(feeds.order_lines(spark, sf_dir))


def ecommerce_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform.conform_ecommerce(orders(spark, sf_dir)).drop(*LINEAGE)


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pos_sales(spark, sf_dir).unionByName(ecommerce_sales(spark, sf_dir))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = raw.newest_rows(feeds.raw_customers(spark, sf_dir))
    return conform.conform_customers(newest, F.col("dt")).drop(*LINEAGE)


def flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sqlpath.flatten_orders(orders(spark, sf_dir))


def sales_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sqlpath.combine_sales(pos_sales(spark, sf_dir), flattened(spark, sf_dir))


def _over(source: Query, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(source(spark, sf_dir))


def _gated(source: Query, operator) -> Query:
    """Gate outputs over stored sales, as in the pipeline: repeated ids first, then the rows."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = stored(spark, source(spark, sf_dir), "sales")
        return operator(rows, gate.duplicate_sales(spark, rows))

    return query


# ---- reports over several sources

def rows_by_dt(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = {
        "pos": feeds.raw_pos(spark, sf_dir),
        "ecommerce": orders(spark, sf_dir),
        "customers": feeds.raw_customers(spark, sf_dir),
    }
    counts = [
        rows.groupBy("dt").agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "dt", "n")
        for name, rows in sources.items()
    ]
    return raw.union_by_name(counts).orderBy("source", "dt")


def orders_in_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.rows_per(raw.in_date_range(orders(spark, sf_dir), "1998-01-01", "1999-12-31"), "dt")


def orphan_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.unknown_customer_counts(sales(spark, sf_dir), customers(spark, sf_dir))


def orphan_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(spark, sales(spark, sf_dir), "sales")
    return reports.unknown_customer_sales(spark, rows, customers(spark, sf_dir))


def issue_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.issue_profile(feeds.raw_pos(spark, sf_dir), orders(spark, sf_dir), feeds.raw_customers(spark, sf_dir))


def curated_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(spark, sales(spark, sf_dir), "sales")
    gate_plans.analyst_view(spark, gate.curated(rows, gate.duplicate_sales(spark, rows)))
    return spark.sql(
        "SELECT category, count(*) AS n, sum(quantity) AS units FROM curated_sales GROUP BY category"
    )


def filename_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.split("key", "/"), -1)
    return feeds.file_heads(spark, sf_dir).select(name.alias("file_name"), file_name_date(name).alias("dt"))


def arrival_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrival.manifest(feeds.file_heads(spark, sf_dir)).drop("path", "modified", "checked_at")


def sending_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads, landed = feeds.file_heads(spark, sf_dir), feeds.landed_files(spark, sf_dir)
    return arrival.sending_list(heads, landed, tuple(arrival.FORMATS))


# ---- whole zones on files

def _by_day(rows: DataFrame, **options):
    """Writer of dated folders, from where the rows lie: each task adds a file to each of its days, with so many rows at most that
    it can be read whole where it is compressed."""
    return rows.write.mode("append").partitionBy("dt").option("maxRecordsPerFile", ROWS_PER_FILE).options(**options)


def _file_a_task(rows: DataFrame, **options):
    """Writer of dated folders with one file each out of rows that have their days apart, so that files can be counted."""
    return rows.write.mode("append").partitionBy("dt").options(**options)


def _write_csv(rows: DataFrame, path: str, write=_by_day, **options) -> None:
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    with unsorted(rows.sparkSession):
        write(rows, header=True, **kept, **options).csv(path)


def _write_orders(text: DataFrame, path: str) -> None:
    with unsorted(text.sparkSession):
        _by_day(text, **PACKED).text(path)


def write_landing(spark: SparkSession, sf_dir: str) -> str:
    """Landing zone with the derived feeds as files. Second quarters of sales come broken."""
    zone = shared_folder(spark, "landing")
    broken = F.substr(F.col("dt"), F.lit(6), F.lit(2)) == "04"
    pos = feeds.raw_pos(spark, sf_dir, apart=True)
    _write_csv(pos.filter(~broken), f"{zone}/pos", _file_a_task)
    _write_csv(pos.filter(broken).select(*reversed(schemas.POS_HEADER), "dt"), f"{zone}/pos", _file_a_task)
    documents = feeds.order_documents(spark, sf_dir, apart=True).select(*schemas.ORDER.names, "dt")
    with unsorted(spark):
        _file_a_task(documents.filter(~broken), ignoreNullFields=False).json(f"{zone}/ecommerce")
        _file_a_task(documents.filter(broken).drop("items"), ignoreNullFields=False).json(f"{zone}/ecommerce")
    _write_csv(feeds.raw_customers(spark, sf_dir, apart=True), f"{zone}/customers", _file_a_task, sep="|", extension="txt")
    spark.createDataFrame([], "value string").coalesce(1).write.text(f"{zone}/customers/dt=2026-10-05")
    header = spark.createDataFrame([("|".join(schemas.CUSTOMER_HEADER),)], "value string")
    header.coalesce(1).write.text(f"{zone}/customers/dt=2026-10-12")
    return zone


def write_raw(spark: SparkSession, sf_dir: str, sources: tuple[str, ...] = ("pos", "ecommerce", "customers")) -> str:
    """Raw zone with the derived feeds as accepted files, compressed."""
    zone = shared_folder(spark, "raw")
    if "pos" in sources:
        _write_csv(feeds.raw_pos(spark, sf_dir), f"{zone}/pos", **PACKED)
    if "ecommerce" in sources:
        _write_orders(feeds.order_text(spark, sf_dir), f"{zone}/ecommerce")
    if "customers" in sources:
        _write_csv(feeds.raw_customers(spark, sf_dir), f"{zone}/customers", sep="|", **PACKED)
    return zone


def _verdict_days(files: DataFrame) -> DataFrame:
    """File names differ from run to run, so the verdicts are counted per day: a file that is missed or checked twice shows."""
    return files.groupBy("source", "dt", "status", "reason").agg(F.count("*").alias("files"))


def arrival_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = arrival_plans.arrival_job(spark, write_landing(spark, sf_dir), shared_folder(spark, "manifest"))
    return _verdict_days(files)


def arrival_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = arrival_plans.check_landing(spark, write_landing(spark, sf_dir))
    return arrival.arrival_summary(files)


def arrival_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In batches of a few files each, which list the folders they touch; the batch job finds the day of nothing but an empty file."""
    zone, manifest = write_landing(spark, sf_dir), shared_folder(spark, "manifest")
    arrival_stream.watch_landing(spark, zone, manifest, shared_folder(spark, "offsets"), files_per_batch=25).awaitTermination()
    return _verdict_days(arrival_plans.arrival_job(spark, zone, manifest))


def arrival_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts after files have changed, the log has been compacted and the job has run again: as the last ones before."""
    zone, manifest = write_landing(spark, sf_dir), shared_folder(spark, "manifest")
    arrival_plans.arrival_job(spark, zone, manifest)
    _rewritten(spark, zone, "pos", "....-07-..", "quantity,unit_price", "unit_price,quantity")
    arrival_plans.arrival_job(spark, zone, manifest)
    arrival_plans.compact_manifest(spark, manifest)
    return _verdict_days(arrival_plans.arrival_job(spark, zone, manifest))


def sales_job_in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sales job straight from the landing zone, a few files at a time."""
    zone = write_landing(spark, sf_dir)
    manifest = arrival_plans.arrival_job(spark, zone, shared_folder(spark, "manifest"))
    run = sales_plans.sales_job_in_ranges(spark, zone, shared_folder(spark, "trusted"), manifest, files_at_once=15, sources=("pos",))
    return run.sales.drop(*LINEAGE)


def _expect_failure(run: Callable[[], object]) -> None:
    try:
        run()
    except Exception as error:
        if "FAILED_READ_FILE" not in str(error) and "header" not in str(error):
            raise
    else:
        raise RuntimeError("The run should have failed.")


def _add_bad_file(spark: SparkSession, sf_dir: str, zone: str) -> None:
    """A later day of store sales with its columns the other way round, at which a run fails while it writes."""
    rows = feeds.raw_pos(spark, sf_dir).filter("dt LIKE '%-04-%'").withColumn("dt", F.lit("2031-01-01"))
    _write_csv(rows.select(*reversed(schemas.POS_HEADER), "dt"), f"{zone}/pos")


def sales_after_failed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A good run, then one that fails in the middle: the table is that of the good one."""
    zone, trusted = write_raw(spark, sf_dir, ("pos", "ecommerce")), shared_folder(spark, "trusted")
    sales_plans.sales_job(spark, zone, trusted)
    _add_bad_file(spark, sf_dir, zone)
    _expect_failure(lambda: sales_plans.sales_job(spark, zone, trusted))
    return tables.read_trusted_sales(spark, trusted).drop(*LINEAGE)


def customers_after_failed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone, trusted = write_raw(spark, sf_dir, ("customers",)), shared_folder(spark, "trusted")
    customer_plans.customers_job(spark, zone, trusted)
    bad = feeds.raw_customers(spark, sf_dir).withColumn("dt", F.lit("2031-01-01"))
    _write_csv(bad.select(*reversed(schemas.CUSTOMER_HEADER), "dt"), f"{zone}/customers", sep="|")
    _expect_failure(lambda: customer_plans.customers_job(spark, zone, trusted))
    return tables.read_trusted_customers(spark, trusted).drop(*LINEAGE)


def gate_after_failed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both outcomes after a gate run over rows that cannot be read to the end."""
    zone, trusted = write_raw(spark, sf_dir, ("pos", "ecommerce")), shared_folder(spark, "trusted")
    sales_plans.sales_job(spark, zone, trusted)
    gate_plans.gate_job(spark, trusted)
    _add_bad_file(spark, sf_dir, zone)
    unreadable = conform.conform_pos(raw.read_pos(spark, f"{zone}/pos"))
    _expect_failure(lambda: gate_plans.split_sales(spark, unreadable, f"{trusted}/sales", f"{trusted}/quarantine"))
    run = {name: read(spark, f"{trusted}/{name}", schema) for name, schema in (("sales", schemas.SALES), ("quarantine", schemas.QUARANTINE))}
    return _outcomes(run["sales"], run["quarantine"])


def gate_after_day_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept gate after the days of two years came first without store sales, then whole again, each time brought up to date by days."""
    zone, trusted = write_raw(spark, sf_dir, ("pos", "ecommerce")), shared_folder(spark, "trusted")
    sales_plans.sales_job(spark, zone, trusted)
    gate_plans.keep_gate(spark, trusted)
    span = {"first_day": "1994-01-01", "last_day": "1995-12-31"}
    for sources in (("ecommerce",), ("pos", "ecommerce")):
        sales_plans.sales_job(spark, zone, trusted, sources=sources, **span)
        gate_plans.update_gate(spark, trusted, *span.values())
    return _outcomes(*gate_plans.kept_gate(spark, trusted))


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the sales table by the source and day their lineage names; a row whose file lies elsewhere, or without a time, shows."""
    zone = write_raw(spark, sf_dir, ("pos", "ecommerce"))
    rows = sales_plans.sales_job(spark, zone, shared_folder(spark, "trusted")).sales
    of = F.regexp_extract("source_file", "/(pos|ecommerce)/dt=([^/]+)/[^/]+$", 1), F.regexp_extract("source_file", "/(pos|ecommerce)/dt=([^/]+)/[^/]+$", 2)
    named = rows.select(of[0].alias("source"), of[1].alias("folder_day"), "dt", F.col("ingested_at").isNotNull().alias("timed"))
    return named.groupBy("source", "folder_day", "dt", "timed").agg(F.count("*").alias("n"))


def accepted_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store sales read from the landing zone itself; the files the check rejected are never opened."""
    zone = write_landing(spark, sf_dir)
    accepted = arrival_plans.accepted_paths(spark, zone, arrival_plans.check_landing(spark, zone))
    rows = raw.read_pos(spark, f"{zone}/pos", check_header=False, paths=[path for _, path in accepted["pos"]])
    return reports.rows_per(rows, "dt")


def raw_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = tables.register_raw(spark, write_raw(spark, sf_dir))
    # All fields of each view take part, so a wrong value shows.
    columns = {
        "raw_pos": ", ".join(schemas.POS_HEADER), "raw_customers": ", ".join(schemas.CUSTOMER_HEADER),
        **dict.fromkeys(("raw_ecommerce", "ecommerce_orders"), "orderId, orderTimestamp, channel, currency, customer.customerId, customer.guest, "
                        "shippingAddress.province, shippingAddress.country, size(items)"),
    }
    return raw.union_by_name([
        spark.sql(f"""SELECT '{name}' AS name, line, count(*) AS n FROM (SELECT concat_ws('|', {", ".join(f"coalesce(cast({c.strip()} AS string), '~')" for c in columns[name].split(","))}) AS line FROM {name})
        GROUP BY line""") for name in names
    ])


def sales_job_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = write_raw(spark, sf_dir, ("pos", "ecommerce"))
    return sales_plans.sales_job(spark, zone, shared_folder(spark, "trusted")).sales.drop(*LINEAGE)


def pos_job_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = write_raw(spark, sf_dir, ("pos",))
    return sales_plans.pos_job(spark, zone, shared_folder(spark, "trusted")).sales.drop(*LINEAGE)


def customers_job_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = write_raw(spark, sf_dir, ("customers",))
    return customer_plans.customers_job(spark, zone, shared_folder(spark, "trusted")).customers.drop(*LINEAGE)


def stream_sales_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone, trusted = write_raw(spark, sf_dir, ("pos", "ecommerce")), shared_folder(spark, "trusted")
    conform_stream.append_sales(
        conform_stream.stream_sales(spark, zone), f"{trusted}/sales_conformed", shared_folder(spark, "offsets")
    ).awaitTermination()
    return tables.read_trusted_sales(spark, trusted).drop(*LINEAGE)


def stream_after_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second halves of the years by the batch job, the rest by the stream into the same table."""
    first, second, trusted = shared_folder(spark, "raw"), shared_folder(spark, "raw"), shared_folder(spark, "trusted")
    late = F.substr(F.col("dt"), F.lit(6), F.lit(2)) >= "07"
    for zone, part in ((first, late), (second, ~late)):
        _write_csv(feeds.raw_pos(spark, sf_dir).filter(part), f"{zone}/pos", **PACKED)
        _write_orders(feeds.order_text(spark, sf_dir).filter(part), f"{zone}/ecommerce")
    sales_plans.sales_job(spark, first, trusted)
    offsets = shared_folder(spark, "offsets")
    for _ in range(2):  # the second run finds nothing new
        conform_stream.append_sales(
            conform_stream.stream_sales(spark, second), f"{trusted}/sales_conformed", offsets
        ).awaitTermination()
    return tables.read_trusted_sales(spark, trusted).drop(*LINEAGE)


def pos_job_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw zone of files with blanks in the header, without the payment type, and in another order."""
    zone, rows, month = shared_folder(spark, "raw"), feeds.raw_pos(spark, sf_dir), F.substr(F.col("dt"), F.lit(6), F.lit(2))
    spaced = [F.col(name).alias(f" {name} ") for name in schemas.POS_HEADER]
    _write_csv(rows.filter(month == "01").select(*spaced, "dt"), f"{zone}/pos")
    _write_csv(rows.filter(month == "04").drop("payment_type"), f"{zone}/pos")
    _write_csv(rows.filter(month == "07").select(*reversed(schemas.POS_HEADER), "dt"), f"{zone}/pos")
    _write_csv(rows.filter(month == "10"), f"{zone}/pos")
    return sales_plans.sales_job(spark, zone, shared_folder(spark, "trusted"), sources=("pos",), pos_header=None).sales.drop(*LINEAGE)


def _first_line(source, target, chunk: int = CHUNK) -> None:
    """Copies the first line of a stream, with a line end."""
    part, end = source.read(chunk), b""
    while part and not end:
        line, end, _ = part.partition(b"\n")
        target.write(line)
        part = b"" if end else source.read(chunk)
    target.write(b"\n")


def _first_replaced(source, target, old: bytes, new: bytes, chunk: int = CHUNK) -> None:
    """Copies a stream with `new` for the first `old`, which may lie across chunks."""
    held, done = b"", False
    while part := source.read(chunk):
        held += part
        if not done and old in held:
            held, done = held.replace(old, new, 1), True
        kept = 0 if done else min(len(held), len(old) - 1)
        target.write(held[: len(held) - kept])
        held = held[len(held) - kept:]
    target.write(held)


def _rewritten(spark: SparkSession, zone: str, source: str, day: str, old: str, new: str, cut: bool = False) -> None:
    """Rewrites the files of a source whose day matches, in tasks: `old` for `new`, or nothing after the first line.

    A file goes chunk by chunk into a hidden one beside it, which then takes its place."""

    def rewrite(batches):
        from pyarrow import fs

        for batch in batches:
            for path in batch["path"]:
                store, name = fs.FileSystem.from_uri(landing._arrow_uri(path))
                parent, _, last = name.rpartition("/")
                made = f"{parent}/.{last}.rewritten"
                with store.open_input_stream(name) as source, store.open_output_stream(made) as target:
                    _first_line(source, target) if cut else _first_replaced(source, target, old.encode(), new.encode())
                store.move(made, name)
            yield batch[["path"]]

    files = landing.list_files(spark, zone).where(F.col("key").rlike(f"^{source}/dt={day}/") & (F.col("size") > 0))
    files.select("path").mapInPandas(rewrite, "path string").write.format("noop").mode("overwrite").save()


def arrival_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted files of third quarters are replaced by ones of the same size with two columns changed over: last verdicts."""
    zone, manifest = write_landing(spark, sf_dir), shared_folder(spark, "manifest")
    arrival_plans.arrival_job(spark, zone, manifest)
    _rewritten(spark, zone, "pos", "....-07-..", "quantity,unit_price", "unit_price,quantity")
    return _verdict_days(arrival.last_verdicts(arrival_plans.arrival_job(spark, zone, manifest)))


def customers_after_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest accepted snapshot is replaced by header lines: the one before is conformed."""
    zone, manifest, trusted = shared_folder(spark, "landing"), shared_folder(spark, "manifest"), shared_folder(spark, "trusted")
    _write_csv(feeds.raw_customers(spark, sf_dir), f"{zone}/customers", sep="|", extension="txt")
    customer_plans.customers_job(spark, zone, trusted, arrival_plans.arrival_job(spark, zone, manifest))
    _rewritten(spark, zone, "customers", NEWEST_SNAPSHOT, "", "", cut=True)
    run = customer_plans.customers_job(spark, zone, trusted, arrival_plans.arrival_job(spark, zone, manifest))
    return run.customers.drop(*LINEAGE)


def export_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated output in folders of channels, read back."""
    trusted, curated_zone = shared_folder(spark, "trusted"), shared_folder(spark, "curated")
    sales_plans.sales_job(spark, write_raw(spark, sf_dir, ("pos", "ecommerce")), trusted)
    gate_plans.export_job(spark, tables.read_trusted_sales(spark, trusted), curated_zone, ("channel",))
    return read(spark, f"{curated_zone}/sales_clean", schemas.SALES).select(*schemas.SALES_COLUMNS)


def sales_run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sales job reports about its run: rows, rows per column that was not converted, bad lines."""
    run = sales_plans.sales_job(spark, write_raw(spark, sf_dir, ("pos", "ecommerce")), shared_folder(spark, "trusted"))
    counts = {"rows": run.rows, **run.parse_errors, "bad_lines": run.bad_lines}
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{name} bigint" for name in counts))


def _outcomes(curated: DataFrame, quarantine: DataFrame) -> DataFrame:
    return raw.union_by_name([
        rows.select(F.lit(outcome).alias("outcome"), *schemas.SALES_COLUMNS)
        for outcome, rows in (("curated", curated), ("quarantine", quarantine))
    ])


def gate_job_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = shared_folder(spark, "trusted")
    sales_plans.sales_job(spark, write_raw(spark, sf_dir, ("pos", "ecommerce")), trusted)
    run = gate_plans.gate_job(spark, trusted)
    return _outcomes(run.curated, run.quarantine)


def _sql_path(spark: SparkSession, sf_dir: str, database: str) -> DataFrame:
    zone, trusted = write_raw(spark, sf_dir, ("pos", "ecommerce")), shared_folder(spark, "trusted")
    sales_plans.pos_job(spark, zone, trusted)
    return sqlpath_plans.sql_path_job(spark, zone, trusted, database, tables_path=shared_folder(spark, "tables"))


@contextmanager
def own_database(spark: SparkSession):
    """A database of the run's own, so that no other tables are touched; it goes when its results are written."""
    name = f"millrace_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name}")
    try:
        yield name
    finally:
        spark.sql(f"DROP DATABASE {name} CASCADE")


def sql_path_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    with own_database(spark) as database:
        counts = _sql_path(spark, sf_dir, database)
        return spark.createDataFrame(counts.collect(), counts.schema)  # one row


def export_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    curated_zone = shared_folder(spark, "curated")
    with own_database(spark) as database:
        _sql_path(spark, sf_dir, database)
        sqlpath_plans.export_tables(spark, curated_zone, database)
    return _outcomes(
        read(spark, f"{curated_zone}/sales_clean"), read(spark, f"{curated_zone}/quarantine")
    )


QUERIES: dict[str, Query] = {
    "conform_pos": pos_sales,
    "conform_ecommerce": ecommerce_sales,
    "conform_customers": customers,
    "sales_conformed_union": sales,
    "rows_by_channel": _over(sales, lambda rows: reports.rows_per(rows, "channel")),
    "rows_by_parse_errors": _over(sales, lambda rows: reports.rows_per(rows, "parse_errors")),
    "parse_error_counts": _over(sales, reports.parse_error_counts),
    "customer_parse_errors": _over(
        customers, lambda rows: reports.parse_error_counts(rows, reports.CUSTOMERS_PARSED)
    ),
    "rows_by_dt": rows_by_dt,
    "orders_in_date_range": orders_in_date_range,
    "bad_json_lines": _over(feeds.order_lines, reports.bad_line_counts),
    "rejected_json_lines": _over(
        feeds.order_lines, lambda lines: reports.rows_per(raw.rejected_order_lines(lines), "dt")
    ),
    "customer_distinct": _over(customers, reports.distinct_customers),
    "ecommerce_flatten_sql": flattened,
    "sales_all_sql": sales_sql,
    "quarantine_sql": _gated(sales_sql, gate.quarantine),
    "curated_sql": _gated(sales_sql, gate.curated),
    "reconcile_sql": _over(sales_sql, reports.reconcile),
    "order_items": _over(orders, reports.order_items),
    "duplicate_ids": _over(sales, reports.duplicate_ids),
    "duplicate_summary": _over(sales, reports.duplicate_summary),
    "quarantine": _gated(sales, gate.quarantine),
    "curated": _gated(sales, gate.curated),
    "reconcile_store": _over(pos_sales, reports.reconcile),
    "reconcile": _over(sales, reports.reconcile),
    "curated_revenue": _over(sales, reports.curated_revenue),
    "rule_counts": _over(sales, reports.rule_counts),
    "rule_new_counts": _over(sales, reports.rule_new_counts),
    "orphan_customers": orphan_customers,
    "orphan_sales": orphan_sales,
    "issue_profile": issue_profile,
    "file_issues": _over(arrival_verdicts, profile.file_issues),
    "curated_view": curated_view,
    "filename_dates": filename_dates,
    "arrival_verdicts": arrival_verdicts,
    "sending_plan": sending_plan,
    "sending_summary": _over(sending_plan, arrival.sending_summary),
    "arrival_manifest": arrival_manifest,
    "arrival_summary": arrival_summary,
    "arrival_stream": arrival_streamed,
    "arrival_compacted": arrival_compacted,
    "sales_job_in_ranges": sales_job_in_ranges,
    "sales_after_failed_run": sales_after_failed_run,
    "customers_after_failed_run": customers_after_failed_run,
    "gate_after_failed_run": gate_after_failed_run,
    "gate_after_day_range": gate_after_day_range,
    "lineage": lineage,
    "accepted_sales": accepted_sales,
    "raw_views": raw_views,
    "sales_job_roundtrip": sales_job_roundtrip,
    "pos_job_roundtrip": pos_job_roundtrip,
    "customers_job_roundtrip": customers_job_roundtrip,
    "stream_sales_roundtrip": stream_sales_roundtrip,
    "stream_after_batch": stream_after_batch,
    "pos_job_variants": pos_job_variants,
    "arrival_recheck": arrival_recheck,
    "customers_after_reject": customers_after_reject,
    "export_by_channel": export_by_channel,
    "sales_run_totals": sales_run_totals,
    "gate_job_roundtrip": gate_job_roundtrip,
    "sql_path_roundtrip": sql_path_roundtrip,
    "export_roundtrip": export_roundtrip,
}


def _pinned(query: Query) -> Query:
    return lambda spark, sf_dir: query(pin_session(spark), sf_dir)


def queries() -> dict[str, Query]:
    return {name: _pinned(query) for name, query in QUERIES.items()}
