"""Raw sales files to the conformed sales table."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from millrace.functions.numbers import USD_TO_CAD
from millrace.operators.arrival import ACCEPTED
from millrace.operators.conform import conform_ecommerce, conform_pos
from millrace.operators.reports import SALES_PARSED, has_parse_error, rows_per
from millrace.plans.arrival import accepted_paths
from millrace.schemas import POS_HEADER
from millrace.session import pin_session
from millrace.sinks.tables import has_file_log, rebalanced, write_by_day
from millrace.sinks.versions import current as read_version
from millrace.sources import raw
from millrace.sources.landing import in_days
from millrace.sources.tables import read_trusted_sales

log = logging.getLogger(__name__)


#: Paths on the driver at a time when a job runs in ranges.
FILES_AT_ONCE = 100_000


class NoInput(RuntimeError):
    """There is nothing to conform; nothing has been written."""


@dataclass(frozen=True)
class SalesRun:
    """What a run wrote: row count, rows per column that could not be converted, skipped JSON lines."""

    rows: int
    parse_errors: dict[str, int]
    bad_lines: int
    sales: DataFrame

    def by_channel(self) -> DataFrame:
        return rows_per(self.sales, "channel")


def run_totals(names: tuple[str, ...]) -> list[Column]:
    return [F.count("*").alias("rows"), *[F.count_if(has_parse_error(name)).alias(name) for name in names]]


def sales_job(
    spark: SparkSession,
    raw_zone: str,
    trusted_zone: str,
    usd_to_cad: str = USD_TO_CAD,
    sources: tuple[str, ...] = ("pos", "ecommerce"),
    compact: bool = False,
    manifest: DataFrame | None = None,
    pos_header: tuple[str, ...] | None = POS_HEADER,
    first_day: str | None = None,
    last_day: str | None = None,
) -> SalesRun:
    """Conform all raw sales and replace `sales_conformed`.

    A source without files is skipped. Input without any row fails before the write, so it never
    replaces good output. Reading, conforming, counting and writing are one pass over the files; nothing
    is cached. With `manifest`, `raw_zone` may be the landing zone itself: only the files the arrival check
    accepted, and that have not changed since, are opened. `pos_header` is the header that check was given;
    None takes each file's own (of a raw zone). With `first_day` or `last_day` (as in dt) only the folders of these days are
    listed and read, and only these days of `sales_conformed` are replaced; `sales` of the run is the whole table.
    """
    pin_session(spark)
    base, target = raw.folder(raw_zone), raw.folder(trusted_zone) + "sales_conformed/"
    if has_file_log(spark, target):
        raise RuntimeError(f"{target} belongs to a file stream: what is written beside its log would not be read.")
    found = {}
    if manifest is not None:
        accepted = accepted_paths(spark, raw_zone, manifest, first_day, last_day)
        readers = {
            "pos": lambda paths: raw.read_pos(spark, base + "pos", False, pos_header or POS_HEADER, paths),
            "ecommerce": lambda paths: raw.read_order_lines(spark, base + "ecommerce", paths),
        }
        for source in sources:
            if source in accepted:
                found[source] = readers[source]([path for _, path in accepted[source]])
    else:
        readers = {
            "pos": lambda path: raw.read_pos(spark, path, header=pos_header) if pos_header else raw.read_pos_variants(spark, path, first_day, last_day),
            "ecommerce": lambda path: raw.read_order_lines(spark, path),
        }
        for source in sources:
            if raw.source_exists(spark, base + source):
                found[source] = readers[source](base + source).where(in_days(F.col("dt"), first_day, last_day))
            else:
                log.info("no dated folders under %s%s, source skipped", base, source)
    if not found:
        raise NoInput(f"No input under {base}.")
    if all((raw.valid_orders(rows) if source == "ecommerce" else rows).isEmpty() for source, rows in found.items()):
        raise NoInput(f"The input folders under {base} hold no rows.")

    totals, bad_lines = Observation("sales"), Observation("lines")
    parts = []
    if "pos" in found:
        parts.append(conform_pos(found["pos"]))
    if "ecommerce" in found:
        parts.append(conform_ecommerce(raw.valid_orders(found["ecommerce"], bad_lines), usd_to_cad))
    sales = rebalanced(raw.union_by_name(parts)) if compact else raw.union_by_name(parts)
    # Observed in the stage that writes, whose tasks count once even when they are run again.
    sales = sales.observe(totals, *run_totals(SALES_PARSED))
    write_by_day(sales, target, first_day, last_day)

    counts = dict(totals.get)
    run = SalesRun(
        rows=counts.pop("rows"),
        parse_errors=counts,
        bad_lines=bad_lines.get["bad_lines"] if "ecommerce" in found else 0,
        sales=read_trusted_sales(spark, trusted_zone),
    )
    log.info("wrote %d rows, parse errors %s, skipped JSON lines %d", run.rows, run.parse_errors, run.bad_lines)
    return run


def day_ranges(manifest: DataFrame, files_at_once: int) -> list[tuple[str | None, str | None]]:
    """Ranges of days, one after the other and open at both ends, each with at most so many accepted files (a day with more is
    a range of its own). One row a day reaches the driver."""
    accepted = manifest.where((F.col("status") == ACCEPTED) & F.col("dt").isNotNull())
    per_day = accepted.groupBy("dt").agg(F.count_distinct("path").alias("n")).orderBy("dt").toLocalIterator()
    last_days, held, before = [], 0, None
    for day, n in per_day:
        if held and held + n > files_at_once:
            last_days.append(before)
            held = 0
        held, before = held + n, day
    # The last range is open, so that days which have no files any more go.
    firsts = [None, *[(date.fromisoformat(day) + timedelta(days=1)).isoformat() for day in last_days]]
    return list(zip(firsts, [*last_days, None]))


def sales_job_in_ranges(
    spark: SparkSession, landing_zone: str, trusted_zone: str, manifest: DataFrame, files_at_once: int = FILES_AT_ONCE, **options
) -> SalesRun:
    """sales_job straight from the landing zone, in ranges of days, so that no more than `files_at_once` paths (or one day's) are on the
    driver at a time. Ranges without rows are left out, but their old rows go. Options as of sales_job."""
    runs = []
    for first, last in day_ranges(manifest, files_at_once):
        try:
            runs.append(sales_job(spark, landing_zone, trusted_zone, manifest=manifest, first_day=first, last_day=last, **options))
        except NoInput:
            log.info("days %s to %s hold no rows", first, last)
            if read_version(spark, raw.folder(trusted_zone) + "sales_conformed"):
                empty = read_trusted_sales(spark, trusted_zone).limit(0)
                write_by_day(empty, raw.folder(trusted_zone) + "sales_conformed", first, last)
    if not runs:
        raise NoInput(f"No input under {landing_zone}.")
    totals = {name: sum(run.parse_errors[name] for run in runs) for name in runs[0].parse_errors}
    return SalesRun(sum(run.rows for run in runs), totals, sum(run.bad_lines for run in runs), read_trusted_sales(spark, trusted_zone))


def pos_job(spark: SparkSession, raw_zone: str, trusted_zone: str) -> SalesRun:
    """The same for store sales alone, which the SQL path starts from."""
    return sales_job(spark, raw_zone, trusted_zone, sources=("pos",))
