"""Newest customer snapshot to the conformed customers table."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from millrace.operators.conform import conform_customers
from millrace.operators.reports import CUSTOMERS_PARSED, distinct_customers
from millrace.plans.arrival import accepted_paths
from millrace.plans.sales import run_totals
from millrace.session import pin_session
from millrace.sinks.tables import write_whole
from millrace.sources import raw
from millrace.sources.tables import read_trusted_customers

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class CustomersRun:
    snapshot: str
    rows: int
    parse_errors: dict[str, int]
    customers: DataFrame

    def distinct(self) -> DataFrame:
        return distinct_customers(self.customers)


def customers_job(
    spark: SparkSession, raw_zone: str, trusted_zone: str, manifest: DataFrame | None = None
) -> CustomersRun | None:
    """Replace `customers_conformed` by the newest snapshot; without a snapshot nothing happens.

    With `manifest`, `raw_zone` may be the landing zone: the newest day is used of which files are accepted and
    have not changed since. A snapshot without any row fails before the write, so the old table stays.
    """
    pin_session(spark)
    base = raw.folder(raw_zone) + "customers"
    paths = None
    if manifest is None:
        snapshot = raw.latest_snapshot(spark, base)
    else:
        accepted = accepted_paths(spark, raw_zone, manifest.filter(F.col("source") == "customers")).get("customers", [])
        snapshot = max((dt for dt, _ in accepted), default=None)
        paths = [path for dt, path in accepted if dt == snapshot]
    if snapshot is None:
        log.info("no customer snapshot under %s", base)
        return None
    totals = Observation("customers")
    if paths is None:
        rows = raw.read_snapshot(spark, base, snapshot)
    else:
        rows = raw.read_customers(spark, base, check_header=False, paths=paths)
    if rows.isEmpty():
        raise RuntimeError(f"The customer snapshot {snapshot} holds no rows.")
    conformed = conform_customers(rows, snapshot)
    write_whole(
        conformed.observe(totals, *run_totals(CUSTOMERS_PARSED)), raw.folder(trusted_zone) + "customers_conformed/"
    )
    counts = dict(totals.get)
    run = CustomersRun(snapshot, counts.pop("rows"), counts, read_trusted_customers(spark, trusted_zone))
    log.info("snapshot %s: wrote %d rows, parse errors %s", snapshot, run.rows, run.parse_errors)
    return run
