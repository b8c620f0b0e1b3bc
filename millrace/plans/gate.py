"""Quality gate over a stored sales table, and the exports of its two results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from millrace.operators import gate
from millrace.operators.keys import measured, stored
from millrace.schemas import QUARANTINE, SALES, SALES_COLUMNS, TEXT, WHOLE, record, text_record
from millrace.sinks.tables import write_outcomes, write_whole
from millrace.sinks.versions import NO_DAY, Part, current, publish, read, with_days, with_range, write_run
from millrace.sources.landing import in_days
from millrace.sources.raw import folder
from millrace.sources.tables import read_trusted_sales

CURATED_DAYS, QUARANTINE_DAYS = (StructType([*s.fields, *text_record("dt").fields]) for s in (SALES, QUARANTINE))


@dataclass(frozen=True)
class GateRun:
    all_rows: int
    curated_rows: int
    quarantine_rows: int
    curated: DataFrame
    quarantine: DataFrame

    @property
    def balanced(self) -> bool:
        return self.all_rows == self.curated_rows + self.quarantine_rows


def split_sales(
    spark: SparkSession, sales: DataFrame, curated_path: str, quarantine_path: str, partition_by: tuple[str, ...] = ()
) -> GateRun:
    """Write passing rows (partitioned if wanted) and rejects.

    The repeated ids are found first. Then one pass over the stored sales deals every row to its outcome, and both tables
    are published when it is complete. Curated rows in folders of their own columns take a pass for each table.
    """
    duplicates, totals = gate.duplicate_sales(spark, sales), Observation("outcomes")
    counts = [F.count_if(F.col("fail_reasons") == "").alias("curated"), F.count_if(F.col("fail_reasons") != "").alias("quarantine")]
    if not partition_by:
        rows = gate.outcomes(sales, duplicates).observe(totals, F.count("*").alias("n"), *counts)
        write_outcomes(rows, "outcome", {"curated": curated_path, "quarantine": quarantine_path})
        found = totals.get
        n, passed, rejected = found["n"], found["curated"], found["quarantine"]
    else:
        seen = Observation("passed")
        write_whole(gate.curated(sales, duplicates).observe(seen, F.count("*").alias("n")), curated_path, partition_by)
        rows = gate.gated(sales, duplicates).observe(totals, F.count("*").alias("n"), *counts).filter("fail_reasons <> ''")
        write_whole(rows, quarantine_path)
        n, passed, rejected = totals.get["n"], seen.get["n"], totals.get["quarantine"]
    return GateRun(n, passed, rejected, read(spark, curated_path, SALES).select(*SALES_COLUMNS), read(spark, quarantine_path, QUARANTINE))


ID_COUNTS, REPEATED_IDS = "gate_id_counts", "gate_repeated_ids"
COUNTS = record(sale_id=TEXT, n=WHOLE, dt=TEXT, bucket=WHOLE)
#: Says of a version of the counts which buckets it lies in.
IN_BUCKETS = {"buckets": gate.BUCKETS}
#: Runs that the kept gate's tables consist of at most before they are written anew as one.
MOST_RUNS = 30


@dataclass(frozen=True)
class GateUpdate:
    """Days whose rows were looked at again, and ids that have become repeated or are so no more."""

    days: list[str]
    crossed: int


def keep_gate(spark: SparkSession, trusted_zone: str) -> None:
    """The gate over the whole table, in days, with what update_gate() needs to keep it: rows of each id in hash buckets, with what
    each day has of them, and repeated ids."""
    base, sales = folder(trusted_zone), read_trusted_sales(spark, trusted_zone)
    counts = _write_counts(gate.id_counts(sales), base)
    stored = spark.read.schema(COUNTS).parquet(f"{base}{counts.folder}")
    repeated = stored.groupBy("sale_id").agg(F.sum("n").alias("n")).where("n > 1").select("sale_id")
    ids = write_run(repeated, base + REPEATED_IDS)
    duplicates = measured(spark.read.schema("sale_id string").parquet(f"{base}{ids.folder}"), "sale_id")
    made = write_run(gate.outcomes(sales, duplicates, "dt"), base + "sales", ("outcome", "dt"))
    for name, outcome in KEPT_OUTCOMES:
        publish(spark, base + name, [_outcome(spark, base, made, outcome)])
    publish(spark, base + REPEATED_IDS, [ids])
    publish(spark, base + ID_COUNTS, [counts], IN_BUCKETS)


def _write_counts(counts: DataFrame, base: str) -> Part:
    """A run of counts with a folder for each bucket, from where they were counted, and with the first and last of its days."""
    seen, day = Observation("days"), F.coalesce("dt", F.lit(NO_DAY))
    run = write_run(counts.observe(seen, F.min(day).alias("first"), F.max(day).alias("last")), base + ID_COUNTS, ("bucket",))
    days = seen.get
    return Part(run.folder, (days["first"] or "", days["last"] or ""))


KEPT_OUTCOMES = (("quarantine", "quarantine"), ("sales", "curated"))


def _outcome(spark: SparkSession, base: str, run: Part, outcome: str) -> Part:
    """The part of a run that holds an outcome; a folder without rows is made."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}{run.folder}/outcome={outcome}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return Part(f"{run.folder}/outcome={outcome}")


def update_gate(spark: SparkSession, trusted_zone: str, first: str | None, last: str | None) -> GateUpdate:
    """Brings the kept gate up to date after the days from `first` to `last` of sales_conformed were replaced.

    Counted again are only these days, and merged with the other days' counts in the buckets of ids that have more rows now, or
    fewer. Ids whose count has crossed one (repeated now, or no more) name the other days whose rows change; all days
    concerned are dealt to their outcomes again. The counts are published last: an update that fails in between is simply
    run again, from the same counts of before.
    """
    base, sales = folder(trusted_zone), read_trusted_sales(spark, trusted_zone)
    if current(spark, base + ID_COUNTS).note != IN_BUCKETS:
        _counts_made_one(spark, base)
    span = F.coalesce(in_days(F.col("dt"), first, last), F.lit(False))
    known, before = read(spark, base + ID_COUNTS, COUNTS), current(spark, base + ID_COUNTS)
    counts = _write_counts(gate.id_counts(sales.where(span)), base)
    come, gone = spark.read.schema(COUNTS).parquet(f"{base}{counts.folder}"), known.where(span)
    change = stored(spark, gate.changes(gone, come), "changes")
    merged = _in_buckets_of(known, change)
    crossed = stored(spark, gate.crossing(merged, change, measured(change, "sale_id")), "crossed")
    keys = measured(crossed, "sale_id")
    # Rows without an id are in no count, so the days that have been replaced are those of the rows themselves.
    kept = [read(spark, base + name, schema) for name, schema in (("sales", CURATED_DAYS), ("quarantine", QUARANTINE_DAYS))]
    days = sorted(_days(keys.keep(merged.where(~span))).union(*[_days(rows.where(span)) for rows in (sales, *kept)]))

    repeated = read(spark, base + REPEATED_IDS, text_record("sale_id")).join(keys.side(), "sale_id", "left_anti")
    ids = write_run(repeated.union(crossed.where("repeated").select("sale_id")), base + REPEATED_IDS)
    duplicates = measured(spark.read.schema("sale_id string").parquet(f"{base}{ids.folder}"), "sale_id")
    rows = gate.outcomes(sales.where(F.coalesce("dt", F.lit(NO_DAY)).isin(days)), duplicates, "dt")
    made = write_run(rows, base + "sales", ("outcome", "dt"))
    for name, outcome in KEPT_OUTCOMES:
        publish(spark, base + name, with_days(current(spark, base + name), _outcome(spark, base, made, outcome), days))
    publish(spark, base + REPEATED_IDS, [ids])
    publish(spark, base + ID_COUNTS, with_range(before, counts, first, last), IN_BUCKETS)
    if len(current(spark, base + "sales").parts) > MOST_RUNS:
        _made_one(spark, base)
    return GateUpdate(days, crossed.count())


def _in_buckets_of(known: DataFrame, ids: DataFrame) -> DataFrame:
    """The counts in the buckets that the ids fall into; the folders of the others are not read."""
    return known.where(F.col("bucket").isin([row.bucket for row in ids.select("bucket").distinct().toLocalIterator()]))


def _days(rows: DataFrame) -> set[str]:
    """The days of the rows, by their folders' names."""
    return {row.day for row in rows.select(F.coalesce("dt", F.lit(NO_DAY)).alias("day")).distinct().toLocalIterator()}


def _counts_made_one(spark: SparkSession, base: str) -> None:
    """The counts as one run in hash buckets, whether they lay in these or in days, as they once did."""
    known = read(spark, base + ID_COUNTS, record(sale_id=TEXT, n=WHOLE, dt=TEXT))
    publish(spark, base + ID_COUNTS, [_write_counts(gate.in_buckets(known.select("sale_id", "n", "dt")), base)], IN_BUCKETS)


def _made_one(spark: SparkSession, base: str) -> None:
    """The kept gate's tables as one run each."""
    both = [
        read(spark, base + name, schema).select(*SALES_COLUMNS, reasons.alias("fail_reasons"), "dt", F.lit(outcome).alias("outcome"))
        for name, outcome, schema, reasons in (
            ("sales", "curated", CURATED_DAYS, F.lit("")), ("quarantine", "quarantine", QUARANTINE_DAYS, F.col("fail_reasons")),
        )
    ]
    made = write_run(both[0].union(both[1]), base + "sales", ("outcome", "dt"))
    for name, outcome in KEPT_OUTCOMES:
        publish(spark, base + name, [_outcome(spark, base, made, outcome)])
    _counts_made_one(spark, base)


def kept_gate(spark: SparkSession, trusted_zone: str) -> tuple[DataFrame, DataFrame]:
    """Curated and quarantined rows as keep_gate() and update_gate() have left them."""
    base = folder(trusted_zone)
    curated = read(spark, base + "sales", CURATED_DAYS).select(*SALES_COLUMNS)
    return curated, read(spark, base + "quarantine", QUARANTINE_DAYS).select(*QUARANTINE.names)


def gate_job(spark: SparkSession, trusted_zone: str) -> GateRun:
    """Passing rows of `sales_conformed` to sales/, rejects to quarantine/ in the trusted zone."""
    base = folder(trusted_zone)
    return split_sales(spark, read_trusted_sales(spark, trusted_zone), base + "sales", base + "quarantine")


def export_job(
    spark: SparkSession, sales: DataFrame, curated_zone: str, partition_by: tuple[str, ...] = ()
) -> GateRun:
    """Both results to the curated zone."""
    base = folder(curated_zone)
    return split_sales(spark, sales, base + "sales_clean", base + "quarantine", partition_by)


def analyst_view(spark: SparkSession, curated: DataFrame, name: str = "curated_sales") -> DataFrame:
    """The one view analysts read: curated rows, nothing from quarantine or further up."""
    curated.createOrReplaceTempView(name)
    return spark.table(name)
