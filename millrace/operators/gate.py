"""Quality gate: five rules, rows to curated or quarantine, and the sums over both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.functions import rules
from millrace.operators.keys import BROADCAST_LIMIT, KeySet, repeated_keys, settle
from millrace.schemas import SALES_COLUMNS


#: Hash buckets that the stored counts of ids lie in.
BUCKETS = 32


def duplicate_sales(spark: SparkSession, sales: DataFrame, limit: int = BROADCAST_LIMIT) -> KeySet:
    """Sale ids that two or more rows share."""
    return settle(spark, repeated_keys(sales, "sale_id"), "sale_id", limit)


def _marked(sales: DataFrame, duplicates: KeySet, *also: str) -> DataFrame:
    return duplicates.mark(sales.select(*SALES_COLUMNS, *also), "is_duplicate")


def _with_reasons(marked: DataFrame, *also: str) -> DataFrame:
    return marked.select(*SALES_COLUMNS, rules.reasons(F.col("is_duplicate")).alias("fail_reasons"), *also)


def gated(sales: DataFrame, duplicates: KeySet, *also: str) -> DataFrame:
    """All rows in the gate columns with `fail_reasons`; '' means the row passes. `also`: further columns to keep."""
    return _with_reasons(_marked(sales, duplicates, *also), *also)


def quarantine(sales: DataFrame, duplicates: KeySet) -> DataFrame:
    """Rows that fail at least one rule, with the reasons (put together for those rows only)."""
    fails = rules.any_of(rules.row_rules().values()) | F.col("is_duplicate")
    return _with_reasons(_marked(sales, duplicates).filter(fails))


def curated(sales: DataFrame, duplicates: KeySet) -> DataFrame:
    """Rows that pass all rules. The row rules come first, so they reach the scan and thin the join."""
    return duplicates.drop(sales.select(*SALES_COLUMNS).filter(rules.passes_row_rules()))


def in_buckets(counts: DataFrame) -> DataFrame:
    """The counts with the hash bucket of their id."""
    return counts.withColumn("bucket", F.pmod(F.xxhash64("sale_id"), F.lit(BUCKETS)))


def id_counts(sales: DataFrame) -> DataFrame:
    """Rows of each sale id on each day, with the id's bucket."""
    return in_buckets(sales.where(F.col("sale_id").isNotNull()).groupBy("dt", "sale_id").agg(F.count("*").alias("n")))


def changes(gone: DataFrame, come: DataFrame) -> DataFrame:
    """(sale_id, bucket, change) of the ids that have more rows, or fewer, when the counts `gone` are replaced by `come`."""
    rows = gone.select("sale_id", "bucket", (-F.col("n")).alias("n")).union(come.select("sale_id", "bucket", "n"))
    return rows.groupBy("sale_id", "bucket").agg(F.sum("n").alias("change")).where("change <> 0")


def crossing(known: DataFrame, change: DataFrame, changed: KeySet) -> DataFrame:
    """(sale_id, repeated) of the ids that have become repeated, or are so no more; known: the counts of before in the buckets of
    `changed`, the ids of `change`, of which only those ids' are looked at."""
    before = changed.keep(known.select("sale_id", "n")).groupBy("sale_id").agg(F.sum("n").alias("before"))
    both = change.join(before, "sale_id", "left").withColumn("before", F.coalesce("before", F.lit(0)))
    after = F.col("before") + F.col("change")
    return both.where((F.col("before") > 1) != (after > 1)).select("sale_id", (after > 1).alias("repeated"))


def outcomes(sales: DataFrame, duplicates: KeySet, *also: str) -> DataFrame:
    """All rows in the gate columns with `fail_reasons` and `outcome`, curated or quarantine: one pass for both."""
    passes = F.col("fail_reasons") == ""
    return gated(sales, duplicates, *also).withColumn("outcome", F.when(passes, F.lit("curated")).otherwise(F.lit("quarantine")))


def _first_failures(conditions: dict[str, Column], names: tuple[str, ...]) -> dict[str, Column]:
    """For each rule whether it fails while no earlier rule of `names` does."""
    first, clear = {}, F.lit(True)
    for name in names:
        first[name] = clear & conditions[name]
        clear = clear & ~conditions[name]
    return first


def gate_tallies(sales: DataFrame) -> DataFrame:
    """Every count and sum of the gate as one row, without joining the rows to their duplicates.

    The rows are tallied per sale id (pre-aggregated before the one shuffle, so a hot id is no
    problem), and the copies of an id decide afterwards what its tallies count for.
    """
    row_rules = rules.row_rules()
    no_rule = ~rules.any_of(row_rules.values())
    before_duplicates = rules.any_of(
        row_rules[name] for name in (rules.DATE_RULE, rules.QUANTITY_RULE, rules.PRICE_RULE)
    )
    first = _first_failures(row_rules, tuple(row_rules))
    per_id = sales.groupBy("sale_id").agg(
        F.count("*").alias("n"),
        F.count_if(no_rule).alias("clean"),
        F.count_if(~before_duplicates).alias("open_for_duplicates"),
        F.sum(F.when(no_rule, F.col("quantity") * F.col("unit_price_cad"))).alias("revenue"),
        *[F.count_if(failed).alias(f"all_{name}") for name, failed in row_rules.items()],
        *[F.count_if(failed).alias(f"first_{name}") for name, failed in first.items()],
    )
    duplicate = F.col("sale_id").isNotNull() & (F.col("n") > 1)

    def total(col: str, when: Column | None = None) -> Column:
        value = F.col(col) if when is None else F.when(when, F.col(col))
        return F.coalesce(F.sum(value), F.lit(0))

    first_of_category = total(f"first_{rules.CATEGORY_RULE}", ~duplicate)
    return per_id.agg(
        total("n").alias("all_rows"),
        total("clean", ~duplicate).alias("curated_rows"),
        (total("n", duplicate) + F.coalesce(
            F.sum(F.when(~duplicate, F.col("n") - F.col("clean"))), F.lit(0))).alias("quarantine_rows"),
        total("revenue", ~duplicate).cast("decimal(38,2)").alias("curated_revenue"),
        F.count_if(duplicate).alias("duplicate_ids"),
        total("n", duplicate).alias("duplicate_rows"),
        *[total(f"all_{name}").alias(f"all_{name}") for name in row_rules],
        total("n", duplicate).alias(f"all_{rules.DUPLICATE_RULE}"),
        *[total(f"first_{name}").alias(f"first_{name}") for name in row_rules if name != rules.CATEGORY_RULE],
        total("open_for_duplicates", duplicate).alias(f"first_{rules.DUPLICATE_RULE}"),
        first_of_category.alias(f"first_{rules.CATEGORY_RULE}"),
    )
