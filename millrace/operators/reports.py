"""Counts and sums the jobs log and the analysts ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.functions import rules
from millrace.operators.gate import gate_tallies
from millrace.operators.keys import key_counts, repeated_keys, settle
from millrace.sources.raw import is_corrupt

SALES_PARSED = ("sale_date", "quantity", "unit_price")
CUSTOMERS_PARSED = ("signup_date", "opt_in")


def rows_per(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(*columns)


def as_rows(totals: DataFrame, label: str, names: dict[str, str], value: str = "n") -> DataFrame:
    """One-row totals turned into one row per column; `names` gives the label of each column."""
    counts = totals.select(*[F.col(column).cast("bigint").alias(name) for column, name in names.items()])
    return counts.unpivot([], list(names.values()), label, value)


def has_parse_error(name: str) -> Column:
    return F.contains(F.col("parse_errors"), F.lit(name))


def parse_error_counts(rows: DataFrame, names: tuple[str, ...] = SALES_PARSED) -> DataFrame:
    """Rows in which each column could not be converted, in one pass."""
    totals = rows.agg(*[F.count_if(has_parse_error(name)).alias(name) for name in names])
    return as_rows(totals, "column_name", {name: name for name in names})


def bad_line_counts(lines: DataFrame) -> DataFrame:
    corrupt = is_corrupt(lines)
    return lines.agg(F.count_if(corrupt).alias("bad_lines"), F.count_if(~corrupt).alias("good_lines"))


def distinct_customers(customers: DataFrame) -> DataFrame:
    """Rows, distinct ids (NULL counts as one) and surplus rows."""
    return key_counts(customers, "customer_id").agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("all_rows"),
        F.count("*").alias("distinct_ids"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("surplus_rows"),
    )


def order_items(orders: DataFrame) -> DataFrame:
    """Ad-hoc look into the nested orders: one row per item."""
    return orders.select("orderId", F.inline("items")).select(
        F.col("orderId").alias("order_id"), "sku", "qty", F.col("priceCents").alias("price_cents")
    )


def duplicate_ids(sales: DataFrame) -> DataFrame:
    return repeated_keys(sales, "sale_id")


def duplicate_summary(sales: DataFrame) -> DataFrame:
    return gate_tallies(sales).select(
        "duplicate_ids",
        "duplicate_rows",
        (F.col("duplicate_rows") - F.col("duplicate_ids")).alias("surplus_rows"),
    )


def reconcile(sales: DataFrame) -> DataFrame:
    """All, curated and quarantined rows."""
    return gate_tallies(sales).select("all_rows", "curated_rows", "quarantine_rows")


def curated_revenue(sales: DataFrame) -> DataFrame:
    return gate_tallies(sales).select(F.col("curated_revenue").alias("revenue_cad"))


def rule_counts(sales: DataFrame) -> DataFrame:
    """Rows each rule sends to quarantine, overlaps counted under every rule."""
    return as_rows(gate_tallies(sales), "rule", {f"all_{rule}": rule for rule in rules.RULES})


def rule_new_counts(sales: DataFrame) -> DataFrame:
    """Rows each rule adds to those of the rules before it."""
    return as_rows(gate_tallies(sales), "rule", {f"first_{rule}": rule for rule in rules.RULES})


def unknown_customer_counts(sales: DataFrame, customers: DataFrame) -> DataFrame:
    """Customer ids of sales that no customer row has, with their number of sales rows.

    Sales are counted per id before the join, so a hot customer is one row in it. The customers are
    reduced to distinct ids for the same reason.
    """
    per_id = key_counts(sales.filter(F.col("customer_id").isNotNull()), "customer_id")
    known = customers.select("customer_id").filter(F.col("customer_id").isNotNull()).distinct()
    return per_id.join(known, "customer_id", "left_anti").withColumnRenamed("copies", "sale_rows")


def unknown_customer_sales(spark: SparkSession, sales: DataFrame, customers: DataFrame) -> DataFrame:
    """The sales rows of those ids. A report only: the gate has no such rule. Reads the sales twice, so
    they should be a stored table."""
    unknown = settle(spark, unknown_customer_counts(sales, customers), "customer_id")
    return unknown.keep(sales)
