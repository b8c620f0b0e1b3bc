"""The SQL path as one job: four catalogue tables, reconciliation, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions.numbers import USD_TO_CAD_SQL
from millrace.operators import gate
from millrace.operators.sqlpath import combine_sales, flatten_orders
from millrace.session import pin_session
from millrace.sinks.tables import save_table, write_whole
from millrace.sources import raw
from millrace.sources.tables import read_trusted_sales

TABLES = ("sales_ecommerce", "sales_all", "quarantine_all", "curated_all")


def sql_path_job(
    spark: SparkSession,
    raw_zone: str,
    trusted_zone: str,
    database: str = "default",
    tables_path: str | None = None,
    usd_to_cad: str = USD_TO_CAD_SQL,
) -> DataFrame:
    """Build the four tables from raw orders and conformed store sales; returns the reconciliation.

    `sales_conformed` must hold store sales only. If the sales job has put e-commerce rows into it,
    combining would double them, so that is an error.
    """
    pin_session(spark)
    store_sales = read_trusted_sales(spark, trusted_zone)
    if not store_sales.filter(F.col("channel") != "store").isEmpty():
        raise ValueError("sales_conformed already holds e-commerce rows; the SQL path needs store sales only.")

    def save(rows: DataFrame, name: str) -> DataFrame:
        path = raw.folder(tables_path) + name if tables_path else None
        return save_table(spark, rows, f"{database}.{name}", path)

    orders = raw.read_all_orders(spark, raw.folder(raw_zone) + "ecommerce")
    flattened = save(flatten_orders(orders, usd_to_cad), "sales_ecommerce")
    sales = save(combine_sales(store_sales, flattened), "sales_all")
    duplicates = gate.duplicate_sales(spark, sales)
    save(gate.quarantine(sales, duplicates), "quarantine_all")
    save(gate.curated(sales, duplicates), "curated_all")
    return reconcile_tables(spark, database)


def reconcile_tables(spark: SparkSession, database: str = "default") -> DataFrame:
    """Row counts of the stored tables side by side; curated and quarantine make up all."""
    names = {"all_rows": "sales_all", "curated_rows": "curated_all", "quarantine_rows": "quarantine_all"}
    counts = [
        spark.table(f"{database}.{table}").select(F.count("*")).scalar().alias(label)
        for label, table in names.items()
    ]
    return spark.range(1).select(*counts)


def export_tables(spark: SparkSession, curated_zone: str, database: str = "default") -> None:
    """Stored gate results to the curated zone, replacing what is there."""
    base = raw.folder(curated_zone)
    write_whole(spark.table(f"{database}.curated_all"), base + "sales_clean")
    write_whole(spark.table(f"{database}.quarantine_all"), base + "quarantine")
