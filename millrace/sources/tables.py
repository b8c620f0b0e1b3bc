"""Catalogue of named tables: temporary views over the zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace import schemas
from millrace.sinks.versions import read
from millrace.sources import raw


def read_trusted_sales(spark: SparkSession, trusted: str) -> DataFrame:
    return read(spark, raw.folder(trusted) + "sales_conformed", schemas.SALES_CONFORMED)


def read_trusted_customers(spark: SparkSession, trusted: str) -> DataFrame:
    return read(spark, raw.folder(trusted) + "customers_conformed", schemas.CUSTOMERS_CONFORMED)


def register_raw(spark: SparkSession, base: str) -> list[str]:
    """Views raw_pos, raw_ecommerce and raw_customers over the dated folders, and ecommerce_orders over
    all order files, as far as they exist."""
    base = raw.folder(base)
    dated_views = {
        "raw_pos": ("pos", raw.read_pos),
        "raw_ecommerce": ("ecommerce", lambda s, b: raw.valid_orders(raw.read_order_lines(s, b))),
        "raw_customers": ("customers", raw.read_customers),
    }
    made = []
    for name, (source, reader) in dated_views.items():
        if raw.source_exists(spark, base + source):
            reader(spark, base + source).createOrReplaceTempView(name)
            made.append(name)
    if raw.path_exists(spark, base + "ecommerce"):
        raw.read_all_orders(spark, base + "ecommerce").createOrReplaceTempView("ecommerce_orders")
        made.append("ecommerce_orders")
    return made


def register_trusted(spark: SparkSession, trusted: str) -> None:
    read_trusted_sales(spark, trusted).createOrReplaceTempView("sales_conformed")
    read_trusted_customers(spark, trusted).createOrReplaceTempView("customers_conformed")
