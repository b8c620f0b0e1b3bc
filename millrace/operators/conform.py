"""Raw rows to the shared sales and customer schemas.

Every conversion either succeeds or gives NULL and is named in `parse_errors`; no row is dropped,
merged or repaired. All three are a single projection: no shuffle, and they run on streams as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import catalogue, dates, numbers
from millrace.functions.text import (
    clean, clean_lower, clean_upper, loyalty_number, padded_number, sku, unparsed,
)
from millrace.schemas import CUSTOMER_HEADER, CUSTOMERS_CONFORMED, POS_REQUIRED, SALES_CONFORMED


def require_columns(rows: DataFrame, names) -> None:
    absent = [name for name in names if name not in rows.columns]
    if absent:
        raise ValueError(f"Input lacks the columns: {', '.join(absent)}")


def lineage(rows: DataFrame) -> list[Column]:
    """File of the row (as the readers recorded it) and time of the run."""
    source = F.col("source_file") if "source_file" in rows.columns else F.input_file_name()
    return [source.alias("source_file"), F.current_timestamp().alias("ingested_at")]


def conform_pos(rows: DataFrame) -> DataFrame:
    """Store sales lines to the sales schema."""
    require_columns(rows, (*POS_REQUIRED, "dt"))
    return _with_errors(rows.select(
        clean(F.col("txn_id")).alias("sale_id"),
        F.lit("store").alias("channel"),
        dates.pos_date(F.col("txn_date")).alias("sale_date"),
        loyalty_number(F.col("loyalty_id")).alias("customer_id"),
        sku(F.col("sku")).alias("sku"),
        clean(F.col("product_name")).alias("product_name"),
        clean(F.col("category")).alias("category"),
        numbers.whole_number(F.col("quantity")).alias("quantity"),
        numbers.price(F.col("unit_price")).alias("unit_price_cad"),
        clean_upper(F.col("province")).alias("province"),
        clean(F.col("store_id")).alias("store_id"),
        *lineage(rows),
        "dt",
    ))


def conform_ecommerce(orders: DataFrame, usd_to_cad: str = numbers.USD_TO_CAD) -> DataFrame:
    """Orders to the sales schema, one row per item; an order without items stays as one row."""
    # What belongs to the order is converted below the generator, once per order.
    headers = orders.select(
        clean(F.col("orderId")).alias("order_id"),
        clean_lower(F.col("channel")).alias("channel"),
        dates.local_date(F.col("orderTimestamp")).alias("sale_date"),
        padded_number(F.col("customer.customerId")).alias("customer_id"),
        numbers.rate_to_cad(F.col("currency"), usd_to_cad).alias("rate"),
        clean_upper(F.col("shippingAddress.province")).alias("province"),
        *lineage(orders),
        "dt",
        "items",
    )
    lines = headers.select("*", F.posexplode_outer("items").alias("position", "item"))
    line_number = F.coalesce(F.col("position") + 1, F.lit(1)).cast("string")
    return _with_errors(lines.select(
        F.concat(F.col("order_id"), F.lit("-"), line_number).alias("sale_id"),
        "channel",
        "sale_date",
        "customer_id",
        sku(F.col("item.sku")).alias("sku"),
        clean(F.col("item.title")).alias("product_name"),
        catalogue.store_category(F.col("item.categoryPath")).alias("category"),
        F.col("item.qty").try_cast("int").alias("quantity"),
        numbers.cents_to_cad(F.col("item.priceCents"), F.col("rate")).alias("unit_price_cad"),
        "province",
        F.lit(None).cast("string").alias("store_id"),
        "source_file",
        "ingested_at",
        "dt",
    ))


def _with_errors(sales: DataFrame) -> DataFrame:
    """Sales schema with the names of the values that are missing, in contract order."""
    errors = unparsed(
        sale_date=F.col("sale_date"), quantity=F.col("quantity"), unit_price=F.col("unit_price_cad")
    )
    return sales.withColumn("parse_errors", errors).select(*SALES_CONFORMED.names)


def conform_customers(rows: DataFrame, snapshot: str | Column) -> DataFrame:
    """Customer rows of one snapshot to the customer schema."""
    require_columns(rows, CUSTOMER_HEADER)
    answer = F.upper(F.trim(F.col("opt_in")))
    typed = rows.select(
        clean(F.col("cust_no")).alias("customer_id"),
        clean(F.col("first_name")).alias("first_name"),
        clean(F.col("last_name")).alias("last_name"),
        clean(F.col("email")).alias("email"),
        dates.signup_date(F.col("signup_dt")).alias("signup_date"),
        catalogue.province_code(F.col("province")).alias("province"),
        clean_upper(F.col("segment_cd")).alias("segment_code"),
        F.when(answer.isin("Y", "N"), answer == "Y").alias("opt_in"),
        (F.lit(snapshot) if isinstance(snapshot, str) else snapshot).alias("snapshot_date"),
        *lineage(rows),
    )
    errors = unparsed(signup_date=F.col("signup_date"), opt_in=F.col("opt_in"))
    return typed.withColumn("parse_errors", errors).select(*CUSTOMERS_CONFORMED.names)
