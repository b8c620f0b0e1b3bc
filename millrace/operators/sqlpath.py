"""The older SQL path: orders flattened with its own rules, then combined with conformed store sales.

It is an alternative to `conform_ecommerce`, never an addition: combining both would hold every
e-commerce line twice.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, functions as F

from millrace.functions import catalogue, dates, numbers
from millrace.schemas import SALES_COLUMNS


def flatten_orders(
    orders: DataFrame, usd_to_cad: str = numbers.USD_TO_CAD_SQL, quotient_digits: int = 2
) -> DataFrame:
    """One row per item, text taken as it is; orders without items give no row.

    `quotient_digits` is the number of decimals kept of cents / 100 before the rate is applied. Two is
    exact; one gives what an engine does that derives the scale of a decimal quotient from its inputs.
    """
    lines = orders.select("*", F.posexplode("items").alias("position", "item"))
    rate = F.when(F.col("currency") == "USD", F.lit(Decimal(usd_to_cad))).otherwise(F.lit(Decimal("1.0")))
    dollars = F.round(F.col("item.priceCents").try_cast(numbers.CENTS) * F.lit(Decimal("0.01")), quotient_digits)
    return lines.select(
        F.concat(F.col("orderId"), F.lit("-"), (F.col("position") + 1).cast("string")).alias("sale_id"),
        F.lit("ecommerce").alias("channel"),
        dates.leading_date(F.col("orderTimestamp")).alias("sale_date"),
        F.col("customer.customerId").cast("string").alias("customer_id"),
        F.replace(F.col("item.sku"), F.lit("TH"), F.lit("TH-")).alias("sku"),
        F.col("item.title").alias("product_name"),
        catalogue.store_category_by_prefix(F.col("item.categoryPath")).alias("category"),
        F.col("item.qty").try_cast("int").alias("quantity"),
        (dollars * rate).try_cast(numbers.PRICE).alias("unit_price_cad"),
        F.col("shippingAddress.province").alias("province"),
    )


def combine_sales(store_sales: DataFrame, flattened: DataFrame) -> DataFrame:
    """Store sales and flattened orders in the eleven gate columns."""
    with_store = flattened.withColumn("store_id", F.lit(None).cast("string"))
    return store_sales.select(*SALES_COLUMNS).unionByName(with_store.select(*SALES_COLUMNS))
