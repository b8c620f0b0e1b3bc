"""Declared schemas. Nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names of the files the sources deliver.
POS_HEADER = (
    "txn_id", "store_id", "province", "txn_date", "sku", "product_name",
    "category", "quantity", "unit_price", "payment_type", "loyalty_id",
)
CUSTOMER_HEADER = (
    "cust_no", "first_name", "last_name", "email", "signup_dt", "province", "segment_cd", "opt_in",
)
CORRUPT = "_corrupt_record"

TEXT = T.StringType()
WHOLE = T.LongType()
POS_REQUIRED = tuple(name for name in POS_HEADER if name != "payment_type")


def record(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


def text_record(*names: str) -> T.StructType:
    return record(**dict.fromkeys(names, TEXT))


POS_RAW = text_record(*POS_HEADER, "dt")
CUSTOMERS_RAW = text_record(*CUSTOMER_HEADER, "dt")

ORDER = record(
    orderId=TEXT,
    orderTimestamp=TEXT,
    channel=TEXT,
    currency=TEXT,
    customer=record(customerId=WHOLE, guest=T.BooleanType()),
    shippingAddress=record(province=TEXT, country=TEXT),
    items=T.ArrayType(record(sku=TEXT, title=TEXT, categoryPath=TEXT, qty=WHOLE, priceCents=WHOLE)),
)
# Orders as lines of text: a line that does not fit is kept in the corrupt column.
ORDER_LINE = T.StructType([*ORDER.fields, T.StructField(CORRUPT, TEXT)])
ORDERS_RAW = T.StructType([*ORDER_LINE.fields, T.StructField("dt", TEXT)])

# The eleven columns the quality gate and the analysts see, and the lineage around them.
SALES = record(
    sale_id=TEXT,
    channel=TEXT,
    sale_date=T.DateType(),
    customer_id=TEXT,
    sku=TEXT,
    product_name=TEXT,
    category=TEXT,
    quantity=T.IntegerType(),
    unit_price_cad=T.DecimalType(10, 2),
    province=TEXT,
    store_id=TEXT,
)
SALES_COLUMNS = tuple(SALES.names)
QUARANTINE = T.StructType([*SALES.fields, T.StructField("fail_reasons", TEXT)])
SALES_CONFORMED = T.StructType([
    *SALES.fields,
    *record(parse_errors=TEXT, source_file=TEXT, ingested_at=T.TimestampType(), dt=TEXT).fields,
])
CUSTOMERS_CONFORMED = record(
    customer_id=TEXT,
    first_name=TEXT,
    last_name=TEXT,
    email=TEXT,
    signup_date=T.DateType(),
    province=TEXT,
    segment_code=TEXT,
    opt_in=T.BooleanType(),
    parse_errors=TEXT,
    snapshot_date=TEXT,
    source_file=TEXT,
    ingested_at=T.TimestampType(),
)
MANIFEST = record(
    key=TEXT,
    path=TEXT,
    source=TEXT,
    dt=TEXT,
    size=WHOLE,
    modified=T.TimestampType(),
    status=TEXT,
    reason=TEXT,
    target_key=TEXT,
    checked_at=T.TimestampType(),
)
