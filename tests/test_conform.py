import datetime
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace import schemas
from millrace.operators.conform import conform_customers, conform_ecommerce, conform_pos
from millrace.operators.sqlpath import combine_sales, flatten_orders
from millrace.sources.raw import parse_order_lines, valid_orders

POS = dict(
    txn_id="S001-1", store_id="S001", province="on", txn_date="09/17/2026", sku="TH1001", product_name=" Boot ",
    category="Footwear", quantity="2", unit_price="149.99", payment_type="cash", loyalty_id="L000123", dt="2026-09-17",
)
ORDER = {
    "orderId": "EC-1", "orderTimestamp": "2026-09-17T09:44:40-04:00", "channel": "web", "currency": "CAD",
    "customer": {"customerId": 123, "guest": False}, "shippingAddress": {"province": "ON", "country": "CA"},
    "items": [{"sku": "TH1101", "title": "Tent", "categoryPath": "Camp & Hike > Tents", "qty": 2, "priceCents": 14999}],
}


def pos(spark, **changes):
    frame = spark.createDataFrame([tuple({**POS, **changes}.values())], schemas.POS_RAW)
    return conform_pos(frame).first()


def orders(spark, *documents):
    lines = [doc if isinstance(doc, str) else json.dumps(doc) for doc in documents]
    frame = spark.createDataFrame([(line, "2026-09-17") for line in lines], "value string, dt string")
    return valid_orders(parse_order_lines(frame))


def item(**changes):
    return {**ORDER, "items": [{**ORDER["items"][0], **changes}]}


def test_pos_row(spark):
    row = pos(spark)
    assert row.asDict() | {"source_file": "", "ingested_at": None} == dict(
        sale_id="S001-1", channel="store", sale_date=datetime.date(2026, 9, 17), customer_id="000123", sku="TH-1001",
        product_name="Boot", category="Footwear", quantity=2, unit_price_cad=Decimal("149.99"), province="ON",
        store_id="S001", parse_errors=None, source_file="", ingested_at=None, dt="2026-09-17",
    )


def test_pos_keeps_what_it_cannot_convert_as_null(spark):
    row = pos(spark, txn_date="2026-13-45", quantity="N/A", unit_price="x", loyalty_id="", category=" ")
    assert row.parse_errors == "sale_date,quantity,unit_price"
    assert (row.sale_date, row.quantity, row.unit_price_cad, row.customer_id, row.category) == (None,) * 5
    row = pos(spark, quantity="-2", unit_price="0.00")
    assert (row.quantity, row.unit_price_cad, row.parse_errors) == (-2, Decimal("0.00"), None)


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="sku, dt"):
        conform_pos(spark.createDataFrame([tuple(POS.values())], schemas.POS_RAW).drop("sku", "dt"))
    with pytest.raises(ValueError, match="email"):
        conform_customers(spark.createDataFrame([], schemas.CUSTOMERS_RAW).drop("email"), "2026-09-28")


def test_payment_type_is_optional(spark):
    frame = spark.createDataFrame([tuple(POS.values())], schemas.POS_RAW).drop("payment_type")
    assert conform_pos(frame).count() == 1


def test_schemas_are_the_contract(spark):
    for frame, schema in (
        (conform_pos(spark.createDataFrame([], schemas.POS_RAW)), schemas.SALES_CONFORMED),
        (conform_ecommerce(orders(spark, ORDER)), schemas.SALES_CONFORMED),
        (conform_customers(spark.createDataFrame([], schemas.CUSTOMERS_RAW), "d"), schemas.CUSTOMERS_CONFORMED),
    ):
        assert [(f.name, f.dataType) for f in frame.schema] == [(f.name, f.dataType) for f in schema]


def test_ecommerce_row(spark):
    row = conform_ecommerce(orders(spark, {**item(), "currency": "USD"})).first()
    assert (row.sale_id, row.channel, row.sale_date, row.customer_id, row.sku, row.category, row.quantity) == (
        "EC-1-1", "web", datetime.date(2026, 9, 17), "000123", "TH-1101", "Camping", 2
    )
    assert (row.unit_price_cad, row.store_id, row.parse_errors) == (Decimal("202.49"), None, None)


def test_rate_is_a_parameter(spark):
    row = conform_ecommerce(orders(spark, {**item(), "currency": "USD"}), "1.4250").first()
    assert row.unit_price_cad == Decimal("213.74")


@pytest.mark.parametrize("items", [[], None, "missing", [None]])
def test_order_without_items_stays(spark, items):
    order = {key: value for key, value in ORDER.items() if key != "items"}
    if items != "missing":
        order["items"] = items
    rows = conform_ecommerce(orders(spark, order)).collect()
    assert [(row.sale_id, row.sku, row.parse_errors) for row in rows] == [("EC-1-1", None, "quantity,unit_price")]
    assert flatten_orders(orders(spark, order)).count() == (1 if items == [None] else 0)


def test_items_are_numbered_and_rows_conserved(spark):
    order = {**ORDER, "items": ORDER["items"] * 3}
    rows = conform_ecommerce(orders(spark, order, {**ORDER, "items": []}, ORDER)).collect()
    assert sorted(row.sale_id for row in rows) == ["EC-1-1", "EC-1-1", "EC-1-1", "EC-1-2", "EC-1-3"]


def test_order_without_id_has_no_sale_id(spark):
    assert conform_ecommerce(orders(spark, {**ORDER, "orderId": " "})).first().sale_id is None


def test_too_large_quantity_is_null_not_wrapped(spark):
    row = conform_ecommerce(orders(spark, item(qty=3000000000))).first()
    assert (row.quantity, row.parse_errors) == (None, "quantity")


def test_guest_has_no_customer(spark):
    row = conform_ecommerce(orders(spark, {**ORDER, "customer": {"customerId": None, "guest": True}})).first()
    assert (row.customer_id, row.parse_errors) == (None, None)


def test_lines_that_do_not_fit_are_left_out(spark):
    assert orders(spark, "not json", item(qty="2"), item(qty=2.0), "", "  ", ORDER).count() == 1
    assert orders(spark, item(unknown=1), {**ORDER, "more": [1]}).count() == 2


def test_sql_path_differs_where_it_should(spark):
    frame = orders(
        spark,
        {**item(sku="TH-1001", categoryPath="Toys > x", qty=1), "currency": "USD", "orderTimestamp": "2026-09-17 10:15"},
        {**item(categoryPath=None), "currency": "EUR", "orderTimestamp": "2026-09-31T10:15:00Z"},
    )
    first, second = sorted(flatten_orders(frame).collect(), key=lambda row: row.sku)
    assert (first.sku, first.category, first.unit_price_cad, first.customer_id, first.channel) == (
        "TH--1001", "UNKNOWN", Decimal("213.74"), "123", "ecommerce"
    )
    assert first.sale_date == datetime.date(2026, 9, 17)
    assert (second.sku, second.category, second.unit_price_cad, second.sale_date) == (
        "TH-1101", "UNKNOWN", Decimal("149.99"), None
    )
    rounded = flatten_orders(orders(spark, item(priceCents=14999)), quotient_digits=1).first()
    assert rounded.unit_price_cad == Decimal("150.00")
    combined = combine_sales(conform_pos(spark.createDataFrame([tuple(POS.values())], schemas.POS_RAW)), flatten_orders(frame))
    assert combined.columns == list(schemas.SALES_COLUMNS) and combined.count() == 3


def test_customers(spark):
    rows = [
        ("000123", " Ann ", "Lee", "a@x.com", "18-JAN-22", "Ontario", "new", "y", "2026-09-28"),
        ("000124", "", "UNKNOWN", "N/A", "99-DEC-99", "Atlantis", "LYL", "", "2026-09-28"),
    ]
    first, second = conform_customers(spark.createDataFrame(rows, schemas.CUSTOMERS_RAW), "2026-09-28").orderBy("customer_id").collect()
    assert (first.first_name, first.signup_date, first.province, first.segment_code, first.opt_in, first.parse_errors) == (
        "Ann", datetime.date(2022, 1, 18), "ON", "NEW", True, None
    )
    assert (second.first_name, second.last_name, second.email, second.province, second.opt_in) == (
        None, "UNKNOWN", "N/A", "ATLANTIS", None
    )
    assert (second.parse_errors, second.snapshot_date) == ("signup_date,opt_in", "2026-09-28")


def test_conforming_is_one_projection(spark):
    plan = conform_pos(spark.createDataFrame([tuple(POS.values())], schemas.POS_RAW))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan
    plan = conform_ecommerce(orders(spark, ORDER))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan
