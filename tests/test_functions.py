import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.functions import catalogue, dates, numbers, text


def apply(spark, function, values, kind="string"):
    rows = [(i, value) for i, value in enumerate(values)]
    frame = spark.createDataFrame(rows, f"i int, v {kind}").select("i", function(F.col("v")).alias("v"))
    return [row["v"] for row in frame.orderBy("i").collect()]


DAY = datetime.date


@pytest.mark.parametrize("function, cases", [
    (text.clean, {" a ": "a", "": None, "   ": None, "\t": "\t", None: None}),
    (text.sku, {"TH1001": "TH-1001", "th-1001": "TH-1001", " TH-1001 ": "TH-1001", "X1": "X1", "": None}),
    (text.loyalty_number, {"L000123": "000123", "l000123": "000123", "": None, "L": None, "LL1": "L1", "7": "7"}),
    (text.clean_upper, {" bc ": "BC", " ": None}),
    (text.clean_lower, {" Web ": "web", " ": None}),
    (dates.pos_date, {
        "09/17/2026": DAY(2026, 9, 17), " 09/17/2026 ": DAY(2026, 9, 17), "9/17/2026": None, "02/30/2026": None,
        "2026-13-45": None, "31/09/2026": None, "00/00/0000": None, "": None, None: None,
    }),
    (dates.local_date, {
        "2026-09-17T09:44:40-04:00": DAY(2026, 9, 17), "2026-09-17T23:59:59Z": DAY(2026, 9, 17),
        "2026-09-17T09:44:40": None, "2026-09-31T09:44:40-04:00": None, "yesterday": None,
        "17/09/2026 10:15": None, "": None,
    }),
    (dates.leading_date, {"2026-09-17 whatever": DAY(2026, 9, 17), "2026-09-31T": None, "yesterday": None}),
    (dates.signup_date, {
        "18-JAN-22": DAY(2022, 1, 18), "18-Jan-22": DAY(2022, 1, 18), "01-JAN-00": DAY(2000, 1, 1),
        "01-JAN-99": DAY(2099, 1, 1), "99-DEC-99": None, "18-JAN-2022": None,
    }),
    (dates.file_name_date, {
        "pos_2026-09-30.csv": "2026-09-30", "x_20260930.txt": "2026-09-30", "none.csv": None,
        "a_2026-13-45_20260102.csv": "2026-01-02", "p_1999-01-01.csv": None, "q_2101-01-01.csv": None,
        "20260101_2027-02-02": "2027-02-02",
    }),
    (numbers.whole_number, {
        "-2": -2, "0": 0, " 3 ": 3, "2.5": 2, "2.": 2, "+4": 4, "N/A": None, "1e3": None, "3000000000": None,
        "": None, "2.x": None, "\t5\t": 5, ".5": 0, ".": 0, "+": None, "-.5": 0, "1_0": None, None: None,
    }),
    (numbers.price, {
        "2.999": Decimal("3.00"), "2.995": Decimal("3.00"), "-1.00": Decimal("-1.00"), "N/A": None,
        "123456789.00": None, " 149.99 ": Decimal("149.99"),
    }),
    (catalogue.store_category, {
        "Shoes > Hiking Boots": "Footwear", "Camp & Hike > Tents": "Camping", "Bags": "Packs", " Gear>x": "Accessories",
        "Toys > Plush": "Toys", " ": None, " > x": None, None: None,
    }),
    (catalogue.store_category_by_prefix, {
        "Shoes > Boots": "Footwear", "Shoestring": "Footwear", "Toys": "UNKNOWN", None: "UNKNOWN", "": "UNKNOWN",
    }),
    (catalogue.province_code, {"Ontario": "ON", " quebec ": "QC", "Atlantis": "ATLANTIS", "": None, None: None}),
])
def test_text_in(spark, function, cases):
    assert apply(spark, function, list(cases)) == list(cases.values())


def test_padded_number_keeps_long_numbers(spark):
    assert apply(spark, text.padded_number, [123, None, 1234567], "bigint") == ["000123", None, "1234567"]


def test_cents_to_cad(spark):
    rows = [(14999, "USD"), (14999, "cad "), (-1, "CAD"), (14999, "EUR"), (14999, None), (None, "CAD"), (10**15, "CAD")]
    frame = spark.createDataFrame(rows, "cents bigint, currency string")
    price = numbers.cents_to_cad(F.col("cents"), numbers.rate_to_cad(F.col("currency"), "1.35"))
    got = [row[0] for row in frame.select(price).collect()]
    assert got == [Decimal("202.49"), Decimal("149.99"), Decimal("-0.01"), None, None, None, None]


def test_name_lists(spark):
    frame = spark.createDataFrame([(None, None), (1, None), (1, 2)], "a int, b int")
    got = frame.select(text.unparsed(a=F.col("a"), b=F.col("b"))).collect()
    assert [row[0] for row in got] == ["a,b", "b", None]


def test_sku_is_idempotent(spark):
    once = apply(spark, text.sku, ["TH1", "th-2", "TH-TH3"])
    assert apply(spark, text.sku, once) == once


def test_results_do_not_depend_on_ansi_mode(spark):
    before = spark.conf.get("spark.sql.ansi.enabled")
    try:
        for ansi in ("true", "false"):
            spark.conf.set("spark.sql.ansi.enabled", ansi)
            assert apply(spark, numbers.whole_number, ["2.5", "3000000000"]) == [2, None]
            assert apply(spark, dates.pos_date, ["02/30/2026"]) == [None]
            assert apply(spark, numbers.price, ["123456789.00"]) == [None]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
