import datetime
from decimal import Decimal

import pytest

from millrace import schemas
from millrace.operators import gate, reports
from millrace.operators.keys import repeated_keys, settle

DAY = datetime.date(2026, 9, 17)


def sale(sale_id, day=DAY, quantity=1, price="10.00", category="Packs", customer=None):
    return (sale_id, "store", day, customer, "TH-1", "x", category, quantity, price and Decimal(price), "ON", "S001")


SALES = [
    sale("a"), sale("a"), sale("b", quantity=3), sale(None), sale(None), sale("c", category=" unknown "),
    sale("d", category="Unknown"), sale("e", category=" "), sale("f", category=None), sale("g", quantity=0),
    sale("h", price="-0.01"), sale("i", day=None), sale("j", None, None, None, None), sale("j", None, None, None, None),
    sale("k", quantity=None), sale("l", price=None), sale("m", day=None), sale("m", category="UNKNOWN"),
]


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(SALES, schemas.SALES).repartition(3)


@pytest.fixture(scope="module", params=[None, 0], ids=["broadcast", "sorted"])
def duplicates(request, spark, sales):
    found = gate.duplicate_sales(spark, sales) if request.param is None else gate.duplicate_sales(spark, sales, 0)
    assert found.small == (request.param is None)
    return found


def test_reasons(sales, duplicates):
    got = {}
    for row in gate.gated(sales, duplicates).collect():
        got.setdefault(row.sale_id, set()).add(row.fail_reasons)
    assert got == {
        "a": {"R4_duplicate_sale_id"}, "b": {""}, None: {""}, "c": {""}, "d": {"R5_category"}, "e": {"R5_category"},
        "f": {"R5_category"}, "g": {"R2_quantity"}, "h": {"R3_unit_price"}, "i": {"R1_sale_date"},
        "j": {"R1_sale_date,R2_quantity,R3_unit_price,R4_duplicate_sale_id,R5_category"},
        "k": {"R2_quantity"}, "l": {"R3_unit_price"},
        "m": {"R1_sale_date,R4_duplicate_sale_id", "R4_duplicate_sale_id,R5_category"},
    }


def test_outputs_are_complements(sales, duplicates):
    passed, failed = gate.curated(sales, duplicates), gate.quarantine(sales, duplicates)
    assert passed.columns == list(schemas.SALES_COLUMNS)
    assert failed.columns == [*schemas.SALES_COLUMNS, "fail_reasons"]
    together = passed.unionByName(failed.drop("fail_reasons"))
    assert together.exceptAll(sales).isEmpty() and sales.exceptAll(together).isEmpty()
    assert sorted(str(row.sale_id) for row in passed.collect()) == ["None", "None", "b", "c"]


def test_join_strategy_follows_the_size(sales, duplicates):
    plan = gate.gated(sales, duplicates)._jdf.queryExecution().toString()
    assert ("BroadcastHashJoin" in plan) == duplicates.small
    assert ("SortMergeJoin" in plan) != duplicates.small


def test_tallies_agree_with_the_rows(sales, duplicates):
    totals = gate.gate_tallies(sales).first()
    rows = gate.gated(sales, duplicates).collect()
    failed = [row.fail_reasons.split(",") for row in rows if row.fail_reasons]
    assert (totals.all_rows, totals.curated_rows, totals.quarantine_rows) == (18, 4, 14)
    assert totals.curated_revenue == Decimal("60.00")
    for rule in ("R1_sale_date", "R2_quantity", "R3_unit_price", "R4_duplicate_sale_id", "R5_category"):
        assert totals[f"all_{rule}"] == sum(rule in reasons for reasons in failed), rule
        assert totals[f"first_{rule}"] == sum(reasons[0] == rule for reasons in failed), rule


def test_empty_sales(spark):
    nothing = spark.createDataFrame([], schemas.SALES)
    totals = gate.gate_tallies(nothing).first()
    assert (totals.all_rows, totals.curated_rows, totals.quarantine_rows) == (0, 0, 0)
    found = gate.duplicate_sales(spark, nothing)
    assert found.size == 0 and gate.gated(nothing, found).isEmpty()


def test_union_order_does_not_matter(spark, sales):
    half, other = sales.filter("sale_id < 'f'"), sales.filter("sale_id >= 'f' OR sale_id IS NULL")
    assert gate.gate_tallies(half.unionByName(other)).first() == gate.gate_tallies(other.unionByName(half)).first()


def test_hot_key(spark):
    rows = spark.range(0, 3000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE cast(id AS string) END AS sale_id", "id"
    )
    keys = settle(spark, repeated_keys(rows, "sale_id"), "sale_id", limit=0)
    assert keys.keep(rows).count() == 1000 and keys.drop(rows).count() == 2000
    assert keys.mark(rows, "dup").filter("dup").count() == 1000


def test_reports(spark, sales):
    assert reports.duplicate_summary(sales).first().asDict() == dict(duplicate_ids=3, duplicate_rows=6, surplus_rows=3)
    assert {row.sale_id: row.copies for row in reports.duplicate_ids(sales).collect()} == {"a": 2, "j": 2, "m": 2}
    assert {row["rule"]: row.n for row in reports.rule_new_counts(sales).collect()} == {
        "R1_sale_date": 4, "R2_quantity": 2, "R3_unit_price": 2, "R4_duplicate_sale_id": 3, "R5_category": 3,
    }
    customers = spark.createDataFrame([("1",), ("1",), (None,)], "customer_id string")
    assert reports.distinct_customers(customers).first().asDict() == dict(all_rows=3, distinct_ids=2, surplus_rows=1)


def test_unknown_customers_are_a_report_only(spark):
    rows = spark.createDataFrame(
        [sale("a", customer="1"), sale("b", customer="9"), sale("c", customer="9"), sale("d")], schemas.SALES
    )
    customers = spark.createDataFrame([("1",), ("1",), (None,)], "customer_id string")
    assert [tuple(row) for row in reports.unknown_customer_counts(rows, customers).collect()] == [("9", 2)]
    lost = reports.unknown_customer_sales(spark, rows, customers)
    assert sorted(row.sale_id for row in lost.collect()) == ["b", "c"]
    assert gate.gate_tallies(rows).first().quarantine_rows == 0


def test_large_key_set_joins_only_rows_that_may_hold_its_keys(spark):
    from millrace.operators.keys import settle

    keys = spark.range(0, 20000, 40).selectExpr("concat('k', id) AS sale_id")
    rows = spark.range(20000).selectExpr("concat('k', id) AS sale_id", "id").union(spark.createDataFrame([(None, -1)], "sale_id string, id long"))
    large = settle(spark, keys, "sale_id", limit=0)
    likely, others = large._likely(rows)
    n = likely.count()
    assert 500 <= n < 4000 and others.count() == 20001 - n
    marked = large.mark(rows, "flag")
    assert marked.count() == 20001 and marked.where("flag").count() == 500
    assert {r.id for r in marked.where("flag").collect()} == {r.id for r in large.keep(rows).collect()} == set(range(0, 20000, 40))
    left = large.drop(rows)
    assert left.count() == 19501 and left.where("sale_id IS NULL").count() == 1 and left.columns == ["sale_id", "id"]
