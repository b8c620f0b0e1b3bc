"""Known kinds of source problems, counted from the raw rows: one row per source and issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import dates, numbers
from millrace.functions.catalogue import PLACEHOLDER
from millrace.functions.rules import no_category, not_positive
from millrace.functions.text import clean, loyalty_number, padded_number
from millrace.operators.arrival import EMPTY, HEADER_ONLY
from millrace.operators.reports import as_rows
from millrace.sources.raw import union_by_name

# Placeholders in the customer extract.
PLACEHOLDER_SIGNUPS = ("01-JAN-00", "99-DEC-99")
MISSING_EMAIL = "N/A"


# Kinds of things that are counted by key; all other kinds are issues, counted without one.
ROW, ORDER, SNAPSHOT_KEY, CUSTOMER = "pos row", "order", "snapshot key", "customer"


def _event(kind: str, key: Column | None = None, n: Column | int = 1, web: Column | int = 0, known: int = 0) -> Column:
    """A thing to count: n of it in the store (or wherever its kind belongs), `web` in e-commerce, known to the customer extract."""
    key = F.lit(None) if key is None else key
    count = lambda value: (value if isinstance(value, Column) else F.lit(value)).cast("bigint")
    return F.struct(
        F.lit(kind).alias("kind"), key.cast("string").alias("key"), count(n).alias("n"), count(web).alias("web"), count(known).alias("known")
    )


def _events(rows: DataFrame, *events: Column) -> DataFrame:
    """The events of each row that count anything; of a row the text is parsed once."""
    return rows.select(F.inline(F.array(*events))).where("n + web + known > 0")


def _if(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def pos_events(rows: DataFrame) -> DataFrame:
    columns = [name for name in rows.columns if name not in ("source_file", "dt")]
    # NULL and empty text differ in JSON, as they do in rows; only the id counts as empty when it is absent.
    whole = F.to_json(F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c == "txn_id" else F.col(c) for c in columns]))
    loyalty = loyalty_number(F.col("loyalty_id"))
    return _events(
        rows,
        _event(ROW, F.left(F.sha2(whole, 256), F.lit(32))),
        _event(CUSTOMER, loyalty, _if(loyalty.isNotNull())),
        _event("pos bad_date", n=_if(dates.pos_date(F.col("txn_date")).isNull())),
        _event("pos bad_price", n=_if(not_positive(numbers.price(F.col("unit_price"))))),
        _event("pos bad_quantity", n=_if(not_positive(numbers.whole_number(F.col("quantity"))))),
        _event("pos missing_category", n=_if(no_category(F.col("category")))),
    )


def order_events(orders: DataFrame) -> DataFrame:
    buyer = padded_number(F.col("customer.customerId"))
    cheap = F.size(F.filter(F.col("items"), lambda item: item["priceCents"] <= 0))
    province = F.upper(F.trim(F.col("shippingAddress.province"))) == PLACEHOLDER
    return _events(
        orders,
        _event(ORDER, F.col("orderId"), _if(F.col("orderId").isNotNull())),
        _event(CUSTOMER, buyer, 0, _if(buyer.isNotNull())),
        _event("ecommerce bad_timestamp", n=_if(dates.local_date(F.col("orderTimestamp")).isNull())),
        _event("ecommerce bad_price", n=F.greatest(F.coalesce(cheap, F.lit(0)), F.lit(0))),
        _event("ecommerce unknown_province", n=_if(province)),
    )


def customer_events(snapshots: DataFrame) -> DataFrame:
    """Of all snapshots; a key is repeated when it stands twice in the same snapshot."""
    email, number = clean(F.col("email")), clean(F.col("cust_no"))
    return _events(
        snapshots,
        _event(SNAPSHOT_KEY, F.to_json(F.struct("dt", "cust_no"))),
        _event(CUSTOMER, number, 0, 0, 1),
        _event("customers bad_signup_date", n=_if(F.col("signup_dt").isin(*PLACEHOLDER_SIGNUPS))),
        _event("customers missing_email", n=_if(email.isNull() | (email == MISSING_EMAIL))),
        _event("customers placeholder_name", n=_if(F.upper(F.trim(F.col("last_name"))) == PLACEHOLDER)),
        _event("customers rows_total"),
    )


def file_issues(manifest: DataFrame) -> DataFrame:
    """Broken files by source, from the arrival manifest."""
    issue = F.when(F.col("reason") == EMPTY, F.lit("empty_file")).when(
        F.col("reason") == HEADER_ONLY, F.lit("header_only_file")
    )
    broken = manifest.select("source", issue.alias("issue")).filter("issue IS NOT NULL")
    return broken.groupBy("source", "issue").agg(F.count("*").alias("n"))


def issue_profile(pos: DataFrame, orders: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One pass over each source and one aggregation for all: events are counted by kind and key (issues have no key, so
    they are summed before they are shuffled, and so is a hot key), then the counts are turned into one row an issue."""
    events = union_by_name([pos_events(pos), order_events(orders), customer_events(snapshots)])
    groups = events.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("web").alias("web"), F.max("known").alias("known"))
    stray = (F.col("kind") == CUSTOMER) & (F.col("known") == 0) & F.col("key").isNotNull()
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    issues = {
        **{name: of(name, F.col("n")) for name in (
            "pos bad_date", "pos bad_price", "pos bad_quantity", "pos missing_category", "ecommerce bad_timestamp", "ecommerce bad_price",
            "ecommerce unknown_province", "customers bad_signup_date", "customers missing_email", "customers placeholder_name",
            "customers rows_total",
        )},
        "pos duplicate_rows": of(ROW, F.col("n") - 1),
        "ecommerce duplicate_orders": of(ORDER, F.col("n") - 1),
        "customers duplicate_keys": of(SNAPSHOT_KEY, F.col("n") - 1),
        "pos orphan_customer_ids": F.when(stray, F.col("n")),
        "ecommerce orphan_customer_ids": F.when(stray, F.col("web")),
    }
    totals = groups.agg(*[F.coalesce(F.sum(value), F.lit(0)).alias(name) for name, value in issues.items()])
    counts = as_rows(totals, "issue", {name: name for name in issues})
    name = lambda part: F.split_part(F.col("issue"), F.lit(" "), F.lit(part))
    return counts.select(name(1).alias("source"), name(2).alias("issue"), "n")
