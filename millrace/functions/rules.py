"""The five quality rules. Each condition is true or false, never NULL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from millrace.functions.catalogue import PLACEHOLDER
from millrace.functions.text import name_list

# Rule names, in report order.
DATE_RULE = "R1_sale_date"
QUANTITY_RULE = "R2_quantity"
PRICE_RULE = "R3_unit_price"
DUPLICATE_RULE = "R4_duplicate_sale_id"
CATEGORY_RULE = "R5_category"
RULES = (DATE_RULE, QUANTITY_RULE, PRICE_RULE, DUPLICATE_RULE, CATEGORY_RULE)


def not_positive(col: Column) -> Column:
    return F.coalesce(col <= 0, F.lit(True))


def no_category(col: Column) -> Column:
    """NULL, only spaces, or the placeholder in any case."""
    return F.coalesce((F.trim(col) == "") | (F.upper(col) == PLACEHOLDER), F.lit(True))


def row_rules() -> dict[str, Column]:
    """The rules that look at one row alone."""
    return {
        DATE_RULE: F.col("sale_date").isNull(),
        QUANTITY_RULE: not_positive(F.col("quantity")),
        PRICE_RULE: not_positive(F.col("unit_price_cad")),
        CATEGORY_RULE: no_category(F.col("category")),
    }


def any_of(conditions) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


def passes_row_rules() -> Column:
    """Complement of the row rules, written so that each part can be pushed into a Parquet scan."""
    return (
        F.col("sale_date").isNotNull()
        & (F.col("quantity") > 0)
        & (F.col("unit_price_cad") > 0)
        & (F.trim(F.col("category")) != "")
        & (F.upper(F.col("category")) != PLACEHOLDER)
    )


def reasons(duplicate: Column) -> Column:
    """All failed rules in report order, '' for a row that passes."""
    failed = {**row_rules(), DUPLICATE_RULE: duplicate}
    return name_list(**{rule: failed[rule] for rule in RULES})
