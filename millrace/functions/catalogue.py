"""Fixed value tables."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from millrace.functions.text import clean, clean_upper, translate_value

# Top level of an e-commerce category path and the store category it stands for.
STORE_CATEGORY = {
    "Bags": "Packs",
    "Camp & Hike": "Camping",
    "Clothing": "Apparel",
    "Gear": "Accessories",
    "Shoes": "Footwear",
}
# Province and territory codes of Canada.
PROVINCE_CODE = {
    "ALBERTA": "AB",
    "BRITISH COLUMBIA": "BC",
    "MANITOBA": "MB",
    "NEW BRUNSWICK": "NB",
    "NEWFOUNDLAND AND LABRADOR": "NL",
    "NORTHWEST TERRITORIES": "NT",
    "NOVA SCOTIA": "NS",
    "NUNAVUT": "NU",
    "ONTARIO": "ON",
    "PRINCE EDWARD ISLAND": "PE",
    "QUEBEC": "QC",
    "SASKATCHEWAN": "SK",
    "YUKON": "YT",
}
PLACEHOLDER = "UNKNOWN"


def store_category(path: Column) -> Column:
    """Store category of a path such as 'Shoes > Boots'; an unmapped top level is kept, blank is NULL."""
    top = clean(F.split_part(path, F.lit(">"), F.lit(1)))
    return translate_value(top, STORE_CATEGORY)


def store_category_by_prefix(path: Column) -> Column:
    """SQL-path rule: category by what the path starts with, the placeholder for the rest."""
    branches = F.when(F.lit(False), F.lit(None).cast("string"))
    for prefix, category in STORE_CATEGORY.items():
        branches = branches.when(path.startswith(prefix), F.lit(category))
    return branches.otherwise(F.lit(PLACEHOLDER))


def province_code(name: Column) -> Column:
    """Two-letter code of a province name; a name that is not in the table is kept in upper case."""
    return translate_value(clean_upper(name), PROVINCE_CODE)
