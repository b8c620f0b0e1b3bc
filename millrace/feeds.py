"""Raw retail feeds derived from the given tables, for the registered queries, tests and bench.

Each feed is a projection of one whole table (store sales of `lineitem`, orders of `orders`, customers
of `customer`): no join, no filter, no shuffle unless its days are wanted apart. Every kind of problem the pipeline has to deal with is
worked into the values by conditions on the keys, so the feeds grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace import schemas
from millrace.operators.arrival import FORMATS, landing_key
from millrace.sources.raw import parse_order_lines

QUARTER = "date_format(trunc({day}, 'quarter'), 'yyyy-MM-dd')"
PAD = "CASE WHEN length({text}) < 6 THEN lpad({text}, 6, '0') ELSE {text} END"


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    """A given table. One that comes in fewer pieces than there are cores (a small file is one row
    group) is spread over them; a large table, or any without `spread`, is read as it lies."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if not spread:
        return rows
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores, rows.columns[0]) if rows.rdd.getNumPartitions() < cores else rows


def days_apart(rows: DataFrame, day: str) -> DataFrame:
    """The rows with each day (an SQL expression) in a partition of its own, rows without one in the last. Moved before they
    become text, rows are a fraction as wide. One row a day passes through the driver."""
    spark, days = rows.sparkSession, rows.select(F.expr(day).alias("_day")).where("_day IS NOT NULL").distinct()
    found = sorted(row[0] for row in days.toLocalIterator())
    places = F.broadcast(spark.createDataFrame([(d, i) for i, d in enumerate(found)], "_day string, _place int"))
    placed = rows.withColumn("_day", F.expr(day)).join(places, "_day", "left")
    moved = placed.repartitionById(len(found) + 1, F.coalesce("_place", F.lit(len(found))))
    return moved.drop("_day", "_place")


def pad6(number: str) -> str:
    return PAD.format(text=f"cast({number} AS string)")


def raw_pos(spark: SparkSession, sf_dir: str, apart: bool = False) -> DataFrame:
    """Store sales as text, one row per line item and a second one where a copy was sent. `apart`: see days_apart()."""
    given = table(spark, sf_dir, "lineitem", spread=not apart)
    if apart:
        given = days_apart(given, QUARTER.format(day="cast(l_shipdate AS date)"))
    lines = given.withColumns({
        "store": F.expr("concat('S', lpad(cast(l_suppkey % 40 + 1 AS string), 3, '0'))"),
        "day": F.expr("cast(l_shipdate AS date)"),
        "copy": F.expr("explode(sequence(1, CASE WHEN l_orderkey % 199 = 4 AND l_linenumber = 1 THEN 2 ELSE 1 END))"),
    })
    return lines.selectExpr(
        "CASE WHEN l_orderkey % 997 = 0 THEN ' ' ELSE concat(store, '-', l_orderkey, '-', l_linenumber) END AS txn_id",
        "store AS store_id",
        """CASE l_suppkey % 6 WHEN 0 THEN 'ON' WHEN 1 THEN 'QC' WHEN 2 THEN 'bc ' WHEN 3 THEN 'AB'
           WHEN 4 THEN 'MB' ELSE '' END AS province""",
        """CASE l_partkey % 83 WHEN 0 THEN '2031-19-02' WHEN 1 THEN '30/02/2031' WHEN 2 THEN '77/88/1999'
           WHEN 3 THEN '' WHEN 4 THEN '4/7/2031' WHEN 5 THEN '02/29/2031'
           ELSE date_format(day, 'MM/dd/yyyy') END AS txn_date""",
        """concat(CASE l_partkey % 3 WHEN 0 THEN 'TH-' WHEN 1 THEN 'th-' ELSE 'TH' END, l_partkey) AS sku""",
        "concat(' Item ', l_partkey, CASE WHEN l_partkey % 2 = 0 THEN '  ' ELSE '' END) AS product_name",
        """CASE l_partkey % 97 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN ' ' WHEN 2 THEN 'unknown'
           ELSE CASE l_partkey % 5 WHEN 0 THEN 'Camping' WHEN 1 THEN 'Apparel' WHEN 2 THEN 'Footwear'
                WHEN 3 THEN 'Accessories' ELSE 'Packs' END END AS category""",
        """CASE l_suppkey % 50 WHEN 0 THEN '0' WHEN 1 THEN '-7' WHEN 2 THEN 'some' WHEN 3 THEN '2.5'
           WHEN 4 THEN ' 3 ' ELSE cast(cast(l_quantity AS int) AS string) END AS quantity""",
        """CASE l_partkey % 89 WHEN 0 THEN 'free' WHEN 1 THEN '-5.25' WHEN 2 THEN '0.00' WHEN 3 THEN '2.999'
           WHEN 4 THEN '123456789.00'
           ELSE cast(cast(l_extendedprice AS decimal(12,2)) AS string) END AS unit_price""",
        "CASE l_returnflag WHEN 'A' THEN 'credit' WHEN 'N' THEN 'debit' ELSE 'cash' END AS payment_type",
        f"""CASE WHEN l_partkey % 2 = 0 THEN '' WHEN l_partkey % 25 = 7 THEN concat('L', 900000 + l_partkey)
            WHEN l_partkey % 25 = 9 THEN concat('l', {pad6('l_partkey')})
            ELSE concat('L', {pad6('l_partkey')}) END AS loyalty_id""",
        f"{QUARTER.format(day='day')} AS dt",
    )


def order_documents(spark: SparkSession, sf_dir: str, apart: bool = False) -> DataFrame:
    """Well-formed nested orders, one per row of `orders`, and how often each was sent. `apart`: see days_apart()."""
    given = table(spark, sf_dir, "orders", spread=not apart)
    if apart:
        given = days_apart(given, QUARTER.format(day="cast(o_orderdate AS date)"))
    orders = given.withColumns({
        "day": F.expr("cast(o_orderdate AS date)"),
        "cents": F.expr("cast(cast(o_totalprice AS decimal(14,2)) * 100 AS bigint)"),
        "buyer": F.expr("""CASE WHEN o_custkey % 9 = 0 THEN NULL WHEN o_custkey % 25 = 7 THEN 900000 + o_custkey
                           ELSE o_custkey END"""),
    })
    item = """named_struct(
        'sku', concat('TH', o_custkey % 500 + 1000 + i),
        'title', concat('Product ', o_custkey % 500 + 1000 + i),
        'categoryPath', CASE (o_custkey + i) % 97 WHEN 2 THEN 'Toys > Plush' WHEN 3 THEN ' '
            ELSE CASE (o_custkey + i) % 5 WHEN 0 THEN 'Camp & Hike > Tents' WHEN 1 THEN 'Clothing > Pants'
                 WHEN 2 THEN 'Shoes > Boots' WHEN 3 THEN 'Gear > Lighting' ELSE 'Bags > Daypacks' END END,
        'qty', CASE (o_orderkey + i) % 61 WHEN 0 THEN 0L WHEN 1 THEN 3000000000L ELSE cast(i + o_orderkey % 3 AS bigint) END,
        'priceCents', CASE (o_orderkey + i) % 101 WHEN 0 THEN -1L WHEN 1 THEN 0L ELSE cents % 100000 + i END)"""
    return orders.selectExpr(
        f"CASE WHEN o_orderkey % 499 = 0 THEN NULL ELSE concat('EC-', {pad6('o_orderkey')}) END AS orderId",
        """CASE o_orderkey % 71 WHEN 0 THEN '2031-02-29T07:30:00-05:00' WHEN 2 THEN 'last week'
           WHEN 4 THEN '29.01.2031 07:30' WHEN 6 THEN '' WHEN 8 THEN concat(date_format(day, 'yyyy-MM-dd'), 'T10:15:00')
           WHEN 10 THEN concat(date_format(day, 'yyyy-MM-dd'), 'T10:15:00Z')
           ELSE concat(date_format(day, 'yyyy-MM-dd'), 'T10:15:00-04:00') END AS orderTimestamp""",
        "CASE WHEN o_custkey % 2 = 0 THEN 'web' WHEN o_custkey % 31 = 1 THEN ' App' ELSE 'app' END AS channel",
        "CASE o_orderkey % 16 WHEN 1 THEN 'USD' WHEN 3 THEN 'usd ' WHEN 7 THEN 'EUR' WHEN 9 THEN NULL ELSE 'CAD' END AS currency",
        "named_struct('customerId', buyer, 'guest', buyer IS NULL) AS customer",
        """named_struct('province', CASE WHEN o_orderkey % 97 = 1 THEN 'UNKNOWN'
               ELSE CASE o_custkey % 4 WHEN 0 THEN 'ON' WHEN 1 THEN 'qc' WHEN 2 THEN 'AB ' ELSE NULL END END,
           'country', 'CA') AS shippingAddress""",
        f"""CASE WHEN o_orderkey % 101 = 50 THEN NULL
            ELSE transform(slice(array(1, 2, 3), 1, cast(o_orderkey % 4 AS int)), i -> {item}) END AS items""",
        f"{QUARTER.format(day='day')} AS dt",
        "o_orderkey AS order_key",
        "CASE WHEN o_orderkey % 59 = 3 THEN 2 ELSE 1 END AS copies",
    )


def order_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as JSON lines (columns `value`, `dt`); some cut short, some with a value of a wrong type."""
    json = F.to_json(F.struct(*schemas.ORDER.names))
    value = (
        F.when(F.col("order_key") % 211 == 5, F.left(json, F.lit(25)))
        .when(F.col("order_key") % 223 == 6, F.replace(json, F.lit('"guest":'), F.lit('"guest":"no","was":')))
        .otherwise(json)
    )
    documents = order_documents(spark, sf_dir)
    return documents.select(F.explode(F.array_repeat(value, F.col("copies"))).alias("value"), "dt")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON lines parsed with the declared schema."""
    return parse_order_lines(order_text(spark, sf_dir))


def raw_customers(spark: SparkSession, sf_dir: str, apart: bool = False) -> DataFrame:
    """Two customer snapshots as text; the first one lacks some customers, both hold repeated ids. `apart`: see days_apart()."""
    snapshots = table(spark, sf_dir, "customer", spread=not apart).withColumns({
        "dt": F.expr("""explode(CASE WHEN c_custkey % 20 = 0 THEN array('2026-09-28')
                        ELSE array('2026-09-21', '2026-09-28') END)"""),
    })
    if apart:
        snapshots = days_apart(snapshots, "dt")
    customers = snapshots.withColumns({
        "copy": F.expr("explode(sequence(1, CASE WHEN c_custkey % 101 = 5 THEN 2 ELSE 1 END))"),
    })
    return customers.selectExpr(
        f"{pad6('c_custkey')} AS cust_no",
        "concat('First', c_custkey % 50) AS first_name",
        "CASE WHEN c_custkey % 83 = 0 THEN 'UNKNOWN' ELSE c_name END AS last_name",
        """CASE c_custkey % 31 WHEN 0 THEN 'N/A' WHEN 1 THEN ''
           ELSE concat('c', c_custkey, '@example.com') END AS email""",
        """CASE c_custkey % 67 WHEN 0 THEN '01-JAN-00' WHEN 1 THEN '99-DEC-99' WHEN 2 THEN '18-Jan-22'
           ELSE upper(date_format(date_add(date'2019-01-01', cast(c_custkey % 2800 AS int)), 'dd-MMM-yy')) END AS signup_dt""",
        """CASE (c_nationkey + copy - 1) % 7 WHEN 0 THEN 'Ontario' WHEN 1 THEN 'Quebec' WHEN 2 THEN 'British Columbia'
           WHEN 3 THEN 'Alberta' WHEN 4 THEN ' manitoba' WHEN 5 THEN 'Nova Scotia' ELSE 'Atlantis' END AS province""",
        "lower(left(c_mktsegment, 3)) AS segment_cd",
        "CASE c_custkey % 5 WHEN 0 THEN 'N' WHEN 1 THEN '' WHEN 2 THEN 'y' ELSE 'Y' END AS opt_in",
        "dt",
    )


def file_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small file per order as the landing reader gives it: sound ones and each kind of broken one."""
    pos, customers = ",".join(schemas.POS_HEADER), "|".join(schemas.CUSTOMER_HEADER)
    table_file = f"""concat(CASE source WHEN 'pos' THEN '{pos}' ELSE '{customers}' END, '\\r\\n',
                     o_orderkey, CASE source WHEN 'pos' THEN ',' ELSE '|' END, o_custkey, '\\r\\n')"""
    order_file = """concat('\\n{"orderId":"EC-', o_orderkey, '","items":null,"customerId":', o_custkey, '}\\n')"""
    orders = table(spark, sf_dir, "orders").withColumns({
        "day": F.expr("cast(o_orderdate AS date)"),
        "source": F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'pos' WHEN 1 THEN 'ecommerce' ELSE 'customers' END"),
        "suffix": F.expr("CASE o_orderkey % 3 WHEN 0 THEN '.csv' WHEN 1 THEN '.json' ELSE '.txt' END"),
    }).withColumns({
        "name": F.expr(file_name()),
        "head": F.expr(f"""CASE o_orderkey % 11 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN ' \\n \\n'
            WHEN 3 THEN CASE source WHEN 'ecommerce' THEN '[1, 2]' ELSE 'a;b\\u00e9\\n1;2\\n' END
            WHEN 4 THEN CASE source WHEN 'ecommerce' THEN 'not json' WHEN 'pos' THEN '{pos}\\n' ELSE '{customers}\\n \\n' END
            WHEN 5 THEN CASE source WHEN 'ecommerce' THEN '{{"orderId":"x","item":[]}}'
                        ELSE replace(replace({table_file}, ',', ' , '), '|', ' | ') END
            ELSE CASE source WHEN 'ecommerce' THEN {order_file} ELSE {table_file} END END"""),
    })
    return orders.selectExpr(
        "concat('file:/', source, '/', name) AS path",
        """concat(CASE WHEN o_orderkey % 19 = 7 THEN 'other' ELSE source END, '/dt=',
           date_format(day, 'yyyy-MM-dd'), '/', name) AS key""",
        "CASE WHEN head IS NULL THEN 9L ELSE cast(octet_length(head) AS bigint) END AS size",
        "head",
        "CASE WHEN o_orderkey % 401 = 400 THEN 'cannot be opened' END AS error",
    )


def file_name() -> str:
    """File names with and without a usable date (columns o_orderkey, day, suffix)."""
    return """concat('f', o_orderkey, CASE o_orderkey % 5
        WHEN 0 THEN concat('_', date_format(day, 'yyyy-MM-dd'))
        WHEN 1 THEN concat('-', date_format(day, 'yyyyMMdd'))
        WHEN 2 THEN concat('_2026-13-45_', date_format(day, 'yyyyMMdd'))
        WHEN 3 THEN concat('_', date_format(day, 'yyyyMMdd'), '_', date_format(date_add(day, 1200), 'yyyy-MM-dd'))
        ELSE '_none' END, suffix)"""


def landed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landing content by place and size: a third of the files of `file_heads`, some with another size."""
    heads = file_heads(spark, sf_dir).withColumn("name", F.element_at(F.split("key", "/"), -1))
    place = F.lit(None).cast("string")
    for folder, suffix in FORMATS.values():
        place = F.when(F.col("name").endswith(suffix), landing_key(folder, F.col("name"))).otherwise(place)
    number = F.regexp_extract("name", r"^f(\d+)", 1).cast("bigint")
    changed = F.when(number % 9 == 3, 1).otherwise(0)
    return heads.withColumn("number", number).select(
        F.when(number % 3 == 0, place).otherwise(F.concat(F.lit("old/"), place)).alias("key"),
        (F.col("size") + changed).alias("size"),
    )
