"""Compares all registered queries with their SQL: python tests/check_all.py [sf_dir] [name ...]"""

import sys
import time
import traceback

sys.path[:0] = ["/root/repo", "/root/repo/tests"]

from pyspark.sql import SparkSession  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from compare import difference, duck  # noqa: E402

sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:] or list(queries())
spark = (
    SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").getOrCreate()
)
spark.sparkContext.setLogLevel("OFF")
connection = duck(sf_dir)
failed = 0
for name in names:
    start = time.time()
    try:
        problem = difference(queries()[name](spark, sf_dir), connection, oracle_sql()[name])
    except Exception as error:
        problem = f"{type(error).__name__}: {str(error)[:600]}"
        if "-v" in sys.argv:
            traceback.print_exc()
    failed += problem is not None
    print(f"{name:28s} {time.time() - start:6.2f}s {problem or 'same'}", flush=True)
print(f"{failed} differ")
