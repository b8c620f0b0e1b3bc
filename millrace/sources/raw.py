"""Raw-zone readers. Only the dated folders (dt=.../) below a source folder are read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from millrace import schemas
from millrace.sources import landing

# Columns of a CSV line at most. A line with more than the header is cut to the header's, never an error.
MOST_COLUMNS = 1_000_000



def folder(base: str) -> str:
    return base.rstrip("/") + "/"


def dated(base: str) -> str:
    return folder(base) + "dt=*/"


def with_source_file(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.col("_metadata.file_path").alias("source_file"))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern names anything; one look-up, no listing of what lies below."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return found is not None and len(found) > 0


def source_exists(spark: SparkSession, base: str) -> bool:
    """Whether there is at least one dated folder below `base`."""
    return path_exists(spark, dated(base))


def read_pos(
    spark: SparkSession, base: str, check_header: bool = True, header: tuple[str, ...] = schemas.POS_HEADER,
    paths: list[str] | None = None,
) -> DataFrame:
    """Store sales, all text: those below `base`, or of it the files `paths`.

    The arrival check has made sure of the header, so it is declared, and a file with another one fails the
    job. Without `check_header` columns are taken by position: for files whose header is known to be this one,
    if with blanks around the names. Columns the header lacks are NULL.
    """
    absent = [name for name in schemas.POS_REQUIRED if name not in header]
    if absent:
        raise ValueError(f"The header lacks the columns: {', '.join(absent)}")
    reader = spark.read.option("header", True).option("basePath", folder(base)).option("maxColumns", MOST_COLUMNS)
    reader = reader.schema(schemas.text_record(*header, "dt")).option("enforceSchema", not check_header)
    rows = with_source_file(reader.csv(paths or dated(base)))
    for name in schemas.POS_HEADER:
        if name not in header:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    return rows.select(*schemas.POS_HEADER, F.col("dt").cast("string"), "source_file")


def pos_headers(spark: SparkSession, base: str, first: str | None = None, last: str | None = None) -> dict[tuple[str, ...], list[str]]:
    """The dated files below `base` by their header, blanks around the names left out. One small read a file."""
    files = landing.list_files(spark, base, first, last).where(F.col("key").startswith("dt=") & (F.col("size") > 0))
    line = F.split_part(F.regexp_replace(F.col("head"), "\r\n?", "\n"), F.lit("\n"), F.lit(1))
    names = F.transform(F.split(line, ","), lambda cell: F.trim(F.replace(cell, F.lit('"'), F.lit(""))))
    found: dict[tuple[str, ...], list[str]] = {}
    for names_of, path in landing.read_heads(files, line=True).select(names, "path").toLocalIterator():
        found.setdefault(tuple(names_of or ()), []).append(path)
    return {header: sorted(paths) for header, paths in sorted(found.items())}


def read_pos_variants(spark: SparkSession, base: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Store sales of a raw zone whose files differ in the order of their columns, in blanks around the names or
    in the payment type, which may be absent. A file without the other columns fails the job by name."""
    parts = []
    for header, paths in pos_headers(spark, base, first, last).items():
        absent = [name for name in schemas.POS_REQUIRED if name not in header]
        if absent:
            raise ValueError(f"{paths[0]} lacks the columns: {', '.join(absent)}")
        parts.append(read_pos(spark, base, check_header=False, header=header, paths=paths))
    if not parts:
        raise RuntimeError(f"No store sales under {base}.")
    return union_by_name(parts)


def read_order_lines(spark: SparkSession, base: str, paths: list[str] | None = None) -> DataFrame:
    """E-commerce orders, one per JSON line; a line that does not fit the schema is in `_corrupt_record`."""
    return with_source_file(
        spark.read.schema(schemas.ORDERS_RAW)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", schemas.CORRUPT)
        .option("basePath", folder(base))
        .json(paths or dated(base))
    )


def parse_order_lines(lines: DataFrame) -> DataFrame:
    """Orders out of text lines (columns `value`, `dt`) where they do not come from JSON files."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": schemas.CORRUPT}
    parsed = F.from_json(F.col("value"), schemas.ORDER_LINE, options)
    # Blank lines are no records. inline() keeps later filters from parsing each line once more.
    return lines.filter(F.trim(F.col("value")) != "").select(F.inline(F.array(parsed)), "dt")


def is_corrupt(lines: DataFrame) -> Column:
    """Whether a line does not fit the schema.

    Spark only notices a value of a wrong type in the columns it is asked for, so the condition asks for
    all of them: a count over the orders then sees the same lines as a query over every field.
    """
    fields = [F.col(name).isNull().cast("int") for name in schemas.ORDER.names if name in lines.columns]
    all_read = reduce(Column.__add__, fields) >= 0
    return F.col(schemas.CORRUPT).isNotNull() & all_read


def valid_orders(lines: DataFrame, bad_lines: Observation | None = None) -> DataFrame:
    """Orders without the corrupt lines, which `bad_lines` counts in the pass that reads the orders."""
    corrupt = is_corrupt(lines)
    if bad_lines is not None:
        lines = lines.observe(bad_lines, F.count_if(corrupt).alias("bad_lines"))
    return lines.filter(~corrupt).drop(schemas.CORRUPT)


def rejected_order_lines(lines: DataFrame) -> DataFrame:
    """Text of the lines `valid_orders` leaves out, so that nothing is lost without trace."""
    kept = [name for name in ("dt", "source_file") if name in lines.columns]
    return lines.filter(is_corrupt(lines)).select(F.col(schemas.CORRUPT).alias("line"), *kept)


def read_all_orders(spark: SparkSession, base: str) -> DataFrame:
    """Every JSON file below `base`, dated or not: the table the SQL path works on."""
    return valid_orders(
        spark.read.schema(schemas.ORDER_LINE)
        .option("columnNameOfCorruptRecord", schemas.CORRUPT)
        .option("recursiveFileLookup", True)
        .json(folder(base))
    )


def read_customers(
    spark: SparkSession, base: str, check_header: bool = True, paths: list[str] | None = None
) -> DataFrame:
    """All customer snapshots, or of them the files `paths`, all text."""
    return with_source_file(
        spark.read.schema(schemas.CUSTOMERS_RAW)
        .option("header", True)
        .option("enforceSchema", not check_header)
        .option("sep", "|")
        .option("basePath", folder(base))
        .csv(paths or dated(base))
    )


def latest_snapshot(spark: SparkSession, base: str) -> str | None:
    """Newest snapshot folder that holds data, as text. Folders are looked into from the newest down, so as a rule one is; no
    content is read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(dated(base).rstrip("/"))
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    days = {status.getPath().getName()[3:]: status.getPath() for status in store.globStatus(place) or [] if status.isDirectory()}
    for day in sorted(days, reverse=True):
        files = store.listFiles(days[day], True)
        while files.hasNext():
            status = files.next()
            if status.getLen() > 0 and status.getPath().getName()[:1] not in "_.":
                return day
    return None


def read_snapshot(spark: SparkSession, base: str, snapshot: str, check_header: bool = True) -> DataFrame:
    """One snapshot; the filter on dt prunes the other folders."""
    return read_customers(spark, base, check_header).filter(F.col("dt") == snapshot)


def newest_rows(snapshots: DataFrame) -> DataFrame:
    """Rows of the newest snapshot of a table that holds several."""
    newest = snapshots.select(F.max("dt")).scalar()
    return snapshots.filter(F.col("dt") == newest)


def in_date_range(rows: DataFrame, first: str = "2026-01-01", last: str | None = None) -> DataFrame:
    """Rows of the dated folders from `first` to `last` (today if not given); prunes partitions."""
    end = F.lit(last) if last else F.date_format(F.current_date(), "yyyy-MM-dd")
    return rows.filter((F.col("dt") >= first) & (F.col("dt") <= end))


def union_by_name(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
