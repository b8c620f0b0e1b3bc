"""Parquet writers. All publish in one step (see versions), so a failed run leaves what was there, and a second run gives the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.sinks import versions


def rebalanced(rows: DataFrame) -> DataFrame:
    """Rows moved together by day for fewer files; a large day is split over as many tasks as it needs."""
    return rows.hint("rebalance", "dt")


def write_by_day(rows: DataFrame, path: str, first: str | None = None, last: str | None = None) -> None:
    """One folder per dt. Raw files lie in dated folders, so a task holds few days and the rows can be
    written where they were read, without a shuffle.

    With `first` or `last` (the rows are of these days only) the other days stay; a day of the range without rows goes."""
    if first is None and last is None:
        versions.replace(rows, path, ("dt",))
    else:
        versions.replace_days(rows, path, first, last)


def write_whole(rows: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    versions.replace(rows, path, partition_by)


def write_outcomes(rows: DataFrame, column: str, paths: dict[str, str]) -> None:
    """Rows dealt to several tables by the value of a column, in one pass. Either all tables get theirs or none does: the run is complete
    before the first table names it."""
    spark, first = rows.sparkSession, next(iter(paths.values()))
    run = versions.write_run(rows, first, (column,))
    parent = first.rstrip("/").rsplit("/", 1)[0]
    for value, path in paths.items():
        if path.rstrip("/").rsplit("/", 1)[0] != parent:
            raise ValueError(f"{path} does not lie beside {first}.")
        store, place = versions._store(spark, f"{parent}/{run.folder}/{column}={value}")
        store.mkdirs(place)  # a value without rows has no folder yet
    for value, path in paths.items():
        versions.publish(spark, path, [versions.Part(f"{run.folder}/{column}={value}")])


def save_table(spark: SparkSession, rows: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Catalogue table in Parquet, below `path` or else the database's folder. The rows are written first; then the table is
    pointed to them."""
    if path is None:
        database, _, table = name.rpartition(".")
        place = spark.sql(f"DESCRIBE DATABASE {database or spark.catalog.currentDatabase()}").where("info_name = 'Location'").first()[1]
        path = f"{place}/{table}"
    versions.replace(rows, path)
    part = versions.current(spark, path).parts[0]
    location = f"{path.rstrip('/').rsplit('/', 1)[0]}/{part.folder}"
    known = spark.catalog.tableExists(name)
    if known and [(f.name, f.dataType) for f in spark.table(name).schema] == [(f.name, f.dataType) for f in rows.schema]:
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{location}'")
    else:
        if known:
            spark.sql(f"DROP TABLE {name}")
        spark.catalog.createTable(name, path=location, source="parquet", schema=rows.schema)
    spark.catalog.refreshTable(name)
    return spark.table(name)


def has_file_log(spark: SparkSession, path: str) -> bool:
    """Whether a file stream has written its log into a folder; readers then see only what is in the log."""
    store, place = versions._store(spark, path.rstrip("/") + "/_spark_metadata")
    return store.exists(place)


def append_batch(rows: DataFrame, path: str, label: str) -> None:
    """Appends rows to a table of days, once for each label: what an earlier attempt under the same label has left is replaced."""
    versions.append(rows, path, label)
