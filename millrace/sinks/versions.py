"""Tables that change in one step: runs are written beside each other, and a small file that is written last says which of them count.

A table folder holds `_runs/published_run=<id>/` (the rows of one run, never changed) and `_versions/<number>.json`, the highest of
which is the table: its parts, each a run's folder, the days of it that were replaced since, and the labels of the batches in it. A run that
fails or is killed leaves the newest version as it was, and readers see all of a run or nothing. Both folders' names hide them from
readers that do not look up the version, which find no rows instead of too many.

One writer at a time: a second one that publishes the same number fails. The last KEEP versions and their runs stay for readers
that have planned with them; what a killed run left goes with vacuum(). A folder without versions is read as it lies.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

KEEP = 3
#: Parts made by labelled batches that are merged into one when there are more.
MOST_BATCHES = 50
RUN = "published_run"
#: Files that a task keeps open while it writes to folders; beyond that it sorts the rest of its rows.
OPEN_FILES = 100
#: Takes about two thirds of the space of the default.
COMPRESSION = "zstd"
#: Spark's folder name for rows without a day. They are in no range of days but the one of this name and the one open at both ends.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Part:
    """folder: below the table's parent. days: first and last dt of the run. without: ranges of days that newer parts replace."""

    folder: str
    days: tuple[str, str] | None = None
    without: tuple[tuple[str | None, str | None], ...] = ()
    labels: tuple[str, ...] = ()

    @property
    def run(self) -> str:
        return self.folder.split(f"/{RUN}=")[1].split("/")[0]


@dataclass(frozen=True)
class Version:
    number: int
    parts: tuple[Part, ...] = ()
    note: dict = field(default_factory=dict)


def _store(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _clean(table: str) -> str:
    return table.rstrip("/")


def _parent(table: str) -> tuple[str, str]:
    parent, name = _clean(table).rsplit("/", 1)
    return parent, name


def delete(spark: SparkSession, path: str) -> None:
    store, place = _store(spark, path)
    store.delete(place, True)


def numbers(spark: SparkSession, table: str) -> list[int]:
    store, place = _store(spark, f"{_clean(table)}/_versions")
    if not store.exists(place):
        return []
    names = [status.getPath().getName() for status in store.listStatus(place)]
    return sorted(int(name[:-5]) for name in names if name.endswith(".json") and not name.startswith("."))


def _load(spark: SparkSession, table: str, number: int) -> Version:
    store, place = _store(spark, f"{_clean(table)}/_versions/{number:012d}.json")
    stream = store.open(place)
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    found = json.loads(text)
    parts = [
        Part(p["folder"], p["days"] and tuple(p["days"]), tuple((a, b) for a, b in p["without"]), tuple(p["labels"]))
        for p in found["parts"]
    ]
    return Version(number, tuple(parts), found["note"])


def current(spark: SparkSession, table: str) -> Version | None:
    """The table's newest version, None if nothing has been published."""
    known = numbers(spark, table)
    return _load(spark, table, known[-1]) if known else None


def publish(spark: SparkSession, table: str, parts: list[Part], note: dict | None = None, keep: int = KEEP) -> None:
    """Makes the parts the table, by one rename, and drops versions beyond the last `keep` with the runs only they have."""
    known = numbers(spark, table)
    number = known[-1] + 1 if known else 1
    base = f"{_clean(table)}/_versions"
    store, target = _store(spark, f"{base}/{number:012d}.json")
    _, made = _store(spark, f"{base}/.{uuid.uuid4().hex}")
    stream = store.create(made, False)
    stream.write(bytearray(json.dumps({"parts": [asdict(p) for p in parts], "note": note or {}}).encode()))
    stream.close()
    if store.exists(target) or not store.rename(made, target):
        store.delete(made, False)
        raise RuntimeError(f"{table}: another run has published version {number}.")
    old, kept = [*known, number][:-keep], [*known, number][-keep:]
    if old:
        used = {p.folder for n in kept for p in _load(spark, table, n).parts}
        for n in old:
            for part in _load(spark, table, n).parts:
                if part.folder not in used:
                    delete(spark, f"{_parent(table)[0]}/{part.folder}")
            delete(spark, f"{base}/{n:012d}.json")


@contextmanager
def unsorted(spark: SparkSession, files: int = OPEN_FILES):
    """While writing to folders each task keeps a file open for each, so that its rows need no sort, which spills."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(files))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_run(rows: DataFrame, table: str, partition_by: tuple[str, ...] = ()) -> Part:
    """The rows as a run of the table, not yet published; nothing stays if writing fails."""
    spark, (parent, name) = rows.sparkSession, _parent(table)
    folder = f"{name}/_runs/{RUN}=r{uuid.uuid4().hex}"
    try:
        with unsorted(spark):
            rows.write.partitionBy(*partition_by).option("compression", COMPRESSION).parquet(f"{parent}/{folder}")
    except BaseException:
        delete(spark, f"{parent}/{folder}")
        raise
    days = None
    if partition_by[:1] == ("dt",):
        store, place = _store(spark, f"{parent}/{folder}")
        found = sorted(s.getPath().getName()[3:] for s in store.listStatus(place) if s.getPath().getName().startswith("dt="))
        days = (found[0], found[-1]) if found else ("", "")
    return Part(folder, days)


def replace(rows: DataFrame, table: str, partition_by: tuple[str, ...] = ()) -> None:
    """The rows become the table."""
    publish(rows.sparkSession, table, [write_run(rows, table, partition_by)])


def with_days(before: Version | None, made: Part, days: list[str]) -> list[Part]:
    """The parts of a table after the run `made` replaces some of its days."""
    return [*(Part(p.folder, p.days, (*p.without, *((d, d) for d in days)), p.labels) for p in (before.parts if before else ())), made]


def _covers(span: tuple[str | None, str | None], days: tuple[str, str] | None) -> bool:
    first, last = span
    if days is None or NO_DAY in days and span != (None, None):
        return False
    return (first is None or days[0] >= first) and (last is None or days[1] <= last)


def _inside(first: str | None, last: str | None) -> Column:
    """Whether a row's day is in the range."""
    if first == NO_DAY:
        return F.col("dt").isNull()
    inside = F.lit(True) if first is None else F.col("dt") >= first
    inside = inside if last is None else inside & (F.col("dt") <= last)
    return F.coalesce(inside, F.lit(False))


def with_range(before: Version | None, made: Part, first: str | None, last: str | None) -> list[Part]:
    """The parts of a table after the run `made` replaces its days from `first` to `last`."""
    span = (first, last)
    rest = [] if before is None else [p for p in before.parts if not _covers(span, p.days)]
    outside = lambda p: p.days is not None and (first is not None and p.days[1] < first or last is not None and p.days[0] > last)
    return [*(p if outside(p) else Part(p.folder, p.days, (*p.without, span), p.labels) for p in rest), made]


def replace_days(rows: DataFrame, table: str, first: str | None, last: str | None) -> None:
    """The rows become the table's days from `first` to `last`; the other days stay, and a day of the range without rows goes."""
    spark = rows.sparkSession
    before = current(spark, table)
    publish(spark, table, with_range(before, write_run(rows, table, ("dt",)), first, last))


def append(rows: DataFrame, table: str, label: str, partition_by: tuple[str, ...] = ("dt",), schema: T.StructType | None = None) -> None:
    """Adds the rows of a batch, once for each label: a batch that runs again replaces what it had added. Many batches' parts are merged."""
    spark = rows.sparkSession
    before = current(spark, table)
    parts = list(before.parts) if before else []
    if any(label in p.labels and len(p.labels) > 1 for p in parts):
        return  # published and merged since: the same batch gives the same rows
    made = write_run(rows, table, partition_by)
    parts = [p for p in parts if p.labels != (label,)] + [Part(made.folder, made.days, (), (label,))]
    small = [p for p in parts if p.labels]
    if len(small) > MOST_BATCHES:
        one = write_run(_read(spark, table, small, schema or rows.schema), table, partition_by)
        parts = [p for p in parts if not p.labels] + [Part(one.folder, one.days, (), tuple(x for p in small for x in p.labels))]
    publish(spark, table, parts, before.note if before else None)


def read(spark: SparkSession, table: str, schema: T.StructType | None = None) -> DataFrame:
    """The newest version of the table."""
    version = current(spark, table)
    if version is None:
        return (spark.read.schema(schema) if schema else spark.read).parquet(_clean(table))
    return _read(spark, table, list(version.parts), schema)


def _read(spark: SparkSession, table: str, parts: list[Part], schema: T.StructType | None) -> DataFrame:
    parent = _parent(table)[0]
    if len(parts) == 1 and not parts[0].without:
        path = f"{parent}/{parts[0].folder}"
        return (spark.read.schema(schema) if schema else spark.read).option("basePath", path).parquet(path)
    reader = spark.read.option("basePath", f"{parent}/{parts[0].folder.split('/_runs/')[0]}/_runs")
    if schema:
        reader = reader.schema(T.StructType([*schema.fields, T.StructField(RUN, T.StringType())]))
    rows = reader.parquet(*[f"{parent}/{p.folder}" for p in parts])
    dropped = F.lit(False)
    for part in parts:
        for first, last in part.without:
            dropped = dropped | ((F.col(RUN) == part.run) & _inside(first, last))
    # On folders' names alone, so what was replaced is not read.
    return rows.where(~dropped).drop(RUN) if any(p.without for p in parts) else rows.drop(RUN)


def vacuum(spark: SparkSession, table: str, older_than_hours: float = 24) -> int:
    """Removes runs that no version names and that are older; how many."""
    store, place = _store(spark, f"{_clean(table)}/_runs")
    if not store.exists(place):
        return 0
    used = {p.folder for n in numbers(spark, table) for p in _load(spark, table, n).parts}
    limit = spark._jvm.java.lang.System.currentTimeMillis() - older_than_hours * 3_600_000
    name, removed = _parent(table)[1], 0
    for status in store.listStatus(place):
        folder = f"{name}/_runs/{status.getPath().getName()}"
        # A run whose parts two tables share is kept as long as one of its folders is named.
        if status.getModificationTime() < limit and not any(f == folder or f.startswith(folder + "/") for f in used):
            store.delete(status.getPath(), True)
            removed += 1
    return removed
