"""Landing-zone files: which there are, how large and how old they are, and how each one begins.

The arrival check looks at the first 64 KiB of a file. No built-in source reads a part of a file, so a
small `mapInPandas` step does one ranged read per file; everything decided from it is a Spark expression.
Folders are listed in tasks too, level by level, so that no list of files passes through the driver. Files
of zero bytes, which have no rows in any Spark source, are listed like the others. Names that begin with `_`
or `.` are left out, as Spark's readers never read them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

HEAD_BYTES = 65536
# Heads held in memory at a time.
FILES_AT_ONCE = 64
LISTED = "folder string, path string, size bigint, modified timestamp"
FILES = "path string, key string, size bigint, modified timestamp"


def canonical(path: Column) -> Column:
    """One form for file:/x and file:///x with or without escapes, so that paths of different readers compare equal."""
    # url_decode takes a plus for a space, which it is not in a path.
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "^([A-Za-z0-9]+):/+", "$1:/")


def in_days(day: Column, first: str | None, last: str | None) -> Column:
    """Whether a day is in the range; a limit that is None is open."""
    return (F.lit(first is None) | (day >= F.lit(first or ""))) & (F.lit(last is None) | (day <= F.lit(last or "")))


def list_files(spark: SparkSession, base: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """All files below `base` with path, key relative to `base`, size and time of the last change.

    The first two levels (sources and days) are listed folder by folder, each day's folder as a whole by
    one task: an order of magnitude more tasks than sources, and no action. Of folders dt=..., only the days from
    `first` to `last` are listed.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(base.rstrip("/"))
    root = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    root = re.sub("^([A-Za-z0-9]+):/+", r"\1:/", root)
    n = spark.sparkContext.defaultParallelism
    found = spark.createDataFrame([(root, None, None, None)], LISTED)
    for deep in (False, False, True):
        found = found.mapInPandas(_lister(deep), LISTED)
        if not deep:
            day = F.regexp_extract("folder", "/dt=([^/]*)$", 1)
            found = found.where(F.col("path").isNotNull() | (day == "") | in_days(day, first, last)).repartition(n)
    key = F.substr(F.col("path"), F.lit(len(root) + 2))
    return found.where("path IS NOT NULL").select("path", key.alias("key"), "size", "modified")


def list_folders(spark: SparkSession, base: str, folders: list[str]) -> DataFrame:
    """All files of the given folders (source/day, below `base`) as list_files gives them: nothing else is listed."""
    place = spark._jvm.org.apache.hadoop.fs.Path(base.rstrip("/"))
    root = re.sub("^([A-Za-z0-9]+):/+", r"\1:/", place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString())
    found = spark.createDataFrame([(f"{root}/{folder}", None, None, None) for folder in folders], LISTED)
    found = found.repartition(max(1, min(len(folders), spark.sparkContext.defaultParallelism)))
    key = F.substr(F.col("path"), F.lit(len(root) + 2))
    return found.mapInPandas(_lister(True), LISTED).where("path IS NOT NULL").select("path", key.alias("key"), "size", "modified")


def _lister(deep: bool):
    """Lists the folders of a batch (their files and, unless `deep`, their folders); files found before pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            rows = []
            for folder, path, size, modified in batch.itertuples(index=False):
                if path is not None and path == path:
                    rows.append((folder, path, size, modified))
                    continue
                if folder is None:
                    continue
                store, name = fs.FileSystem.from_uri(_arrow_uri(folder))
                head = folder[: len(folder) - len(name.strip("/"))] if folder.endswith(name.strip("/")) else folder
                for info in store.get_file_info(fs.FileSelector(name, allow_not_found=True, recursive=deep)):
                    full = head + info.path.lstrip("/")
                    if any(part[:1] in "_." for part in full[len(folder) + 1:].split("/")):
                        continue
                    if info.is_file:
                        stamp = pd.Timestamp(info.mtime_ns, unit="ns").floor("ms") if info.mtime_ns is not None else pd.NaT
                        rows.append((folder, full, info.size, stamp))
                    elif not deep:
                        rows.append((full, None, None, pd.NaT))
            frame = pd.DataFrame(rows, columns=["folder", "path", "size", "modified"])
            frame["size"] = pd.array(frame["size"], dtype="Int64")
            frame["modified"] = pd.to_datetime(frame["modified"])
            yield frame

    return run


def _arrow_uri(path: str) -> str:
    """file:/x as file:///x and s3a:/bucket/x as s3://bucket/x, the forms Arrow takes."""
    scheme, rest = path.split(":/", 1)
    rest = quote(rest)
    if scheme == "file":
        return f"file:///{rest}"
    return f"{'s3' if scheme == 's3a' else scheme}://{rest}"


def _begin_of(path: str, limit: int, line: bool = False) -> tuple[int | None, str | None, str | None]:
    """Size, first `limit` bytes as text (NULL when they are not UTF-8) and read error of one file.

    With `line` it reads on until the first filled line and something after it are there.
    """
    from pyarrow import ArrowException, fs

    try:
        store, name = fs.FileSystem.from_uri(_arrow_uri(path))
        size = store.get_file_info(name).size
        if size is None:
            return None, None, "file not found"
        with store.open_input_file(name) as stream:
            head = stream.read(limit)
            while line and len(head) < size and len(head.lstrip().replace(b"\r", b"\n").split(b"\n", 1)) < 2:
                limit *= 2
                head += stream.read(limit)
            limit = len(head)
    except (OSError, ArrowException, ValueError) as error:
        return None, None, str(error)
    try:
        return size, head.decode("utf-8-sig"), None
    except UnicodeDecodeError as error:
        # A character that the limit cuts in two is no fault of the file. The positions of the error
        # count without a byte order mark, as does the object it carries.
        cut_off = error.end == len(error.object) and error.reason == "unexpected end of data"
        if size > limit and cut_off:
            return size, error.object[: error.start].decode("utf-8"), None
        return size, None, None


def read_heads(files: DataFrame, limit: int = HEAD_BYTES, line: bool = False) -> DataFrame:
    """The files with `size`, `head` and `error`; with `line` the first filled line is whole, however long.

    Waiting for the store takes the time here, not the few bytes of the listing, so the files are dealt
    out to all cores; the number is given because AQE would merge such small partitions into one.
    """

    def peek(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), FILES_AT_ONCE):
                part = batch.iloc[start:start + FILES_AT_ONCE]
                found = [_begin_of(path, limit, line) for path in part["path"]]
                yield pd.DataFrame({
                    "path": part["path"].tolist(),
                    "key": part["key"].tolist(),
                    "size": pd.array([size for size, _, _ in found], dtype="Int64"),
                    "modified": pd.to_datetime(part["modified"].reset_index(drop=True)),
                    "head": [head for _, head, _ in found],
                    "error": [error for _, _, error in found],
                })

    modified = F.col("modified") if "modified" in files.columns else F.lit(None).cast("timestamp").alias("modified")
    dealt = files.select("path", "key", modified).repartition(files.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInPandas(peek, f"{FILES}, head string, error string")
