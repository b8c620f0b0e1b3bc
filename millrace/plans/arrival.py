"""Landing files to the manifest that says which of them the raw zone takes."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace import schemas
from millrace.operators import arrival
from millrace.operators.keys import stored
from millrace.sinks import versions
from millrace.sinks.tables import rebalanced
from millrace.sources import landing

log = logging.getLogger(__name__)


def read_manifest(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Stored manifest, empty where none has been written yet; with `first` or `last` only of the folders of these days.

    After a compaction it is the last verdicts of then and all that were added since.
    """
    try:
        verdicts = spark.read.schema(schemas.MANIFEST).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.MANIFEST)
    days = landing.in_days(F.col("dt"), first, last)
    compacted = versions.current(spark, _compacted(path))
    if compacted:
        since = F.timestamp_micros(F.lit(compacted.note["checked_until"]))
        before = versions.read(spark, _compacted(path), schemas.MANIFEST).select(*schemas.MANIFEST.names)
        verdicts = before.union(verdicts.where(F.col("checked_at") > since).select(*schemas.MANIFEST.names))
    return verdicts if first is None and last is None else verdicts.where(days)


def _compacted(path: str) -> str:
    return path.rstrip("/") + "/_last"


def compact_manifest(spark: SparkSession, path: str) -> int:
    """Stores the last verdict of each path apart, so that later runs read these and what is added from now on; how many.

    The verdicts themselves stay where they are, as streams read them; those checked before may be removed once all streams have
    passed them. Not while an arrival job runs.
    """
    verdicts = read_manifest(spark, path)
    until = verdicts.agg(F.unix_micros(F.max("checked_at"))).first()[0]
    if until is None:
        return 0
    last = arrival.last_verdicts(verdicts).select(*schemas.MANIFEST.names)
    part = versions.write_run(rebalanced(last), _compacted(path), ("dt",))
    versions.publish(spark, _compacted(path), [part], {"checked_until": until})
    return versions.read(spark, _compacted(path), schemas.MANIFEST).count()


def check_landing(
    spark: SparkSession, landing_zone: str, seen: DataFrame | None = None,
    pos_header: tuple[str, ...] = schemas.POS_HEADER, folders: list[str] | None = None,
) -> DataFrame:
    """Verdict on every file of the landing zone, or of its `folders` (source/day); on new and changed ones only if `seen` is given.

    Sizes and times come from the listing; only files of a source that have no verdict are opened.
    """
    listed = landing.list_files(spark, landing_zone) if folders is None else landing.list_folders(spark, landing_zone, folders)
    files = arrival.routed(listed)
    if seen is not None:
        files = arrival.not_yet_seen(files, seen)
    return arrival.manifest(landing.read_heads(files), pos_header)


def arrival_job(
    spark: SparkSession, landing_zone: str, manifest_path: str, pos_header: tuple[str, ...] = schemas.POS_HEADER,
    folders: list[str] | None = None,
) -> DataFrame:
    """Check what is new or changed and append it to the manifest, which lies in folders of days. Running it again adds nothing.

    Files that could not be read stay out of the manifest, so that the next run tries them again. With `folders` only these
    folders (source/dt=...) are listed, and of the manifest only the days from the first to the last of them are read.
    """
    days = sorted(folder.partition("/dt=")[2] for folder in folders or ())
    known = read_manifest(spark, manifest_path, *((days[0], days[-1]) if days and all(days) else (None, None)))
    # Stored first: one short row for each file that was opened.
    verdicts = stored(spark, check_landing(spark, landing_zone, known, pos_header, folders), "verdicts")
    unread = F.col("status") == arrival.FAILED
    # As few files a run as there are verdicts to write.
    rebalanced(verdicts.filter(~unread)).write.mode("append").partitionBy("dt").parquet(manifest_path)
    failed = verdicts.filter(unread).count()
    if failed:
        log.warning("%d files could not be read", failed)
    return read_manifest(spark, manifest_path)


def accepted_paths(
    spark: SparkSession, landing_zone: str, manifest: DataFrame, first: str | None = None, last: str | None = None
) -> dict[str, list[tuple[str, str]]]:
    """(dt, path) of the accepted, unchanged files in dated folders of each source, in order. What a reader is given instead of
    the folder, so that rejected files are never opened; it keeps the same list to plan its tasks. Only the days from `first`
    to `last` are listed, if given."""
    found: dict[str, list[tuple[str, str]]] = {}
    # The days come first: they prune the manifest's folders, and a path has one day.
    manifest = manifest.where(F.col("dt").isNotNull() & landing.in_days(F.col("dt"), first, last))
    for row in arrival.accepted_now(manifest, landing.list_files(spark, landing_zone, first, last)).toLocalIterator():
        found.setdefault(row.source, []).append((row.dt, row.path))
    return {source: sorted(paths) for source, paths in found.items()}


def sending_plan(spark: SparkSession, source_folder: str, landing_zone: str | None, kind: str) -> DataFrame:
    """What sending a local folder to the landing zone would do with each file."""
    heads = landing.read_heads(landing.list_files(spark, source_folder), line=True)
    if landing_zone is None:
        landed = spark.createDataFrame([], "key string, size bigint")
    else:
        landed = landing.list_files(spark, landing_zone)
    return arrival.sending_list(heads, landed, (kind,))
