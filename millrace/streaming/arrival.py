"""Arrival check driven by a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.plans.arrival import arrival_job
from millrace.sources.landing import canonical

FILE = "path string, modificationTime timestamp, length bigint, content binary"
#: Files of a batch at most; no batch's list of folders is longer.
FILES_PER_BATCH = 10_000


def touched_folders(batch: DataFrame, landing_zone: str) -> list[str]:
    """Folders (source/day) that the files of a batch (column path) lie in; as many as the batch has files at most."""
    spark = batch.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(landing_zone.rstrip("/"))
    root = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    below = F.substr(canonical(F.col("path")), F.length(canonical(F.lit(root))) + 2)
    return sorted(row[0] for row in batch.select(F.substring_index(below, "/", 2)).distinct().toLocalIterator())


def watch_landing(
    spark: SparkSession, landing_zone: str, manifest_path: str, checkpoint: str, glob: str = "*/*/*", files_per_batch: int = FILES_PER_BATCH
) -> StreamingQuery:
    """Check files as they arrive, until all that are there now are done.

    The stream tells what arrived (only the listing is read, no content). Each batch lists the folders its files lie in and takes
    what the manifest's verdicts of these days do not know: this includes files of zero bytes, which give no rows in a
    stream, and makes a batch that is run again after a failure harmless. Days that hold nothing but such files are
    left to the batch job, which lists the whole zone.
    """
    base = landing_zone.rstrip("/")
    arrived = (
        spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", files_per_batch)
        .load(f"{base}/{glob}").select("path", "length")
    )

    def check(batch: DataFrame, batch_id: int) -> None:
        folders = touched_folders(batch, landing_zone)
        if folders:
            arrival_job(batch.sparkSession, landing_zone, manifest_path, folders=folders)

    return (
        arrived.writeStream.foreachBatch(check)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
