"""Conforming of arriving raw files. The gate stays a batch job, since a duplicate may come at any time."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace import schemas
from millrace.functions.numbers import USD_TO_CAD
from millrace.operators.arrival import ACCEPTED
from millrace.operators.conform import conform_ecommerce, conform_pos
from millrace.plans.arrival import accepted_paths
from millrace.session import pin_session
from millrace.sinks.tables import append_batch
from millrace.sources import raw


def stream_pos(spark: SparkSession, base: str) -> DataFrame:
    files = (
        spark.readStream.schema(schemas.POS_RAW).option("header", True).option("enforceSchema", False)
        .option("basePath", raw.folder(base)).csv(raw.dated(base))
    )
    return conform_pos(raw.with_source_file(files))


def stream_orders(spark: SparkSession, base: str, usd_to_cad: str = USD_TO_CAD) -> DataFrame:
    files = (
        spark.readStream.schema(schemas.ORDERS_RAW).option("columnNameOfCorruptRecord", schemas.CORRUPT)
        .option("basePath", raw.folder(base)).json(raw.dated(base))
    )
    return conform_ecommerce(raw.valid_orders(raw.with_source_file(files)), usd_to_cad)


def stream_sales(spark: SparkSession, raw_zone: str, usd_to_cad: str = USD_TO_CAD) -> DataFrame:
    """Both sources as one stream: a file sink takes one query only."""
    base = raw.folder(raw_zone)
    streams = []
    if raw.source_exists(spark, base + "pos"):
        streams.append(stream_pos(spark, base + "pos"))
    if raw.source_exists(spark, base + "ecommerce"):
        streams.append(stream_orders(spark, base + "ecommerce", usd_to_cad))
    if not streams:
        raise RuntimeError(f"No input under {base}.")
    return raw.union_by_name(streams)


def append_sales(sales: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to the conformed table, each file once.

    The layout is that of the batch job, whose rows stay: no log is put into the folder. A batch that runs again after a
    failure replaces what it had written.
    """
    label = f"stream-{zlib.crc32(checkpoint.encode()):08x}"

    def append(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch, path, f"{label}-{batch_id}")

    return (
        sales.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stream_accepted(
    spark: SparkSession, landing_zone: str, manifest_path: str, trusted_zone: str, checkpoint: str,
    usd_to_cad: str = USD_TO_CAD, pos_header: tuple[str, ...] = schemas.POS_HEADER,
) -> StreamingQuery:
    """Conform and append the files of a landing zone as the arrival check accepts them.

    The stream is the manifest; a batch opens only files with an accepting verdict that have not changed since. A file that was
    accepted before in another state cannot be replaced by appending: the batch fails and asks for the sales job.
    """
    pin_session(spark)
    base, label = raw.folder(landing_zone), f"stream-{zlib.crc32(checkpoint.encode()):08x}"
    verdicts = spark.readStream.schema(schemas.MANIFEST).parquet(manifest_path)

    def append(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        first, last = batch.agg(F.min("dt"), F.max("dt")).first()
        every = session.read.schema(schemas.MANIFEST).parquet(manifest_path).filter(F.col("status") == ACCEPTED)
        if first is not None:
            every = every.filter(F.col("dt").between(first, last))  # of a path there is one day
        again = batch.filter(F.col("status") == ACCEPTED).select("path").distinct().join(every, "path")
        again = again.groupBy("path").agg(F.count_distinct("size", "modified").alias("states")).filter("states > 1").first()
        if again:
            raise RuntimeError(f"{again.path} was accepted before in another state; run the sales job.")
        accepted = accepted_paths(session, landing_zone, batch, first, last)
        parts = []
        if "pos" in accepted:
            paths = [path for _, path in accepted["pos"]]
            parts.append(conform_pos(raw.read_pos(session, base + "pos", False, pos_header, paths)))
        if "ecommerce" in accepted:
            paths = [path for _, path in accepted["ecommerce"]]
            orders = raw.valid_orders(raw.read_order_lines(session, base + "ecommerce", paths))
            parts.append(conform_ecommerce(orders, usd_to_cad))
        if parts:
            append_batch(raw.union_by_name(parts), raw.folder(trusted_zone) + "sales_conformed", f"{label}-{batch_id}")

    return (
        verdicts.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
