"""Sets of keys found by one job and used by the next: repeated ids, unknown ids.

A key set is counted with a map-side pre-aggregation, so one key may hold any share of the rows. It is
then written to the shared folder, because only then is its real size known when the following join is
planned: a small set is broadcast and the wide rows are not shuffled at all. Of a large one bitmaps of hashes go to every task, and
only rows whose bit is set, the set's own and a few by chance, are joined by sort-merge, where AQE splits hot keys on the row side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from millrace.session import shared_folder

BROADCAST_LIMIT = 32 * 1024 * 1024
# Rough memory of one hashed row besides its text.
ROW_OVERHEAD = 64
# Bits of one bitmap (fixed by Spark), of all bitmaps for a key, and bitmaps at most (16 MiB).
BITMAP_BITS, BITS_PER_KEY, MOST_BITMAPS = 32768, 16, 4096


def stored(spark: SparkSession, rows: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read back.

    For rows that several passes need: each pass then reads only its columns, filters reach the Parquet
    scan, nothing is parsed twice, and a lost executor costs no more than its own tasks.
    """
    path = shared_folder(spark, label)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def key_counts(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("copies"))


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys held by more than one row. NULL is no key."""
    return key_counts(rows.filter(F.col(key).isNotNull()), key).filter("copies > 1")


@dataclass(frozen=True)
class KeySet:
    """Written key set with the size it takes when broadcast."""

    frame: DataFrame
    key: str
    size: int
    limit: int = BROADCAST_LIMIT

    @property
    def small(self) -> bool:
        return self.size <= self.limit

    def side(self) -> DataFrame:
        keys = self.frame.select(self.key)
        return F.broadcast(keys) if self.small else keys.hint("merge")

    def _likely(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows whose key may be in the set, and those whose key is not (or NULL), by bitmaps of the keys' hashes."""
        keys = self.size // ROW_OVERHEAD
        maps = min(MOST_BITMAPS, max(1, -(-keys * BITS_PER_KEY // BITMAP_BITS)))
        place = F.pmod(F.xxhash64(F.col(self.key)), F.lit(maps * BITMAP_BITS))
        bucket, bit = F.floor(place / F.lit(BITMAP_BITS)).cast("int"), F.pmod(place, F.lit(BITMAP_BITS))
        made = self.frame.select(bucket.alias("_bucket"), bit.alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_map"))
        empty = self.frame.sparkSession.range(maps).select(F.col("id").cast("int").alias("_bucket"), F.lit(None).cast("binary").alias("_map"))
        each = made.union(empty).groupBy("_bucket").agg(F.max("_map").alias("_map"))
        bits = each.agg(F.transform(F.array_sort(F.collect_list(F.struct("_bucket", "_map"))), lambda one: one["_map"])).scalar()
        byte = F.substr(F.get(bits, bucket), (bit / 8).cast("int") + 1, F.lit(1))
        is_set = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), F.pmod(bit, F.lit(8)).cast("int")) == 1
        likely = F.col(self.key).isNotNull() & F.coalesce(is_set, F.lit(False))
        return rows.filter(likely), rows.filter(~likely)

    def mark(self, rows: DataFrame, flag: str) -> DataFrame:
        """All rows, with a boolean that says whether the key is in the set."""
        marks = self.side().withColumn(flag, F.lit(True))
        if self.small:
            marked = rows.join(marks, self.key, "left")
            return marked.select(*rows.columns, F.coalesce(F.col(flag), F.lit(False)).alias(flag))
        # Rows without a key go round the join as well: they would all meet in one partition.
        likely, others = self._likely(rows)
        marked = likely.join(marks, self.key, "left")
        marked = marked.select(*rows.columns, F.coalesce(F.col(flag), F.lit(False)).alias(flag))
        return marked.union(others.withColumn(flag, F.lit(False)))

    def keep(self, rows: DataFrame) -> DataFrame:
        """Rows whose key is in the set."""
        likely = rows if self.small else self._likely(rows)[0]
        return likely.join(self.side(), self.key, "left_semi")

    def drop(self, rows: DataFrame) -> DataFrame:
        """Rows whose key is not in the set, rows without a key included."""
        if self.small:
            return rows.join(self.side(), self.key, "left_anti")
        likely, others = self._likely(rows)
        return likely.join(self.side(), self.key, "left_anti").select(*rows.columns).union(others)


def measured(frame: DataFrame, key: str, limit: int = BROADCAST_LIMIT) -> KeySet:
    """A key set that is stored already."""
    size = frame.agg(F.coalesce(F.sum(F.octet_length(F.col(key).cast("string")) + F.lit(ROW_OVERHEAD)), F.lit(0))).first()[0]
    return KeySet(frame, key, int(size), limit)


def settle(spark: SparkSession, keys: DataFrame, key: str, limit: int = BROADCAST_LIMIT) -> KeySet:
    """Write a key set (unique, not NULL) to the shared folder and measure it on the way."""
    measured = Observation()
    size = F.sum(F.octet_length(F.col(key).cast("string")) + F.lit(ROW_OVERHEAD))
    keys = keys.select(key).observe(measured, F.coalesce(size, F.lit(0)).alias("size"))
    frame = stored(spark, keys, f"keys-{key}")
    return KeySet(frame, key, int(measured.get["size"]), limit)
