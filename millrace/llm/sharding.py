"""Shards of near equal bytes by longest-processing-time scheduling of groups that must stay together.

Groups are equal texts. They are taken by size, the largest first, and each goes to the least-loaded shard, which a heap gives.
The driver schedules classes, not groups: sizes below 4,096 bytes and, above, sizes that agree in their first 12 bits are
one class (under 100,000 classes up to 2^56 bytes), whose members differ by less than a two-thousandth. Each class gets a number
of members per shard; which member goes where follows from its rank in its class, counted in the tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import prepare, stored

SHARDS = 24
#: Leading bits of a size that name its class.
CLASS_BITS = 12
ROW_BYTES = 8

SCHEMA = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"


def scheduled(classes: Iterable[tuple[int, float, int]], shards: int) -> dict[int, np.ndarray]:
    """For (class, mean size, members), the largest size first: how many members each shard gets.

    A shard that is least loaded by more than a member takes as many as bring it level with the next; once all loads lie
    within one size, members are dealt in whole rounds. Both give what one member at a time would give.
    """
    heap = [(0.0, shard) for shard in range(shards)]
    found = {}
    for name, size, members in classes:
        given = np.zeros(shards, np.int64)
        while members:
            load, shard = heap[0]
            if members >= shards and max(heap)[0] - load <= size:
                rounds = members // shards
                given += rounds
                members -= rounds * shards
                heap = [(x + rounds * size, s) for x, s in heap]  # the order stays
                continue
            following = min(heap[1:3])[0] if shards > 1 else float("inf")
            take = int(min(members, (following - load) // size + 1)) if shards > 1 else members
            given[shard] += take
            members -= take
            heapq.heapreplace(heap, (load + take * size, shard))
        found[name] = given
    return found


def numbered(df: DataFrame, by: str) -> DataFrame:
    """Adds part (the partition) and at (number of the row among those with the same `by` in its partition)."""
    from pyspark.sql.types import IntegerType, LongType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField("part", IntegerType()), StructField("at", LongType())])

    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            values = batch.column(by).to_numpy()
            kinds, which, counts = np.unique(values, return_inverse=True, return_counts=True)
            order = np.argsort(which, kind="stable")
            at = np.empty(len(values), np.int64)
            at[order] = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
            before = np.array([seen.get(k, 0) for k in kinds.tolist()], np.int64)
            seen.update(zip(kinds.tolist(), (before + counts).tolist()))
            yield batch.append_column("part", pa.array(np.full(len(values), part, np.int32))).append_column("at", pa.array(at + before[which]))

    return df.mapInArrow(run, schema)


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """SCHEMA, a row per document. A null text is an empty one; rows without doc_id are placed like others.

    Documents meet their group's shard in one join on the group, in which Spark may split a large group. A group larger than a
    fair share still stays together: it has its shard to itself and the others stay equal.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("key"),
    )
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    groups = groups.withColumn("low", F.expr(f"greatest(length(bin(bytes)) - {CLASS_BITS}, 0)"))
    groups = groups.select("key", "bytes", F.expr("shiftleft(shiftright(bytes, low), low)").alias("class"))
    groups = stored(numbered(groups.repartitionByRange(F.desc("class"), "key").sortWithinPartitions("class", "key"), "class"), "shard-groups")

    # Sorted by class, so no more rows than classes and partitions together.
    found = groups.groupBy("class", "part").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()
    offsets, members, total = {}, {}, {}
    for name, part, n, size in sorted(found):
        offsets[name, part] = members.get(name, 0)
        members[name] = members.get(name, 0) + n
        total[name] = total.get(name, 0) + size
    plan = scheduled(((c, total[c] / members[c], members[c]) for c in sorted(members, reverse=True)), shards)
    ends = {c: np.cumsum(given) for c, given in plan.items()}

    def placed(batches):
        for batch in batches:
            names, parts, at = (batch.column(c).to_pylist() for c in ("class", "part", "at"))
            shard = [int(np.searchsorted(ends[c], offsets[c, p] + i, side="right")) for c, p, i in zip(names, parts, at)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(shard, pa.int32())], names=["key", "shard"])

    homes = groups.select("key", "class", "part", "at").mapInArrow(placed, "key binary, shard int")
    joined = rows.join(homes, "key").select("doc_id", "size", "text_crc32", "shard")
    joined = stored(numbered(joined, "shard"), "shard-rows")
    # As many rows as partitions times shards.
    firsts, count = {}, [0] * shards
    for part, shard, n in sorted(joined.groupBy("part", "shard").agg(F.count("*")).collect()):
        firsts[part, shard], count[shard] = count[shard], count[shard] + n

    def slotted(batches):
        for batch in batches:
            part, shard = batch.column("part").to_pylist(), batch.column("shard").to_pylist()
            slot = batch.column("at").to_numpy() + np.array([firsts[k] for k in zip(part, shard)], np.int64)
            law, grown = pa.array(["bytes"] * len(slot)), pa.nulls(len(slot), pa.int32())
            columns = [*(batch.column(c) for c in ("doc_id", "size", "text_crc32")), law, batch.column("shard"), pa.array(slot), grown]
            yield pa.RecordBatch.from_arrays(columns, names=[field.split()[0] for field in SCHEMA.split(", ")])

    return joined.mapInArrow(slotted, SCHEMA)


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    from millrace.llm.common import table

    return shard_by_bytes(table(spark, sf_dir, "documents"))
