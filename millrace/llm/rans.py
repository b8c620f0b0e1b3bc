"""Token ids of documents in files of interleaved static range asymmetric numeral systems (rANS).

File format: a Parquet folder whose rows are segments, written by Spark's own committer, so that a lost executor or a second
attempt leaves nothing half written. Columns: part (range of doc_id, ascending), segment (number in the part), first (ids
of the part before the segment), n_tokens, doc_ids and doc_tokens (arrays: the documents of the segment, in order) and
data, the image of the ids:

    magic "RAN1", crc32 of all after it, then numbers as unsigned 32-bit: n ids, lanes, steps between checkpoints,
    n blocks, length of the packed table | table: zlib of the used ids (differences) and their frequencies, which sum to 2^20
    | for each block: n ids, n words, n checkpoints, crc32 of its ids | for each block: checkpoints, words

A block is coded by itself under the table of its segment: step t codes ids t*lanes .. in as many lanes, each with a
64-bit state, all pushing 32-bit words to one stream. A checkpoint holds the lanes' states and the place in the stream
before a step, so that decoding may start there (decode_range): blocks and checkpoints can be decoded in parallel.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import gathered, prepare
from millrace.llm.tokens import encoder, tokenizer_path
from millrace.session import shared_folder

BITS = 20
LOW = np.uint64(1 << 31)
LANES = 512
CHECK_STEPS = 256
BLOCK_IDS = LANES * 512
SEGMENT_IDS = 1 << 21
END_ID = 2
MAGIC = b"RAN1"

SEGMENTS = "part int, segment int, first long, n_tokens long, doc_ids array<bigint>, doc_tokens array<bigint>, data binary"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Used ids and frequencies of at least 1 that sum to 2^BITS."""
    used, counts = np.unique(ids, return_counts=True)
    if len(used) > 1 << BITS:
        raise ValueError("more different ids than the table has places")
    share = counts * ((1 << BITS) - len(used)) // max(1, counts.sum()) + 1
    if len(used):
        share[np.argmax(share)] += (1 << BITS) - share.sum()
    return used.astype(np.uint32), share.astype(np.uint32)


class Table:
    """Frequencies of a segment, ready for coding and decoding."""

    def __init__(self, used: np.ndarray, freq: np.ndarray):
        self.used, self.freq = used, freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64) if len(used) else self.freq

    def packed(self) -> bytes:
        return zlib.compress(np.diff(self.used, prepend=np.uint32(0)).astype("<u4").tobytes() + self.freq.astype("<u4").tobytes())

    @classmethod
    def unpacked(cls, data: bytes) -> Table:
        both = np.frombuffer(zlib.decompress(data), "<u4")
        used = np.cumsum(both[: len(both) // 2], dtype=np.uint32)
        return cls(used, both[len(both) // 2 :])

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.used), dtype=np.uint32), self.freq.astype(np.int64))


def encode_block(table: Table, ids: np.ndarray, lanes: int = LANES, every: int = CHECK_STEPS) -> tuple[bytes, int, int]:
    """(checkpoints and words, number of words, number of checkpoints) of one block."""
    symbol = np.searchsorted(table.used, ids)
    freq, start = table.freq[symbol], table.start[symbol]
    steps = -(-len(ids) // lanes)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    points, sizes = [], []
    for step in range(steps - 1, -1, -1):
        f, s = freq[step * lanes : (step + 1) * lanes], start[step * lanes : (step + 1) * lanes]
        x = state[: len(f)]
        full = x >= f << np.uint64(63 - BITS)
        words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        x = np.where(full, x >> np.uint64(32), x)
        state[: len(f)] = ((x // f) << np.uint64(BITS)) + x % f + s
        if step % every == 0:
            points.append(state.copy())
            sizes.append(len(words))
    stream = np.concatenate(words[::-1]) if words else np.empty(0, "<u4")
    before = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    places = [len(stream) - int(before[n]) for n in sizes]
    heads = b"".join(struct.pack("<I", place) + s.astype("<u8").tobytes() for place, s in zip(places[::-1], points[::-1]))
    return heads + stream.tobytes(), len(stream), len(points)


def decode_block(table: Table, slots: np.ndarray, data: memoryview, n: int, n_words: int, points: int, lanes: int, every: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of a block from checkpoint `first` to before checkpoint `last`."""
    size = 4 + 8 * lanes
    stream = np.frombuffer(data, "<u4", n_words, points * size).astype(np.uint64)
    place = struct.unpack_from("<I", data, first * size)[0] if points else 0
    state = np.frombuffer(data, "<u8", lanes, first * size + 4).copy() if points else None
    begin = first * every * lanes
    end = n if last is None or last >= points else last * every * lanes
    out = np.empty(end - begin, np.uint32)
    mask = np.uint64((1 << BITS) - 1)
    for at in range(begin, end, lanes):
        k = min(lanes, n - at)
        x = state[:k]
        slot = x & mask
        symbol = slots[slot]
        out[at - begin : at - begin + k] = table.used[symbol]
        x = table.freq[symbol] * (x >> np.uint64(BITS)) + slot - table.start[symbol]
        low = np.flatnonzero(x < LOW)
        x[low] = (x[low] << np.uint64(32)) | stream[place : place + len(low)]
        place += len(low)
        state[:k] = x
    return out


def encode_segment(ids: np.ndarray, lanes: int = LANES, every: int = CHECK_STEPS, block: int = BLOCK_IDS) -> bytes:
    table = Table(*frequencies(ids))
    packed = table.packed()
    heads, bodies = [], []
    for at in range(0, len(ids), block):
        part = ids[at : at + block]
        body, n_words, points = encode_block(table, part, lanes, every)
        heads.append(struct.pack("<4I", len(part), n_words, points, zlib.crc32(part.astype("<u4").tobytes())))
        bodies.append(body)
    rest = struct.pack("<5I", len(ids), lanes, every, len(heads), len(packed)) + packed + b"".join(heads) + b"".join(bodies)
    return MAGIC + struct.pack("<I", zlib.crc32(rest)) + rest


class Segment:
    """Reads the image of a segment; raises ValueError if a checksum does not hold."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        if bytes(self.data[:4]) != MAGIC or zlib.crc32(self.data[8:]) != struct.unpack_from("<I", data, 4)[0]:
            raise ValueError("damaged segment")
        self.n, self.lanes, self.every, blocks, size = struct.unpack_from("<5I", data, 8)
        self.table = Table.unpacked(self.data[28 : 28 + size])
        self.slots = self.table.slots()
        self.blocks, at = [], 28 + size + 16 * blocks
        for k in range(blocks):
            n, n_words, points, crc = struct.unpack_from("<4I", data, 28 + size + 16 * k)
            self.blocks.append((at, n, n_words, points, crc))
            at += points * (4 + 8 * self.lanes) + 4 * n_words

    def block(self, k: int) -> np.ndarray:
        at, n, n_words, points, crc = self.blocks[k]
        ids = decode_block(self.table, self.slots, self.data[at:], n, n_words, points, self.lanes, self.every)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"damaged block {k}")
        return ids

    def decode(self) -> np.ndarray:
        return np.concatenate([self.block(k) for k in range(len(self.blocks))]) if self.blocks else np.empty(0, np.uint32)

    def decode_range(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop, from the checkpoints around them only."""
        out, base = [], 0
        for at, n, n_words, points, _ in self.blocks:
            low, high = max(start - base, 0), min(stop - base, n)
            if low < high:
                step = self.every * self.lanes
                got = decode_block(self.table, self.slots, self.data[at:], n, n_words, points, self.lanes, self.every, low // step, -(-high // step))
                out.append(got[low - low // step * step :][: high - low])
            base += n
        return np.concatenate(out) if out else np.empty(0, np.uint32)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encodes all texts and writes their ids in ascending doc_id order to a folder of segments.

    One shuffle, of the texts by ranges of doc_id. A task holds one segment of ids. Rows without doc_id come first, a null
    text counts as empty, repeated rows are written again, an empty table gives a folder without segments.
    """
    prepare(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        encode, part, number, first = encoder(tokenizer).encode, TaskContext.get().partitionId(), 0, 0
        found: list[bytes] = []
        doc_ids: list = []

        def segment():
            sizes = [len(x) // 4 for x in found]
            ids = np.frombuffer(b"".join(found), "<u4")
            columns = [[part], [number], [first], [len(ids)], [doc_ids], [sizes], [encode_segment(ids)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = [field.split()[0] for field in SEGMENTS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names), len(ids)

        size = 0
        for batch in gathered(batches):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").fill_null(""))):
                found.append(ids + end)
                doc_ids.append(doc)
                size += len(ids) // 4 + 1
                if size >= SEGMENT_IDS:
                    made, n = segment()
                    yield made
                    number, first, found, doc_ids, size = number + 1, first + n, [], [], 0
        if found:
            yield segment()[0]

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    coded = ordered.mapInArrow(run, SEGMENTS)
    # The images do not compress further.
    coded.write.option("compression", "uncompressed").parquet(path)


def read_ids(spark, path: str) -> DataFrame:
    """Decodes a folder of segments: DOCUMENTS, one row per document; start counts the ids of all documents before it."""
    prepare(spark)
    segments = spark.read.schema(SEGMENTS).parquet(path)
    # One row for each range of doc_id: as few as the partitions of the writing job.
    ends = segments.groupBy("part").agg(F.max(F.col("first") + F.col("n_tokens")).alias("n")).collect()
    base, before = {}, 0
    for part, n in sorted(ends):
        base[part], before = before, before + n

    def run(batches):
        for batch in batches:
            # A row holds a whole segment: Spark bounds the batch by its bytes, and one row at a time is decoded.
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                data = Segment(row["data"]).decode().astype("<u4").tobytes()
                sizes = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                start = ends - sizes + base[row["part"]] + row["first"]
                columns = [row["doc_ids"], start, sizes, crc]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return segments.mapInArrow(run, DOCUMENTS)


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    from millrace.llm.common import table

    docs = table(spark, sf_dir, "documents")
    path = shared_folder(spark, "token-ids")
    write_ids(docs, path, tokenizer_path("word_bpe_49k.json"))
    return read_ids(spark, path)
