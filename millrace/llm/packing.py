"""Sum-of-squares online packing of tokenised documents into windows.

Each partition of the input is one packing stream with its own level array. A document is placed where it leaves the least
sum of squared counts of partially filled windows; a document longer than a window fills whole windows first. Nothing
is shuffled and a task holds only its partially filled windows, at most MAX_OPEN of them. Those that are left when the stream
ends (or when there are too many, as with documents that never fit together) are made full by cutting: the emptiest
give their ids to the fullest. The ids left then lie in sequences of power-of-two lengths, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import gathered, prepare
from millrace.llm.tokens import encoder, tokenizer_path

WINDOW = 2048
END_ID = 1
#: Partially filled windows a stream keeps before it completes them by cutting.
MAX_OPEN = 2048
#: A hole of at most this many ids is left to padding when windows are completed.
SMALL_HOLE = 8
#: Different pieces a worker keeps, and bytes of text it encodes at a time: less than elsewhere, since windows are held beside them and
#: workers of earlier stages stay.
KEPT, TEXT_BYTES = 300_000, 4 << 20

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Levels:
    """Partially filled windows by level, and the choice of the level that takes a piece of a given size."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.at: list[list[list]] = [[] for _ in range(window + 1)]

    def best(self, size: int) -> int:
        """The level to place `size` ids on, 0 for a new window; of equal ones the fullest.

        Moving a window from level h to h + size changes the sum of squares by 1 - 2 n(h), if h is not empty, and by
        2 n(h + size) + 1, if the window does not become full.
        """
        top = self.window - size
        gain = np.where(self.count[: top + 1] > 0, 1 - 2 * self.count[: top + 1], np.iinfo(np.int64).max // 2)
        gain[0] = 0
        cost = 2 * self.count[size : self.window + 1] + 1
        cost[-1] = 0
        total = gain + cost
        return top - int(np.argmin(total[::-1]))

    def place(self, piece) -> list | None:
        """Puts a piece (with its size first) into a window; gives the window if that is full now."""
        size = piece[0]
        level = self.best(size)
        pieces = []
        if level:
            self.count[level] -= 1
            pieces = self.at[level].pop()
        pieces.append(piece)
        if level + size == self.window:
            return pieces
        self.count[level + size] += 1
        self.at[level + size].append(pieces)
        return None

    def take_all(self) -> list[tuple[int, list]]:
        """All partially filled windows as (level, pieces), the fullest first; none is left."""
        found = [(level, w) for level in range(self.window, 0, -1) for w in self.at[level]]
        self.at = [[] for _ in range(self.window + 1)]
        self.count[:] = 0
        return found


def cut(piece, size: int):
    """A piece (size, doc, start, ids, doc_tokens) cut in two."""
    _, doc, start, ids, tokens = piece
    return (size, doc, start, ids[: 4 * size], tokens), (piece[0] - size, doc, start + size, ids[4 * size :], tokens)


def completed(windows: list[tuple[int, list]], window: int, small: int = SMALL_HOLE) -> Iterator[list]:
    """Windows, the fullest first, completed by the pieces of the emptiest; the rest in power-of-two sequences."""
    first, last = 0, len(windows) - 1
    spare: list = []  # pieces of dissolved windows
    while first <= last:
        level, pieces = windows[first]
        first += 1
        while window - level > small:
            if not spare:
                if first > last:
                    break
                spare = list(windows[last][1])
                last -= 1
            piece = spare.pop()
            if piece[0] > window - level:
                piece, rest = cut(piece, window - level)
                spare.append(rest)
            pieces.append(piece)
            level += piece[0]
        if window - level <= small:
            yield pieces
        else:
            spare = pieces
    left = sum(piece[0] for piece in spare)
    while left:
        size = min(window, 1 << (left.bit_length() - 1))
        left -= size
        out = []
        while size:
            piece = spare.pop()
            if piece[0] > size:
                piece, rest = cut(piece, size)
                spare.append(rest)
            out.append(piece)
            size -= piece[0]
        yield out


def packed(documents: Iterator[tuple], window: int = WINDOW, max_open: int = MAX_OPEN) -> Iterator[list]:
    """Sequences, each a list of pieces, from (doc_id, ids as bytes of 32-bit integers)."""
    levels, n_open = Levels(window), 0
    for doc, ids in documents:
        tokens, start = len(ids) // 4, 0
        while tokens - start >= window:
            yield [(window, doc, start, ids[4 * start : 4 * (start + window)], tokens)]
            start += window
        if tokens > start:
            full = levels.place((tokens - start, doc, start, ids[4 * start :], tokens))
            if full:
                yield full
        n_open = int(levels.count.sum())
        if n_open > max_open:
            yield from completed(levels.take_all(), window)
    yield from completed(levels.take_all(), window)


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, window: int = WINDOW, max_open: int = MAX_OPEN) -> DataFrame:
    """One row per piece of a document: SCHEMA. A null text counts as empty; every document has at least its end id.

    A stream that has more than `max_open` partially filled windows completes them by cutting and begins anew: a bound on
    memory, by which no id is lost and only the places change. Repeated rows are packed each, very long texts fill
    windows of their own first, an empty table gives no rows, further columns are not read. Rows without doc_id are packed like others. sequence_id = 2^32 x partition of the input + number in it, so
    it needs no pass over the result; offset counts the ids before the piece in its sequence.
    """
    prepare(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext

        encode = encoder(tokenizer, KEPT).encode
        base = TaskContext.get().partitionId() << 32

        def documents():
            for part in gathered(batches, TEXT_BYTES):
                for doc, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text").fill_null(""))):
                    yield doc, ids + end

        rows: list[tuple] = []
        for number, pieces in enumerate(packed(documents(), window, max_open)):
            offset = 0
            for size, doc, start, ids, tokens in pieces:
                rows.append((doc, start, size, zlib.crc32(ids), tokens, base + number, offset))
                offset += size
            if len(rows) >= 4096:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    names = [field.split()[0] for field in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in zip(*rows)], names=names)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    from millrace.llm.common import table

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
