"""Near-duplicate embeddings by an inverted multi-index: a grid of cells made by two codebooks, visited nearest first, then verified.

Each half of the normalized vectors has a codebook of its own, so a vector's cell is a pair of codewords. A partner in another cell lies
beyond the planes between the codewords; how far each codeword's region is at least gives two lists, and the multi-sequence
traversal visits cells in the order of the summed squares. It ends at a reach that finds the target share of partners: measured
on partners placed in random directions at exactly the limit, around the sampled vectors (pairs that are closer are found
more often). A target of 1 takes the limit's own distance, at which no partner can be missed.

Equal vectors of a label are one class from the start. Of two cells the later is visited from the earlier, so two classes are
compared once. A crowded cell is a grid of blocks: every two blocks meet in a task, so nothing is left out and no task has
more than two blocks. A task gives sums of links and, of each set of connected classes, one edge a class, never all pairs.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, prepare
from millrace.llm.minhash import components

SIMILARITY = 0.98
#: Share of the partners at the limit that the traversal has to reach.
TARGET = 0.999
#: Classes that codebooks and reach are fitted on, at most, taken by a hash.
SAMPLE = 4096
#: Codewords of a half: as many as give about CELL classes a cell, between these numbers.
CODEWORDS = (4, 256)
CELL = 64
#: Classes of a block.
BLOCK = 1024
LINKS = "vec_id long, n_links long, component_id long, kept boolean"
_ENTRIES = "key binary, label string, width int, vec binary"


# ---- codebooks and traversal, on arrays

def codebook(points: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    """Centres of k-means from a fixed start; at most as many as there are points."""
    if not points.shape[1]:
        return np.zeros((1, 0))
    centres = points[np.random.default_rng(7).permutation(len(points))[:size]].copy()
    for _ in range(rounds):
        near = nearest(points, centres)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres * centres).sum(axis=1) - 2 * points @ centres.T + (points * points).sum(axis=1)[:, None]


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return _distances(points, centres).argmin(axis=1)


def bounds(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each point and centre the squared distance that the centre's region has from the point at least."""
    away = _distances(points, centres)
    between = np.sqrt(np.maximum(_distances(centres, centres), 0))
    least = np.zeros_like(away)
    for k in range(len(centres)):
        apart = between[:, k] > 1e-9
        least[:, apart] = np.maximum(least[:, apart], (away[:, apart] - away[:, k : k + 1]) / (2 * between[apart, k]))
    return least * least


def multi_sequence(one: np.ndarray, two: np.ndarray, reach: float) -> Iterator[tuple[int, int]]:
    """Places (i, j) in the order of one[i] + two[j], up to `reach`; both lists ascend."""
    heap, seen = [(one[0] + two[0], 0, 0)], {(0, 0)}
    while heap and heap[0][0] <= reach:
        _, i, j = heapq.heappop(heap)
        yield i, j
        for step in ((i + 1, j), (i, j + 1)):
            if step[0] < len(one) and step[1] < len(two) and step not in seen:
                seen.add(step)
                heapq.heappush(heap, (one[step[0]] + two[step[1]], *step))


class MultiIndex:
    """Two codebooks and the reach of the traversal, fitted on a sample of normalized vectors."""

    def __init__(self, sample: np.ndarray, size: int, similarity: float, target: float):
        self.half = sample.shape[1] - sample.shape[1] // 2
        self.books = [codebook(part, size) for part in self.halves(sample)]
        self.reach = 2 - 2 * similarity
        if target < 1 and len(sample) and sample.shape[1] > 1:
            draws = np.random.default_rng(11)
            base = sample[draws.integers(0, len(sample), 8192)]
            way = draws.normal(size=base.shape)
            way -= (way * base).sum(axis=1)[:, None] * base
            way /= np.maximum(np.linalg.norm(way, axis=1), 1e-12)[:, None]
            partner = similarity * base + np.sqrt(max(0.0, 1 - similarity**2)) * way
            rows = np.arange(len(base))
            far = sum(bounds(x, book)[rows, nearest(y, book)] for x, y, book in zip(self.halves(base), self.halves(partner), self.books))
            self.reach = min(self.reach, float(np.quantile(far, target)))

    def halves(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return points[:, : self.half], points[:, self.half :]

    def cells(self, points: np.ndarray) -> np.ndarray:
        one, two = (nearest(part, book) for part, book in zip(self.halves(points), self.books))
        return one * len(self.books[1]) + two

    def visits(self, points: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(own cell, later cells that may hold partners) of each point."""
        width, own = len(self.books[1]), self.cells(points)
        one, two = (bounds(part, book) for part, book in zip(self.halves(points), self.books))
        for k, cell in enumerate(own.tolist()):
            first, second = (np.flatnonzero(least[k] <= self.reach) for least in (one, two))
            first, second = first[np.argsort(one[k][first])], second[np.argsort(two[k][second])]
            found = multi_sequence(one[k][first], two[k][second], self.reach)
            yield cell, [c for i, j in found if (c := int(first[i]) * width + int(second[j])) > cell]


def normalized(data: list[bytes], width: int, to: int | None = None) -> np.ndarray:
    """Vectors of `width` floats or doubles, as doubles at length 1, with zeros after them if more columns are wanted."""
    points = np.stack([np.frombuffer(vector, f"<f{len(vector) // width}") for vector in data]).astype(float)
    points = points / np.abs(points).max(axis=1)[:, None]
    points = points / np.linalg.norm(points, axis=1)[:, None]
    return points if to is None or to == width else np.pad(points, ((0, 0), (0, to - width)))


# ---- on Spark

def entries(vectors: DataFrame) -> DataFrame:
    """vec_id with _ENTRIES: key (hash of label and vector), label as text, number of components, vector as floats where they hold it exactly, else doubles. All null where the label or
    the vector is null, the vector is zero or empty, or a component is null or not finite: such vectors link with nothing."""

    def run(batches):
        for batch in batches:
            column, labels = batch.column("embedding").cast(pa.list_(pa.float64())), batch.column("label").to_pylist()
            widths = pc.fill_null(pc.list_value_length(column), 0).to_pylist()
            flat = column.flatten()
            values = np.ascontiguousarray(pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)) + 0.0
            out, at = [], 0
            for label, width in zip(labels, widths):
                part = values[at : at + width]
                at += width
                if label is None or not np.isfinite(part).all() or not part.any():
                    out.append((None, None, None, None))
                    continue
                key = hashlib.blake2b(label.encode() + b"\0" + part.astype("<f8").tobytes(), digest_size=16).digest()
                with np.errstate(over="ignore"):
                    single = part.astype("<f4")
                out.append((key, label, width, (single if (single == part).all() else part.astype("<f8")).tobytes()))
            columns = [batch.column("vec_id"), *(pa.array([r[k] for r in out], t) for k, t in enumerate((pa.binary(), pa.string(), pa.int32(), pa.binary())))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "key", "label", "width", "vec"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, f"vec_id long, {_ENTRIES}")


def placed(classes: DataFrame, index: MultiIndex, dims: int) -> DataFrame:
    """A row for each class in its own cell (visits false) and in each later cell it visits."""

    def run(batches):
        for batch in batches:
            keys, labels, widths, vecs, counts = (batch.column(c).to_pylist() for c in ("key", "label", "width", "vec", "n"))
            out = []
            for width in set(widths):
                of = [k for k, w in enumerate(widths) if w == width]
                for k, (cell, others) in zip(of, index.visits(normalized([vecs[k] for k in of], width, dims))):
                    entry = (keys[k], labels[k], width, vecs[k], counts[k])
                    out.append((*entry, cell, False))
                    out += [(*entry, other, True) for other in others]
            kinds = (pa.binary(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.bool_())
            names = ["key", "label", "width", "vec", "n", "cell", "visits"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    return classes.select("key", "label", "width", "vec", "n").mapInArrow(run, f"{_ENTRIES}, n long, cell int, visits boolean")


def grouped(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """The rows dealt to groups, each of which one task compares. A cell of one block and one of visitors is a group ("all"); otherwise
    two blocks of the cell ("own") and a block of visitors with one of the cell ("in") make a group each."""
    block = lambda n: F.pmod(F.xxhash64("key"), F.greatest(F.col(n), F.lit(1))).cast("int")
    known = rows.join(sizes, ["label", "width", "cell"])
    known = known.withColumn("block", F.when(F.col("visits"), block("guests")).otherwise(block("blocks")))
    pair = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.cast("int").alias("a"), b.cast("int").alias("b"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    inside = F.transform(upto("blocks"), lambda k: pair("own", F.least(k, F.col("block")), F.greatest(k, F.col("block"))))
    hosts = F.when(F.col("guests") > 0, F.transform(upto("guests"), lambda k: pair("in", k, F.col("block")))).otherwise(F.array().cast("array<struct<kind:string,a:int,b:int>>"))
    guests = F.transform(upto("blocks"), lambda k: pair("in", F.col("block"), k))
    small = (F.col("blocks") == 1) & (F.col("guests") <= 1)
    groups = F.when(small, F.array(pair("all", F.lit(0), F.lit(0)))).when(F.col("visits"), guests).otherwise(F.concat(inside, hosts))
    dealt = known.select("*", F.explode(groups).alias("g"))
    name = F.concat_ws("|", "g.kind", "g.a", "g.b", "cell", "width", "label")
    return dealt.select(name.alias("group"), F.col("g.kind").alias("kind"), (F.col("g.a") == F.col("g.b")).alias("square"), "block", "visits", "width", "key", "vec", "n")


def compared(groups: DataFrame, similarity: float) -> DataFrame:
    """(key, links, root) of each class that has a partner in a group: the vectors it links with there, and a class connected with it."""

    def work(rows: list[tuple]):
        kind, square, width = rows[0][1], rows[0][2], rows[0][5]
        points, counts = normalized([r[7] for r in rows], width), np.array([r[8] for r in rows], np.int64)
        guest = np.array([r[4] for r in rows])
        near = points @ points.T >= similarity
        if kind == "all":
            near &= ~(guest[:, None] & guest[None])
        elif kind == "in":
            near &= guest[:, None] != guest[None]
        elif not square:
            of = np.array([r[3] for r in rows])
            near &= of[:, None] != of[None]
        np.fill_diagonal(near, False)
        have = np.flatnonzero(near.any(axis=1))
        if not len(have):
            return [], [], []
        near = near[np.ix_(have, have)]
        root = np.arange(len(have))
        while True:
            best = np.minimum(root, np.where(near, root[None], len(have)).min(axis=1))
            best = best[best]
            if (best == root).all():
                break
            root = best
        keys = [rows[k][6] for k in have.tolist()]
        return keys, (near @ counts[have]).tolist(), [keys[k] for k in root.tolist()]

    def run(batches):
        names = ["group", "kind", "square", "block", "visits", "width", "key", "vec", "n"]
        group, held = None, []
        for batch in batches:
            keys, links, roots = [], [], []
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if row[0] != group:
                    if len(held) > 1:
                        for into, got in zip((keys, links, roots), work(held)):
                            into += got
                    group, held = row[0], []
                held.append(row)
            yield _links(keys, links, roots)
        if len(held) > 1:
            yield _links(*work(held))

    return groups.repartition("group").sortWithinPartitions("group").mapInArrow(run, "key binary, links long, root binary")


def _links(keys: list, links: list, roots: list) -> pa.RecordBatch:
    columns = [pa.array(keys, pa.binary()), pa.array(links, pa.int64()), pa.array(roots, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["key", "links", "root"])


def linked(vectors: DataFrame, similarity: float = SIMILARITY, target: float = TARGET, sample: int = SAMPLE, size: int | None = None, block: int = BLOCK) -> DataFrame:
    """LINKS, a row for each row of vectors (vec_id, label, embedding): vectors of the same label and length whose cosine reaches `similarity`.

    Rows that are equal in label and vector link with each other, also under one vec_id. A component's id is the least vec_id in it,
    null only if all are null; kept is false where vec_id is null. Vectors that cannot link have a component of their own.
    """
    spark = prepare(vectors.sparkSession)
    run = Scratch(spark, "multiindex")
    rows = run.stored(entries(vectors), "entries")
    classes = rows.where("key IS NOT NULL").groupBy("key", "label", "width", "vec").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    classes = run.stored(classes, "classes")
    total, dims = classes.agg(F.count("*"), F.max("width")).first()
    taken = classes.select("width", "vec").orderBy(F.xxhash64("key"), "key").limit(sample).collect()
    points = np.concatenate([normalized([r.vec], r.width, dims) for r in taken]) if taken else np.zeros((0, 1))
    if total:
        size = size or int(min(CODEWORDS[1], max(CODEWORDS[0], round((total / CELL) ** 0.5))))
        index = MultiIndex(points, size, similarity, target)
        cells = run.stored(placed(classes, index, dims), "cells")
        found = cells.groupBy("label", "width", "cell").agg(F.count_if(~F.col("visits")).alias("here"), F.count_if("visits").alias("guests"))
        parts = lambda name: F.ceil(F.col(name) / block).cast("int")
        sizes = found.where((F.col("here") > 1) | (F.col("here") > 0) & (F.col("guests") > 0))
        sizes = sizes.select("label", "width", "cell", parts("here").alias("blocks"), parts("guests").alias("guests"))
        links = run.stored(compared(grouped(cells, sizes), similarity), "links")
        degrees = links.groupBy("key").agg(F.sum("links").alias("links"))
        edges = links.where("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")).distinct()
        of = components(run.stored(edges, "edges"), run).withColumnsRenamed({"node": "key"})
        known = classes.select("key", "low", "n").join(degrees, "key", "left").join(of, "key", "left")
        known = known.select("key", "low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "key").alias("component"))
        known = run.stored(known, "known")
        least = known.groupBy("component").agg(F.min("low").alias("component_id"))
        result = known.join(least, "component").select("key", "n_links", "component_id")
        joined = rows.where("key IS NOT NULL").join(result, "key").select("vec_id", "n_links", "component_id")
        alone = rows.where("key IS NULL")
    else:
        joined, alone = None, rows
    alone = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = alone if joined is None else joined.unionByName(alone)
    return both.select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op12_embedding_links(spark, sf_dir: str) -> DataFrame:
    """All embeddings at a cosine of 0.98 within their label."""
    from millrace.llm.common import table

    return linked(table(spark, sf_dir, "embeddings"))
