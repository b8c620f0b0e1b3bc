"""Near-duplicate documents by ProbMinHash sketches of weighted word shingles, banding and exact verification.

A text is the weighted set of its five-word shingles, the weight being 1 + ln(occurrences). Each shingle has a Poisson process of
arrivals, at a rate of its weight, that go to random registers; a register keeps the shingle that arrives first. Two
registers agree with the probability Jaccard similarity of the sets. A process ends when it is later than every register
of its document, so long documents need little more than one arrival per shingle.

A text with repeated shingles has a second, plain sketch, with all weights 1, whose registers agree with the Jaccard similarity; without
repeats the two are equal. Both have bands and marks, so that pairs similar by either measure are found.

Equal texts are one node from the start. Nodes that share a band (4 of 256 registers, 24 bands) are compared by their marks (4 bits of
each register, compared in the join itself), and pairs whose marks agree as those of similar texts do are verified, unless
parity bits rule the pair out: a text has 1,024 bits, each telling whether an odd number of its different shingles falls on it.
Bits in which two texts differ need a shingle that only one of them has, so they are at most as many as such shingles, and
more of them than a Jaccard similarity of 0.8 allows is proof that it is below. This loses no pair:
1. in every bucket each node with the bucket's centre only, the node that shares its bands with the most others over all
   its buckets (in a group of edited copies the original); then components are formed;
2. buckets whose nodes lie in several components are looked at again: the nodes outside the centre's component are compared
   with all of the bucket, each pair in the first band it shares. Very large buckets are divided before by each second
   band that nodes share and have the parts' centres tried first; what is still outside is compared in cells, a grid that
   has every pair of the bucket once.
So a group of copies costs a star and no pairs, and links between different components are not lost.
A link needs a similarity of 0.8: exact probability Jaccard or exact Jaccard of the shingle sets.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, fresh, map_texts, prepare, slices, stored
from millrace.llm.scan import MASK64, mixed, windows, words_of

SHINGLE = 5
#: Registers of a sketch; the first BANDS * ROWS make the bands, all of them the marks.
REGISTERS = 256
ROWS = 4
BANDS = 24
SIMILARITY = 0.8
#: Buckets of more members have centres of their parts tried first and are compared in cells of about so many members by so
#: many. It changes the plan only: no pair of a bucket is left out.
LARGE_BUCKET = 4096
#: Long integers of marks of a node: for each 64 registers one with the lowest bit of each, one with the next, and so on to the fourth.
PLANES = 4
MARKS = REGISTERS // 64 * PLANES
#: Marks that agree at least: for a similarity of 0.8 it is 208 on average, with a standard deviation of 6.2.
AGREE = 183
#: Parity bits of a text, in long integers of 64.
PARITY_BITS = 1024
PARITIES = PARITY_BITS // 64
#: What a pair is compared by before its texts are: marks, parity bits and the number of different shingles.
COMPARED = [*(f"m{k}" for k in range(MARKS)), *(f"o{k}" for k in range(PARITIES)), "size"]
#: A node in more than this part of all pairs is heavy, unless it is in few. Heavy nodes are fewer than twice this number.
HEAVY_PARTS = 4096
HEAVY_LEAST = 32
#: Bits of the filter that tells most texts without a candidate from the others; a set size, 16 MB.
FILTER_BITS = 27

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def node_of(text: str | None) -> bytes:
    return hashlib.sha256((text or "").encode()).digest()[:16]


def node_column() -> Column:
    """node_of as a Spark expression."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)), 1, 16)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, occurrences) of a slice, ordered by row. A text of one to four words has one shingle, of all its words."""
    words = words_of(texts)
    hashes, at = windows(words, SHINGLE)
    row = words.row[at]
    n_words = np.diff(words.first)
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(SHINGLE - 1):
            has = n_words[short] > k
            extra[has] = mixed(extra[has] * GOLDEN + words.hash[words.first[short[has]] + k])
        hashes, row = np.concatenate([hashes, extra]), np.concatenate([row, short])
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], hashes[at], np.diff(np.append(at, len(row)))


def weights(occurrences: np.ndarray) -> np.ndarray:
    return 1 + np.log(occurrences)


def sketches(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, rows: int, m: int = REGISTERS) -> np.ndarray:
    """ProbMinHash registers, rows x m unsigned 32-bit; zeros for a row without shingles."""
    first = np.full(rows * m, np.inf)
    holder = np.zeros(rows * m, np.uint32)
    mark = (mixed(shingle) >> np.uint64(32)).astype(np.uint32)
    at, time, turn = np.arange(len(row)), np.zeros(len(row)), 0
    while len(at):
        turn += 1
        dice = mixed(shingle[at] + np.uint64(turn * int(GOLDEN) & MASK64))
        time = time - np.log(((dice >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / weight[at]
        register = row[at] * m + (mixed(dice) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, register, time)
        won = time == first[register]
        holder[register[won]] = mark[at[won]]
        latest = first.reshape(rows, m).max(axis=1)
        alive = time < latest[row[at]]
        at, time = at[alive], time[alive]
    return holder.reshape(rows, m)


def probability_jaccard(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray) -> tuple[float, float]:
    """(probability Jaccard, Jaccard) of two weighted sets, the elements in ascending order."""
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    union = len(x) + len(y) - len(i)
    if not len(i):
        return 0.0, 0.0
    a, b = np.concatenate([wx, np.zeros(union - len(x))]), np.zeros(union)
    b[i] = wy[j]
    only = np.ones(len(y), bool)
    only[j] = False
    b[len(x) :] = wy[only]
    ratio, which = np.unique(wx[i] / wy[j], return_inverse=True)
    total = np.array([np.maximum(a, r * b).sum() for r in ratio])
    return float((wx[i] / total[which]).sum()), len(i) / union


def parities(row: np.ndarray, shingle: np.ndarray, rows: int) -> np.ndarray:
    """rows x PARITIES 64-bit integers: a bit is set if an odd number of the row's different shingles falls on it."""
    place = row * PARITY_BITS + (mixed(~shingle) % np.uint64(PARITY_BITS)).astype(np.int64)
    odd = np.bincount(place, minlength=rows * PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(rows, PARITY_BITS), axis=1).view(np.int64)


def sketched(docs: DataFrame, run: Scratch) -> DataFrame:
    """node (of each different text), rep (least doc_id), n_rows, sketch (binary, empty without shingles), plain (the sketch
    with weights 1, empty if no shingle is repeated, since the two are equal then), odd (parity bits) and size (number of
    different shingles); stored."""

    def work(part):
        texts = part.column("text")
        row, shingle, n = shingles(texts)
        found = sketches(row, shingle, weights(n), part.num_rows)
        size = np.bincount(row, minlength=part.num_rows)
        sketch = [r.tobytes() if s else b"" for r, s in zip(found, size.tolist())]
        odd = [r.tobytes() if s else b"" for r, s in zip(parities(row, shingle, part.num_rows), size.tolist())]
        repeats = np.bincount(row[n > 1], minlength=part.num_rows) > 0
        place, of = np.cumsum(repeats) - 1, repeats[row]
        alone = sketches(place[row[of]], shingle[of], np.ones(of.sum()), int(repeats.sum()))
        plain = [alone[k].tobytes() if r else b"" for k, r in zip(place.tolist(), repeats.tolist())]
        node = [node_of(t) for t in texts.to_pylist()]
        return {"doc_id": part.column("doc_id"), "node": node, "sketch": sketch, "plain": plain, "odd": odd, "size": size}

    found = map_texts(docs, work, "doc_id long, node binary, sketch binary, plain binary, odd binary, size int")
    first = [F.first(name).alias(name) for name in ("sketch", "plain", "odd", "size")]
    nodes = found.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_rows"), *first)
    return run.stored(nodes, "nodes")


def of_kinds(nodes: DataFrame, *also: str) -> DataFrame:
    """(node, also..., kind, sketch) of each sketch: kind 0 is both in one, 1 the weighted and 2 the plain one of a text with repeats."""
    one, two = (F.struct(F.lit(k).alias("kind"), F.col(name).alias("sketch")) for k, name in ((1, "sketch"), (2, "plain")))
    both = F.struct(F.lit(0).alias("kind"), F.col("sketch").alias("sketch"))
    return nodes.select("node", *also, F.inline(F.when(F.length("plain") > 0, F.array(one, two)).otherwise(F.array(both))))


def comparable(one: str, two: str) -> Column:
    """Whether sketches of these kinds estimate the same similarity: all but weighted and plain."""
    return F.col(one).bitwiseOR(F.col(two)) != 3


def band_values(sketches_of: list[bytes]) -> np.ndarray:
    """The 64-bit values of the bands of sketches, one row each."""
    both = np.frombuffer(b"".join(sketches_of), np.uint32).reshape(-1, REGISTERS)[:, : BANDS * ROWS]
    both = both.reshape(-1, BANDS, ROWS).astype(np.uint64)
    value = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * GOLDEN, both.shape[:2]).copy()
    for k in range(ROWS):
        value = mixed(value * GOLDEN + both[:, :, k] + np.uint64(k + 1))
    return value.view(np.int64)


def banded(nodes: DataFrame) -> DataFrame:
    """(bucket, band, node, kind): a 64-bit value per band of each sketch."""

    def run(batches):
        for batch in batches:
            sketch = batch.column("sketch").to_pylist()
            keep = [k for k, s in enumerate(sketch) if s]
            if keep:
                value = band_values([sketch[k] for k in keep])
                node, kind = (batch.column(name).take(pa.array(np.repeat(keep, BANDS))) for name in ("node", "kind"))
                band = pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(keep)))
                yield pa.RecordBatch.from_arrays([pa.array(value.ravel()), band, node, kind], names=["bucket", "band", "node", "kind"])

    return of_kinds(nodes).mapInArrow(run, "bucket long, band int, node binary, kind int")


def heavy_nodes(pairs: DataFrame, run: Scratch) -> DataFrame:
    """(node, parts) of the nodes that stored pairs (a, b) hold in more than one of HEAVY_PARTS parts; stored.

    n pairs have 2 n ends, so fewer than 2 * HEAVY_PARTS nodes can have more than n / HEAVY_PARTS of them: the table is small
    whatever the number of pairs, and any other node's pairs are few enough for one task.
    """
    least = max(-(-pairs.count() // HEAVY_PARTS), HEAVY_LEAST)
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).groupBy("node").agg(F.count("*").alias("n"))
    return run.stored(ends.where(F.col("n") > least).select("node", F.ceil(F.col("n") / least).cast("int").alias("parts")), "heavy")


def beside(pairs: DataFrame, name: str, other: str, side: DataFrame, heavy: DataFrame) -> DataFrame:
    """pairs with the columns of side (node, ...) for the node in column `name`. The pairs of a heavy node are dealt over its
    parts by the node in column `other`, and its row of side is there once for each part."""
    known = F.broadcast(heavy.withColumnRenamed("node", name))
    dealt = pairs.join(known, name, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(other), "parts").cast("int"), F.lit(0)))
    side = side.withColumnRenamed("node", name)
    # Only heavy nodes have rows beyond part 0.
    more = side.join(known, name).where("parts > 1").withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts") - 1)))
    side = side.withColumn("part", F.lit(0)).unionByName(more.drop("parts"))
    return dealt.drop("parts").join(side, [name, "part"]).drop("part")


def verified(pairs: DataFrame, texts: DataFrame, run: Scratch) -> DataFrame:
    """The (a, b) of stored pairs whose texts are similar enough; texts: (node, text), one row a node."""
    heavy = heavy_nodes(pairs, run)
    pairs = beside(pairs, "a", "b", texts, heavy)
    pairs = beside(pairs, "b", "a", texts.withColumnRenamed("text", "other"), heavy)

    def compared(batches):
        for batch in batches:
            for part in slices([batch]):
                sets = []
                for name in ("text", "other"):
                    row, shingle, n = shingles(part.column(name))
                    ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                    sets.append([(shingle[s:e], weights(n[s:e])) for s, e in zip(ends[:-1], ends[1:])])
                good = [max(probability_jaccard(*x, *y)) >= SIMILARITY - 1e-12 for x, y in zip(*sets)]
                kept = part.filter(pa.array(good, pa.bool_()))
                yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])

    return pairs.select("a", "b", "text", "other").mapInArrow(compared, "a binary, b binary")


def components(links: DataFrame, run: Scratch, known: DataFrame | None = None) -> DataFrame:
    """(node, component) of every node in links (a, b): the least node reached. Labels move along links and are then
    followed to their own labels, so a chain halves with each turn; every turn is stored. known: labels of fewer links."""
    both = links.union(links.select("b", "a")).toDF("a", "b")
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node")
    if known is not None:
        before = known.withColumnRenamed("component", "before")
        labels = labels.join(before, "node", "left").select("node", F.least("component", "before").alias("component"))
    labels = run.stored(labels, "labels")
    while True:
        changed = Observation()
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("other"))
        moved = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.least("component", "other").alias("component"), F.col("component").alias("was")
        )
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = moved.join(jump, "component", "left").select("node", F.least("component", "further").alias("component"), "was")
        # Counted in the stage that writes, whose tasks count once even when they are run again.
        labels = run.stored(new.observe(changed, F.count_if(F.col("component") != F.col("was")).alias("n")), "labels").drop("was")
        if not changed.get["n"]:
            return labels


def marked(nodes: DataFrame) -> DataFrame:
    """(node, COMPARED, bands, kind) of each sketch: the low four bits of each register, the text's parity bits and number of
    shingles, and the values of all bands."""

    def run(batches):
        for batch in batches:
            sketch = batch.column("sketch").to_pylist()
            keep = [k for k, s in enumerate(sketch) if s]
            if not keep:
                continue
            registers = np.frombuffer(b"".join(sketch[k] for k in keep), np.uint32).reshape(len(keep), REGISTERS // 64, 1, 64)
            bits = (registers >> np.arange(PLANES, dtype=np.uint32)[:, None] & np.uint32(1)).astype(np.uint8)
            marks = np.packbits(bits, axis=3).view(np.int64).reshape(len(keep), MARKS)
            odd = batch.column("odd").to_pylist()
            odd = np.frombuffer(b"".join(odd[k] for k in keep), np.int64).reshape(len(keep), PARITIES)
            columns = [batch.column("node").take(pa.array(keep)), *(pa.array(np.ascontiguousarray(x)) for x in (*marks.T, *odd.T))]
            columns.append(batch.column("size").take(pa.array(keep)))
            bands = pa.FixedSizeListArray.from_arrays(pa.array(band_values([sketch[k] for k in keep]).ravel()), BANDS)
            columns += [bands.cast(pa.list_(pa.int64())), batch.column("kind").take(pa.array(keep))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", *COMPARED, "bands", "kind"])

    fields = ", ".join(f"{name} {'int' if name == 'size' else 'long'}" for name in COMPARED)
    return of_kinds(nodes, "odd", "size").mapInArrow(run, f"node binary, {fields}, bands array<bigint>, kind int")


def side_of(mark: str) -> list[Column]:
    """The columns that pairs are compared by, named for one side of a pair."""
    return [F.col(name).alias(f"{mark}_{name}") for name in COMPARED]


def alike(one: str, two: str, kind_one: str, kind_two: str) -> Column:
    """Whether enough marks agree, those of which no bit differs, and parity bits do not rule the pair out.

    The bits speak of the Jaccard similarity, which is the probability Jaccard too where neither text repeats a shingle. Two
    weighted sketches, or one of a text without repeats and a weighted one, are compared by their marks alone.
    """
    total, odd = F.lit(0), F.lit(0)
    for k in range(0, MARKS, PLANES):
        differ = [F.col(f"{one}_m{k + b}").bitwiseXOR(F.col(f"{two}_m{k + b}")) for b in range(PLANES)]
        total = total + F.bit_count(reduce(Column.bitwiseOR, differ))
    for k in range(PARITIES):
        odd = odd + F.bit_count(F.col(f"{one}_o{k}").bitwiseXOR(F.col(f"{two}_o{k}")))
    # Of n shingles in two sets of similarity s, at most n (1 - s) / (1 + s) are in one set only.
    most = (F.col(f"{one}_size") + F.col(f"{two}_size")) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-6
    weighted = (F.col(kind_one) == 1) | (F.col(kind_two) == 1)
    return (total <= REGISTERS - AGREE) & (weighted | (odd <= most))


def renamed(members: DataFrame, name: str, mark: str, *also: str) -> DataFrame:
    """(bucket, name, marks, also...) for the other side of a join in buckets."""
    return members.select("bucket", F.col("node").alias(name), *side_of(mark), *also)


def open_buckets(members: DataFrame, labels: DataFrame, run: Scratch) -> tuple[DataFrame, DataFrame]:
    """Buckets of several components as (bucket, n, lead, leader), and all members with their component; both stored.

    leader is the bucket's centre, lead its component.
    """
    known = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = run.stored(known, "members")
    found = known.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"),
        F.max(F.struct("score", "node", "component")).alias("top"),
    )
    found = found.where("low <> high").select("bucket", "n", F.col("top.component").alias("lead"), F.col("top.node").alias("leader"))
    return run.stored(found, "buckets"), known


def ordered(pairs: DataFrame) -> DataFrame:
    """(a, b) with a < b, from (x, y)."""
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def strays(buckets: DataFrame, members: DataFrame, marks: DataFrame, run: Scratch, cells: bool = False) -> DataFrame:
    """Pairs (a, b) of each node outside the centre's component with alike nodes of other components in its bucket. A pair of
    sketches comes up once: in the bucket of the first band it shares. With cells a bucket of n members is a grid of
    n / LARGE_BUCKET rows and columns: a member has one row and one column, so each pair meets in one cell."""
    kept = buckets.select("bucket", "lead", F.ceil(F.col("n") / LARGE_BUCKET).cast("int").alias("parts"))
    inside = run.stored(members.join(kept, "bucket").join(marks, ["node", "kind"]), "inside")
    outside = inside.where("component <> lead").withColumn("earlier", F.slice("bands", 1, F.col("band")))
    if cells:
        own, others = F.pmod(F.xxhash64("node"), "parts"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        outside = outside.withColumn("row", own).withColumn("column", others)
        inside = inside.withColumn("column", own).withColumn("row", others)
        outside, inside = (side.withColumn("bucket", F.struct("bucket", F.col("row").cast("int"), F.col("column").cast("int"))) for side in (outside, inside))
    one = renamed(outside.withColumnsRenamed({"component": "cx", "kind": "kx"}), "x", "p", "cx", "kx", "lead", "earlier")
    two = renamed(inside.withColumnsRenamed({"component": "cy", "kind": "ky", "bands": "by"}), "y", "q", "cy", "ky", "by")
    once = (F.col("cy") == F.col("lead")) | (F.col("x") < F.col("y"))
    same = (one.bucket == two.bucket) & comparable("kx", "ky")
    return ordered(one.join(two, same & (F.col("cx") != F.col("cy")) & once & alike("p", "q", "kx", "ky") & ~F.arrays_overlap("earlier", "by")))


def alike_pairs(pairs: DataFrame, marks: DataFrame, run: Scratch) -> DataFrame:
    """Those (a, b) of stored pairs that are alike by their weighted or by their plain sketches."""
    heavy = heavy_nodes(pairs, run)
    for name, other, mark in (("a", "b", "p"), ("b", "a", "q")):
        side = marks.select("node", F.col("kind").alias(f"k{name}"), *side_of(mark))
        pairs = beside(pairs, name, other, side, heavy)
    return pairs.where(comparable("ka", "kb") & alike("p", "q", "ka", "kb")).select("a", "b").distinct()


def from_leader(buckets: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b) of each bucket's centre with the nodes outside its component."""
    outside = members.join(buckets.select("bucket", "lead", "leader"), "bucket").where("component <> lead")
    return ordered(outside.select(F.col("leader").alias("x"), F.col("node").alias("y")))


def text_filter(nodes: DataFrame) -> np.ndarray:
    """A bit for each of 2^FILTER_BITS remainders of node hashes: 16 MB at most, whatever the number of nodes."""
    place = F.pmod(F.xxhash64("node"), F.lit(1 << FILTER_BITS))
    # bitmap_bucket_number counts from 1 and a bitmap has 32,768 bits.
    maps = nodes.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bits = np.zeros(((1 << FILTER_BITS) >> 3) + 4096, np.uint8)
    for k, found in maps.toLocalIterator():
        bits[k * 4096 : k * 4096 + 4096] = np.frombuffer(found, np.uint8)
    return bits


def in_filter(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    """place: as in text_filter, with bit positions as bitmap_bit_position and bitmap_bucket_number give them."""
    bucket, position = (place + 32767) // 32768, (place - 1) % 32768
    bucket[place == 0], position[place == 0] = 0, 0
    return (bits[bucket * 4096 + position // 8] >> (position % 8).astype(np.uint8)) & 1 == 1


def candidate_texts(docs: DataFrame, candidates: DataFrame, run: Scratch) -> DataFrame:
    """(node, text) once for each candidate; stored. The filter keeps most other texts out of the shuffle."""
    place = F.pmod(F.xxhash64(node_column()), F.lit(1 << FILTER_BITS))
    bits = text_filter(candidates)
    spread = docs.sparkSession.sparkContext.broadcast(bits)
    asked = docs.select(node_column().alias("node"), F.coalesce("text", F.lit("")).alias("text"), place.alias("place"))

    def hits(batches):
        for batch in batches:
            hit = in_filter(spread.value, batch.column("place").to_numpy().copy())
            yield batch.filter(pa.array(hit)).select(["node", "text"])

    found = asked.mapInArrow(hits, "node binary, text string").groupBy("node").agg(F.first("text").alias("text"))
    return run.stored(found.join(candidates, "node", "left_semi"), "texts")


def connected(docs: DataFrame, nodes: DataFrame, run: Scratch) -> DataFrame | None:
    """(node, component) of the nodes that are linked, from as many verified links as connect them; None if no nodes share a band."""
    bands = banded(nodes)
    # At least two sketches of one similarity; those of one text are never both weighted or both plain.
    counts = [F.count("*").alias("n"), F.count_if(F.col("kind") != 2).alias("weighted"), F.count_if(F.col("kind") != 1).alias("plain")]
    shared = bands.groupBy("bucket").agg(*counts).where("weighted > 1 OR plain > 1").select("bucket", "n")
    shared = run.stored(shared, "buckets")
    inside = run.stored(bands.join(shared, "bucket"), "inside")
    if inside.isEmpty():
        return None
    scores = inside.groupBy("node").agg(F.sum("n").alias("score"))
    members = run.stored(inside.drop("n").join(run.stored(scores, "scores"), "node"), "members")
    leaders = run.stored(members.groupBy("bucket").agg(F.max(F.struct("score", "node"))["node"].alias("leader")), "leaders")
    marks = run.stored(marked(nodes).join(scores.select("node"), "node"), "marks")
    led = members.join(leaders, "bucket").where("node <> leader")
    star = run.stored(ordered(led.select(F.col("leader").alias("x"), F.col("node").alias("y"))).distinct(), "pairs")
    star = run.stored(alike_pairs(star, marks, run), "pairs")
    texts = candidate_texts(docs, run.stored(members.select("node").distinct(), "candidates"), run)
    links = run.stored(verified(star, texts, run), "links")
    done, labels = star, components(links, run)

    def tried(pairs: list[DataFrame]) -> bool:
        """Verifies pairs that have not been; whether there are new links."""
        nonlocal links, labels, done
        fresh = pairs[0]
        for other in pairs[1:]:
            fresh = fresh.union(other)
        fresh = run.stored(fresh.distinct().join(done, ["a", "b"], "left_anti"), "pairs")
        if fresh.isEmpty():
            return False
        found = run.stored(verified(fresh, texts, run), "links")
        done = done.union(fresh)
        if found.isEmpty():
            return False
        links = links.union(found)
        labels = components(links, run, labels)
        return True

    # Buckets that the stars have left in several components.
    buckets, known = open_buckets(members, labels, run)
    pairs = [strays(buckets.where(F.col("n") <= LARGE_BUCKET), known, marks, run)]
    large = run.stored(known.join(buckets.where(F.col("n") > LARGE_BUCKET).select("bucket"), "bucket"), "large")
    if large.isEmpty():
        tried(pairs)
        return labels
    # A node of a large bucket with each of its later bands that other nodes share.
    second = inside.select(F.col("bucket").alias("second"), F.col("band").alias("later"), "node", "kind")
    divided = large.drop("component").join(second, ["node", "kind"]).where("later > band")
    divided = divided.withColumn("bucket", F.xxhash64("bucket", "second")).drop("second")
    buckets, known = open_buckets(divided, labels, run)
    pairs.append(alike_pairs(run.stored(from_leader(buckets, known).distinct(), "pairs"), marks, run))
    tried(pairs)
    # Whatever the parts' centres have left in several components, whether or not it shares a second band.
    buckets, known = open_buckets(large.drop("component"), labels, run)
    tried([strays(buckets, known, marks, run, cells=True)])
    return labels


def node_classes(docs: DataFrame) -> DataFrame:
    """(node, rep, n_rows, class_id, keeper, linked) of each different text; stored.

    class_id is the least doc_id of the class, keeper tells the node that has it, linked a node with other nodes in its class.
    """
    run = Scratch(prepare(docs.sparkSession), "minhash")
    nodes = sketched(docs, run)
    labels = connected(docs, nodes, run)
    plain = nodes.select("node", "rep", "n_rows")
    if labels is None:
        classes = plain.select("*", F.col("rep").alias("class_id"), F.lit(True).alias("keeper"), F.lit(False).alias("linked"))
        classes = stored(classes, "minhash-classes")
        run.drop()
        return classes
    linked = run.stored(labels.join(plain, "node"), "linked")
    first = linked.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "node")).alias("first"))
    first = run.stored(first.select("component", F.col("first.rep").alias("class_id"), F.col("first.node").alias("first_node")), "classes")
    of = run.stored(linked.join(first, "component").select("node", "class_id", "first_node"), "classes")
    classes = stored(
        plain.join(of, "node", "left").select(
            "node", "rep", "n_rows", F.coalesce("class_id", "rep").alias("class_id"),
            F.coalesce(F.col("node") == F.col("first_node"), F.lit(True)).alias("keeper"), F.col("first_node").isNotNull().alias("linked"),
        ),
        "minhash-classes",
    )
    run.drop()
    return classes


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id and class_id of every row: documents in one class are equal or connected by similarities of 0.8 or more.

    A null text counts as empty. Texts without a word are in a class only with equal ones. Rows without doc_id are classed
    by their text and never name a class; class_id is null if a class has no doc_id at all. Repeated rows repeat.
    """
    classes = node_classes(docs).select("node", "class_id")
    return docs.select("doc_id", node_column().alias("node")).join(classes, "node").select("doc_id", "class_id")


def near_duplicate_stage(docs: DataFrame) -> DataFrame:
    """One row of each class, that of the least doc_id, all columns as they are; a repeated row stays once.

    Rows whose text is not in the filter of repeated or linked texts stay without a shuffle.
    """
    columns, schema = docs.columns, docs.schema
    node, rep, place = (fresh(columns, stem) for stem in ("_node", "_rep", "_place"))
    classes = node_classes(docs)
    touched = classes.where("linked OR n_rows > 1")
    bits = docs.sparkSession.sparkContext.broadcast(text_filter(touched.select("node")))
    where = F.pmod(F.xxhash64(node_column()), F.lit(1 << FILTER_BITS)).alias(place)

    def chosen(wanted: bool):
        def run(batches):
            for batch in batches:
                hit = in_filter(bits.value, batch.column(batch.num_columns - 1).to_numpy().copy())
                yield batch.filter(pa.array(hit == wanted)).select(columns)

        return docs.select("*", where).mapInArrow(run, schema)

    # One row of each keeper: (doc_id, node) names it, equal rows become one.
    keepers = classes.where("keeper").select(F.col("node").alias(node), F.col("rep").alias(rep))
    kept = chosen(True).withColumn(node, node_column()).join(keepers, node)
    kept = kept.where(F.col("doc_id").eqNullSafe(F.col(rep))).dropDuplicates([node])
    return chosen(False).unionByName(kept.drop(node, rep))


def op7_near_duplicates(spark, sf_dir: str) -> DataFrame:
    from millrace.llm.common import table

    return near_duplicates(table(spark, sf_dir, "documents"))
