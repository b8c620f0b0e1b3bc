"""Prefix polynomial hashes of documents.

H[k] = sum over j < k of code[j] * B^j, modulo two primes below 2^31. Two places of the array give the hash of any span, so
spans of any two texts are compared in constant time, and the longest common extension of two places is found by binary
search. A fingerprint is a sample of span hashes from the arrays, chosen by their values, so equal parts of two texts are seen
wherever they lie. A document and its successor by doc_id meet in ranges of doc_id; only the first row of each range is sent twice.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import prepare, slices

#: Two primes below 2^31 and a base for each.
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_812_433_253)
#: Code points of the spans a fingerprint samples, and hashes of its sample.
SPAN = 16
POINTS = 64

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> list[np.ndarray]:
    """The first n powers of both bases, or of their inverses; kept at the longest length asked for."""
    for k, (prime, base) in enumerate(zip(PRIMES, BASES)):
        have = _powers.get((k, inverse), np.ones(1, np.uint64))
        while len(have) < n:
            factor = pow(base, -len(have) if inverse else len(have), prime)
            have = np.concatenate([have, have * np.uint64(factor) % np.uint64(prime)])
        _powers[k, inverse] = have
    return [_powers[k, inverse][:n] for k in range(2)]


class Prefix:
    """The prefix arrays of a text: `sums` are the two arrays of length n + 1."""

    def __init__(self, sums: list[np.ndarray]):
        self.sums = sums
        self.n = len(sums[0]) - 1
        self.made: str | None = None

    @classmethod
    def of(cls, text: str) -> Prefix:
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        sums = []
        for prime, power in zip(PRIMES, powers(len(codes))):
            total = np.zeros(len(codes) + 1, np.uint64)
            # Terms are below 2^31, so a sum of up to 2^33 of them fits.
            np.cumsum(codes * power % np.uint64(prime), out=total[1:])
            sums.append(total % np.uint64(prime))
        return cls(sums)

    def head_joined(self, length: int, other: Prefix, take: int) -> Prefix:
        """The arrays of this text's first `length` places followed by the other's first `take`."""
        out = []
        for prime, power, mine, theirs in zip(PRIMES, powers(length + 1), self.sums, other.sums):
            p = np.uint64(prime)
            out.append(np.concatenate([mine[: length + 1], (mine[length] + theirs[1 : take + 1] * power[length]) % p]))
        return Prefix(out)

    def span(self, start: int, end: int) -> tuple[int, int]:
        """Hash of a span, brought to place 0: equal spans have equal hashes wherever they lie."""
        found = []
        for prime, base, sums in zip(PRIMES, BASES, self.sums):
            found.append((int(sums[end]) - int(sums[start])) * pow(base, -start, prime) % prime)
        return found[0], found[1]

    def equal(self, start: int, end: int, other: Prefix, at: int) -> bool:
        """Whether this text's span equals the other's of the same length at `at`."""
        length = end - start
        if at + length > other.n:
            return False
        top = max(start, at) + 1
        for prime, power, mine, theirs in zip(PRIMES, powers(top), self.sums, other.sums):
            a = (int(mine[end]) - int(mine[start])) * int(power[at])
            b = (int(theirs[at + length]) - int(theirs[at])) * int(power[start])
            if (a - b) % prime:
                return False
        return True

    def extension(self, at: int, other: Prefix, other_at: int) -> int:
        """Length of the longest common extension to the right of two places, by binary search."""
        low, high = 0, min(self.n - at, other.n - other_at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(at, at + middle, other, other_at):
                low = middle
            else:
                high = middle - 1
        return low

    def ending(self, other: Prefix) -> int:
        """Length of the longest common ending, by binary search."""
        low, high = 0, min(self.n, other.n)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(self.n - middle, self.n, other, other.n - middle):
                low = middle
            else:
                high = middle - 1
        return low

    def spans(self) -> np.ndarray:
        """Mixed hashes of all spans of SPAN places, brought to place 0; of a shorter text that of the whole text."""
        if not self.n:
            return np.empty(0, np.uint64)
        length = min(SPAN, self.n)
        found = np.zeros(self.n + 1 - length, np.uint64)
        for prime, back, sums in zip(PRIMES, powers(len(found), inverse=True), self.sums):
            p = np.uint64(prime)
            value = (sums[length:] + p - sums[:-length]) % p * back % p
            found = (found << np.uint64(31)) ^ value
        found = (found ^ (found >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return found ^ (found >> np.uint64(27))

    def fingerprint(self) -> str:
        """length:hash:sample, hexadecimal. The sample is the POINTS least different span hashes, ascending, 32 bits each."""
        if self.made is None:
            least = np.unique(self.spans() >> np.uint64(32))[:POINTS]
            self.made = f"{self.n:x}:{int(self.sums[0][self.n]):08x}{int(self.sums[1][self.n]):08x}:{least.astype('>u4').tobytes().hex()}"
        return self.made


def likeness(one: str, two: str) -> float:
    """Of two fingerprints: the share of spans the two texts have in common, wherever they lie (1 for equal fingerprints).

    Of the POINTS least hashes of both samples together as many are in both as the span sets overlap (exactly, if the texts have
    no more different spans than that; else with a standard deviation of 0.0625 at most); an overlap of J is a share of 2J / (1 + J).
    """
    if one == two:
        return 1.0
    a, b = (set(s[k : k + 8] for k in range(0, len(s), 8)) for s in (f.rsplit(":", 1)[1] for f in (one, two)))
    least = sorted(a | b)[:POINTS]
    both = sum(h in a and h in b for h in least)
    return 2 * both / (len(least) + both) if least else 0.0


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ahead) in partitions that are ranges of doc_id, sorted, with the row after the range at their end (ahead).

    One pass over the ids for the bounds, one for the first id of each range, then one shuffle of the texts.
    """
    spark = docs.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Rows without doc_id come first.
    ids = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))
    shares = [k / ranges for k in range(1, ranges)]
    bounds = ids.agg(F.percentile_approx("id", shares or [0.5], 20 * ranges)).first()[0] or [0]
    splits = [float("-inf"), *sorted({float(b) for b in bounds}), float("inf")]

    from pyspark.ml.feature import Bucketizer

    bucket = Bucketizer(splits=splits, inputCol="key", outputCol="part", handleInvalid="keep")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))
    ranged = bucket.transform(rows.withColumn("key", F.col("id").cast("double"))).withColumn("part", F.col("part").cast("int"))
    keyed = bucket.transform(ids.withColumn("key", F.col("id").cast("double")))
    firsts = sorted((int(p), i) for p, i in keyed.groupBy("part").agg(F.min("id")).collect())  # one row a range
    before = {p: firsts[k - 1][0] for k, (p, _) in enumerate(firsts)}
    ahead = F.element_at(F.array(*[F.lit(before.get(p, -1)) for p in range(len(splits))]), F.col("part") + 1)
    home = F.struct(F.col("part").alias("to"), F.lit(False).alias("ahead"))
    twice = F.array(home, F.struct(ahead.alias("to"), F.lit(True).alias("ahead")))
    to = F.explode(F.when(F.col("id").isin([i for _, i in firsts]), twice).otherwise(F.array(home))).alias("to")
    dealt = ranged.select("doc_id", "text", "id", to).select("doc_id", "text", "id", F.col("to.ahead").alias("ahead"), F.col("to.to").alias("to"))
    return dealt.repartitionById(len(splits), "to").sortWithinPartitions("ahead", "id", "text").select("doc_id", "text", "ahead")


def compared(docs: DataFrame) -> DataFrame:
    """SCHEMA, a row per document: its fingerprint, that of its edited text and how alike they and its successor are.

    The edited text has the last quarter of code points replaced by as many from the beginning of the next document, by
    ascending doc_id and, for equal ones, text; after the last document comes the first. A null text counts as empty; an empty text
    is like no other but an empty one. Rows without doc_id come first, repeated rows follow each other, an empty table gives
    no rows, further columns are not read.
    """
    prepare(docs.sparkSession)

    def run(batches):
        before = None
        done = False
        for batch in slices(batches):
            out = []
            for doc, text, ahead in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "ahead"))):
                if done:
                    break
                row = (doc, text, Prefix.of(text))
                if before is not None:
                    out.append(edited(*before, *row[1:]))
                before, done = row, ahead
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out))), schema=fields)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(SCHEMA))
    names = fields.names
    return with_next(docs).mapInArrow(run, SCHEMA)


def edited(doc, text: str, prefix: Prefix, following: str, after: Prefix) -> tuple:
    quarter = len(text) // 4
    kept, taken = len(text) - quarter, min(quarter, len(following))
    new = prefix.head_joined(kept, after, taken)
    digest = hashlib.sha256((text[:kept] + following[:taken]).encode()).hexdigest()
    mine, changed = prefix.fingerprint(), new.fingerprint()
    return doc, len(text), digest, mine, changed, likeness(mine, changed), likeness(mine, after.fingerprint())


def op10_fingerprints(spark, sf_dir: str) -> DataFrame:
    from millrace.llm.common import table

    return compared(table(spark, sf_dir, "documents"))


ORACLE_EDITED = r"""
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(left(t, length(t) - length(t) // 4) || left(nt, length(t) // 4)) AS edited_sha256
FROM (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nt
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
"""
