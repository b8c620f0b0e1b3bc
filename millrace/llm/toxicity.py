"""Toxicity by logistic regression, learned with FTRL-proximal over hashed word n-grams and skip-grams.

Features are words, pairs of neighbours and pairs with one or two words between, hashed to 2^20 coordinates; each counts once
in a document. FTRL-proximal keeps two numbers per coordinate: n sets its own learning rate, and |z| <= L1 keeps its
weight exactly 0. What remains is a short list of weights, at most 2^20 and in practice some hundreds, that every task gets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_texts, prepare, slices
from millrace.llm.scan import BASE, LETTERS, mixed, words_of

HASH_BITS = 20
#: Labelled rows the model is fitted on at most, those whose doc_id has the smallest hashes.
SAMPLE_ROWS = 12_000
#: Distances of the two words of a pair; beyond 1 it is a skip-gram.
DISTANCES = (1, 2, 3)


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.1
    epochs: int = 6


@dataclass(frozen=True)
class Model:
    """Coordinates with a weight, ascending, their weights and the bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, coordinate) of every feature of a slice of texts, repeats included. Words are runs of letters, small ones."""
    words = words_of(texts, LETTERS, fold=True)
    h, row = words.hash, words.row
    rows, keys = [row], [mixed(h + np.uint64(1))]
    for d in DISTANCES:
        if len(h) > d:
            same = row[:-d] == row[d:]
            rows.append(row[:-d][same])
            keys.append(mixed((h[:-d] * np.uint64(BASE) + h[d:] + np.uint64(2 * d + 1))[same]))
    return np.concatenate(rows), (np.concatenate(keys) >> np.uint64(64 - HASH_BITS)).astype(np.int32)


def fit(examples, rows: int, positive: int, how: Ftrl = Ftrl()) -> Model:
    """Learns from (label, coordinates without repeats) in the order given, several times over."""
    z, n = np.zeros(1 << HASH_BITS), np.zeros(1 << HASH_BITS)
    offset = math.log((positive + 0.5) / (rows - positive + 1.5))
    zb = nb = 0.0

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= how.l1, 0.0, -(zz - np.sign(zz) * how.l1) / ((how.beta + np.sqrt(n[at])) / how.alpha + how.l2))

    bias = 0.0
    for _ in range(how.epochs):
        for label, at in examples:
            w = weights(at)
            bias = -zb / ((how.beta + math.sqrt(nb)) / how.alpha + how.l2)
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, offset + bias + w.sum())))) - label
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / how.alpha * bias
            nb += g * g
            before = n[at]
            z[at] += g - (np.sqrt(before + g * g) - np.sqrt(before)) / how.alpha * w
            n[at] = before + g * g
    index = np.flatnonzero(np.abs(z) > how.l1)
    return Model(index.astype(np.int32), weights(index), offset + bias)


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """Probability of each text of a slice; an empty text has that of the bias."""
    dense = np.zeros(1 << HASH_BITS, np.float32)
    dense[model.index] = model.weight
    row, at = features(texts)
    used = np.flatnonzero(dense[at])
    once = np.unique(row[used].astype(np.int64) << HASH_BITS | at[used])
    total = model.bias + np.bincount(once >> HASH_BITS, dense[once & ((1 << HASH_BITS) - 1)], len(texts))
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def held_out():
    """Rows that are never learned from: crc32 of doc_id as text divisible by 5. False for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, how: Ftrl = Ftrl()) -> Model:
    """Fits the model on at most `rows` labelled documents that are not held out.

    Features are made in parallel; the fit, sequential by its nature, runs in one task over the bounded sample. A document that
    has several labels counts as toxic if one says so. Of rows with the same doc_id one counts: that whose coordinates come first
    in order, so the model does not depend on which row is read first. Without labels no text is toxic.
    """
    prepare(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # The sample has a set number of rows, so it may be sent to every task.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")

    def featured(batches):
        for part in slices(batches):
            row, at = features(part.column("text"))
            once = np.unique(row.astype(np.int64) << HASH_BITS | at)
            ends = np.searchsorted(once, np.arange(part.num_rows + 1, dtype=np.int64) << HASH_BITS)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((once & ((1 << HASH_BITS) - 1)).astype(np.int32)))
            names = ["doc_id", "toxic", "at"]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic").cast(pa.int32()), lists], names=names)

    def learn(batches):
        examples = []
        for batch in batches:
            lists = batch.column("at")
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for k, label in enumerate(batch.column("toxic").to_pylist()):
                examples.append((label, values[ends[k] : ends[k + 1]]))
        model = fit(examples, len(examples), sum(label for label, _ in examples), how)
        index, weight = np.append(model.index, -1), np.append(model.weight, model.bias)
        yield pa.RecordBatch.from_arrays([pa.array(index, pa.int32()), pa.array(weight, pa.float64())], names=["at", "weight"])

    made = texts.mapInArrow(featured, "doc_id long, toxic int, at array<int>")
    made = made.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("at").alias("at"))
    one = made.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    found = one.mapInArrow(learn, "at int, weight double").toPandas().sort_values("at")
    if not len(found):
        return Model(np.empty(0, np.int32), np.empty(0), math.log(0.5 / 1.5))
    return Model(found["at"].to_numpy()[1:], found["weight"].to_numpy()[1:], float(found["weight"].iloc[0]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, without a shuffle; a null text counts as empty and has the bias's score.

    Repeated rows are scored each, an empty table gives no rows, texts of any length are read whole, other columns are not looked at.
    """
    prepare(docs.sparkSession)
    found = map_texts(docs, lambda part: {"doc_id": part.column("doc_id"), "score": scores(model, part.column("text"))}, "doc_id long, score double")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity_stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model does not take for toxic, all columns as they are."""
    model = train(docs, labels)

    def run(batches):
        for part in slices(batches):
            yield part.filter(pa.array(scores(model, part.column("text")) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    from millrace.llm.common import table

    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))
