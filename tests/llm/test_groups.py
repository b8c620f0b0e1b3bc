import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import difference, duck
from millrace.llm import fingerprints, minhash, pii, quality, sharding, toxicity
from millrace.llm.common import Scratch
from millrace.llm.minhash import probability_jaccard, shingles, sketches, weights

SF = "/root/testdata/sf0.001"


def words(dice, n):
    return [f"w{dice.randrange(5000)}" for _ in range(n)]


def classes_of(texts):
    """Brute force: every pair of texts, exact similarities, connected."""
    row, shingle, n = shingles(pa.array(texts))
    sets = [(shingle[row == k], weights(n[row == k])) for k in range(len(texts))]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            same = texts[a] == texts[b]
            if same or len(sets[a][0]) and len(sets[b][0]) and max(probability_jaccard(*sets[a], *sets[b])) >= 0.8 - 1e-12:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [root(k) for k in range(len(texts))]


def corpus(seed):
    """Copies, near copies, chains of edits, and many short texts around one passage."""
    dice, out = random.Random(seed), []
    passage = words(dice, 60)
    for k in range(45):
        out.append(passage + words(dice, dice.randrange(4, 30)))
    base = words(dice, 120)
    for k in range(40):
        text = list(base)
        for _ in range(dice.randrange(0, 5)):
            text[dice.randrange(120)] = f"e{dice.randrange(10**6)}"
        out.append(text)
    text = words(dice, 100)
    for k in range(12):
        text = list(text)
        text[dice.randrange(100)] = f"c{k}"
        text[dice.randrange(100)] = f"d{k}"
        out.append(text)
    out += [words(dice, 50) for _ in range(20)] + [["short", "one"], ["short", "one"], ["other"], []]
    out += [list(out[3]), list(out[50])]
    return [" ".join(t) for t in out]


@pytest.mark.parametrize("large", [4096, 4])
def test_near_duplicates_equal_brute_force(docs_of, monkeypatch, large):
    monkeypatch.setattr(minhash, "LARGE_BUCKET", large)
    texts = corpus(large)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs_of(texts)).collect()}
    assert [got[k] for k in range(len(texts))] == classes_of(texts)


@pytest.mark.parametrize("large", [4096, 2])
def test_texts_similar_by_plain_jaccard_only(docs_of, monkeypatch, large):
    """A text against itself with a passage repeated many times: Jaccard is above 0.8, probability Jaccard far below."""
    monkeypatch.setattr(minhash, "LARGE_BUCKET", large)
    dice, texts = random.Random(5), []
    for times in (60, 60, 60, 60, 20, 20, 20, 20):
        base, passage = words(dice, 500), words(dice, 60)
        texts += [" ".join(base), " ".join(base + passage * times), " ".join(passage * (times - 5) + base)]
    row, shingle, n = shingles(pa.array(texts[:2]))
    sets = [(shingle[row == k], weights(n[row == k])) for k in range(2)]
    weighted, plain = probability_jaccard(*sets[0], *sets[1])
    assert weighted < 0.65 and plain > 0.85
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs_of(texts)).collect()}
    assert [got[k] for k in range(len(texts))] == classes_of(texts)


def test_large_buckets_lose_no_pair_that_shares_one_band(docs_of, monkeypatch):
    """With one band only, no pair shares a second one: the classes must be those of buckets that are not large."""
    every, found = minhash.banded, []
    monkeypatch.setattr(minhash, "banded", lambda nodes: every(nodes).where("band = 0"))
    dice = random.Random(1)
    base, texts = words(dice, 200), []
    for k in range(16):
        # Pairs of copies that are alike to each other but not to those of other pairs.
        text = list(base)
        for at in range(10 + k, 200, 19):
            text[at] = f"g{k}-{at}"
        texts += [" ".join(text[:195] + [f"x{k}{j}"] * 2) for j in range(3)]
    for large in (4096, 3):
        monkeypatch.setattr(minhash, "LARGE_BUCKET", large)
        rows = minhash.near_duplicates(docs_of(texts)).collect()
        found.append({r.doc_id: r.class_id for r in rows})
    assert found[0] == found[1] and len(set(found[0].values())) < len(texts)


def test_pairs_of_one_centre_are_dealt_over_tasks(spark):
    """5,000 pairs of one centre among 5,000 others: joined as by a plain join, and in even tasks."""
    pairs = spark.range(5000).selectExpr("'centre' AS a", "concat('copy', id) AS b").union(
        spark.range(5000).selectExpr("concat('n', id) AS a", "concat('other', id) AS b"))
    side = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().withColumn("text", F.concat(F.lit("text of "), "node"))
    heavy = minhash.heavy_nodes(pairs, Scratch(spark, "test"))
    assert [(r.node, r.parts) for r in heavy.collect()] == [("centre", 157)]
    before = {key: spark.conf.get(key) for key in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for key, value in zip(before, ("false", "-1", "40")):
            spark.conf.set(key, value)
        found = minhash.beside(pairs, "a", "b", side, heavy).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sorted((r.a, r.b, r.text) for r in found) == sorted((r.a, r.b, "text of " + r.a) for r in pairs.collect())
    sizes = Counter(r.task for r in found)
    assert len(sizes) == 40 and max(sizes.values()) < 2 * 10_000 / 40


def test_heavy_nodes_are_few_whatever_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HEAVY_PARTS", 10)
    monkeypatch.setattr(minhash, "HEAVY_LEAST", 1)
    pairs = spark.range(4000).selectExpr("concat('a', id % 17) AS a", "concat('b', id % 400) AS b")
    assert minhash.heavy_nodes(pairs, Scratch(spark, "test")).count() == 0
    more = pairs.union(pairs.where("a = 'a1'"))
    assert [(r.node, r.parts) for r in minhash.heavy_nodes(more, Scratch(spark, "test")).collect()] == [("a1", 2)]


def test_near_duplicates_with_heavy_nodes_equal_brute_force(docs_of, monkeypatch):
    monkeypatch.setattr(minhash, "HEAVY_LEAST", 2)
    texts = corpus(7)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs_of(texts)).collect()}
    assert [got[k] for k in range(len(texts))] == classes_of(texts)


def test_sketches_estimate_the_similarity():
    dice = np.random.default_rng(2)
    x = dice.integers(0, 2**63, 400, dtype=np.uint64)
    wx, wy = 1 + dice.random(300), 1 + dice.random(300)
    a, b = np.sort(x[:300]), np.sort(x[100:])
    want = probability_jaccard(a, wx, b, wy)[0]
    row = np.repeat([0, 1], 300)
    found = sketches(row, np.concatenate([a, b]), np.concatenate([wx, wy]), 2, m=20_000)
    assert abs((found[0] == found[1]).mean() - want) < 0.015


def test_probability_jaccard_of_plain_sets_is_jaccard():
    x, y = np.arange(10, dtype=np.uint64), np.arange(4, 20, dtype=np.uint64)
    both = probability_jaccard(x, np.ones(10), y, np.ones(16))
    assert both == pytest.approx((6 / 20, 6 / 20))


@pytest.mark.parametrize("kinds", [(0, 0), (0, 1), (2, 2)])
def test_comparison_before_texts_equals_registers_and_proof(spark, docs_of, kinds):
    """Marks by the registers themselves; parity bits only where no weighted sketch is compared, and never against the exact similarity."""
    dice = random.Random(3)
    base = words(dice, 300)
    texts = [" ".join(base)]
    for k in range(60):
        text = list(base)
        for at in dice.sample(range(300), 1 + k // 5):
            text[at] = f"x{k}-{at}"
        texts.append(" ".join(text))
    nodes = minhash.sketched(docs_of(texts), Scratch(spark, "test"))
    registers = {bytes(r.node): np.frombuffer(r.sketch, np.uint32) & 15 for r in nodes.collect()}
    marks = minhash.marked(nodes)
    one = marks.select(F.col("node").alias("a"), F.lit(kinds[0]).alias("ka"), *minhash.side_of("p")).where(F.col("a") == minhash.node_of(texts[0]))
    two = marks.select(F.col("node").alias("b"), F.lit(kinds[1]).alias("kb"), *minhash.side_of("q"))
    pairs = one.join(two, F.lit(True)).select("b", minhash.alike("p", "q", "ka", "kb").alias("alike")).collect()
    row, shingle, n = shingles(pa.array(texts))
    sets = {minhash.node_of(t): set(shingle[row == k].tolist()) for k, t in enumerate(texts)}
    first, ruled_out = minhash.node_of(texts[0]), 0
    assert len(pairs) == len(set(texts))
    for pair in pairs:
        b = bytes(pair.b)
        agree = int((registers[first] == registers[b]).sum()) >= minhash.AGREE
        similarity = len(sets[first] & sets[b]) / len(sets[first] | sets[b])
        assert not pair.alike or agree
        if agree and (1 in kinds or similarity >= 0.8):
            assert pair.alike
        ruled_out += agree and not pair.alike
    assert (ruled_out > 0) == (1 not in kinds)


@pytest.mark.parametrize("n", [1, 5, 40, 300, 1500, 6000])
def test_parity_bits_never_exceed_the_difference(n):
    dice = np.random.default_rng(n)
    base = np.unique(dice.integers(0, 2**63, 2 * n, dtype=np.uint64))
    for share in (0.5, 0.75, 0.8, 0.85, 0.95, 1.0):
        common = base[: int(n * share)]
        x, y = (np.union1d(common, dice.integers(0, 2**63, n - len(common), dtype=np.uint64)) for _ in range(2))
        bits = minhash.parities(np.repeat([0, 1], [len(x), len(y)]), np.concatenate([x, y]), 2)
        differ = sum(int(v).bit_count() for v in (bits[0] ^ bits[1]).view(np.uint64))
        only = len(np.setxor1d(x, y))
        assert differ <= only and (only - differ) % 2 == 0
        if only:
            assert differ
            jaccard = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            assert jaccard < 0.8 or differ <= (len(x) + len(y)) / 9 + 1e-6


def naive(classes, shards):
    heap, out = [(0.0, s) for s in range(shards)], {}
    for name, size, members in classes:
        out[name] = np.zeros(shards, np.int64)
        for _ in range(members):
            load, s = heapq.heappop(heap)
            out[name][s] += 1
            heapq.heappush(heap, (load + size, s))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_schedule_equals_one_at_a_time(seed):
    dice = random.Random(seed)
    classes = sorted(((k, float(dice.randrange(1, 400)), dice.randrange(1, 90)) for k in range(30)), key=lambda c: -c[1])
    got, want = sharding.scheduled(classes, 5), naive(classes, 5)
    loads = [sum(found[k] * size for k, size, _ in classes) for found in (got, want)]
    assert all(found[k].sum() == members for found in (got, want) for k, _, members in classes)
    assert np.ptp(loads[0]) <= np.ptp(loads[1]) + 1e-9 and np.allclose(np.sort(loads[0]), np.sort(loads[1]))


def test_shards(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = sharding.op8_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    homes, slots, loads = defaultdict(set), defaultdict(list), [0] * sharding.SHARDS
    for r in rows:
        data = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        homes[data].add(r.shard)
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
    assert all(len(h) == 1 for h in homes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(loads) <= 4 / 3 * sum(loads) / len(loads) or max(loads) == max(r.size for r in rows)


def test_fingerprints_equal_sql(spark):
    got = fingerprints.op10_fingerprints(spark, SF)
    assert difference(got.select("doc_id", "n_chars", "edited_sha256"), duck(SF), fingerprints.ORACLE_EDITED) is None
    rows = sorted(got.collect(), key=lambda r: r.doc_id)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r, after in zip(rows, [*rows[1:], rows[0]]):
        assert r.fingerprint.startswith(f"{r.n_chars:x}:") and r.near_next == fingerprints.likeness(r.fingerprint, after.fingerprint)
        assert r.near_edited == fingerprints.likeness(r.fingerprint, r.edited_fingerprint)
        text, following, q = texts[r.doc_id], texts[after.doc_id], r.n_chars // 4
        assert abs(r.near_edited - share(text, text[: len(text) - q] + following[:q])) <= 0.25
        assert abs(r.near_next - share(text, following)) <= 0.25


def share(a, b, size=fingerprints.SPAN):
    """Spans that two texts have in common, as a share of the different spans of both."""
    if a == b:
        return 1.0
    x, y = ({t[k : k + min(size, len(t))] for k in range(max(1, len(t) + 1 - size))} if t else set() for t in (a, b))
    return 2 * len(x & y) / max(1, len(x) + len(y))


def test_likeness_sees_equal_parts_anywhere():
    dice = random.Random(3)
    text = "".join(dice.choices("abcdefgh é", k=2000))
    ends = "#" + text[1:-1] + "#"
    spread = "".join("#" if k % 200 == 100 else c for k, c in enumerate(text))
    for other in (ends, "#" + text[:-1], text[1000:] + text[:1000], spread, text[:1500], text * 2, text[:50], "".join(dice.choices("abcdefgh é", k=2000)), "", "x"):
        got = fingerprints.likeness(*(fingerprints.Prefix.of(t).fingerprint() for t in (text, other)))
        assert abs(got - share(text, other)) <= 0.2, other[:20]
    assert share(text, ends) > 0.98 and share(text, text[1000:] + text[:1000]) > 0.98
    for a, b in (("abc", "abc"), ("abc", "abd"), ("", "a"), ("short text of few spans", "few spans, short text of")):
        one, two = (fingerprints.Prefix.of(t).fingerprint() for t in (a, b))
        assert fingerprints.likeness(one, two) == pytest.approx(share(a, b))


def test_spans_and_extensions_by_brute_force():
    dice = random.Random(1)
    a, b = ("".join(dice.choices("abé", k=60)) for _ in range(2))
    x, y = fingerprints.Prefix.of(a), fingerprints.Prefix.of(b)
    for _ in range(2000):
        i, j, n = dice.randrange(61), dice.randrange(61), dice.randrange(12)
        if i + n <= 60:
            assert x.equal(i, i + n, y, j) == (j + n <= 60 and a[i : i + n] == b[j : j + n])
            if j + n <= 60:
                assert (x.span(i, i + n) == y.span(j, j + n)) == (a[i : i + n] == b[j : j + n])
        k = 0
        while i + k < 60 and j + k < 60 and a[i + k] == b[j + k]:
            k += 1
        assert x.extension(i, y, j) == k
    joined = x.head_joined(40, y, 15)
    assert all(np.array_equal(p, q) for p, q in zip(joined.sums, fingerprints.Prefix.of(a[:40] + b[:15]).sums))


def test_equal_texts_have_equal_fingerprints(docs_of):
    rows = fingerprints.compared(docs_of(["same text", "another", "same text", "", ""])).collect()
    prints = {r.doc_id: r.fingerprint for r in rows}
    assert prints[0] == prints[2] and prints[3] == prints[4] and len(set(prints.values())) == 3
    assert {r.doc_id: r.near_next for r in rows}[3] == 1.0


def test_edited_text_goes_over_partitions_and_ties(docs_of):
    texts = [(dice, f"{dice} text of " * (dice + 1)) for dice in range(23)] + [(5, "second of five " * 9), (None, "none " * 8)]
    rows = fingerprints.compared(docs_of(texts).repartition(5)).collect()
    order = sorted(texts, key=lambda t: (t[0] is not None, t[0] or 0, t[1]))
    want = []
    for k, (doc, text) in enumerate(order):
        following, q = order[(k + 1) % len(order)][1], len(text) // 4
        want.append((doc, hashlib.sha256((text[: len(text) - q] + following[:q]).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.edited_sha256)) for r in rows)


def test_pipeline_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in quality.applied(quality.ledger(docs)).where("kept").collect()}
    first = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert {r.doc_id for r in first.collect()} == kept
    model = toxicity.train(first, labels)
    clean = {r.doc_id for r in toxicity.scored(first, model).where("predicted = 0").collect()}
    second = corpus_pipeline.STAGES[1][1](spark, first, SF)
    assert {r.doc_id for r in second.collect()} == clean
    rows = sorted((r.doc_id, r.text) for r in second.select("doc_id", "text").collect())
    classes = classes_of([text for _, text in rows])
    third = corpus_pipeline.STAGES[2][1](spark, second, SF)
    assert sorted(r.doc_id for r in third.collect()) == sorted({rows[c][0] for c in classes})
    fourth = corpus_pipeline.STAGES[3][1](spark, third, SF)
    texts = dict(rows)
    for r in fourth.collect():
        base = pii.base_spans(texts[r.doc_id])
        assert not pii.emails(r.text) and r.n_chars == len(r.text) and (bool(base) == (r.text != texts[r.doc_id]))
    result = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in result.select("doc_id").distinct().collect()} == {r.doc_id for r in fourth.collect()}
