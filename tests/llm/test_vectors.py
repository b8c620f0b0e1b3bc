"""Embedding operators against all pairs and against a dense eigenvalue solver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import multiindex, whitening
from millrace.llm.queries import queries

SCHEMA = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")
ODD = [
    (1, [1.0, 0.0, 0.0], 1), (2, [2.0, 0.0, 0.0], 1), (3, [1.0, 0.01, 0.0], 1), (3, [1.0, 0.01, 0.0], 1), (None, [1.0, 0.0, 0.0], 1),
    (4, [1.0, 0.0, 0.0], 2), (5, [1.0, 0.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 0.0], 1), (9, [1.0, NAN, 0.0], 1),
    (10, [INF, 0.0, 0.0], 1), (11, [], 1), (12, [1.0, 0.0], 1), (13, [3.0, 0.0], 1), (14, [-1.0, 0.0, 0.0], 1), (15, [0.98, 0.199, 0.0], 1),
    (16, [1e-30, 0.0, 0.0], 1), (17, [0.0, 0.0, 5.0], 1), (None, None, None), (18, [-0.0, 0.0, 7.0], 1),
]


def all_pairs(rows, limit=0.98):
    """(vec_id, n_links, component_id, kept) of every row, by every pair."""
    good = []
    for vec_id, vector, label in rows:
        ok = label is not None and vector and all(v is not None and np.isfinite(v) for v in vector) and any(vector)
        good.append(np.array(vector, float) / np.linalg.norm(np.array(vector, float) * 1e10) * 1e10 if ok else None)
    near = [set() for _ in rows]
    for label, width in {(r[2], len(g)) for r, g in zip(rows, good) if g is not None}:
        of = [k for k, r in enumerate(rows) if good[k] is not None and r[2] == label and len(good[k]) == width]
        points = np.stack([good[k] for k in of])
        for a, b in zip(*np.nonzero(points @ points.T >= limit)):
            if a != b:
                near[of[a]].add(of[b])
    out, seen = [None] * len(rows), set()
    for k in range(len(rows)):
        if k in seen:
            continue
        group, todo = {k}, [k]
        while todo:
            for j in near[todo.pop()] - group:
                group.add(j)
                todo.append(j)
        seen |= group
        least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        for j in group:
            out[j] = (rows[j][0], len(near[j]), least, rows[j][0] is not None and rows[j][0] == least)
    return sorted(out, key=str)


def clustered(n, dims, groups, noise, seed=1):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(groups, dims))
    which = r.integers(0, groups, n)
    points = centre[which] + noise * r.normal(size=(n, dims)) / dims**0.5 * np.linalg.norm(centre[which], axis=1)[:, None]
    return [(i, list(map(float, p)), int(w % 3)) for i, (p, w) in enumerate(zip(points.astype(np.float32), which))]


def got(frame):
    return sorted([tuple(x) for x in frame.collect()], key=str)


@pytest.mark.parametrize("block", [2, 1024])
def test_links_of_odd_rows(spark, block):
    table = spark.createDataFrame(ODD, SCHEMA).withColumn("key", F.lit("clash")).withColumn("n", F.lit(1))
    assert got(multiindex.linked(table, block=block)) == all_pairs(ODD)
    empty = spark.createDataFrame([], SCHEMA)
    assert multiindex.linked(empty).count() == 0 and multiindex.linked(empty).columns == ["vec_id", "n_links", "component_id", "kept"]


@pytest.mark.parametrize(("target", "block", "size"), [(1.0, 16, 6), (1.0, 1024, 12), (1.0, 5, 2)])
def test_full_reach_finds_all_pairs(spark, target, block, size):
    rows = clustered(600, 24, 60, 0.13)
    want = all_pairs(rows)
    assert sum(x[1] for x in want) > 500
    assert got(multiindex.linked(spark.createDataFrame(rows, SCHEMA), target=target, block=block, size=size)) == want


def test_recall_of_the_target(spark):
    rows = clustered(3000, 64, 400, 0.138)
    want, found = all_pairs(rows), got(multiindex.linked(spark.createDataFrame(rows, SCHEMA), size=16))
    links, have = sum(x[1] for x in want), sum(x[1] for x in found)
    assert links > 3000 and links * 0.99 <= have <= links
    assert all(x[1] <= y[1] for x, y in zip(sorted(found), sorted(want)))


def test_hot_group_is_split(spark):
    """Half of all rows are edited copies of one vector: blocks share the work, and every link counts."""
    rows = clustered(800, 16, 400, 0.0)
    base, r = np.array(rows[0][1]), np.random.default_rng(2)
    rows += [(1000 + k, list(map(float, base + 0.02 * np.linalg.norm(base) * r.normal(size=16) / 4)), rows[0][2]) for k in range(800)]
    table = spark.createDataFrame(rows, SCHEMA)
    assert got(multiindex.linked(table, block=100)) == all_pairs([(i, list(map(float, np.float32(v))), lab) for i, v, lab in rows])


def test_multi_sequence_order():
    r = np.random.default_rng(4)
    one, two = np.sort(r.random(9)), np.sort(r.random(7))
    places = list(multi_sequence := multiindex.multi_sequence(one, two, 0.9))
    sums = [one[i] + two[j] for i, j in places]
    assert sums == sorted(sums) and set(places) == {(i, j) for i in range(9) for j in range(7) if one[i] + two[j] <= 0.9} and multi_sequence


def test_bounds_hold():
    r = np.random.default_rng(5)
    points, book = r.normal(size=(300, 6)), r.normal(size=(10, 6))
    near, least = multiindex.nearest(points, book), multiindex.bounds(points, book)
    apart = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    assert all(least[i, near[j]] <= apart[i, j] + 1e-9 for i in range(300) for j in range(300))


def test_links_query_against_all_pairs(spark):
    path = "/root/testdata/sf0.01"
    rows = [(x.vec_id, x.embedding, x.label) for x in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    assert got(queries()["op12_embedding_links"](spark, path)) == all_pairs(rows)


# ---- whitening

def dense(rows):
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    whole = n * x - sums
    centred = whole.astype(float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return n, (whole**2).sum(axis=1), centred, values[::-1], axes[:, ::-1]


def check(frame, rows, components=8):
    n, far, centred, values, axes = dense(rows)
    found = frame.collect()
    count = min(components, int((values > 1e-12 * values[0]).sum()))
    assert len(found) == n * count
    of = {}
    for x in found:
        of.setdefault(x.vec_id, {})[x.component] = x
    z = np.array([[of[v][k + 1].whitened for k in range(count)] for v, _ in rows])
    want = centred @ axes[:, :count] / np.sqrt(values[:count])
    signs = np.sign((z * want).sum(axis=0))
    assert np.abs(z - want * signs).max() < 1e-7
    for (v, _), d in zip(rows, far):
        assert all(of[v][k + 1].deviation == d and of[v][k + 1].n == n for k in range(count))
    for k in range(count):
        assert abs(of[rows[0][0]][k + 1].explained * values.sum() / values[k] - 1) < 1e-9
    assert {x.identity_error for x in found}.pop() < 1e-9


@pytest.mark.parametrize(("n", "dims"), [(400, 64), (50, 8), (30, 40), (9, 3)])
def test_whitening_equals_dense_solver(spark, n, dims):
    r = np.random.default_rng(n)
    points = (r.normal(size=(n, dims)) * np.linspace(2, 1, dims)).astype(np.float32)
    rows = [(i, list(map(float, p))) for i, p in enumerate(points)]
    table = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, n string").repartition(3)
    check(whitening.whitened(table), rows)


def test_whitening_of_odd_rows(spark):
    good = [(i, [float((i * k * 7) % 11), float(i % 3), float(k == 2)]) for i in range(1, 6) for k in (1, 2)]
    good = [(10 * i + k, v) for k, (i, v) in enumerate(good)]
    bad = [(90, None), (91, [1.0, None, 2.0]), (92, [NAN, 1.0, 2.0]), (93, [1.0, INF, 2.0]), (94, [1.0, 2.0]), (95, [])]
    check(whitening.whitened(spark.createDataFrame(good + bad, "vec_id long, embedding array<double>")), good)
    for rows in ([], bad[:4], bad[:1] + [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]):
        none = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        assert none.count() == 0 and none.columns[:3] == ["vec_id", "component", "n"]


def test_whitening_of_large_entries(spark):
    """Exact whole numbers beyond what n times them leaves in a long; their deviation has no long."""
    rows = [(i, [float(10**15 * (i - 2)), float(i * i)]) for i in range(6)]
    found = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {x.deviation for x in found} == {None} and {x.component for x in found} >= {1}
    assert np.allclose(sorted({abs(x.whitened) for x in found if x.component == 1}), sorted({abs(i - 2.5) / (35 / 12) ** 0.5 for i in range(6)}))


def test_filter_damps_the_unwanted():
    values = np.array([10.0, 9, 5, 3, 2, 1.5, 1])
    times = lambda q: values[:, None] * q
    q = np.eye(7)
    out = np.abs(whitening.filtered(times, q, times(q), 1.0, 5.0, 10.0, 8)).diagonal()
    assert out[0] == pytest.approx(1) and out[1] > 0.2 and out[2:].max() < 2e-3


def test_close_eigenvalues_are_certified():
    r = np.random.default_rng(1)
    axes = np.linalg.qr(r.normal(size=(120, 120)))[0]
    values = np.concatenate([[2.0, 2.0], np.linspace(1.2, 1.0, 118)])
    v = axes * values @ axes.T
    passes = []
    found, vectors, residuals = whitening.leading(lambda q: passes.append(1) or v @ q, 120)
    assert np.allclose(found, values[:8], atol=1e-12) and max(residuals) <= 1e-9 and len(passes) < 200
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-12


def test_whitening_query(spark):
    path = "/root/testdata/sf0.001"
    rows = [(x.vec_id, x.embedding) for x in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    check(queries()["op13_embedding_whitening"](spark, path), rows)
