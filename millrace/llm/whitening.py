"""Whitening of embeddings: leading components of the covariance by Chebyshev-filtered subspace iteration, then a projection.

Entries c become whole numbers x = floor(1024 c) + 100000. The covariance V of the x (divisor n) is never formed: every step is a pass
over the stored blocks that gives V Q for a few columns Q, centred before multiplying, with partial sums in the tasks. A short
Lanczos run (its Ritz values, less its residual) finds where the spectrum begins; then each round

1. applies a Chebyshev polynomial of V by its three-term recurrence, which stays small over the unwanted part of the
   spectrum and grows fast above it,
2. makes the block orthonormal (QR) and
3. solves the small problem in it (Rayleigh-Ritz), whose pass also gives the residuals.

It ends when the residuals of the wanted pairs certify them to double precision (or have stopped to fall near it).
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, prepare

SCALE, SHIFT = 1024, 100_000
#: Components wanted, and columns of the block they are found in.
COMPONENTS = 8
COLUMNS = 24
#: Steps of the Lanczos run, degree of the filter, and rounds at most.
STEPS = 10
DEGREE = 7
ROUNDS = 60
#: Residuals that certify a pair, as a part of the largest eigenvalue; those that do at the least if they fall no more.
RESIDUAL, ENOUGH = 1e-14, 1e-9
#: Eigenvalues below this part of the largest are zero: whole numbers in double precision tell no more.
NOTHING = 1e-12
#: Vectors of a block.
BLOCK = 4096
LONGEST = (1 << 63) - 1
WHITE = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_BLOCKS = "width int, n long, ids array<bigint>, x binary"


def blocks(vectors: DataFrame, size: int = BLOCK) -> DataFrame:
    """_BLOCKS of the vectors that are not null and have no null or non-finite entry: their ids and whole numbers (long), for each length of
    vectors. Entries whose whole number is beyond a long take its limit."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            column = batch.column("embedding")
            widths = pc.list_value_length(column).to_pylist()
            values = np.ascontiguousarray(pc.fill_null(column.flatten(), float("nan")).to_numpy(zero_copy_only=False))
            at = 0
            for vec_id, width in zip(batch.column("vec_id").to_pylist(), widths):
                if width is None:
                    continue
                part = values[at : at + width]
                at += width
                if np.isfinite(part).all():
                    ids, parts = held.setdefault(width, [[], []])
                    ids.append(vec_id)
                    parts.append(part)
                    if len(ids) == size:
                        yield _block(width, *held.pop(width))
        for width, (ids, parts) in held.items():
            yield _block(width, ids, parts)

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, _BLOCKS)


def _block(width: int, ids: list, parts: list) -> pa.RecordBatch:
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * np.stack(parts))
    x = np.clip(scaled, -(2.0**63), np.nextafter(2.0**63, 0)).astype(np.int64)
    x = np.where(x > LONGEST - SHIFT, LONGEST, x + SHIFT)
    columns = [[width], [len(ids)], [ids], [x.astype("<i8").tobytes()]]
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["width", "n", "ids", "x"])


def _each(batches):
    for batch in batches:
        for width, ids, data in zip(*(batch.column(c).to_pylist() for c in ("width", "ids", "x"))):
            yield ids, np.frombuffer(data, "<i8").reshape(len(ids), width)


class FitList:
    """The stored vectors of one length with their number and sums, and the passes over them."""

    def __init__(self, stored: DataFrame, width: int):
        self.rows, self.width = stored.where(F.col("width") == width), width
        self.n = self.rows.agg(F.sum("n")).first()[0]
        self.sums = self.added(self._column_sums(), "decimal(38,0)")
        self.mean = np.array([float(Fraction(int(s), self.n)) for s in self.sums])

    def _column_sums(self):
        def run(batches):
            total = None
            for _, x in _each(batches):
                part = x.sum(axis=0) if np.abs(x.astype(float)).max() < 2.0**48 else x.astype(object).sum(axis=0)
                total = part.astype(object) if total is None else total + part
            if total is not None:
                yield _numbered([str(v) for v in total], pa.string())

        return run, "string"

    def added(self, work, kind: str = "double") -> list:
        """Sums over all tasks of numbered values: as many rows reach the driver as there are numbers."""
        run, given = work
        parts = self.rows.select("width", "ids", "x").mapInArrow(run, f"k int, v {given}")
        found = dict(parts.groupBy("k").agg(F.sum(F.col("v").cast(kind))).collect())
        return [found[k] for k in range(len(found))]

    def times(self, q: np.ndarray) -> np.ndarray:
        """V Q: one pass, centred before multiplying."""
        centred = self.centring()

        def run(batches):
            total = np.zeros(q.shape)
            for _, x in _each(batches):
                rows = centred(x)
                total += rows.T @ (rows @ q)
            yield _numbered(total.ravel(), pa.float64())

        return np.array(self.added((run, "double"))).reshape(q.shape) / self.n

    def whole(self):
        """n x - S, exactly: long where it fits, else Python's integers."""
        n, sums = self.n, [int(s) for s in self.sums]
        most = max(map(abs, sums))

        def of(x: np.ndarray) -> np.ndarray:
            if n * int(np.abs(x.astype(float)).max() + 1) + most < 1 << 62:
                return n * x - np.array(sums, np.int64)
            return n * x.astype(object) - np.array(sums, object)

        return of

    def centring(self):
        whole, n = self.whole(), self.n
        return lambda x: whole(x).astype(float) / n

    def spread(self) -> float:
        """Trace of V."""
        centred = self.centring()

        def run(batches):
            yield _numbered([sum(float((centred(x) ** 2).sum()) for _, x in _each(batches))], pa.float64())

        return self.added((run, "double"))[0] / self.n

    def identity_error(self, axes: np.ndarray) -> float:
        """Largest entry, in absolute value, of the covariance of the whitened vectors less the identity."""
        m, centred, n = axes.shape[1], self.centring(), self.n

        def means(batches):
            yield _numbered(sum((centred(x) @ axes).sum(axis=0) for _, x in _each(batches)) + np.zeros(m), pa.float64())

        mean = np.array(self.added((means, "double"))) / n

        def products(batches):
            total = np.zeros((m, m))
            for _, x in _each(batches):
                z = centred(x) @ axes - mean
                total += z.T @ z
            yield _numbered(total.ravel(), pa.float64())

        found = np.array(self.added((products, "double"))).reshape(m, m) / n
        return float(np.abs(found - np.eye(m)).max())


def _numbered(values, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values, kind)], names=["k", "v"])


def lower_edge(times, width: int, steps: int = STEPS) -> tuple[float, float]:
    """A bound that no eigenvalue is below, as far as a Lanczos run can tell (never under zero), and its largest Ritz value."""
    q = np.random.default_rng(5).normal(size=width)
    basis, alphas, betas = [q / np.linalg.norm(q)], [], []
    for _ in range(min(steps, width)):
        w = times(basis[-1][:, None])[:, 0]
        alphas.append(float(w @ basis[-1]))
        for _ in range(2):  # orthogonal to all before, twice for rounding
            for b in basis:
                w = w - (w @ b) * b
        betas.append(float(np.linalg.norm(w)))
        if betas[-1] <= 1e-10 * max(map(abs, alphas)):
            break
        basis.append(w / betas[-1])
    k = len(alphas)
    values, turn = np.linalg.eigh(np.diag(alphas) + np.diag(betas[: k - 1], 1) + np.diag(betas[: k - 1], -1))
    return max(0.0, float(values[0] - betas[-1])), float(values[-1])


def filtered(times, q: np.ndarray, vq: np.ndarray, low: float, high: float, top: float, degree: int = DEGREE) -> np.ndarray:
    """The Chebyshev polynomial of V that is small between low and high, scaled to be 1 at top, applied to Q; vq = V Q."""
    half, middle = (high - low) / 2, (high + low) / 2
    first = sigma = half / (top - middle)
    before, now = q, (vq - middle * q) * (sigma / half)
    for _ in range(degree - 1):
        new = 1 / (2 / first - sigma)
        before, now = now, (times(now) - middle * now) * (2 * new / half) - before * (sigma * new)
        sigma = new
    return now


def leading(times, width: int, wanted: int = COMPONENTS, columns: int = COLUMNS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Largest eigenvalues of V (descending), their unit vectors as columns, and the residuals that certify them; times(Q) = V Q."""
    m, wanted = min(width, max(columns, wanted)), min(wanted, width)
    q = np.linalg.qr(np.random.default_rng(3).normal(size=(width, m)))[0]
    low, _ = lower_edge(times, width) if m < width else (0.0, 0.0)
    kept = None
    for _ in range(ROUNDS):
        vq = times(q)
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        residuals = np.linalg.norm(vq - q * values, axis=0)[:wanted]
        worst, top = float(residuals.max(initial=0)), float(values[0])
        if kept is None or worst < kept[0]:
            before, kept = (kept or (np.inf,))[0], (worst, values[:wanted], q[:, :wanted], residuals.tolist())
        if top <= 0 or m == width or worst <= RESIDUAL * top or worst >= before / 2 and kept[0] <= ENOUGH * top:
            break
        high = float(values[-1])
        edge = min(low, high * (1 - 1e-3))
        q = np.linalg.qr(filtered(times, q, vq, edge, high, top) if top > high > edge else vq)[0]
    else:
        raise RuntimeError(f"{ROUNDS} rounds left a residual of {kept[0]:.3g} at an eigenvalue of {kept[1][0]:.6g}.")
    return kept[1], kept[2], kept[3]


def whitened(vectors: DataFrame, components: int = COMPONENTS, columns: int = COLUMNS) -> DataFrame:
    """WHITE: for each vector and component its standardized coordinate, with figures of the fit.

    Left out are vectors that are null or hold null or non-finite entries, and those whose length is not the most frequent one
    (of equally frequent lengths the greater; empty vectors have no components). Repeated rows count and come out again. Components
    whose eigenvalue is zero have no rows, so a single or a repeated vector gives none, nor does an empty table. deviation is null
    where it is beyond a long.
    """
    spark = prepare(vectors.sparkSession)
    stored = Scratch(spark, "whitening").stored(blocks(vectors), "blocks")
    lengths = stored.groupBy("width").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if lengths is None or not lengths.width:
        return spark.createDataFrame([], WHITE)
    fit = FitList(stored, lengths.width)
    values, axes, _ = leading(fit.times, fit.width, components, columns)
    real = values > NOTHING * max(float(values[0]), 0.0)
    values, axes = values[real], axes[:, real]
    if not len(values):
        return spark.createDataFrame([], WHITE)
    scaled = axes / np.sqrt(values)
    explained, error = (values / fit.spread()).tolist(), fit.identity_error(scaled)
    n, m, whole, centred = fit.n, len(values), fit.whole(), fit.centring()

    def run(batches):
        for ids, x in _each(batches):
            rows = whole(x)
            if rows.dtype == object or float(np.abs(rows).max()) ** 2 * rows.shape[1] > 2.0**62:
                far = [v if v <= LONGEST else None for v in (rows.astype(object) ** 2).sum(axis=1).tolist()]
            else:
                far = (rows * rows).sum(axis=1).tolist()
            z = centred(x) @ scaled
            count = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(count), m))), pa.array(np.tile(np.arange(1, m + 1), count), pa.int32()),
                 pa.array(np.full(count * m, n), pa.int64()), pa.array(far, pa.int64()).take(pa.array(np.repeat(np.arange(count), m))),
                 pa.array(z.ravel()), pa.array(explained * count), pa.array(np.full(count * m, error))],
                names=[field.split()[0] for field in WHITE.split(", ")],
            )

    return fit.rows.select("width", "ids", "x").mapInArrow(run, WHITE)


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    """All embeddings, eight components."""
    from millrace.llm.common import table

    return whitened(table(spark, sf_dir, "embeddings"))
