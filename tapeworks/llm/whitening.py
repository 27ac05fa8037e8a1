"""Embedding whitening: leading components by Chebyshev-filtered subspace iteration.

1. Entries become whole numbers x = floor(256 c). The fit list holds each distinct x once; it is
   written as blocks of vectors, and its size and sums per dimension are exact.
2. A block Q of a few more vectors than components meets the covariance only in passes over the fit
   list: a task adds Z'(ZQ) of its centred rows Z, and other tasks add those matrices. No
   covariance matrix is built; what leaves a pass is one matrix of Q's shape.
3. Two passes on a random block bound the spectrum. Then, in turns, a Chebyshev recurrence of such
   passes damps everything below the block's least Ritz value, QR makes the block orthonormal and
   Rayleigh-Ritz turns it, until the residuals of the wanted components certify them.
4. The components are applied to every remaining row, copies included.

Cases: rows whose vector is null, or has null or non-finite entries or such that 256 c is beyond
2**53, are dropped, as are those whose length isn't the most frequent one (the longer of two). Empty
vectors have no components and give no rows, nor does an empty table. Components without variance
(fewer distinct vectors than components, constant dimensions) are left out. Repeated rows and null
vec_ids stay rows of their own. A deviation beyond 64 bits raises an error. Other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import parts, written

COMPONENTS, EXTRA, SCALE = 4, 12, 256
#: Residual, as a share of the largest eigenvalue, that certifies a component; what rounding may leave at most; degrees of a filter; rounds.
EXACT, ROUNDING, DEGREES, ROUNDS = 1e-14, 1e-12, (4, 24), 60
#: Vectors of a block, bytes of a part of the fit list, and parts whose matrices go to the driver as they are.
BLOCK_ROWS, PART_BYTES, FEW = 4096, 64 << 20, 64
RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Centre:
    """Exact mean of the fit list: its size, and per dimension the mean's floor and the rest in n-ths."""

    n: int
    floor: np.ndarray
    rest: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.floor).astype(np.float64) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums over the dimensions of (n x - S) squared, exact."""
        u = x - self.floor
        reach = self.n * (int(np.abs(u).max(initial=0)) + 1)
        if len(self.floor) * reach * reach < 1 << 63:
            return ((self.n * u - self.rest) ** 2).sum(1).tolist()
        return ((self.n * u.astype(object) - self.rest.astype(object)) ** 2).sum(1).tolist()


@dataclass
class Fit:
    """The written fit list, its centre and the trace of its covariance."""

    blocks: DataFrame
    centre: Centre
    trace: float


def whole_numbers(embeddings: DataFrame, scale: int = SCALE) -> tuple[DataFrame, int]:
    """vec_id and x of the rows that remain, and the bytes of all x."""
    big = float(1 << 53)
    sound = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double") * scale) < big))  # false for infinities and NaN, which is above all
    rows = embeddings.select("vec_id", "embedding").where(F.col("embedding").isNotNull() & sound)
    usual = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("embedding") == (usual["d"] if usual else 0))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale))
    return rows.select("vec_id", x.alias("x")), 8 * usual["d"] * usual["count"] if usual else 0


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, BLOCK_ROWS):
            x = _matrix(b["x"].slice(lo, BLOCK_ROWS))
            yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int32()), pa.array([x.astype("<i8").tobytes()], pa.binary())], ["rows", "x"])


def _sums(blocks: DataFrame, per_block: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int], whole: bool = False) -> np.ndarray:
    """The sum of `per_block` over all blocks of the fit list, a matrix of this shape. Tasks add their own
    blocks; of many tasks, as many others as their root add those; the driver adds the last few."""
    kind = "<i8" if whole else "<f8"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for b in batches:
            for rows, raw in zip(b["rows"].to_pylist(), b["x"], strict=True):
                total += per_block(np.frombuffer(raw.as_buffer(), "<i8").reshape(rows, -1))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for b in batches:
            for raw in b["m"]:
                total += np.frombuffer(raw.as_buffer(), kind).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    made, tasks = blocks.mapInArrow(partial, "m binary"), blocks.rdd.getNumPartitions()
    if tasks > FEW:
        made = made.repartition(math.isqrt(tasks)).mapInArrow(add, "m binary")
    out = np.zeros(shape, kind)
    for r in made.toLocalIterator(prefetchPartitions=True) if tasks > FEW else made.collect():
        out += np.frombuffer(r["m"], kind).reshape(shape)
    return out


def fit_list(rows: DataFrame, size: int) -> Fit | None:
    """Distinct vectors with their exact sums; None without an entry."""
    blocks = written(rows.select("x").distinct().coalesce(parts(size, PART_BYTES, 8)).mapInArrow(_pack, "rows int, x binary"), "fit-list")
    first = blocks.select(F.octet_length("x").alias("b"), "rows").first()
    d = first["b"] // 8 // first["rows"] if first else 0
    if not d:
        return None

    def halves(x: np.ndarray) -> np.ndarray:  # two sums of 32 bits each, so that they are exact for 2**31 rows
        return np.stack((np.append((x >> 32).sum(0), len(x)), np.append((x & 0xFFFFFFFF).sum(0), 0)), 1)

    high, low = _sums(blocks, halves, (d + 1, 2), whole=True).T
    n = int(high[-1])
    total = [(int(h) << 32) + int(lo) for h, lo in zip(high[:-1], low[:-1], strict=True)]
    floor, rest = zip(*(divmod(s, n) for s in total), strict=True)
    centre = Centre(n, np.array(floor, np.int64), np.array(rest, np.int64))
    squares = _sums(blocks, lambda x: (centre.centred(x) ** 2).sum(0)[:, None], (d, 1))
    return Fit(blocks, centre, float(squares.sum() / n))


def top_components(fit: Fit, k: int = COMPONENTS, extra: int = EXTRA, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of the fit list's covariance and their unit eigenvectors (columns), certified by their residuals."""
    centre = fit.centre
    d = len(centre.floor)
    k = min(k, d)
    width = min(d, k + extra)

    def apply(q: np.ndarray) -> np.ndarray:
        def block(x: np.ndarray) -> np.ndarray:
            z = centre.centred(x)
            return z.T @ (z @ q)

        return _sums(fit.blocks, block, q.shape) / centre.n

    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    vq = apply(q)
    both = np.linalg.qr(np.hstack((q, vq)))[0][:, : min(d, 2 * width)]
    v_both = apply(both)
    theta, turn = np.linalg.eigh((both.T @ v_both + v_both.T @ both) / 2)
    outer = np.linalg.norm(v_both @ turn[:, 0] - theta[0] * (both @ turn[:, 0]))
    lowest = max(0.0, theta[0] - outer)
    q, vq, theta = both @ turn[:, ::-1][:, :width], v_both @ turn[:, ::-1][:, :width], theta[::-1][:width]
    before = math.inf
    for _ in range(ROUNDS):
        worst = np.linalg.norm(vq[:, :k] - q[:, :k] * theta[:k], axis=0).max()
        if worst <= EXACT * theta[0] or worst <= ROUNDING * theta[0] and worst > before / 2 or theta[0] <= 0:
            return theta[:k], q[:, :k]
        before = worst
        # damp [lowest, theta[-1]]; the wanted values lie outside and grow by a factor of about exp(acosh(.)) a degree
        half, mid = max((theta[-1] - lowest) / 2, 1e-9 * theta[0]), (theta[-1] + lowest) / 2
        speed, fastest = (math.acosh(max(1 + 1e-6, (theta[i] - mid) / half)) for i in (k - 1, 0))
        degree = min(max(DEGREES[0], math.ceil(math.log(worst / (EXACT * theta[0])) / speed) + 1), DEGREES[1], max(2, int(23 / fastest)))
        scale = half / (theta[0] - mid)
        sigma, x, y = scale, q, (vq - mid * q) * scale / half
        for _ in range(degree - 1):
            ahead = 1 / (2 / scale - sigma)
            x, y, sigma = y, (apply(y) - mid * y) * (2 * ahead / half) - sigma * ahead * x, ahead
        q = np.linalg.qr(y)[0]
        vq = apply(q)
        theta, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        q, vq, theta = q @ turn[:, ::-1], vq @ turn[:, ::-1], theta[::-1]
    raise RuntimeError(f"components not certified in {ROUNDS} rounds: residual {worst:.3g} of {theta[0]:.3g}")


def whiten(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each remaining row and component."""
    rows, size = whole_numbers(embeddings, scale)
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, {RESULT}"
    fit = fit_list(rows, size)
    values, vectors = top_components(fit, components) if fit and fit.trace > 0 else (np.zeros(0), np.zeros((0, 0)))
    live = int((values > 1e-12 * max(values, default=0)).sum())
    if not live:
        return embeddings.sparkSession.createDataFrame([], schema)
    values, vectors = values[:live], vectors[:, :live]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(live)])  # the largest entry is positive
    project, centre, n = vectors / np.sqrt(values), fit.centre, fit.centre.n

    def moments(x: np.ndarray) -> np.ndarray:
        w = centre.centred(x) @ project
        return np.hstack((w.T @ w, w.sum(0)[:, None]))

    found = _sums(fit.blocks, moments, (live, live + 1)) / n
    error = float(np.abs(found[:, :-1] - np.outer(found[:, -1], found[:, -1]) - np.eye(live)).max())
    explained = values / fit.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b["x"])
            k = len(x)
            if k:
                w = centre.centred(x) @ project
                rows_of = pa.array(np.repeat(np.arange(k), live))
                yield pa.RecordBatch.from_arrays([
                    b["vec_id"].take(rows_of), pa.array(np.tile(np.arange(1, live + 1), k), pa.int32()), pa.array(np.full(k * live, n), pa.int64()), pa.array(centre.deviations(x), pa.int64()).take(rows_of),
                    pa.array(w.ravel()), pa.array(np.tile(explained, k)), pa.array(np.full(k * live, error)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
