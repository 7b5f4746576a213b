"""Whitening of vectors: spectra grown by rank-one updates, combined over tasks, refined by one distributed Rayleigh-Ritz step."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.llm.common import ready, stored

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
# States that one task combines; a round divides their number by it.
FAN = 16
# Larger entries count as non-finite: their integers would not be exact in a double.
LARGEST = float(2**40)
EPS = np.finfo(np.float64).eps


# One update -----------------------------------------------------------------------------------------------------------

def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z2 / (d - x), one right of every pole, as the index of the nearer pole and the distance from it.

    ``d`` ascends strictly and ``z2`` is positive. All roots are sought at once: the sums over the poles left and right of a
    root are each replaced by one pole of the same value and slope, whose equation is quadratic; a step that leaves the
    bracket is replaced by halving it.
    """
    m = len(d)
    right = np.append(d[1:], d[-1] + z2.sum())
    place = np.arange(m)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        middle = (right - d) / 2
        f = 1 + (z2 / ((d[None, :] - d[:, None]) - middle[:, None])).sum(axis=1)
        near = np.where((f > 0) | (place == m - 1), place, place + 1)
        gaps = d[None, :] - d[near][:, None]
        low = np.where(near == place, 0.0, -middle)
        high = np.where(near == place, np.where(place == m - 1, right - d, middle), 0.0)
        x = np.where(place == m - 1, np.where(f > 0, middle / 2, (middle + right - d) / 2), (low + high) / 2)
        before = np.tri(m)
        left_gap = gaps[place, place]
        right_gap = np.where(place < m - 1, gaps[place, np.minimum(place + 1, m - 1)], np.inf)
        open_ = np.ones(m, bool)
        for _ in range(80):
            inverse = 1 / (gaps - x[:, None])
            lower = inverse * before
            beyond, behind = inverse @ z2, lower @ z2
            f = 1 + beyond
            left, total = (lower * inverse) @ z2, (inverse * inverse) @ z2
            low, high = np.where(open_ & (f < 0), x, low), np.where(open_ & (f >= 0), x, high)
            open_ &= (np.abs(f) > 8 * EPS * (1 + beyond - 2 * behind)) & (high - low > 2 * EPS * np.maximum(np.abs(low), np.abs(high)))
            if not open_.any():
                break
            a, b = left_gap - x, right_gap - x
            inner = place < m - 1
            s = np.where(inner, (a + b) * f - a * b * total, f + 0.0)
            t = np.where(inner, a * b * f, 0.0)
            c = f - a * left - np.where(inner, b * (total - left), 0.0)
            root = np.sqrt(np.maximum(s * s - 4 * t * c, 0))
            step = np.where(s <= 0, (s - root) / (2 * c), 2 * t / (s + root))
            # The last root has poles on one side only: the value of that pole gives the step.
            step = np.where(inner, step, a * f / c)
            new = x + step
            new = np.where(np.isfinite(new) & (new > low) & (new < high), new, (low + high) / 2)
            x = np.where(open_, new, x)
    return near, x


def rank_one(d: np.ndarray, q: np.ndarray, v: np.ndarray, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, ascending, and eigenvectors of ``q diag(d) q' + weight * v v'``, with ``weight`` >= 0.

    Deflation: directions that v does not touch keep their pair; of eigenvalues that are equal, a reflection leaves one
    direction touched. The rest solve the secular equation. Their vectors come from the vector z for which the roots
    found are exact, so they are orthogonal however close the roots are.
    """
    z = q.T @ v * np.sqrt(weight)
    size = max(float(np.abs(d).max()), float(z @ z))
    if size == 0:
        return d, q
    small = 8 * EPS * size
    q = q.copy()
    close = np.flatnonzero(np.diff(d) <= small)
    if len(close):
        for run in np.split(close, np.flatnonzero(np.diff(close) > 1) + 1):
            at = slice(run[0], run[-1] + 2)
            u = z[at].copy()
            length = np.sqrt(u @ u)
            if length > 0:
                u[-1] += np.copysign(length, u[-1])
                u /= np.sqrt(u @ u)
                q[:, at] -= 2 * np.outer(q[:, at] @ u, u)
                z[at] = 0
                z[run[-1] + 1] = -np.copysign(length, u[-1])
    live = np.flatnonzero(np.abs(z) * np.sqrt(size) > small)
    if not len(live):
        return d, q
    poles, w = d[live], z[live]
    near, x = secular_roots(poles, w * w)
    # Differences of pole and root, without cancellation.
    apart = (poles[None, :] - poles[near][:, None]) - x[:, None]
    between = poles[None, :] - poles[:, None]
    np.fill_diagonal(between, 1.0)
    ratio = apart / between.T * -1.0
    ratio[np.diag_indices(len(live))] = -np.diag(apart)
    w = np.copysign(np.sqrt(np.abs(np.prod(ratio, axis=0))), w)
    vectors = w / apart
    vectors /= np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    d = d.copy()
    d[live] = poles[near] + x
    q[:, live] = q[:, live] @ vectors.T
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


@dataclass
class Spectrum:
    """Number, exact sums, mean and the spectrum of the scatter matrix of the vectors met so far."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    d: np.ndarray
    q: np.ndarray

    @staticmethod
    def none(width: int) -> Spectrum:
        return Spectrum(0, np.zeros(width, np.int64), np.zeros(width), np.zeros(width), np.eye(width))

    def add(self, x: np.ndarray) -> None:
        """One vector: the centred difference changes the scatter matrix by n / (n + 1) of its square."""
        off = x - self.mean
        self.d, self.q = rank_one(self.d, self.q, off, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + off / self.n

    def join(self, other: Spectrum) -> None:
        """Another spectrum: one update per direction of it and one for the distance of the means."""
        n = self.n + other.n
        for value, vector in zip(other.d, other.q.T, strict=True):
            if value > 0:
                self.d, self.q = rank_one(self.d, self.q, vector, value)
        off = other.mean - self.mean
        self.d, self.q = rank_one(self.d, self.q, off, self.n * other.n / n)
        self.mean = self.mean + off * (other.n / n)
        self.n, self.sums = n, self.sums + other.sums

    def write(self) -> bytes:
        return np.int64(self.n).tobytes() + self.sums.tobytes() + np.concatenate([self.mean, self.d, self.q.ravel()]).tobytes()

    @staticmethod
    def read(raw: bytes, width: int) -> Spectrum:
        rest = np.frombuffer(raw, np.float64, offset=8 + 8 * width)
        return Spectrum(int(np.frombuffer(raw, np.int64, 1)[0]), np.frombuffer(raw, np.int64, width, 8).copy(),
                        rest[:width].copy(), rest[width: 2 * width].copy(), rest[2 * width:].reshape(width, width).copy())


# Passes ---------------------------------------------------------------------------------------------------------------

def integers(batch: pa.RecordBatch, width: int) -> tuple[pa.Array, np.ndarray]:
    """vec_id and the integers (one row each) of the vectors that take part."""
    lists = batch.column("embedding")
    full = np.asarray(lists.value_lengths().fill_null(-1)) == width
    kept = batch.filter(pa.array(full))
    values = kept.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    with np.errstate(invalid="ignore"):
        good = (np.abs(values) <= LARGEST).all(axis=1)
    return kept.column("vec_id").filter(pa.array(good)), np.floor(SCALE * values[good]).astype(np.int64) + SHIFT


def _per_task(rows: DataFrame, width: int, work: Callable[[Iterator[np.ndarray]], bytes]) -> DataFrame:
    """(part, state): what the function makes of the vectors of each task."""
    def run(batches):
        state = work(x for batch in batches for _, x in [integers(batch, width)] if len(x))
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([state], pa.binary())], names=["part", "state"])
    return rows.mapInArrow(run, "part bigint, state binary")


def _combined(parts: DataFrame, join: Callable[[list[bytes]], bytes], name: str) -> bytes:
    """One state of all: rounds in which a task joins FAN of them at most; only the last one reaches the driver."""
    def run(table: pa.Table) -> pa.Table:
        states = table.sort_by("part").column("state").to_pylist()
        return pa.table({"part": pa.array([table.column("above")[0].as_py()], pa.int64()), "state": pa.array([join(states)], pa.binary())})
    parts = stored(parts, name)
    while parts.count() > 1:
        parts = stored(parts.withColumn("above", F.floor(F.col("part") / FAN)).groupBy("above").applyInArrow(run, "part bigint, state binary"), name)
    return bytes(parts.first()["state"])


def _added(states: list[bytes]) -> bytes:
    return np.sum([np.frombuffer(s, np.float64) for s in states], axis=0).tobytes()


@dataclass(frozen=True)
class Whitening:
    """n vectors with sums per dimension; eigenvalues of their covariance, falling, unit eigenvectors as columns, and the trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Centred vectors on the components, over the root of the eigenvalue; a component without variance has NaN."""
        centred = x - self.sums / self.n
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, centred @ self.vectors / np.sqrt(self.values), np.nan)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2, exact; None if a sum does not fit 64 bits."""
        far = int(self.n) * max(int(np.abs(x).max()), 1) + int(np.abs(self.sums).max())
        if far < 2**62:
            off = self.n * x - self.sums
            if len(self.sums) * int(np.abs(off).max()) ** 2 < 2**63:
                return (off * off).sum(axis=1).tolist()
        off = [[self.n * a - b for a, b in zip(row, self.sums.tolist(), strict=True)] for row in x.tolist()]
        return [s if s < 2**63 else None for s in (sum(o * o for o in row) for row in off)]


def _usable(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def learn(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all vectors without NULL or non-finite entries; None if there are none.

    Vectors of another length than the most frequent one (of equally frequent ones the longest) take no part.

    Every task grows a spectrum by one rank-one update per vector; the spectra are combined in rounds, FAN to a task, by
    rank-one updates too. In the basis found, a second pass sums the centred products of all vectors; the small matrix, diagonal
    but for rounding, is diagonalised here: the Rayleigh-Ritz step that makes the pairs exact to double precision.
    What travels is a matrix of the vectors' length squared, whatever the number of rows.
    """
    ready(vectors.sparkSession)
    rows = _usable(vectors)
    whole = F.forall("embedding", lambda c: F.coalesce(F.abs(c) <= LARGEST, F.lit(False)))
    widths = rows.filter(whole).groupBy(F.size("embedding").alias("width")).count().filter("width > 0")
    most = widths.orderBy(F.desc("count"), F.desc("width")).first()
    if most is None:
        return None
    width = most["width"]

    def grow(blocks):
        own = Spectrum.none(width)
        for block in blocks:
            own.sums += block.sum(axis=0)
            for x in block.astype(np.float64) - SHIFT:
                own.add(x)
        return own.write() if own.n else None

    def join(states):
        own = Spectrum.read(states[0], width)
        for s in states[1:]:
            own.join(Spectrum.read(s, width))
        return own.write()
    found = Spectrum.read(_combined(_per_task(rows, width, grow), join, "spectra"), width)
    n, sums = found.n, found.sums
    basis, _ = np.linalg.qr(found.q)
    mean = sums / n

    def project(blocks):
        total = None
        for block in blocks:
            y = (block - mean) @ basis
            total = y.T @ y + (0 if total is None else total)
        return None if total is None else total.tobytes()
    ritz = np.frombuffer(_combined(_per_task(rows, width, project), _added, "ritz")).reshape(width, width) / n
    values, inner = np.linalg.eigh((ritz + ritz.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    values = values[order]
    values = np.where(values > width * EPS * max(float(values[0]), 0.0), values, 0.0)
    return Whitening(n, sums, values, basis @ inner[:, order], float(np.trace(ritz)))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest entry of the covariance of all whitened vectors minus the identity, over the components with variance."""
    width, live = len(model.sums), model.values > 0
    if not live.any():
        return 0.0

    def run(blocks):
        total = None
        for block in blocks:
            w = model.whitened(block)[:, live]
            now = np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
            total = now if total is None else total + now
        return None if total is None else total.tobytes()
    sums = np.frombuffer(_combined(_per_task(_usable(vectors), width, run), _added, "identity")) / model.n
    k = int(live.sum())
    mean, square = sums[:k], sums[k:].reshape(k, k)
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every vector that takes part, by component.

    Repeated and NULL ids are rows like any other; other columns are not read. Without such vectors there are no rows. Vectors
    that are all equal, or span fewer dimensions than components, have NULL for ``whitened`` on components without variance,
    and explained is 0 there, or NULL if nothing varies. A deviation beyond 64 bits is NULL.
    """
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    model = learn(vectors, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error, width, k = identity_error(vectors, model), len(model.sums), len(model.values)
    explained = [float(v) / model.trace if model.trace > 0 else None for v in model.values]

    def run(batches):
        for batch in batches:
            ids, x = integers(batch, width)
            m = len(x)
            if m:
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                    pa.array([v for v in model.deviations(x) for _ in range(k)], pa.int64()), pa.array(model.whitened(x).ravel(), from_pandas=True),
                    pa.array(explained * m, pa.float64()), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return _usable(vectors).mapInArrow(run, schema)
