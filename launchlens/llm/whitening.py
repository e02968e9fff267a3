"""Embedding whitening by incremental eigendecomposition.

The covariance is never formed row by row into one matrix. Each partition keeps count, mean and
spectrum of what it has read and applies every row as a centred rank-one update: the
new eigenvalues are the roots of the secular equation, found between the old ones; entries of the
update that vanish, and eigenvalues that coincide, are deflated first. Spectra of
partitions are combined by successive rank-one updates (one for each direction of the
smaller one, one for the distance of the means), sixteen at a time in rounds. The basis
that results is then refined by a distributed Rayleigh-Ritz step: partitions project
their centred rows on it and add up the small matrix, whose eigenvectors turn the basis into
components to double precision. States and sums are dimensions squared in size,
whatever the number of rows.

Vectors are rounded to whole numbers first, so sums and counts are exact. The
fit reads each different vector once; all rows are whitened.

Cases: vectors that are null, or hold null or non-finite entries or entries whose
rounded form is beyond 2^52, are left out, and so are those of another length than most
have (of equally many the longest); repeated rows are whitened each but count once;
an empty table, and vectors of one value only, give no rows; components whose
eigenvalue is no more than 1e-13 of all variance are left out; with ties among
eigenvalues any basis of their space is right; ``deviation`` is null where no long holds it; further columns
are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from launchlens.llm.store import settled

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Spectra or sums that one task combines in a round.
FAN_IN = 16
#: Different vectors that one task reads: a row costs about a millisecond in 64 dimensions.
TASK_ROWS = 4096
#: Eigenvalues below this share of the trace are not told from zero.
LEAST = 1e-13
_EPS = np.finfo(float).eps


# --- eigenvalues of a diagonal matrix plus a rank-one term -------------------------------

def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of ``1 + sum(z2 / (d - x))``, ``d`` ascending and different, ``z2`` positive.

    Returns the roots and the matrix d[i] - root[j], which is exact although a root may be as
    near to its pole as can be: each root is sought as a distance from the nearer pole.
    """
    m = len(d)
    gap = np.append(np.diff(d), z2.sum())
    middle = d + gap / 2
    at_middle = 1 + (z2[:, None] / (d[:, None] - middle[None, :])).sum(0)
    right = at_middle < 0  # the root is beyond the middle
    right[-1] = False
    origin = np.where(right, np.append(d[1:], 0), d)
    low, high = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, gap / 2)
    if at_middle[-1] < 0:
        low[-1], high[-1] = gap[-1] / 2, gap[-1]
    pole = d[:, None] - origin[None, :]
    below = np.tri(m, dtype=bool).T  # poles i up to j
    own, following = np.arange(m), np.minimum(np.arange(m) + 1, m - 1)
    last = own == m - 1
    t = (low + high) / 2
    for _ in range(80):
        away = pole - t
        ratio = z2[:, None] / away
        slope = ratio / away
        f = 1 + ratio.sum(0)
        psi1 = np.where(below, slope, 0).sum(0)
        phi1 = slope.sum(0) - psi1
        low, high = np.where(f < 0, t, low), np.where(f < 0, high, t)
        done = np.abs(f) <= 8 * _EPS * (1 + np.abs(ratio).sum(0))
        if done.all():
            break
        d1, d2 = away[own, own], np.where(last, 1.0, away[following, own])
        s, q = d1 * d1 * psi1, np.where(last, 0.0, d2 * d2 * phi1)
        with np.errstate(all="ignore"):
            c = f - s / d1 - np.where(last, 0.0, q / d2)
            a, b = c * (d1 + d2) + s + q, f * d1 * d2
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step = np.where(last, d1 + s / c, step)
        new = t + step
        good = np.isfinite(new) & (new > low) & (new < high)
        new = np.where(good, new, (low + high) / 2)
        if np.all((new == t) | done):
            break
        t = np.where(done, t, new)
    return origin + t, pole - t


def rank_one(values: np.ndarray, basis: np.ndarray, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of ``basis @ diag(values) @ basis.T + outer(vector, vector)``; values ascending."""
    z = basis.T @ vector
    total = float(z @ z)
    if total == 0:
        return values, basis
    tiny = 8 * _EPS * max(values[-1], total)
    basis = basis.copy()
    # eigenvalues that coincide: one reflection puts their share of the update into one entry
    edges = np.flatnonzero(np.diff(values) > tiny) + 1
    if len(edges) + 1 < len(values):
        for begin, end in zip([0, *edges], [*edges, len(values)], strict=True):
            if end - begin > 1:
                part = z[begin:end].copy()
                norm = np.linalg.norm(part)
                if norm > 0:
                    mirror = part.copy()
                    mirror[-1] += np.copysign(norm, part[-1])
                    mirror /= np.linalg.norm(mirror)
                    basis[:, begin:end] -= 2 * np.outer(basis[:, begin:end] @ mirror, mirror)
                    z[begin:end] = 0
                    z[end - 1] = -np.copysign(norm, part[-1])
    # entries that vanish: their eigenvalue stays
    live = np.flatnonzero(np.abs(z) * np.sqrt(total) > tiny)
    if not len(live):
        return values, basis
    d, zl = values[live], z[live]
    roots, away = secular_roots(d, zl * zl)
    # the update for which these roots are exact, so that its eigenvectors are orthogonal
    m = len(d)
    if m > 1:
        below = np.tri(m, k=-1, dtype=bool)  # j < i
        shifted = d[None, :] - d[:, None]
        other = np.where(below, shifted, np.concatenate([shifted[:, 1:], np.ones((m, 1))], 1))
        zl = np.copysign(np.sqrt(np.abs(np.prod(-away / other, 1))), zl)
    vectors = zl[:, None] / away
    vectors /= np.linalg.norm(vectors, axis=0)
    values = values.copy()
    values[live] = roots
    basis[:, live] = basis[:, live] @ vectors
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


# --- the state of a partition ---------------------------------------------------------------

class Spectrum:
    """Count, exact sums, mean and spectrum of the scatter of some vectors."""

    def __init__(self, width: int) -> None:
        self.n, self.sums = 0, [0] * width
        self.mean, self.values, self.basis = np.zeros(width), np.zeros(width), np.eye(width)

    def add(self, rows: np.ndarray) -> None:
        """Whole-numbered rows, one after another."""
        high, low = rows >> 32, rows & 0xFFFFFFFF  # so that no sum of a block overflows
        self.sums = [s + (a << 32) + b for s, a, b in zip(self.sums, high.sum(0).tolist(), low.sum(0).tolist(), strict=True)]
        for row in (rows - SHIFT).astype(float):
            off = row - self.mean
            if self.n:
                self.values, self.basis = rank_one(self.values, self.basis, off * np.sqrt(self.n / (self.n + 1)))
            self.n += 1
            self.mean = self.mean + off / self.n

    def join(self, other: Spectrum) -> Spectrum:
        big, small = (self, other) if self.n >= other.n else (other, self)
        if not small.n:
            return big
        for value, direction in zip(small.values, small.basis.T, strict=True):
            if value > 0:
                big.values, big.basis = rank_one(big.values, big.basis, np.sqrt(value) * direction)
        n, off = big.n + small.n, small.mean - big.mean
        big.values, big.basis = rank_one(big.values, big.basis, off * np.sqrt(big.n * small.n / n))
        big.mean = big.mean + off * (small.n / n)
        big.sums, big.n = [a + b for a, b in zip(big.sums, small.sums, strict=True)], n
        return big

    def packed(self) -> bytes:
        width = len(self.mean)
        return struct.pack("<qq", width, self.n) + b"".join(v.to_bytes(16, "little", signed=True) for v in self.sums) + b"".join(
            np.ascontiguousarray(a).tobytes() for a in (self.mean, self.values, self.basis))

    @classmethod
    def unpacked(cls, data: bytes) -> Spectrum:
        width, n = struct.unpack_from("<qq", data)
        out, at = cls(0), 16 + 16 * width
        out.n, out.sums = n, [int.from_bytes(data[i:i + 16], "little", signed=True) for i in range(16, at, 16)]
        rest = np.frombuffer(data, np.float64, offset=at).copy()
        out.mean, out.values, out.basis = rest[:width], rest[width:2 * width], rest[2 * width:].reshape(width, width)
        return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, width)


def _combined(states: DataFrame, parts: int, join: Callable[[list[bytes]], bytes]) -> bytes | None:
    """One state out of (part, state) rows, ``FAN_IN`` at a time; a round has a task for each group."""
    def merge(group: pa.Table) -> pa.Table:
        found = sorted(zip(group.column("part").to_pylist(), group.column("state").to_pylist(), strict=True))
        return pa.table({"part": pa.array([found[0][0] // FAN_IN], pa.int64()), "state": pa.array([join([s for _, s in found])], pa.binary())})

    while parts > 1:
        states = states.groupBy(F.floor(F.col("part") / FAN_IN)).applyInArrow(merge, "part long, state binary")
        parts = -(-parts // FAN_IN)
    found = states.collect()
    return found[0]["state"] if found else None


def _over_partitions(fit: DataFrame, state_of: Callable[[Iterator[np.ndarray]], bytes], width: int) -> DataFrame:
    """(part, state) of every partition that has rows."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        blocks = (_matrix(b.column("x"), width) for b in batches if b.num_rows)
        first = next(blocks, None)
        if first is not None:
            def chain() -> Iterator[np.ndarray]:
                yield first
                yield from blocks

            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([state_of(chain())], pa.binary())], ["part", "state"])

    return fit.mapInArrow(work, "part long, state binary")


def _added(states: list[bytes]) -> bytes:
    return sum(np.frombuffer(s) for s in states).tobytes()


# --- the operator ------------------------------------------------------------------------------

def whole_numbers(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """The usable rows with ``x``, the rounded vector as packed 64-bit numbers, and ``width``, its length."""
    value = F.transform(vector, lambda c: F.floor(F.when(F.abs(c.cast("double")) * SCALE < float(1 << 52), c.cast("double") * SCALE)) + SHIFT)
    rounded = df.withColumn("rounded", value).where(F.col(vector).isNotNull() & (F.size("rounded") > 0) & ~F.exists("rounded", lambda c: c.isNull()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("rounded")
            sizes = pc.list_value_length(lists).to_numpy()
            ends = np.concatenate([[0], np.cumsum(sizes)]) * 8
            data = lists.flatten().to_numpy().astype(np.int64).tobytes()
            packed = pa.array([data[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], packed, pa.array(sizes, pa.int32())], [*kept, "x", "width"])

    kept = [c for c in df.columns if c != vector]
    fields = "".join(f"`{n}` {t}, " for n, t in df.dtypes if n != vector)
    return rounded.mapInArrow(pack, fields + "x binary, width int")


class Whitening:
    """Mean, leading components and eigenvalues of the different vectors of a table."""

    def __init__(self, fit: DataFrame, width: int, components: int = COMPONENTS) -> None:
        """``fit`` has every different vector once, as ``x``; it is read three times."""
        parts = fit.rdd.getNumPartitions()

        def update(blocks: Iterator[np.ndarray]) -> bytes:
            state = Spectrum(width)
            for rows in blocks:
                state.add(rows)
            return state.packed()

        def join(states: list[bytes]) -> bytes:
            out = Spectrum.unpacked(states[0])
            for state in states[1:]:
                out = out.join(Spectrum.unpacked(state))
            return out.packed()

        state = Spectrum.unpacked(_combined(_over_partitions(fit, update, width), parts, join))
        self.n, self.sums, self.width = state.n, state.sums, width
        #: The spectrum as the updates gave it, before refinement; ascending.
        self.updated = state.values / state.n
        self.whole, self.rest = zip(*(divmod(s, state.n) for s in state.sums), strict=True)
        basis = np.linalg.qr(state.basis)[0]
        centred = self.centred

        def project(blocks: Iterator[np.ndarray]) -> bytes:
            total = np.zeros((width, width))
            for rows in blocks:
                on = centred(rows) @ basis
                total += on.T @ on
            return total.tobytes()

        ritz = np.frombuffer(_combined(_over_partitions(fit, project, width), parts, _added)).reshape(width, width) / state.n
        values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
        order = np.argsort(-values, kind="stable")[:components]
        self.trace = float(np.trace(ritz))
        keep = [i for i in order if values[i] > LEAST * self.trace]
        self.values, self.components = values[keep], basis @ turn[:, keep]
        weights = self.components / np.sqrt(self.values)
        self.weights = weights

        def whiten(blocks: Iterator[np.ndarray]) -> bytes:
            total = np.zeros((len(keep) + 1, len(keep)))
            for rows in blocks:
                on = centred(rows) @ weights
                total[:-1] += on.T @ on
                total[-1] += on.sum(0)
            return total.tobytes()

        self.identity_error = 0.0
        if keep:
            sums = np.frombuffer(_combined(_over_partitions(fit, whiten, width), parts, _added)).reshape(-1, len(keep)) / state.n
            self.identity_error = float(np.abs(sums[:-1] - np.outer(sums[-1], sums[-1]) - np.eye(len(keep))).max())

    @property
    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        """Rows less the mean, whose whole part is taken off exactly."""
        whole, rest = np.array(self.whole, np.int64), np.array([r / self.n for r in self.rest])
        return lambda rows: (rows - whole).astype(float) - rest

    def deviation(self, rows: np.ndarray) -> list[int | None]:
        """Sum over dimensions of ``(n * x - S) ** 2``, exact; None where no long holds it."""
        near = np.abs(rows - np.array(self.whole, np.int64)).max(initial=0)
        if (int(near) + 1) ** 2 * self.n ** 2 * self.width < 1 << 63:
            off = (rows - np.array(self.whole, np.int64)) * self.n - np.array(self.rest, np.int64)
            return (off * off).sum(1).tolist()
        exact = [sum((self.n * x - s) ** 2 for x, s in zip(row, self.sums, strict=True)) for row in rows.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def fitted(rounded: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``whole_numbers``' rows of the commonest length; None without rows."""
    widths = rounded.groupBy("width").count().orderBy(F.desc("count"), F.desc("width")).first()
    if widths is None:
        return None
    fit = settled(rounded.where(F.col("width") == widths["width"]).select("x").distinct())
    tasks = -(-fit.count() // TASK_ROWS)
    if tasks > fit.rdd.getNumPartitions():
        fit = settled(fit.repartition(tasks))
    return Whitening(fit, widths["width"], components)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable row's coordinates on the leading components, whitened."""
    rounded = whole_numbers(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return whitened(rounded, fitted(rounded))


_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(rounded: DataFrame, model: Whitening | None) -> DataFrame:
    """A row for each row of ``rounded`` (vec_id, x, width) and component."""
    if model is None:
        return rounded.sparkSession.createDataFrame([], _RESULT)
    k = len(model.values)
    centred, weights, n, error = model.centred, model.weights, model.n, model.identity_error
    explained, width, deviation = model.values / model.trace if k else np.zeros(0), model.width, model.deviation

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            rows = _matrix(batch.column("x"), width)
            on = centred(rows) @ weights
            times = np.repeat(np.arange(len(rows)), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").cast(pa.int64()).take(pa.array(times)), pa.array(np.tile(np.arange(1, k + 1), len(rows)), pa.int32()),
                 pa.array(np.full(len(times), n), pa.int64()), pa.array(deviation(rows), pa.int64()).take(pa.array(times)),
                 pa.array(on.ravel()), pa.array(np.tile(explained, len(rows))), pa.array(np.full(len(times), error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rounded.where(F.col("width") == width).select("vec_id", "x").mapInArrow(work, _RESULT)
