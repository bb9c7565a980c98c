"""Embedding whitening by incremental eigendecomposition.

A partition keeps its count, mean and the spectrum of its centred scatter matrix.  A batch of vectors enters as the d rows
of its triangular factor, which has the same scatter; a batch of fewer vectors than that enters as it is.  Every row is one
rank-one update of a spectrum: equal or unaffected eigenvalues are deflated, the others are the roots of the secular
equation, and the eigenvectors follow from the roots.  Spectra are combined the same way, one eigenpair after the
other, ``FAN_IN`` partitions at a time in rounds.  The last spectrum is a complete basis; one more distributed pass
gives the covariance in that basis (Rayleigh-Ritz), whose small rotation removes what rounding has left.

Entries become integers before anything is added, sums are exact, and every covariance is centred before multiplying.
What reaches the driver is bounded by the vectors' width d: one spectrum and two tables of d x d numbers.

Defined results: rows whose vector is NULL, or holds NULL or non-finite entries, are dropped; so are rows whose vector
has not the length that most vectors have (ties: the longest); entries beyond 2^42 are held at that bound; ``deviation``
is NULL where it leaves the range of a long; a component without variance has NULL for ``whitened`` and counts for no
``identity_error``; repeated rows count once each; a NULL vec_id is an id like any other; an empty table gives an empty
result.  Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import table, written

SCALE, SHIFT = 1024, 100_000
LARGEST = 2.0**42
COMPONENTS = 8
FAN_IN = 8
CLOSE = 1e-9
STATE = "part long, n long, sums array<long>, mean array<double>, values array<double>, vectors array<double>"
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def secular_roots(d: np.ndarray, z2: np.ndarray) -> np.ndarray:
    """``d_j - root_i`` as a matrix [i, j], for the eigenvalues of diag(d) + z z' with ascending, distinct ``d``.

    Each root lies between a pole and the next one.  It is sought as an offset from the nearer of the two, by rational
    steps that match both neighbours, and by halving where such a step would leave the bracket.
    """
    m = len(d)
    bound = np.append(d[1:], d[-1] + z2.sum())
    gap = bound - d
    middle = 1 + (z2 / (d - (d + gap / 2)[:, None])).sum(axis=1)
    near_left = (middle >= 0) | (np.arange(m) == m - 1)
    delta = d - np.where(near_left, d, bound)[:, None]
    lo = np.where(near_left, 0.0, -gap / 2)
    hi = np.where(near_left, np.where(np.arange(m) == m - 1, gap, gap / 2), 0.0)
    left = np.tri(m, dtype=bool)
    t, sought = (lo + hi) / 2, np.ones(m, bool)
    own, following = np.diagonal(delta), np.append(np.diagonal(delta, 1), gap[-1])
    for _ in range(80):
        inverse = 1 / (delta - t[:, None])
        term = z2 * inverse
        slope = term * inverse
        f, psi1 = 1 + term.sum(axis=1), np.where(left, slope, 0).sum(axis=1)
        phi1 = slope.sum(axis=1) - psi1
        lo, hi = np.where(f < 0, t, lo), np.where(f >= 0, t, hi)
        a, b = own - t, following - t
        c = f - a * psi1 - b * phi1
        s, p = (a + b) * f - a * b * (psi1 + phi1), a * b * f
        root = np.sqrt(np.maximum(s * s - 4 * p * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(s <= 0, (s - root) / (2 * c), 2 * p / (s + root))
            step[-1] = a[-1] * f[-1] / c[-1]  # no pole to the right
        small = np.abs(step) <= CLOSE * np.abs(t)  # steps converge quadratically: the next one would be below rounding
        new = np.where(small | ((t + step > lo) & (t + step < hi)), t + step, (lo + hi) / 2)
        t = np.where(sought, new, t)
        sought &= ~small
        if not sought.any():
            break
    return delta - t[:, None]


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of (vectors diag(values) vectors') + v v', values ascending."""
    z = vectors.T @ v
    scale = max(abs(values[-1]), z @ z)
    if scale == 0:
        return values, vectors
    close = np.diff(values) <= 8e-16 * scale * len(values)
    if close.any():  # equal eigenvalues: turn their basis until one vector carries all of v's part
        vectors = vectors.copy()
        edges = np.flatnonzero(np.concatenate(([True], ~close, [True])))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            norm = np.linalg.norm(z[a:b]) if b - a > 1 else 0.0
            if norm > 0:
                h = z[a:b].copy()
                h[-1] += np.copysign(norm, h[-1])
                vectors[:, a:b] -= np.outer(vectors[:, a:b] @ h, 2 * h / (h @ h))
                z[a:b] = 0
                z[b - 1] = norm if h[-1] < 0 else -norm
    moved = np.flatnonzero(z * z > 1e-32 * scale)
    if not len(moved):
        return values, vectors
    d, zm = values[moved], z[moved]
    differences = secular_roots(d, zm * zm)
    # The vector for which these roots are exact: eigenvectors from it are orthogonal to working precision.
    ratio = d[None, :] - d[:, None]
    np.fill_diagonal(ratio, 1.0)
    hat = np.sqrt(np.abs(np.prod(differences / -ratio, axis=0))) * np.sign(zm)
    q = hat / differences
    q /= np.linalg.norm(q, axis=1)[:, None]
    values, vectors = values.copy(), vectors.copy()
    values[moved] = d - np.diagonal(differences)
    vectors[:, moved] = vectors[:, moved] @ q.T
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Count, exact sums, mean and spectrum of the centred scatter matrix of some vectors."""

    def __init__(self, d: int):
        self.n, self.sums, self.mean = 0, np.zeros(d, np.int64), np.zeros(d)
        self.values, self.vectors = np.zeros(d), np.eye(d)

    def add(self, x: np.ndarray, times: int) -> None:
        """``times`` rows equal to ``x``."""
        off = x - self.mean
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, off * np.sqrt(self.n * times / (self.n + times)))
        self.mean = self.mean + off * (times / (self.n + times))
        self.n, self.sums = self.n + times, self.sums + x * times

    def add_batch(self, x: np.ndarray) -> None:
        """Many rows: their triangular factor has the scatter of all of them in d rows at most, each of which is one update."""
        if len(x) <= x.shape[1]:
            for row, times in zip(*np.unique(x, axis=0, return_counts=True), strict=True):
                self.add(row, int(times))
            return
        batch = Spectrum(x.shape[1])
        batch.n, batch.sums = len(x), x.sum(axis=0)
        off = centred(x, batch.n, batch.sums)
        batch.mean = batch.sums / batch.n
        for row in np.linalg.qr(off, mode="r"):
            batch.values, batch.vectors = rank_one(batch.values, batch.vectors, row)
        self.join(batch)

    def join(self, other: Spectrum) -> None:
        """The other's rows too: its eigenpairs one after the other, then the distance between the means."""
        if not self.n:
            self.n, self.sums, self.mean, self.values, self.vectors = other.n, other.sums, other.mean, other.values, other.vectors
            return
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, np.sqrt(value) * vector)
        off, n = other.mean - self.mean, self.n + other.n
        self.values, self.vectors = rank_one(self.values, self.vectors, off * np.sqrt(self.n * other.n / n))
        self.mean = self.mean + off * (other.n / n)
        self.n, self.sums = n, self.sums + other.sums

    def row(self, part: int) -> pd.DataFrame:
        return pd.DataFrame([(part, self.n, self.sums, self.mean, self.values, self.vectors.ravel())], columns=["part", "n", "sums", "mean", "values", "vectors"])

    @staticmethod
    def of(row) -> Spectrum:
        s = Spectrum(len(row.sums))
        s.n, s.sums, s.mean, s.values = int(row.n), np.array(row.sums), np.array(row.mean), np.array(row.values)
        s.vectors = np.array(row.vectors).reshape(len(row.sums), -1)
        return s


def prepared(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, x) of the usable rows, and their width."""
    finite = F.forall("embedding", lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(c))
    rows = embeddings.select("vec_id", "embedding").filter(F.col("embedding").isNotNull() & finite)
    widths = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = widths[0]["d"] if widths else 0
    held = lambda c: F.greatest(F.least(c.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))
    x = F.transform("embedding", lambda c: F.floor(held(c) * SCALE).cast("long") + SHIFT)
    return rows.filter(F.size("embedding") == d).select("vec_id", x.alias("x")), d


def spectrum(rows: DataFrame, d: int) -> Spectrum | None:
    """Of all rows: updates within partitions, then rounds of ``FAN_IN`` spectra each."""
    def partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Spectrum(d)
        for batch in batches:
            if len(batch):
                s.add_batch(np.stack(batch["x"].to_numpy()))
        if s.n:
            yield s.row(TaskContext.get().partitionId())

    def combined(group: pd.DataFrame) -> pd.DataFrame:
        states = [Spectrum.of(r) for r in group.sort_values("part").itertuples()]
        for other in states[1:]:
            states[0].join(other)
        return states[0].row(int(group["part"].min()) // FAN_IN)

    parts = rows.rdd.getNumPartitions()
    states = rows.select("x").mapInPandas(partition, STATE)
    while parts > 1:
        states = states.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(combined, STATE)
        parts = -(-parts // FAN_IN)
    last = states.collect()
    return Spectrum.of(last[0]) if last else None


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n, with the difference taken among integers."""
    return (x - sums // n) - (sums % n) / n


def covariance(rows: DataFrame, n: int, sums: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Of all centred rows in ``basis``: a product for each partition, added entry by entry."""
    k = basis.shape[1]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, k))
        for batch in batches:
            if len(batch):
                y = centred(np.stack(batch["x"].to_numpy()), n, sums) @ basis
                total += y.T @ y
        yield pd.DataFrame({"entry": np.arange(k * k), "value": total.ravel()})

    added = rows.select("x").mapInPandas(partial, "entry long, value double").groupBy("entry").agg(F.sum("value").alias("value"))
    out = np.zeros(k * k)
    for r in added.collect():
        out[r["entry"]] = r["value"]
    return out.reshape(k, k) / n


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    if len(x) and max(abs(int(x.max())), abs(int(x.min())), 1) * n < 2**62:
        off = x * n - sums
        if float(np.abs(off).max()) ** 2 * x.shape[1] < 2.0**62:
            return (off * off).sum(axis=1).tolist()
    exact = [sum((n * a - s) ** 2 for a, s in zip(r, sums.tolist(), strict=True)) for r in x.tolist()]
    return [e if e < 2**63 else None for e in exact]


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and leading component."""
    rows, d = prepared(embeddings)
    rows = written(rows)  # four passes follow
    s = spectrum(rows, d) if d else None
    if s is None:
        return embeddings.sparkSession.createDataFrame([], OUT)
    n, sums = s.n, s.sums
    ritz = covariance(rows, n, sums, s.vectors)
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    values, basis = values[::-1][:components], (s.vectors @ turn)[:, ::-1][:, :components]
    basis = basis * np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])])
    total = float(np.trace(ritz))
    varied = values > 1e-13 * max(total, 0.0)
    whitener = np.where(varied, basis / np.sqrt(np.where(varied, values, 1.0)), 0.0)
    error = covariance(rows, n, sums, whitener) - np.diag(varied.astype(float))
    error = float(np.abs(error).max())
    explained = [float(v / total) if k else 0.0 for v, k in zip(values, varied, strict=True)]
    k = len(values)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_numpy())
                y = np.where(varied, centred(x, n, sums) @ whitener, np.nan)
                deviation = pd.Series(_deviation(x, n, sums), dtype="Int64")
                whitened = pd.Series(y.ravel()).astype(object).where(~np.isnan(y.ravel()), None)
                yield pd.DataFrame({
                    "vec_id": batch["vec_id"].astype("Int64").repeat(k).to_numpy(), "component": np.tile(np.arange(1, k + 1), len(batch)), "n": n,
                    "deviation": deviation.repeat(k).to_numpy(), "whitened": whitened, "explained": np.tile(explained, len(batch)), "identity_error": error,
                })

    return rows.mapInPandas(project, OUT)


def op13(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
