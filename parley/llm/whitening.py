"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance V is never formed. Every use of it is a pass over the distinct
vectors, in which each partition centres its rows C and adds CᵀCQ to the
total; only d x block numbers come back. A Chebyshev polynomial in V, computed
by its three-term recurrence, damps the part of the spectrum below the block
and lifts the wanted part above it. QR and Rayleigh-Ritz turn the filtered
block into Ritz pairs, and rounds go on until the pairs are certified: each
residual is at rounding level, and a random vector outside the block, filtered
the same way, finds no larger eigenvalue.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import NO_ID, written
from parley.llm.vectors import finite

#: Entries become floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: The block has this many vectors besides the wanted ones.
GUARD = 16
#: Degree of the filter (passes between two Rayleigh-Ritz steps), at most, and
#: how far it may lift an eigenvalue.
DEGREE, GROWTH = 16, 1e8
#: Residuals as a share of the largest eigenvalue: certified pairs have this at
#: most and have stopped falling; converged ones are kept out of the filter.
RESIDUAL, LOCKED = 1e-13, 1e-14
ROUNDS = 200
#: Vectors in one packed block.
BLOCK_ROWS = 2048
#: Eigenvalues below this share of the largest are zero: no component.
ZERO = 1e-10


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x``: the rows whose vector is there, without null or non-finite
    entries, as whole numbers. An entry too large for a long is an error."""
    x = F.transform("v", lambda c: F.when(F.abs(c) < 2.0 ** 56, F.floor(c * SCALE) + OFFSET).otherwise(
        F.raise_error(F.lit("an entry of the vectors does not fit a long"))))
    return vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")) \
        .where(finite("v")).select("vec_id", x.cast("array<long>").alias("x"))


def common_length(whole: DataFrame) -> int:
    """The length that most distinct vectors have (ties: the longest), 0 without any."""
    top = whole.groupBy("x").agg(F.lit(1)).groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return top["d"] if top else 0


def packed_blocks(distinct: DataFrame, dim: int) -> DataFrame:
    """``x``: blocks of up to BLOCK_ROWS vectors as packed longs."""
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = np.concatenate([*pdf["x"], np.zeros(0, dtype=np.int64)]).astype("<i8").reshape(-1, dim)
            yield pd.DataFrame({"x": [rows[i:i + BLOCK_ROWS].tobytes() for i in range(0, len(rows), BLOCK_ROWS)]})

    return distinct.select("x").mapInPandas(batches, "x binary")


def _summed(blocks: DataFrame, part: Callable[[np.ndarray], np.ndarray], size: int, dtype=np.float64) -> np.ndarray:
    """The sum of ``part`` over all blocks. A task adds up its own blocks;
    many tasks' totals are added in further tasks before the driver adds the
    last few."""
    def own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, dtype=dtype)
        for pdf in frames:
            for x in pdf["x"]:
                total += part(np.frombuffer(x, dtype="<i8")).reshape(-1)
        yield pd.DataFrame({"t": [total.tobytes()]})

    def again(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, dtype=dtype)
        for pdf in frames:
            for t in pdf["t"]:
                total += np.frombuffer(t, dtype=dtype)
        yield pd.DataFrame({"t": [total.tobytes()]})

    totals, n = blocks.mapInPandas(own, "t binary"), blocks.rdd.getNumPartitions()
    while n > 64:
        n = max(16, n // 32)
        totals = totals.repartition(n).mapInPandas(again, "t binary")
    total = np.zeros(size, dtype=dtype)
    for row in totals.collect():  # 64 rows of d x block numbers at most
        total += np.frombuffer(row["t"], dtype=dtype)
    return total


@dataclass(frozen=True)
class Covariance:
    """The distinct vectors' covariance as an operator. ``sums`` and ``n`` are
    exact; a row is centred as (n x - S) / n, whose numerator is a whole number."""

    blocks: DataFrame
    n: int
    sums: np.ndarray

    @staticmethod
    def of(blocks: DataFrame, dim: int) -> Covariance:
        exact = _summed(blocks, lambda x: np.append(x.reshape(-1, dim).sum(axis=0), len(x) // dim), dim + 1, np.int64)
        return Covariance(blocks, int(exact[-1]), exact[:-1])

    @property
    def dim(self) -> int:
        return len(self.sums)

    def times(self, q: np.ndarray) -> np.ndarray:
        """V q by one pass."""
        n, sums, dim = self.n, self.sums, self.dim

        def part(x: np.ndarray) -> np.ndarray:
            c = centred(x.reshape(-1, dim), n, sums)
            return c.T @ (c @ q)

        return _summed(self.blocks, part, q.size).reshape(q.shape) / n

    def trace(self) -> float:
        n, sums, dim = self.n, self.sums, self.dim
        return float(_summed(self.blocks, lambda x: np.array([(centred(x.reshape(-1, dim), n, sums) ** 2).sum()]), 1)[0]) / n


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n. While n x fits a long the difference is a whole number and only
    the division rounds."""
    if len(x) and int(np.abs(x).max()) * n < 1 << 62:
        return (x * n - sums) / n
    return x - np.array([int(s) // n for s in sums]) - np.array([int(s) % n for s in sums]) / n


def filtered(v: Covariance, q: np.ndarray, edge: float, top: float, degree: int, locked: np.ndarray) -> np.ndarray:
    """A Chebyshev polynomial in V, mapped so that [0, edge] is damped, times q.
    Its degree is at most ``degree`` and so low that an eigenvalue of ``top``
    is lifted by GROWTH at most, else q's vectors would all turn to that one's.
    The converged vectors ``locked`` are kept out of every step."""
    def out(x):
        x = x - locked @ (locked.T @ x)
        return x - locked @ (locked.T @ x)

    lift = np.arccosh(max(1.0 + 1e-12, 2 * top / edge - 1))
    half = edge / 2
    before = out(q)
    now = out((v.times(before) - half * before) / half)
    for _ in range(max(1, min(degree, int(np.arccosh(GROWTH) / lift))) - 1):
        before, now = now, out(2 * (v.times(now) - half * now) / half - before)
    return now


@dataclass(frozen=True)
class Spectrum:
    """The leading eigenvalues, falling, and their unit vectors as columns."""

    values: np.ndarray
    vectors: np.ndarray
    trace: float


def leading(v: Covariance, k: int = COMPONENTS, guard: int = GUARD, degree: int = DEGREE, rounds: int = ROUNDS) -> Spectrum:
    """The ``k`` leading eigenpairs of V (fewer if V has a smaller rank), up to
    rounding. A round is a filter and a Rayleigh-Ritz step. Raises if ``rounds``
    don't certify them."""
    d = v.dim
    trace = v.trace() if v.n else 0.0
    if not d or not trace > 0:
        return Spectrum(np.zeros(0), np.zeros((d, 0)), trace)
    rng = np.random.default_rng(1)
    block = min(d, k + guard)
    q = np.linalg.qr(rng.normal(size=(d, block)))[0]
    last = np.inf
    for _ in range(rounds):
        image = v.times(q)
        small = q.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        wanted = min(k, max(1, int((values > ZERO * values[0]).sum())))
        off = np.linalg.norm(image - q * values, axis=0) / values[0]
        worst = off[:wanted].max()
        still = worst <= RESIDUAL and worst > last / 2  # rounding alone is left
        if still and (block == d or _probed(v, q, values, wanted, degree, rng)):
            return Spectrum(values[:wanted], q[:, :wanted], trace)
        last = worst
        done = int(np.argmax(np.append(off > LOCKED, True)))  # converged from the first on
        if done == block:
            done = block - 1
        # The unwanted spectrum lies between 0 and the block's last value; where
        # that is zero nothing is left to damp.
        edge = max(values[-1], values[0] * 1e-9)
        locked = q[:, :done]
        q = np.linalg.qr(np.hstack([locked, filtered(v, q[:, done:], edge, values[done], degree, locked)]))[0]
    raise RuntimeError(f"eigenpairs are not certified after {rounds} rounds: residual {worst:.3g}")


def _probed(v: Covariance, q: np.ndarray, values: np.ndarray, wanted: int, degree: int, rng) -> bool:
    """Whether a random vector outside the block, filtered, has no larger
    eigenvalue than the wanted ones: none of these was missed."""
    least = max(values[wanted - 1], values[0] * 1e-9)
    x = filtered(v, rng.normal(size=(len(q), 1)), least, values[0], degree, q)
    x = x / max(np.linalg.norm(x), 1e-300)
    return float((x.T @ v.times(x))[0, 0]) <= least * (1 + 1e-9)


def identity_error(v: Covariance, s: Spectrum) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the
    identity, by one pass: means and products of the whitened rows."""
    k = len(s.values)
    if not k:
        return 0.0
    n, sums, dim, w = v.n, v.sums, v.dim, s.vectors / np.sqrt(s.values)

    def part(x: np.ndarray) -> np.ndarray:
        z = centred(x.reshape(-1, dim), n, sums) @ w
        return np.vstack([z.T @ z, z.sum(axis=0)])

    total = _summed(v.blocks, part, (k + 1) * k).reshape(k + 1, k) / n
    mean = total[k]
    return float(np.abs(total[:k] - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``
    of each usable row and component.

    Rows whose vector is null or holds null or non-finite entries are left out;
    an entry beyond 2^56 is an error. Every other row has its rows in the result,
    as do repeated and null ids, but vectors that are not as long as most of the
    distinct ones are (ties: the longest) cannot be fitted or projected: their
    ``deviation`` and ``whitened`` are null. Repeated vectors count once in the
    fit. There are as many components as V has eigenvalues above zero, ``k`` at
    most; so tables that are empty or have one distinct vector give no rows.
    ``deviation`` is exact, null if it doesn't fit a long. Other columns are not
    read. The whole-number vectors are written once to the shared folder.
    """
    whole = written(whole_vectors(vectors, id_col, vector_col), "whitening")
    dim = common_length(whole)
    distinct = whole.where(F.size("x") == dim).select("x").distinct()
    v = Covariance.of(written(packed_blocks(distinct, dim), "whitening-fit"), dim)
    s = leading(v, k)
    error = identity_error(v, s)
    found, n, sums = len(s.values), v.n, v.sums
    w, explained = s.vectors / np.sqrt(s.values), s.values / s.trace if found else s.values

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not found:
                continue
            fits = np.array([len(x) == dim for x in pdf["x"]], dtype=bool)
            x = np.zeros((len(pdf), dim), dtype=np.int64)
            if fits.any():
                x[fits] = np.stack([x for x in pdf["x"] if len(x) == dim])
            z = centred(x, n, sums) @ w
            z[~fits] = np.nan
            away = deviations(x, n, sums)
            component = np.tile(np.arange(1, found + 1, dtype=np.int32), len(pdf))
            yield pd.DataFrame({
                "vec_id": pdf["vec_id"].repeat(found).to_numpy(), "component": component, "n": n,
                "deviation": pd.array([a if f else None for a, f in zip(away, fits, strict=True)], dtype="Int64").repeat(found),
                "whitened": z.reshape(-1), "explained": np.tile(explained, len(pdf)), "identity_error": error})

    out = whole.mapInPandas(batches, "vec_id long, component int, n long, deviation long, whitened double, "
                                     "explained double, identity_error double")
    return out.withColumn("vec_id", F.expr(f"nullif(vec_id, {NO_ID + 1} - 1)")) \
        .withColumn("whitened", F.when(~F.isnan("whitened"), F.col("whitened")))


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 of each row, exactly; None if too large."""
    largest = (int(np.abs(x).max()) * n + int(np.abs(sums).max())) if x.size else 0
    if largest < 1 << 62:
        away = x * n - sums
        if x.size and int(np.abs(away).max()) ** 2 * x.shape[1] < 1 << 62:
            return (away * away).sum(axis=1).tolist()
        rows = [sum(a * a for a in row) for row in away.tolist()]
    else:
        rows = [sum((a * n - s) ** 2 for a, s in zip(row, sums.tolist(), strict=True)) for row in x.tolist()]
    return [r if r < 1 << 63 else None for r in rows]
