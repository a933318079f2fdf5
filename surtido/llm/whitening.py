"""Embedding whitening: components by spectral divide-and-conquer on polar decompositions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surtido.llm.vectors import dimension, is_finite, matrix
from surtido.session import materialize

COMPONENTS = 8
SCALE = 1024       # steps a unit of an entry
SHIFT = 100_000    # added to every entry
LARGEST = 2.0**50  # entries beyond it have no exact step and count as not finite
EPS = np.finfo(np.float64).eps
FLAT = 1e-13       # eigenvalues of this part of the largest are taken as zero


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by dynamically weighted Halley steps.

    QDWH in its inverse-free form (Nakatsukasa, Bai and Gygi, 2010): each step is one QR
    factorisation of the scaled matrix on top of the identity. The lower bound of the
    singular values starts at the rounding unit, so six steps or so are enough for any
    matrix; what is smaller is of either sign.
    """
    n = len(a)
    x = a / np.linalg.norm(a)
    low, eye = EPS, np.eye(n)
    for _ in range(20):
        square = low * low
        gamma = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + gamma)
        wa = root + np.sqrt(max(0.0, 8 - 4 * gamma + 8 * (2 - square) / (square * root))) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
        after = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        after = (after + after.T) / 2
        low = min(1.0, low * (wa + wb * square) / (1 + wc * square))
        moved = np.linalg.norm(after - x)
        x = after
        if moved <= 10 * np.sqrt(n) * EPS or (1 - low < EPS and moved < 1e-5):
            break
    return x


def _split(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the eigenvalues above and below a shift; None if all are equal.

    The shift is the mean eigenvalue, which has eigenvalues on both sides unless all are
    equal. One that hits an eigenvalue gives a projector of no whole rank, and is moved.
    """
    n = len(a)
    mean = np.trace(a) / n
    spread = np.linalg.norm(a - mean * np.eye(n))
    if spread <= 4 * n * EPS * scale:
        return None
    random = np.random.default_rng(n)
    for step in (0.0, 1e-3, -1e-3, 7e-3, -7e-3, 3e-2, -3e-2):
        shifted = a - (mean + step * spread / np.sqrt(n)) * np.eye(n)
        projector = (polar_factor(shifted) + np.eye(n)) / 2
        rank = int(round(np.trace(projector)))
        if not 0 < rank < n or np.linalg.norm(projector @ projector - projector) > 1e-10:
            continue
        span = projector @ random.standard_normal((n, rank))
        for _ in range(2):  # once more makes up for an unlucky start
            span, _ = np.linalg.qr(span)
            span = projector @ span
        basis, _ = np.linalg.qr(np.hstack([span, random.standard_normal((n, n - rank))]))
        if np.linalg.norm(basis[:, :rank].T @ a @ basis[:, rank:]) <= 1e3 * n * EPS * scale:
            return basis[:, :rank], basis[:, rank:]
    return None


def leading_components(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): the ``count`` largest eigenvalues, falling, and their unit vectors in columns.

    Spectral divide-and-conquer (Nakatsukasa and Higham, 2013): the polar factor of the
    shifted matrix is the sign of its eigenvalues, so half of it plus the identity projects
    on those above the shift. The matrix is split into the two invariant subspaces, and
    each again, down to single vectors. Subspaces below the first ``count`` are left alone.
    """
    scale = max(np.linalg.norm(a), np.finfo(np.float64).tiny)
    found: list[np.ndarray] = []
    todo = [np.eye(len(a))]
    while todo and len(found) < count:
        basis = todo.pop()
        inner = basis.T @ a @ basis
        halves = _split((inner + inner.T) / 2, scale) if basis.shape[1] > 1 else None
        if halves is None:  # one direction, or any basis of equal eigenvalues
            found += list(basis.T)
        else:
            above, below = halves
            todo += [basis @ below, basis @ above]
    vectors = np.array(found[:count]).reshape(-1, len(a)).T
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")  # equal ones may come out in any order
    return values[order], vectors[:, order]


def _steps(vectors: np.ndarray) -> np.ndarray:
    return np.floor(vectors * SCALE).astype(np.int64) + SHIFT


def fit_moments(rows: DataFrame, vector: str, dim: int) -> tuple[int, list[int], np.ndarray]:
    """(n, S, V): how many vectors, the sums of their steps, and the steps' covariance (divisor n).

    Two passes: exact sums first, then products of centred steps, so that nothing cancels.
    A task adds its own rows up and sends on one row a dimension or a pair of dimensions.
    """
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for batch in batches:
            steps = _steps(matrix(batch[0], dim))
            n += len(steps)
            total = [a + b for a, b in zip(total, (steps - SHIFT).sum(axis=0, dtype=object).tolist())]
        if n:
            total = [t + n * SHIFT for t in total]
            yield pa.RecordBatch.from_pydict(
                {"pos": list(range(dim)), "total": [str(t) for t in total], "n": [n] * dim},
                pa.schema([("pos", pa.int32()), ("total", pa.string()), ("n", pa.int64())]))

    parts = rows.select(vector).mapInArrow(sums, "pos int, total string, n long")
    found = parts.groupBy("pos").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"),
                                     F.sum("n").alias("n")).orderBy("pos").collect()  # one row a dimension
    n, total = found[0]["n"], [int(r["total"]) for r in found]
    whole = np.array([t // n for t in total], np.int64)
    rest = np.array([t % n for t in total]) / n

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((dim, dim))
        for batch in batches:
            centred = (_steps(matrix(batch[0], dim)) - whole) - rest
            gram += centred.T @ centred
        if gram.any():
            i, j = np.triu_indices(dim)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(gram[i, j])],
                names=["i", "j", "v"])

    cells = (rows.select(vector).mapInArrow(products, "i int, j int, v double")
             .groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow())  # one row a pair of dimensions
    cov = np.zeros((dim, dim))
    i, j = cells["i"].to_numpy(), cells["j"].to_numpy()
    cov[i, j] = cov[j, i] = cells["v"].to_numpy() / n
    return n, total, cov


def _deviations(steps: np.ndarray, n: int, total: list[int]) -> list[int]:
    """Exact sums over the dimensions of (n x - S) squared.

    With S = n m + r it is n² Σy² - 2n Σyr + Σr² for y = x - m, whose sums fit a long as a rule.
    """
    m, r = [t // n for t in total], [t % n for t in total]
    y = steps - np.array(m, np.int64)
    most = int(np.abs(y).max(initial=0)) + 1
    wide = most * max(most, n) * len(m) >= 2**62
    y, rest = (y.astype(object), np.array(r, object)) if wide else (y, np.array(r, np.int64))
    squares, mixed = (y * y).sum(axis=1).tolist(), (y * rest).sum(axis=1).tolist()
    constant = sum(x * x for x in r)
    return [n * n * a - 2 * n * b + constant for a, b in zip(squares, mixed)]


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """(key, n, deviation, deviation_exact, whitened, explained, identity_error) of every fit row.

    Vectors with a null, NaN or infinite entry or one beyond 2**50 are left out, as are
    null and empty ones and those of another length than most have. Entries become whole steps
    ``floor(1024 c) + 100000``; their covariance over all rows is taken apart by
    ``leading_components`` on the driver (a matrix of dimension by dimension), and the
    found vectors go to all tasks, which whiten their rows. ``whitened`` has one entry a component,
    by falling eigenvalue, up to ``components`` and the dimension; ``explained`` the shares of
    the variance; ``identity_error`` is the largest entry of the whitened rows' covariance less
    the identity. ``deviation`` is the exact sum of squares of ``n x - S``; where that does not fit
    a long it is null, and ``deviation_exact``, a decimal (null beyond 38 digits), has it.

    A component without variance (all rows alike in it, or fewer rows than components)
    has whitened null and explained 0, and no part in the error, which is null if there is no
    other. Equal eigenvalues: any orthonormal vectors of their space. Null or repeated keys: rows
    like any other. No sound vector: empty. Extra columns are ignored.

    Runs when called: three passes over the vectors, the rows written once.
    """
    schema = (f"`{key}` {df.schema[key].dataType.simpleString()}, n long, deviation long, deviation_exact decimal(38,0), "
              "whitened array<double>, explained array<double>, identity_error double")
    sound = df.select(key, vector).filter(
        is_finite(vector) & F.forall(vector, lambda x: F.abs(x) <= LARGEST))
    dim = dimension(sound, vector)
    if not dim:
        return df.sparkSession.createDataFrame([], schema)
    rows = sound.filter(F.size(vector) == dim)
    n, total, cov = fit_moments(rows, vector, dim)
    values, vectors = leading_components(cov, min(components, dim))
    trace = float(np.trace(cov))
    varied = values > FLAT * max(trace, np.finfo(np.float64).tiny)
    scaled = np.where(varied, vectors / np.sqrt(np.where(varied, values, 1.0)), 0.0)
    explained = [float(v / trace) if ok else 0.0 for v, ok in zip(values, varied)]
    whole = np.array([t // n for t in total], np.int64)
    rest = np.array([t % n for t in total]) / n

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = _steps(matrix(batch[1], dim))
            white = ((steps - whole) - rest) @ scaled
            flat = pa.array(white.ravel(), mask=~np.tile(varied, len(white)))
            offsets = pa.array(np.arange(len(white) + 1, dtype=np.int32) * white.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch[0], pa.array([str(d) for d in _deviations(steps, n, total)], pa.string()),
                 pa.ListArray.from_arrays(offsets, flat)], names=["key", "d", "whitened"])

    white = materialize(rows.mapInArrow(
        project, f"key {df.schema[key].dataType.simpleString()}, d string, whitened array<double>"), "whitened")
    kept = np.flatnonzero(varied).tolist()
    pairs = [F.abs(F.covar_pop(F.get("whitened", F.lit(i)), F.get("whitened", F.lit(j))) - float(i == j))
             for i in kept for j in kept if i <= j]
    error = white.agg(F.greatest(*pairs, F.lit(0.0)).alias("e")).first()["e"] if pairs else None
    return white.select(
        F.col("key").alias(key), F.lit(n).cast("long").alias("n"),
        F.expr("try_cast(d AS bigint)").alias("deviation"),
        F.expr("try_cast(d AS decimal(38,0))").alias("deviation_exact"), "whitened",
        F.lit(explained).cast("array<double>").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"))
