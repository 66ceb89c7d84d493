"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

The fit list (each distinct vector once) is written once as blocks of rows. Every Lanczos step is
one pass over the blocks, which does both products of the method on centred rows: ``p = X z`` and
``X'p``. The left vectors ``u = X w`` are as long as the table and are never stored: what the method needs
of them are inner products, and ``u . p = w . X'p`` has them from the pass's own result, so the full
reorthogonalisation of both sides happens on vectors of the embedding's dimension. The driver holds those
(dimension x steps numbers) and the small bidiagonal matrix, whose singular value decomposition
gives components and deviations. A pass returns one number per dimension, summed by an aggregate.

When a Krylov space is used up (equal or zero singular values, few distinct rows), the method goes on from
a random direction orthogonal to all before, so it always ends with every direction or, on
long vectors, once the leading components have converged and a second start has found no others.

Vectors are taken as whole numbers ``floor(scale * c) + shift``. Rows whose vector is null, empty or has
null or non-finite entries, or whose length is not the most frequent one (ties: the longest), are left
out; entries beyond 2^52 in size are held there. Directions without variance are no components, so
a table with one distinct vector, like an empty one, gives no rows. Repeated rows count once in the fit and
get a row each; ids may be null or equal; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sluice.session import persist_table

SCALE, SHIFT = 64, 1_000_000
LARGEST = float(1 << 52)
NO_VARIANCE = 1e-10  # of the largest singular value
CONVERGED = 1e-14
_SUMS = "pos int, value double"
_SUMS_ARROW = pa.schema([("pos", pa.int32()), ("value", pa.float64())])


def whole_numbers(vector: Column) -> Column:
    """The vector as whole numbers; null where it is not a vector of finite numbers."""
    entries = vector.cast("array<double>")
    fine = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = F.transform(entries, lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(LARGEST)), F.lit(-LARGEST))) + SHIFT)
    return F.when((F.size(entries) > 0) & fine, held)


@dataclass
class Whitening:
    """What a fit gives: rows in the fit list, exact sums, the components as columns, the eigenvalue of each,
    the trace of the covariance and the largest error of the whitened covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float


def _matrix(batch: pa.RecordBatch, name: str, d: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _blocks(it: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """Rows as blocks of the smallest whole-number type, with the sums of their columns."""
    for batch in it:
        if not batch.num_rows:
            continue
        x = _matrix(batch, "x", d)
        kind = np.result_type(np.min_scalar_type(x.min() - SHIFT), np.min_scalar_type(x.max() - SHIFT), np.int8)
        y = np.ascontiguousarray(x - SHIFT, kind)
        yield pa.RecordBatch.from_pydict({"kind": [kind.str], "n": [len(y)], "rows": [y.tobytes()], "sums": [y.sum(0, dtype=np.int64).tolist()]},
                                         schema=pa.schema([("kind", pa.string()), ("n", pa.int64()), ("rows", pa.binary()),
                                                           ("sums", pa.list_(pa.int64()))]))


def _summed(blocks: DataFrame, mean: np.ndarray, work: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all blocks of ``work(centred rows)``; a task adds up its blocks first."""
    d = len(mean)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in it:
            for kind, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                y = np.frombuffer(rows.as_buffer(), np.dtype(kind)).reshape(-1, d)
                for part in range(0, len(y), 8192):
                    total += work(y[part:part + 8192] - mean)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], schema=_SUMS_ARROW)

    out = np.zeros(size)
    for r in blocks.select("kind", "rows").mapInArrow(run, _SUMS).groupBy("pos").agg(F.sum("value").alias("value")).collect():
        out[r.pos] = r.value
    return out


def _orthogonal(x: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """``x`` without its parts in ``basis``, taken away twice."""
    if basis:
        b = np.array(basis)
        for _ in range(2):
            x = x - b.T @ (b @ x)
    return x


def bidiagonalised(product: Callable[[np.ndarray], tuple[np.ndarray, float]], d: int, wanted: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(right singular vectors as columns, singular values) of a matrix known by ``product(z) = (X'Xz, |Xz|^2)``,
    by falling value: all ``d`` of them, or the leading ones once they have converged."""
    rng = np.random.default_rng(seed)
    right: list[np.ndarray] = []  # v
    left: list[np.ndarray] = []  # w with u = X w, and X'u
    back: list[np.ndarray] = []
    alphas: list[float] = []
    betas: list[float] = []  # betas[j] couples step j to step j + 1
    started, again = 0, False
    v = rng.standard_normal(d)
    v /= np.linalg.norm(v)
    while True:
        right.append(v)
        z = v - betas[-1] * left[-1] if betas and betas[-1] else v
        g, square = product(z)
        if left:  # u orthogonal to every u before
            w, b = np.array(left), np.array(back)
            c = w @ g
            z, g, square = z - c @ w, g - c @ b, square - c @ c
        alpha = float(np.sqrt(max(square, 0.0)))
        largest = max([alpha, *alphas, *betas])
        if alpha <= largest * 1e-13:  # nothing left of X in this direction
            alpha, z, g = 0.0, np.zeros(d), np.zeros(d)
        else:
            z, g = z / alpha, g / alpha
        alphas.append(alpha)
        left.append(z)
        back.append(g)
        if len(right) == d:
            break
        r = _orthogonal(g - alpha * v, right)
        beta = float(np.linalg.norm(r))
        small = beta <= largest * 1e-13
        steps = len(right) - started
        if not small and steps > 2 * wanted + 8:
            p, s, _ = np.linalg.svd(_upper(alphas, betas))
            small = bool((beta * np.abs(p[-1, :wanted]) <= CONVERGED * s[0]).all())
            if small and again:
                break
            again = again or small
        if small:
            r, beta, started = _orthogonal(rng.standard_normal(d), right), 0.0, len(right)
            v = r / np.linalg.norm(r)
        else:
            v = r / beta
        betas.append(beta)
    _, s, qt = np.linalg.svd(_upper(alphas, betas))
    return np.array(right).T @ qt.T, s


def _upper(alphas: list[float], betas: list[float]) -> np.ndarray:
    return np.diag(alphas) + np.diag(betas[:len(alphas) - 1], 1)


def fit_whitening(spark: SparkSession, vectors: DataFrame, wanted: int = 16) -> Whitening | None:
    """The whitening of a table with one column ``x`` of whole-number vectors; None without rows."""
    lengths = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return None
    d = lengths[0].d
    distinct = vectors.where(F.size("x") == d).select("x").distinct()
    blocks = persist_table(spark, distinct.mapInArrow(lambda it: _blocks(it, d), "kind string, n long, rows binary, sums array<long>"), "fit-list")
    sums = [0] * d
    exact = blocks.select(F.posexplode("sums").alias("pos", "s")).groupBy("pos").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    for r in exact:
        sums[r.pos] = int(r.s)
    n = blocks.agg(F.sum("n")).first()[0]
    mean = np.array([s / n for s in sums])
    trace = _summed(blocks, mean, lambda x: np.array([np.vdot(x, x)]), 1)[0] / n

    def product(z: np.ndarray) -> tuple[np.ndarray, float]:
        def both(x: np.ndarray) -> np.ndarray:
            p = x @ z
            return np.append(p @ x, p @ p)

        out = _summed(blocks, mean, both, d + 1)
        return out[:d], out[d]

    components, s = bidiagonalised(product, d, wanted) if trace > 0 else (np.zeros((d, 0)), np.zeros(0))
    keep = s > (s[0] * NO_VARIANCE if len(s) else 0)
    components, s = components[:, keep][:, :wanted], s[keep][:wanted]
    if len(s):
        components = components * np.sign(components[np.abs(components).argmax(0), np.arange(len(s))])
    k = len(s)
    eigenvalues = s * s / n

    def whitened(x: np.ndarray) -> np.ndarray:
        white = (x @ components) / np.sqrt(eigenvalues)
        return np.concatenate([(white.T @ white).ravel(), white.sum(0)])

    error = 0.0
    if k:
        out = _summed(blocks, mean, whitened, k * k + k) / n
        error = float(np.abs(out[:k * k].reshape(k, k) - np.outer(out[k * k:], out[k * k:]) - np.eye(k)).max())
    return Whitening(n, [s + n * SHIFT for s in sums], components, eigenvalues, float(trace), error)


def _deviations(dev: np.ndarray, n: int) -> list:
    """Exact sums of squares of each row; null where a long cannot hold one."""
    if not dev.size or dev.shape[1] * float(np.abs(dev).max()) ** 2 < 2.0 ** 62:
        return (dev * dev).sum(1).tolist()
    exact = [sum(int(c) ** 2 for c in row) for row in dev.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whitened_rows(rows: DataFrame, key: Column, vector: Column, fit: Whitening) -> DataFrame:
    """One row for each row of the table with a vector of the fit's length and each component: key,
    component (from 1), n, deviation, whitened, explained, identity_error."""
    d, k, n = len(fit.sums), len(fit.eigenvalues), fit.n
    kept = rows.select(key.alias("key"), whole_numbers(vector).alias("x")).where(F.size("x") == d)
    key_type = kept.schema["key"].dataType
    schema = pa.schema([("key", to_arrow_type(key_type)), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()),
                        ("explained", pa.float64()), ("identity_error", pa.float64())])
    offsets = np.array([s - n * SHIFT for s in fit.sums], object)
    mean = np.array([s / n for s in offsets.tolist()])
    loadings = fit.components / np.sqrt(fit.eigenvalues)
    explained = fit.eigenvalues / fit.trace if k else fit.eigenvalues
    error = fit.identity_error
    wide = max(map(abs, offsets.tolist()), default=0)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            m = batch.num_rows
            if not m or not k:
                continue
            y = _matrix(batch, "x", d) - SHIFT
            small = n * float(np.abs(y).max()) + wide < 2.0 ** 62
            dev = y * n - offsets.astype(np.int64) if small else y.astype(object) * n - offsets
            white = (y - mean) @ loadings
            deviation = pa.array(_deviations(dev, n) if small else [v if (v := sum(c * c for c in row)) < 1 << 63 else None for row in dev.tolist()],
                                 pa.int64())
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                 deviation.take(each), pa.array(white.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))], schema=schema)

    return kept.mapInArrow(run, f"key {key_type.simpleString()}, component int, n long, deviation long, whitened double, explained double, "
                                "identity_error double")


def whiten(spark: SparkSession, rows: DataFrame, key: Column, vector: Column, wanted: int = 16) -> DataFrame:
    """Fit and apply a whitening of up to ``wanted`` components."""
    fit = fit_whitening(spark, rows.select(whole_numbers(vector).alias("x")).where("x IS NOT NULL"), wanted)
    if fit is None:
        fit = Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, 0.0)
        rows = rows.limit(0)
    return whitened_rows(rows, key, vector, fit)
