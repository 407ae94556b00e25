"""Embedding whitening by Jacobi-Davidson.

Vectors are quantised: each entry c, as double, becomes the long floor(256 * c). The fit list holds every distinct quantised vector
once, packed into blocks of rows and written to shared storage. Its covariance V is never formed: all work is products of the
centred rows with a few vectors, one Spark job per product, whose partial sums are added in a tree.

The solver looks for the largest eigenvalues of V. A search subspace gives Ritz pairs (Rayleigh-Ritz); each pair that is not
done has its correction equation, projected against itself and all locked pairs, solved loosely by a few MINRES steps, and the
solutions of all pairs widen the subspace. MINRES runs for all pairs side by side, so a step costs one product whatever their
number. A pair whose residual is at double precision (``PRECISION`` x dimensions x the largest eigenvalue) is locked and
projected out. At the end fresh random directions are tried, so that no larger eigenvalue is missed.

Results: vectors that are null, empty, or hold null, NaN or infinite entries are left out; of vectors of several dimensions only those of the
most frequent one stay (the longest of equally frequent ones). Values outside of a long are cut at its ends. Repeated rows get a row
each; a component whose eigenvalue is zero within rounding has no whitened values and is left out, so a table of
equal vectors, or an empty one, gives no row. ``deviation`` is null where it doesn't fit a long; ``deviation_wide`` then has it.
Columns other than the id and the vector are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airsignal.llm.common import saved

#: Entries are multiplied by this before they are rounded down.
SCALE = 256.0
#: Rows of a packed block, and partial sums that the driver takes at once; more are added on executors first.
BLOCK_ROWS, PARTIALS = 4096, 256
#: MINRES steps of one correction, the reduction at which they end, and restart size of the subspace in multiples of the components.
INNER, INNER_TOLERANCE, WIDEST = 5, 0.1, 8
#: Residual of a finished pair: times dimensions x largest eigenvalue.
PRECISION = float(np.finfo(float).eps)
#: Rounds of corrections at most, and rounds of random directions tried at the end.
ROUNDS, PROBES = 60, 2


# ---- rows ---------------------------------------------------------------------------------------


def quantised(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): the usable rows, x the quantised vector as little-endian longs."""

    def run(batches):
        for batch in batches:
            vectors = batch.column("v")
            ids, out = batch.column("vec_id"), []
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = vectors.slice(at, BLOCK_ROWS)
                size = pc.fill_null(pc.list_value_length(part), 0).to_numpy()
                flat = part.flatten()
                value = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # a null entry becomes NaN
                end = np.cumsum(size)
                bad = np.append(0, np.cumsum(~np.isfinite(value)))
                good = np.flatnonzero((size > 0) & (bad[end] == bad[end - size]))
                with np.errstate(over="ignore", invalid="ignore"):
                    scaled = np.floor(SCALE * value)
                    whole = np.where(scaled >= 2.0 ** 63, np.iinfo(np.int64).max,
                                     np.where(scaled < -(2.0 ** 63), np.iinfo(np.int64).min, scaled.astype(np.int64))).astype("<i8")
                out += [(at + k, whole[end[k] - size[k]:end[k]].tobytes()) for k in good]
            keep = pa.array([k for k, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(keep), pa.array([x for _, x in out], pa.binary())], names=["vec_id", "x"])

    return (rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
            .mapInArrow(run, "vec_id long, x binary"))


def packed(fit: DataFrame, dims: int) -> DataFrame:
    """(n, block): distinct vectors as blocks of rows, in the smallest integers that hold them."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.column("x").slice(at, BLOCK_ROWS)
                x = np.frombuffer(b"".join(part.to_pylist()), "<i8").reshape(-1, dims)
                kind = next(k for k in ("i1", "i2", "i4", "i8") if x.min() >= np.iinfo(k).min and x.max() <= np.iinfo(k).max)
                yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int32()), pa.array([kind]), pa.array([x.astype("<" + kind).tobytes()], pa.binary())],
                                                 names=["n", "kind", "block"])

    return fit.mapInArrow(run, "n int, kind string, block binary")


class Blocks:
    """The fit list: sums over all of its rows, a partial one per task."""

    def __init__(self, table: DataFrame, dims: int) -> None:
        self.table, self.dims = table.persist(), dims
        self.parts = table.rdd.getNumPartitions()

    def gather(self, step: Callable, add: Callable = lambda a, b: a + b):
        """``step`` of each block of rows, all added up; None without rows."""
        dims = self.dims

        def partial(batches):
            total = None
            for batch in batches:
                for kind, block in zip(batch.column("kind").to_pylist(), batch.column("block").to_pylist(), strict=True):
                    one = step(np.frombuffer(block, "<" + kind).reshape(-1, dims))
                    total = one if total is None else add(total, one)
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["part"])

        def joined(batches):
            total = None
            for batch in batches:
                for part in batch.column("part").to_pylist():
                    one = pickle.loads(part)
                    total = one if total is None else add(total, one)
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["part"])

        parts, n = self.table.mapInArrow(partial, "part binary"), self.parts
        while n > PARTIALS:
            n = math.ceil(math.sqrt(n))
            parts = parts.repartition(n).mapInArrow(joined, "part binary")
        total = None
        for row in parts.collect():  # PARTIALS rows at most
            one = pickle.loads(row.part)
            total = one if total is None else add(total, one)
        return total

    def product(self, mean: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
        """V w for the columns of ``w``: centred rows, times w, times centred rows."""
        w = np.ascontiguousarray(w)

        def step(x):
            c = x - mean
            return c.T @ (c @ w)

        return self.gather(step) / n


# ---- eigenpairs -----------------------------------------------------------------------------------


def _against(w: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``w`` without its parts along ``basis``; twice, as once leaves rounding errors."""
    for _ in range(2):
        w = w - basis @ (basis.T @ w)
    return w


def _orthonormal(w: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Unit columns that span what ``w`` adds to ``basis``; columns that add nothing are left out."""
    out = np.zeros((len(w), 0))
    for k in range(w.shape[1]):
        v = w[:, k:k + 1] / max(np.linalg.norm(w[:, k]), 1e-300)
        v = _against(v, np.hstack([basis, out]))
        size = np.linalg.norm(v)
        if size > 1e-10:
            out = np.hstack([out, _against(v / size, np.hstack([basis, out]))])
            out[:, -1] /= np.linalg.norm(out[:, -1])
    return out


def minres(product: Callable, theta: np.ndarray, bases: list[np.ndarray], rhs: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """Loose solutions of (I - QQ') (V - theta I) (I - QQ') t = rhs, one column and one Q each, side by side."""
    d, k = rhs.shape
    out = np.zeros((d, k))
    project = lambda w: np.stack([_against(w[:, j:j + 1], q)[:, 0] for j, q in enumerate(bases)], axis=1)
    v_old, v, beta = np.zeros((d, k)), project(rhs), None
    beta = np.linalg.norm(v, axis=0)
    first, phi = beta.copy(), beta.copy()
    v = v / np.maximum(beta, 1e-300)
    m, m_old = np.zeros((d, k)), np.zeros((d, k))
    cos, sin = np.ones((2, k)), np.zeros((2, k))  # of the last two rotations
    cos[:], beta = 1.0, np.zeros(k)
    live = first > 0
    for _ in range(steps):
        if not live.any():
            break
        p = project(product(v) - v * theta) - v_old * beta
        alpha = (p * v).sum(axis=0)
        p = p - v * alpha
        beta_new = np.linalg.norm(p, axis=0)
        epsilon = sin[0] * beta  # the new column of the tridiagonal matrix, rotated twice
        delta = cos[1] * (cos[0] * beta) + sin[1] * alpha
        gamma_bar = -sin[1] * (cos[0] * beta) + cos[1] * alpha
        gamma = np.maximum(np.hypot(gamma_bar, beta_new), 1e-300)
        c, s = gamma_bar / gamma, beta_new / gamma
        m_new = (v - m * delta - m_old * epsilon) / gamma
        out = out + np.where(live, c * phi, 0.0) * m_new
        phi = -s * phi
        m_old, m = m, m_new
        cos, sin = np.stack([cos[1], c]), np.stack([sin[1], s])
        v_old, v, beta = v, p / np.maximum(beta_new, 1e-300), beta_new
        live &= (np.abs(phi) > tolerance * first) & (beta_new > 1e-14 * np.abs(theta).max())
    return out


def jacobi_davidson(product: Callable, dims: int, wanted: int, trace: float, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues of V, falling, and their unit vectors: ``wanted`` of them, fewer where the rest is zero."""
    rng, wanted = np.random.default_rng(seed), min(wanted, dims)
    values, locked = np.zeros(0), np.zeros((dims, 0))
    space = _orthonormal(rng.normal(size=(dims, min(dims, 2 * wanted + 2))), locked)
    image = product(space)
    none = PRECISION * dims * max(trace, 0.0)
    probes = 0
    for _ in range(ROUNDS * wanted):
        h = space.T @ image
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        top = max([*values, *theta[:1], 0.0])
        open_ = min(wanted - len(values), len(theta))
        limit = max(PRECISION * max(dims, 16) * top, 1e-300)
        u = space @ s[:, :open_]
        r = _against(image @ s[:, :open_] - u * theta[:open_], locked)
        size = np.linalg.norm(r, axis=0)
        full = space.shape[1] + len(values) >= dims  # the subspace is everything: Ritz pairs are exact
        done = 0
        while done < open_ and (size[done] <= limit or full):
            done += 1
        if done:  # in order only, so that numbers follow the eigenvalues
            found = _orthonormal(u[:, :done], locked)
            locked, values = np.hstack([locked, found]), np.append(values, theta[:done])
            space, image = space @ s[:, done:], image @ s[:, done:]
            space, theta, s = space[:, :], theta[done:], np.eye(space.shape[1])
        if len(values) >= wanted or not space.shape[1] or (len(theta) and theta[0] <= none and full):
            larger = len(theta) and theta[0] > values.min() * (1 + 1e-12) if len(values) else False
            if full or (not larger and probes >= PROBES):
                break
            if larger:  # a direction that was missed: what is below it is sought again
                stay = values >= theta[0]
                space, image = np.hstack([space, locked[:, ~stay]]), np.hstack([image, locked[:, ~stay] * values[~stay]])
                locked, values = locked[:, stay], values[stay]
                continue
            probes += 1
            new = rng.normal(size=(dims, wanted))
            for _power in range(2):  # random directions, turned towards large eigenvalues
                new = product(_orthonormal(_against(new, locked), locked))
        else:
            if done:
                continue
            if space.shape[1] > WIDEST * wanted:  # restart with the best of the subspace
                keep = 3 * wanted
                space, image = space @ s[:, :keep], image @ s[:, :keep]
            new = minres(product, theta[:open_], [np.hstack([locked, u])] * open_, -r, INNER, INNER_TOLERANCE)
        new = _orthonormal(_against(new, locked), np.hstack([locked, space]))
        if not new.shape[1]:
            new = _orthonormal(rng.normal(size=(dims, wanted)), np.hstack([locked, space]))
        if new.shape[1]:
            space, image = np.hstack([space, new]), np.hstack([image, product(new)])
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > none]
    vectors = locked[:, order]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]) if vectors.size else np.ones(vectors.shape[1])
    return values[order], vectors * sign


# ---- operator -------------------------------------------------------------------------------------


@dataclass
class Whitening:
    n: int  # distinct vectors
    sums: list[int]  # exact, per dimension
    values: np.ndarray
    vectors: np.ndarray  # dims x components
    trace: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _sums(x: np.ndarray) -> tuple[int, list[int]]:
    small = x.dtype.itemsize < 8
    return len(x), [int(v) for v in x.sum(axis=0, dtype=np.int64)] if small else [sum(map(int, c)) for c in x.T]


def fit(rows: DataFrame, wanted: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> Whitening | None:
    """Components of the fit list of ``rows``; None without a usable row."""
    x = quantised(rows, id_col, vector_col)
    size = x.groupBy(F.length("x").alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("b")).first()
    if size is None:
        return None
    dims = size.b // 8
    blocks = Blocks(saved(packed(x.where(F.length("x") == size.b).select("x").distinct(), dims), "fit-list"), dims)
    try:
        n, sums = blocks.gather(_sums, lambda a, b: (a[0] + b[0], [p + q for p, q in zip(a[1], b[1], strict=True)]))
        mean = np.array([s / n for s in sums])
        trace = float(blocks.gather(lambda b: ((b - mean) ** 2).sum())) / n
        if not trace > 0:
            return Whitening(n, sums, np.zeros(0), np.zeros((dims, 0)), 0.0, 0.0)
        values, vectors = jacobi_davidson(lambda w: blocks.product(mean, w, n), dims, wanted, trace)
        to = vectors / np.sqrt(values)

        def second(b):
            w = (b - mean) @ to
            return np.vstack([w.T @ w, w.sum(axis=0)])

        moments = blocks.gather(second) / n
        off = moments[:-1] - np.outer(moments[-1], moments[-1]) - np.eye(len(values))
        return Whitening(n, sums, values, vectors, trace, float(np.abs(off).max()) if off.size else 0.0)
    finally:
        blocks.table.unpersist()


RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, "
          "deviation_wide decimal(38,0)")


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sum over dimensions of (n * x - S) ** 2 of each row."""
    most = max(abs(n * v - s) for e in (x.min(axis=0), x.max(axis=0)) for v, s in zip(e.tolist(), sums, strict=True))
    if most * most * x.shape[1] < 2 ** 62 and n * int(np.abs(x.astype(object)).max()) < 2 ** 62:
        d = n * x.astype(np.int64) - np.array(sums, np.int64)
        return (d * d).sum(axis=1).tolist()
    return [sum((n * v - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in x.tolist()]


def whiten(rows: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each usable row and component: see ``RESULT``."""
    spark = rows.sparkSession
    if model is None or not len(model.values):
        return spark.createDataFrame([], RESULT)
    held = spark.sparkContext.broadcast(model)  # dimensions x components numbers
    dims, k = model.vectors.shape

    def run(batches):
        import decimal

        decimal.getcontext().prec = 60
        m = held.value
        mean, to, share = m.mean, m.vectors / np.sqrt(m.values), m.values / m.trace
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x = np.frombuffer(b"".join(part.column("x").to_pylist()), "<i8").reshape(-1, dims)
                far = _deviations(x, m.n, m.sums)
                each = np.repeat(np.arange(len(x)), k)
                wide = [decimal.Decimal(v) if v < 10 ** 38 else None for v in far]
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), m.n, np.int64)), pa.array([v if v < 2 ** 63 else None for v in far], pa.int64()).take(pa.array(each)),
                    pa.array(((x - mean) @ to).reshape(-1)), pa.array(np.tile(share, len(x))), pa.array(np.full(len(each), m.identity_error)),
                    pa.array(wide, pa.decimal128(38, 0)).take(pa.array(each))], names=[c.split()[0] for c in RESULT.split(", ")])

    x = quantised(rows, id_col, vector_col).where(F.length("x") == 8 * dims)
    return x.mapInArrow(run, RESULT)
