"""Embedding whitening by Jacobi-Davidson on a covariance that is never formed.

Vectors become whole numbers x. The covariance of the distinct ones acts on a block of directions U
as sum (x - mean) ((x - mean)' U) / n: each task adds up its part, and parts are added in two steps, so
the driver gets a few matrices of one column a direction. Around these products runs a block
Jacobi-Davidson iteration for the largest eigenvalues: Rayleigh-Ritz in a small subspace, for each
wanted pair a correction equation projected off the pair and the locked ones, solved by MINRES (the columns of
all pairs in one product), the corrections join the subspace, and pairs are locked from the top once their residual
is at rounding. A subspace that is full starts again from its best directions.

The driver holds matrices of dim x (subspace) doubles, whatever the number of vectors.

Cases: vectors that are null, empty or hold a null or non-finite component are dropped; a null vec_id is
kept; vectors of different lengths are whitened apart, each length by its own fit; repeated vectors count
once in the fit and get a row each; fewer dimensions than components: as many components as dimensions; a
component without variance has null whitened values and explained 0; entries and deviations beyond a long are
cut to its range; equal eigenvalues: any orthonormal choice; an empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import Workspace

COMPONENTS, SCALE, SEED = 4, 256, 20240311
#: Numbers of a block of packed vectors.
BLOCK = 1 << 18
#: Products of a correction at most, the size at which a subspace starts again, and the rounding of a residual in units of the largest eigenvalue.
INNER, FULL, ROUNDING = 4, 64, 2e-14
#: Pairs that are corrected at once, and directions at the start, for each component: a product costs a pass over the data, its columns little.
ASIDE, START = 3, 8
LONG = (1 << 63) - 1


# --- the iteration, on matrices of a few columns -------------------------------------------


def minres(apply, b: np.ndarray, steps: int, tol: np.ndarray) -> np.ndarray:
    """Solutions x of apply(x) = b, column by column with one symmetric operator each, by at most ``steps`` products."""
    size = np.linalg.norm(b, axis=0)
    v, v_old = b / np.where(size > 0, size, 1), np.zeros_like(b)
    w, w_old, x = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    eta, beta = size.copy(), np.zeros(b.shape[1])
    c, c_old, s, s_old = np.ones_like(size), np.ones_like(size), np.zeros_like(size), np.zeros_like(size)
    for _ in range(steps):
        p = apply(v)
        alpha = (v * p).sum(0)
        p = p - alpha * v - beta * v_old
        beta_new = np.linalg.norm(p, axis=0)
        r0 = c * alpha - c_old * s * beta
        r1 = np.hypot(r0, beta_new)
        r1 = np.where(r1 > 0, r1, 1)
        r2, r3 = s * alpha + c_old * c * beta, s_old * beta
        c_old, s_old, c, s = c, s, r0 / r1, beta_new / r1
        w_old, w = w, (v - r3 * w_old - r2 * w) / r1
        x = x + c * eta * w
        eta = -s * eta
        v_old, v, beta = v, p / np.where(beta_new > 0, beta_new, 1), beta_new
        if (np.abs(eta) <= tol).all():
            break
    return x


def _orthonormal(new: np.ndarray, old: np.ndarray) -> np.ndarray:
    """Directions of ``new`` beyond ``old`` (orthonormal), those that only rounding holds left out."""
    out = old[:, :0]
    for col in new.T:
        size = np.linalg.norm(col)
        if not size:
            continue
        col = col / size
        for _ in range(3):
            for base in (old, out):
                col = col - base @ (base.T @ col)
            left = np.linalg.norm(col)
            if left < 1e-10:
                break
            col = col / left
        else:
            out = np.column_stack([out, col])
    return out


def largest(product, dim: int, k: int, seed: int = SEED, inner: int = INNER, full: int = FULL, most: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """(values, unit vectors as columns) of the k largest eigenvalues of a symmetric positive operator, given by its product with a matrix."""
    rng = np.random.default_rng(seed)
    k = min(k, dim)
    q, values = np.zeros((dim, 0)), []
    v = _orthonormal(rng.standard_normal((dim, min(dim, START * k))), q)
    av, past = product(v), []
    for _ in range(most):
        theta, y = np.linalg.eigh((v.T @ av + av.T @ v) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        u, au = v @ y, av @ y
        wanted = k - len(values)
        r = au[:, :wanted] - u[:, :wanted] * theta[:wanted]
        r = r - q @ (q.T @ r)
        left, scale = np.linalg.norm(r, axis=0), max([abs(theta[0]), *values, 0.0])
        past.append(float(left[0]) if len(left) else 0.0)
        # at rounding: under the bound, or small and no longer falling
        still = len(past) > 3 and min(past[-3:]) >= 0.5 * min(past[:-3])
        whole = v.shape[1] + q.shape[1] >= dim
        done = 0
        while done < min(wanted, u.shape[1]) and (whole or left[done] <= ROUNDING * scale or (still and left[done] <= 1e-12 * scale)):
            done += 1
        if done:
            q, values, past = np.column_stack([q, u[:, :done]]), values + theta[:done].tolist(), []
            u, au, theta, r, left = u[:, done:], au[:, done:], theta[done:], r[:, done:], left[done:]
            wanted -= done
        if not wanted:
            break
        v, av = (u, au) if u.shape[1] + ASIDE * k <= max(full, 8 * k) else (u[:, : max(full, 8 * k) // 2], au[:, : max(full, 8 * k) // 2])
        # pairs behind the wanted ones are corrected as well
        near = min(ASIDE * k, u.shape[1])
        t, ritz, shift = u[:, :near], u[:, :near], theta[:near]
        r = au[:, :near] - ritz * shift
        r = r - q @ (q.T @ r)

        def off(x):
            x = x - q @ (q.T @ x)
            return x - ritz * (ritz * x).sum(0)

        if r.any():
            t = minres(lambda x: off(product(off(x)) - shift * off(x)), -off(r), inner, 0.05 * np.linalg.norm(r, axis=0))
        new = _orthonormal(np.column_stack([t, rng.standard_normal((dim, 1))]) if past and still else t, np.column_stack([q, v]))
        if not new.shape[1]:
            new = _orthonormal(rng.standard_normal((dim, wanted)), np.column_stack([q, v]))
        v, av = np.column_stack([v, new]), np.column_stack([av, product(new)])
    else:
        raise ArithmeticError(f"no convergence in {most} rounds")
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], q[:, order]


# --- distributed sums over packed vectors -------------------------------------------------


def _pack(numbers: int):
    """Vectors of one length as blocks of whole numbers."""

    def run(batches):
        held: dict[int, list] = {}

        def out(dim):
            m = np.concatenate(held.pop(dim))
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "n": pa.array([len(m)], pa.int64()), "data": pa.array([m.tobytes()], pa.binary())})

        for batch in batches:
            dims = np.diff(batch["x"].offsets.to_numpy())
            for dim in np.unique(dims).tolist():
                m = batch.filter(pa.array(dims == dim))["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                step = max(1, numbers // dim)
                for at in range(0, len(m), step):
                    held.setdefault(dim, []).append(m[at : at + step])
                    if sum(map(len, held[dim])) >= step:
                        yield out(dim)
        for dim in list(held):
            yield out(dim)

    return run


def _exact_sums(batches):
    """Sums of whole numbers for each length, as text, so that none overflows."""
    sums: dict[int, list] = {}
    for batch in batches:
        for dim, data in zip(batch["dim"].to_pylist(), batch["data"]):
            m = np.frombuffer(data.as_py(), np.int64).reshape(-1, dim)
            fits = int(np.abs(m.astype(np.float64)).max(initial=0)) * len(m) < 1 << 62
            own = (m if fits else m.astype(object)).sum(0)
            sums[dim] = [int(a) + b for a, b in zip(own, sums.get(dim, [0] * dim))]
    for dim, s in sums.items():
        yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "s": [[str(x) for x in s]]})


def _matrix_sums(batches):
    total = None
    for batch in batches:
        for data in batch["m"]:
            m = np.frombuffer(data.as_py(), np.float64)
            total = m if total is None else total + m
    if total is not None:
        yield pa.RecordBatch.from_pydict({"m": pa.array([total.tobytes()], pa.binary())})


class Covariance:
    """Products with the covariance of packed vectors of one length."""

    def __init__(self, blocks: DataFrame, dim: int, n: int, sums: list[int]):
        self.blocks, self.dim, self.n, self.mean = blocks.where(F.col("dim") == dim).select("data"), dim, n, np.array([s / n for s in sums])
        self.files = len(blocks.inputFiles())

    def total(self, of) -> np.ndarray:
        """The sum of ``of(centred vectors)``, a flat array, over all vectors."""
        dim, mean = self.dim, self.mean

        def run(batches):
            total = None
            for batch in batches:
                for data in batch["data"]:
                    m = of(np.frombuffer(data.as_py(), np.int64).reshape(-1, dim) - mean)
                    total = m if total is None else total + m
            if total is not None:
                yield pa.RecordBatch.from_pydict({"m": pa.array([total.tobytes()], pa.binary())})

        parts = self.blocks.mapInArrow(run, "m binary")
        if self.files > 64:  # no more than about the root of the parts come to the driver
            parts = parts.repartition(int(self.files**0.5)).mapInArrow(_matrix_sums, "m binary")
        rows = sorted(bytes(r["m"]) for r in parts.collect())
        return np.sum([np.frombuffer(r, np.float64) for r in rows], 0)

    def product(self, u: np.ndarray) -> np.ndarray:
        return self.total(lambda x: (x.T @ (x @ u)).ravel()).reshape(self.dim, -1) / self.n

    def trace(self) -> float:
        return float(self.total(lambda x: np.array([(x * x).sum()]))[0] / self.n)

    def identity_error(self, w: np.ndarray) -> float:
        """Largest absolute entry of the covariance of the projections by ``w``, centred anew, less the identity."""
        middle = self.total(lambda x: (x @ w).sum(0)) / self.n
        c = self.total(lambda x: ((x @ w - middle).T @ (x @ w - middle)).ravel()).reshape(w.shape[1], -1) / self.n
        return float(np.abs(c - np.eye(w.shape[1])).max(initial=0))


class Fit:
    """What projects vectors of one length: exact count and sums, directions over the root of their variance."""

    def __init__(self, n: int, sums: list[int], mean: np.ndarray, w: np.ndarray, explained: np.ndarray, error: float):
        self.n, self.sums, self.mean, self.w, self.explained, self.error = n, sums, mean, w, explained, error


def fit(blocks: DataFrame, k: int = COMPONENTS) -> dict[int, Fit]:
    """A fit for each length of vectors in ``blocks`` (dim, n, data: packed whole numbers, each vector once)."""
    out = {}
    counts = {r["dim"]: r["n"] for r in blocks.groupBy("dim").agg(F.sum("n").alias("n")).collect()}  # one row for each length
    sums: dict[int, list[int]] = {}
    for r in blocks.mapInArrow(_exact_sums, "dim int, s array<string>").collect():
        sums[r["dim"]] = [int(a) + b for a, b in zip(r["s"], sums.get(r["dim"], [0] * r["dim"]))]
    for dim, n in sorted(counts.items()):
        cov = Covariance(blocks, dim, n, sums[dim])
        trace, most = cov.trace(), min(k, dim)
        w, explained, error = np.full((dim, most), np.nan), np.zeros(most), 0.0
        if trace > 0:
            values, vectors = largest(cov.product, dim, k)
            real = values > 1e-13 * trace
            w[:, real], explained = vectors[:, real] / np.sqrt(values[real]), np.where(real, values / trace, 0.0)
            error = cov.identity_error(w[:, real])
        out[dim] = Fit(n, sums[dim], cov.mean, w, explained, error)
    return out


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Sums of squares of n * x - S, in whole numbers, cut to a long."""
    reach = n * int(np.abs(x.astype(np.float64)).max(initial=0)) + max(map(abs, sums))
    if reach * reach * x.shape[1] < 1 << 62:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1)
    exact = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(1)
    return np.array([min(int(v), LONG) for v in exact], np.int64)


_ROW = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _project(fits: dict[int, Fit]):
    def run(batches):
        for batch in batches:
            dims = np.diff(batch["x"].offsets.to_numpy())
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x, f = part["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), fits[dim]
                k = f.w.shape[1]
                white = ((x - f.mean) @ f.w).ravel()
                rows = np.repeat(np.arange(len(x)), k)
                cols = [part["id"].take(pa.array(rows)), np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), np.full(len(rows), f.n), _deviations(x, f.n, f.sums)[rows]]
                cols += [pa.array(white, mask=np.isnan(white)), np.tile(f.explained, len(x)), np.full(len(rows), f.error)]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], names=[c.split(" ")[0] for c in _ROW.split(", ")])

    return run


def whiten(vectors: DataFrame, k: int = COMPONENTS, scale: float = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row and component."""
    ws = Workspace(vectors.sparkSession, "whitening")
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    fine = (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.coalesce(fine, F.lit(False))).select("id", F.transform("vec", lambda x: F.floor(x * F.lit(float(scale)))).cast("array<long>").alias("x"))
    rows = ws.save(v, "rows")
    blocks = ws.save(rows.select("x").distinct().mapInArrow(_pack(BLOCK), "dim int, n long, data binary"), "fit")
    return rows.mapInArrow(_project(fit(blocks, k)), _ROW)


def op12_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
