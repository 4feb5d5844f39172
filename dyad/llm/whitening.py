"""Whitening of embeddings by their leading principal components, found by a block Jacobi-Davidson method.

The covariance is never formed. A product with it is one pass: every task centres its rows,
multiplies them by a few vectors and adds up, and the sums of the tasks are added. On the driver
lies a subspace of a few dozen vectors. Its Rayleigh-Ritz values and vectors are refined by
corrections, each from the projected equation (I - QQ')(V - theta)(I - QQ') t = -r, solved inexactly by MINRES, whose
every step is one more pass, shared by all wanted vectors. A vector whose residual has reached
double precision is locked: it leaves the subspace, and later ones stay orthogonal to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyad.llm import store

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LARGEST = 2.0**40  # of an entry: integers beyond lose the exactness the result promises
SLICE_VALUES = 1 << 20
DIRECT = 256  # tasks whose sums the driver adds up itself
INNER = 6
ROUNDS = 200


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column("v").cast(pa.list_(pa.float64()))
        sizes = np.asarray(vectors.value_lengths().fill_null(0), np.int64)
        values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        bad = sizes == 0
        bad[np.repeat(np.arange(len(sizes)), sizes)[~np.isfinite(values)]] = True
        good = values[np.repeat(~bad, sizes)]
        if len(good) and np.abs(good).max() > LARGEST:
            raise ValueError("an embedding has an entry beyond 2**40")
        sizes = sizes[~bad]
        x = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.floor(SCALE * good).astype(np.int64) + SHIFT))
        yield pa.record_batch([batch.column("vec_id").filter(pa.array(~bad)), x], names=["vec_id", "x"])


def _rows(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """The integer vectors as matrices of bounded size."""
    step = max(SLICE_VALUES // d, 1)
    for batch in batches:
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            yield part.column("x").flatten().to_numpy().reshape(-1, d), part


@dataclass(frozen=True)
class Centre:
    """The exact mean: whole part and rest of each sum over the number of rows."""
    n: int
    whole: np.ndarray
    rest: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> np.ndarray | list[int]:
        """For each row the sum over dimensions of (n x - S)**2, exact."""
        off = x - self.whole
        if len(off) and x.shape[1] * ((int(np.abs(off).max()) + 1) * self.n) ** 2 < 2**63:
            return ((self.n * off - self.rest) ** 2).sum(axis=1)
        wide = self.n * off.astype(object) - self.rest.astype(object)
        return (wide**2).sum(axis=1).tolist() if len(off) else []


def _sum_of(table: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray], length: int) -> np.ndarray:
    """The sum over all tasks of the vector of `length` doubles that each makes of its rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([pa.array([part(batches)], pa.list_(pa.float64()))], names=["s"])

    sums = table.mapInArrow(run, "s array<double>")
    if table.rdd.getNumPartitions() > DIRECT:
        each = sums.select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
        found = each.toArrow()
        out = np.zeros(length)
        out[np.asarray(found.column("i"))] = np.asarray(found.column("v"))
        return out
    found = sums.toArrow().column("s").combine_chunks()
    parts = np.asarray(found.flatten()).reshape(-1, length)
    return parts[np.lexsort(parts.T[:1])].sum(axis=0)


def _measured(table: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """Number of rows and the exact sum of every dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, np.int64)
        for x, _ in _rows(batches, d):
            n, total = n + len(x), total + x.sum(axis=0)
        yield pa.record_batch([pa.array(np.arange(d + 1), pa.int32()), pa.array(np.append(total, n))], names=["i", "v"])
    sums = table.mapInArrow(run, "i int, v long").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toArrow().column("v").to_pylist()
    return sums[-1], np.array(sums[:-1], np.int64)


def products(table: DataFrame, centre: Centre, d: int) -> Callable[[np.ndarray], np.ndarray]:
    """B to V B for the covariance V of the rows, centred before multiplying; each call is one pass."""
    def product(block: np.ndarray) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            total = np.zeros((d, block.shape[1]))
            for x, _ in _rows(batches, d):
                y = centre.of(x)
                total += y.T @ (y @ block)
            return total.ravel()
        return _sum_of(table, part, d * block.shape[1]).reshape(d, -1) / centre.n
    return product


def _trace(table: DataFrame, centre: Centre, d: int) -> float:
    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        return np.array([sum((centre.of(x) ** 2).sum() for x, _ in _rows(batches, d))], float)
    return float(_sum_of(table, part, 1)[0]) / centre.n


def minres(operator: Callable[[np.ndarray], np.ndarray], rhs: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """Approximate solutions of operator(x) = rhs for all columns at once; the operator is symmetric for each."""
    beta = np.linalg.norm(rhs, axis=0)
    start = np.where(beta > 0, beta, 1)
    x, v, before, w, w_before = (np.zeros_like(rhs) for _ in range(5))
    v = rhs / start
    eta, last = beta.copy(), np.zeros_like(beta)
    c = c_before = np.ones_like(beta)
    s = s_before = np.zeros_like(beta)
    for _ in range(steps):
        if (np.abs(eta) <= tolerance * start).all():
            break
        p = operator(v) - last * before
        alpha = (v * p).sum(axis=0)
        p -= alpha * v
        following = np.linalg.norm(p, axis=0)
        delta = c * alpha - c_before * s * last
        rho = np.hypot(delta, following)
        live = rho > 0
        safe = np.where(live, rho, 1)
        w_next = (v - (s_before * last) * w_before - (s * alpha + c_before * c * last) * w) / safe
        c_before, s_before, c, s = c, s, np.where(live, delta / safe, 1), np.where(live, following / safe, 0)
        x = x + np.where(live, c * eta, 0) * w_next
        eta = np.where(live, -s * eta, 0)
        before, v, last, w_before, w = v, np.where(following > 0, p / np.where(following > 0, following, 1), 0), following, w, w_next
    return x


def _orthonormal(block: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the block outside the given orthonormal columns; directions lost to rounding are left out."""
    for _ in range(3):
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 0] / size[size > 0]
        for q in against:
            block = block - q @ (q.T @ block)
        block = block[:, np.linalg.norm(block, axis=0) > 1e-10]
        if not block.shape[1]:
            return block
        u, s, _ = np.linalg.svd(block / np.linalg.norm(block, axis=0), full_matrices=False)
        block = u[:, s > 1e-8]
    return block


def leading(product: Callable[[np.ndarray], np.ndarray], d: int, k: int = COMPONENTS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and unit eigenvectors, of a symmetric operator given by its products."""
    k = min(k, d)
    locked, values = np.zeros((d, 0)), np.zeros(0)
    basis = _orthonormal(np.random.default_rng(seed).standard_normal((d, min(d, 2 * k))))
    image = product(basis)
    best, stuck = np.inf, 0
    for _ in range(ROUNDS):
        inner = basis.T @ image
        theta, y = np.linalg.eigh((inner + inner.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        basis, image = basis @ y, image @ y
        want = k - len(values)
        u, residual = basis[:, :want], image[:, :want] - basis[:, :want] * theta[:want]
        residual = residual - locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        largest = max(theta[0], values.max(initial=0))
        fine = 8 * np.finfo(float).eps * np.sqrt(d) * max(largest, 0)
        whole = basis.shape[1] >= d - len(values)  # the subspace is all there is: nothing is left to correct
        worst = size.max(initial=0)
        best, stuck = (worst, 0) if worst < 0.5 * best else (best, stuck + 1)
        good = size <= (fine if stuck < 8 else 16 * fine)  # the sums of very many rows may round to no less
        done = want if whole or good.all() else int(np.argmin(good))
        if done:
            locked, values = np.hstack([locked, basis[:, :done]]), np.append(values, theta[:done])
            basis, image, u, residual, theta = basis[:, done:], image[:, done:], u[:, done:], residual[:, done:], theta[done:]
            best, stuck = np.inf, 0
            if len(values) == k:
                order = np.argsort(-values, kind="stable")
                return values[order], locked[:, order]
            want -= done
        if basis.shape[1] > 8 * k:
            basis, image = basis[:, :3 * k], image[:, :3 * k]
        shift = theta[:want]
        q = np.hstack([locked, u])
        outside = lambda b: b - q @ (q.T @ b)
        step = minres(lambda b: outside(product(b) - b * shift), -outside(residual), INNER, 0.05)
        more = _orthonormal(step, locked, basis)
        if not more.shape[1]:  # nothing new: the corrections are lost in rounding
            more = _orthonormal(np.random.default_rng(seed + len(values)).standard_normal((d, want)), locked, basis)
        basis, image = np.hstack([basis, more]), np.hstack([image, product(more)])
    raise ArithmeticError("the components did not converge")


@dataclass(frozen=True)
class Whitener:
    """What whitening needs of the fit list: its centre, eigenvalues, eigenvectors (columns) and the trace of the covariance."""
    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def of(self, x: np.ndarray) -> np.ndarray:
        return self.centre.of(x) @ self.vectors / np.sqrt(self.values)


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, x) of the rows that have a vector of finite entries, x = floor(1024 entry) + 100000; and the number of dimensions."""
    source = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    kind = source.schema["vec_id"].dataType.simpleString()
    table, _ = store.kept(source.mapInArrow(_integers, f"vec_id {kind}, x array<long>"), "integers")
    low, high = table.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if low != high:
        raise ValueError(f"embeddings of {low} and of {high} dimensions cannot be whitened together")
    return table, low or 0


def fitted(table: DataFrame, d: int, k: int = COMPONENTS) -> Whitener:
    """The first k components of the rows of `integers`; directions without variance are none."""
    n, sums = _measured(table, d)
    centre = Centre(n, sums // n, sums % n)
    trace = _trace(table, centre, d)
    values, vectors = leading(products(table, centre, d), d, k) if trace > 0 else (np.zeros(0), np.zeros((d, 0)))
    some = values > d * np.finfo(float).eps * trace
    return Whitener(centre, values[some], vectors[:, some], trace)


def identity_error(table: DataFrame, d: int, white: Whitener) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    k = len(white.values)
    if not k:
        return 0.0

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((k + 1, k))
        for x, _ in _rows(batches, d):
            w = white.of(x)
            total[0] += w.sum(axis=0)
            total[1:] += w.T @ w
        return total.ravel()
    total = _sum_of(table, part, (k + 1) * k).reshape(k + 1, k) / white.centre.n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(k)).max(initial=0))


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """For each row with a whole vector and each of k components: vec_id, component, n, deviation, whitened, explained, identity_error.

    A vector that is null or empty or has a null or non-finite entry is left out. Other columns are
    not read; rows without an id and rows of one id are rows like others. deviation is decimal, since
    it may pass 64 bits. Vectors of unequal length and entries beyond 2**40 are refused. A direction without
    variance has no component, so equal vectors alone give no rows. Empty in, empty out.
    """
    table, d = integers(vectors, id_col, vector_col)
    kind = table.schema["vec_id"].dataType.simpleString()
    form = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not d:
        return table.sparkSession.createDataFrame([], form)
    white = fitted(table, d, k)
    error = identity_error(table, d, white)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(white.values)
        for x, part in _rows(batches, d):
            each = np.repeat(np.arange(len(x)), k)
            far = white.centre.deviations(x)
            far = pa.array([int(v) for v in far], pa.decimal128(38, 0))
            m = len(each)
            yield pa.record_batch([part.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                                   pa.array(np.full(m, white.centre.n)), far.take(pa.array(each)), pa.array(white.of(x).ravel()),
                                   pa.array(np.tile(white.values / white.trace, len(x)) if k else np.zeros(0)), pa.array(np.full(m, error))],
                                  names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return table.mapInArrow(run, form)
