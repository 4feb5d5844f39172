"""Cross-fitted multinomial logistic models of several feature sets, fitted side by side.

Rows are packed once, as blocks of numbers. A pass over the blocks gives loss and gradient of every model (feature set x
fold left out), a last one the held-out losses; the driver holds coefficients and moments only. The objective is that of
`pyspark.ml`: mean log-loss and a ridge on the coefficients of standardised features, intercepts free.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyad.session import carried, settle

carried(__name__)
FLOOR = 1e-9
RIDGE = 1e-3
# Half the squared Newton decrement: what the mean log-loss may still be above its least.
TOLERANCE = 1e-12
PASSES = 60


def packed(df: DataFrame, features: list[str], label: Column, fold: Column) -> DataFrame:
    """Blocks of rows, written once: features (null is zero), label and fold, -1 where null."""
    known = lambda c: F.coalesce(c.cast("int"), F.lit(-1))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
            x, rest = np.stack(columns[:-2]), np.stack(columns[-2:])
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (x.astype(float), rest.astype(np.int32))], names=["x", "given"])

    rows = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features], known(label).alias("__y"), known(fold).alias("__fold"))
    return settle(rows.mapInArrow(pack, "x binary, given binary"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        for x, given in zip(b.column("x"), b.column("given"), strict=True):
            y, fold = np.frombuffer(given.as_py(), np.int32).reshape(2, -1)
            yield np.frombuffer(x.as_py()).reshape(-1, len(y)), y, fold


def _pass(blocks: DataFrame, size: int, add: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """The sum over all blocks of what `add` puts into an array of `size` numbers."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for x, y, fold in _blocks(batches):
            add(total, x, y, fold)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = blocks.mapInArrow(summed, "sums binary").toArrow()["sums"]  # one small row per task
    return sum((np.frombuffer(p.as_py()) for p in parts), np.zeros(size))


def _log_chances(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Log-probabilities by class (rows) of observations (columns); the last column of `beta` is the intercept."""
    z = beta[:, :-1] @ x + beta[:, -1:]
    z -= z.max(axis=0)
    z -= np.log(np.exp(z).sum(axis=0))
    return z


class _Fit:
    """A model on its way: quasi-Newton steps from the curvature of the model without features."""

    def __init__(self, n: float, mean: np.ndarray, square: np.ndarray, classes: np.ndarray, ridge: float):
        self.n, self.mean, self.alive = n, mean, np.flatnonzero(classes > 0)
        cov = square / n - np.outer(mean, mean)
        deviation = np.sqrt(np.maximum(np.diag(cov), 0) * n / max(n - 1, 1))
        self.deviation = np.where(deviation > 1e-12 * (1 + np.abs(mean)), deviation, np.inf)
        share = classes[self.alive] / n
        k, d = len(share), len(mean)
        self.penalty = np.append(np.where(np.isfinite(self.deviation), ridge, 0.0), 0.0)
        z = np.zeros((d + 1, d + 1))
        z[:d, :d], z[d, d] = cov / np.outer(self.deviation, self.deviation), 1.0
        values, basis = np.linalg.eigh(np.kron(np.diag(share) - np.outer(share, share), z) + np.diag(np.tile(self.penalty, k)))
        self.inverse = basis * np.where(values > 1e-9, 1 / np.where(values > 1e-9, values, 1), 0) @ basis.T
        self.at = np.zeros((k, d + 1))
        self.at[:, -1] = np.log(share)
        self.best = self.value = self.gradient = self.way = None
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.done = k < 2

    def beta(self, classes: int) -> np.ndarray:
        """Coefficients of the features as they are; a class never seen has no chance."""
        out = np.zeros((classes, len(self.mean) + 1))
        out[:, -1] = -1e6
        slope = self.at[:, :-1] / self.deviation
        out[self.alive, :-1], out[self.alive, -1] = slope, self.at[:, -1] - slope @ self.mean
        return out

    def told(self, loss: float, raw: np.ndarray) -> None:
        """Takes the summed loss and gradient at `at`, and moves on."""
        g = raw[self.alive] / self.n
        g[:, :-1] = (g[:, :-1] - np.outer(g[:, -1], self.mean)) / self.deviation
        value = loss / self.n + (self.penalty * self.at**2).sum() / 2
        g = (g + self.penalty * self.at).ravel()
        if self.best is not None and value > self.value + 1e-4 * (self.gradient @ self.way) + 1e-15:
            self.way = self.way / 2
            self.done = np.abs(self.way).max() < 1e-12
            self.at = self.best if self.done else self.best + self.way.reshape(self.at.shape)
            return
        if self.best is not None:
            step, change = (self.at - self.best).ravel(), g - self.gradient
            if step @ change > 0:
                self.pairs = [*self.pairs[-9:], (step, change)]
        self.best, self.value, self.gradient = self.at, value, g
        q, held = g.copy(), []
        for s, c in reversed(self.pairs):
            held.append((s @ q) / (s @ c))
            q -= held[-1] * c
        q = self.inverse @ q
        for (s, c), a in zip(self.pairs, reversed(held), strict=True):
            q += (a - (c @ q) / (s @ c)) * s
        self.way = -q
        self.done = g @ q / 2 < TOLERANCE
        self.at = self.best if self.done else self.best + self.way.reshape(self.at.shape)


def held_out_losses(df: DataFrame, sets: dict[str, list[str]], label: Column, fold: Column, classes: int, folds: int, ridge: float = RIDGE) -> dict[str, tuple[int, float | None]]:
    """For each feature set the number of rows and the mean log-loss of rows scored by a model that never saw their fold.

    Rows without a fold teach none and have the mean chance of the fold models. Rows without a label, or in a fold without other rows to learn from, count but have no loss.
    """
    names = list(dict.fromkeys(f for fs in sets.values() for f in fs))
    where = {v: np.array([names.index(f) for f in fs]) for v, fs in sets.items()}
    blocks, d = packed(df, names, label, F.pmod(fold, F.lit(folds))), len(names)
    width = 2 + d + d * d + classes

    def moments(total, x, y, fold):
        total[-1] += len(y)
        for f in range(folds):
            m = (fold == f) & (y >= 0)
            own, part = x[:, m], total[f * width:(f + 1) * width]
            part[0] += m.sum()
            part[2:2 + d] += own.sum(axis=1)
            part[2 + d:2 + d + d * d] += (own @ own.T).ravel()
            part[2 + d + d * d:] += np.bincount(y[m], minlength=classes)

    sums = _pass(blocks, folds * width + 1, moments)
    rows, sums = int(sums[-1]), sums[:-1].reshape(folds, width)
    fits: dict[tuple[str, int], _Fit] = {}
    for f in range(folds):
        rest = sums.sum(axis=0) - sums[f]
        if rest[0] > 0:
            square = rest[2 + d:2 + d + d * d].reshape(d, d)
            for v, at in where.items():
                fits[v, f] = _Fit(rest[0], rest[2:2 + d][at] / rest[0], square[np.ix_(at, at)], rest[2 + d + d * d:], ridge)

    for _ in range(PASSES):
        moving = {key: fit.beta(classes) for key, fit in fits.items() if not fit.done}
        if not moving:
            break
        ends = np.cumsum([1 + b.size for b in moving.values()])

        def slopes(total, x, y, fold, moving=moving, ends=ends):
            for ((v, f), beta), end in zip(moving.items(), ends, strict=True):
                m = (fold != f) & (fold >= 0) & (y >= 0)
                own, seen = x[np.ix_(where[v], m)], y[m]
                z = _log_chances(own, beta)
                at = np.arange(len(seen))
                part = total[end - 1 - beta.size:end]
                part[0] -= z[seen, at].sum()
                g = np.exp(z)
                g[seen, at] -= 1
                part[1:] += np.column_stack([g @ own.T, g.sum(axis=1)]).ravel()

        found = _pass(blocks, int(ends[-1]), slopes)
        for (key, beta), end in zip(moving.items(), ends, strict=True):
            fits[key].told(found[end - 1 - beta.size], found[end - beta.size:end].reshape(beta.shape))

    final, order = {key: fit.beta(classes) for key, fit in fits.items()}, list(sets)

    def losses(total, x, y, fold):
        for i, v in enumerate(order):
            for f in range(-1, folds):
                models = [final[v, g] for g in (range(folds) if f < 0 else [f]) if (v, g) in final]
                m = (fold == f) & (y >= 0)
                if not models or not m.any():
                    continue
                own, at = x[np.ix_(where[v], m)], np.arange(m.sum())
                chance = sum(np.exp(_log_chances(own, b)[y[m], at]) for b in models) / len(models)
                total[2 * i] -= np.log(np.maximum(chance, FLOOR)).sum()
                total[2 * i + 1] += m.sum()

    total = _pass(blocks, 2 * len(order), losses)
    return {v: (rows, float(total[2 * i] / total[2 * i + 1]) if total[2 * i + 1] else None) for i, v in enumerate(order)}
