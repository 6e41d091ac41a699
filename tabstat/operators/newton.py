"""Many penalised logistic fits at once, for two or more classes.

All models of a batch share some features and differ in one candidate feature
and in the fold they leave out, as the steps of a forward selection do. One
Newton step of all of them is one pass: every task sums each model's gradient,
Hessian and loss as matrix products over its rows (for several classes the
Hessian has a block per pair of classes), blocks are combined in a tree
(``gram.tree_reduce``), and the driver solves the small systems. The rows are
``packed`` once: passes read binary blocks of columns, sorted by fold, and a
run of rows of one fold meets the models of all folds that fit to it, in pieces
that stay in the CPU's cache. A step that does not lower the loss is halved. A model is finished when the largest entry
of its mean gradient is at most ``tol``; that number comes back with the model
and certifies it, as the penalised loss is strictly convex.

Two classes use one score (log odds of the positive class), more classes one
score each (softmax; all scores penalised, intercepts free). The penalty is
sum(b^2) / (2 C) on the summed loss, intercepts excluded.

Held-out answers come from the same models: for more classes the confusion
counts of the left-out fold are summed in the Newton pass itself, so they
belong to the very coefficients that the gradient certifies. For two classes
``best_by_auc`` compares held-out AUC by bounds: histograms of the scores
(positives, negatives, least and largest score per bucket) bound each model's
AUC, candidates whose upper bound is below the best lower bound leave, and only
the contested buckets of the others are cut finer. What moves are histograms,
of ``MOST_EDGES`` edges in all, whatever the number of rows and candidates, and
none of them to the driver: it reads two bounds per model, and new edges of the
models that go on. The exact AUC of those that are left, if a bucket is still
contested, is one global scan of its scores each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from .gram import Blocks, matrix_of, tree_reduce

TOL = 1e-10  # largest entry of the mean gradient
MAX_STEPS = 50
SCORE_DIGITS = 9  # scores that agree to so many decimals tie
CELLS = 32_768  # rows x models that a task handles at once: 256 kB, so that every array of a piece stays in the cache
GROUP = 16  # blocks in a row group of the packed table: some 13 MB at 10,000 rows a block and 7 of 32 features not whole numbers
FIRST_BUCKETS = 256
MORE_BUCKETS = (1024, 4096, 16384, 65536)  # new buckets per model in each refinement
MOST_EDGES = 1_000_000  # of all models in a pass: what the driver sends and holds (8 bytes an edge)


@dataclass
class Batch:
    """Models over ``shared`` features plus one of ``candidates`` (none: one
    model of the shared features), each for every fold it leaves out
    (``None``: leaves out no row). ``outputs``: 1 score for two classes, else
    one per class."""

    names: list[str]
    shared: list[str]
    candidates: list[str]
    folds: list[int | None]
    outputs: int = 1

    @property
    def width(self) -> int:
        return 1 + len(self.shared) + bool(self.candidates)

    @property
    def models(self) -> int:
        return max(1, len(self.candidates))


@dataclass
class Fits:
    beta: np.ndarray  # folds x models x outputs x width, intercept first
    gradient: np.ndarray  # folds x models: largest entry of the mean gradient
    confusion: np.ndarray | None  # folds x models x classes x classes (actual, predicted)
    scale: np.ndarray | None = None  # two classes: folds x models x 2, mean and deviation of the fitted scores

    def converged(self, tol: float = TOL) -> np.ndarray:
        return self.gradient <= tol


def packed(data: DataFrame, names: list[str]) -> DataFrame:
    """The rows of ``data`` (__y, __fold, x0.. in the order of ``names``) as
    binary blocks, written once; every pass takes either form."""
    columns = _columns_of(names)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([_encode(_by_fold(batch, columns))], pa.binary())], names=["block"])

    path = scratch_path(data.sparkSession, "design")
    data.mapInArrow(run, "block binary").write.option("parquet.block.row.count.limit", GROUP).parquet(path)
    return data.sparkSession.read.parquet(path)


def _columns_of(names: list[str]) -> list[str]:
    return ["__y", "__fold", *[f"x{i}" for i in range(len(names))]]


def _by_fold(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Columns x rows, rows in the order of their folds."""
    x = matrix_of(batch, columns)
    return np.ascontiguousarray(x[np.argsort(x[:, 1], kind="stable")].T)


def _encode(x: np.ndarray) -> bytes:
    """Columns x rows as bytes; columns of whole numbers up to 255 take a byte
    a value."""
    with np.errstate(invalid="ignore"):
        small = x.astype(np.uint8)
    whole = (small == x).all(axis=1)
    return np.array(x.shape, "<i4").tobytes() + whole.tobytes() + small[whole].tobytes() + x[~whole].astype("<f8").tobytes()


def _decode(raw) -> np.ndarray:
    k, n = np.frombuffer(raw, "<i4", 2).tolist()
    whole = np.frombuffer(raw, bool, k, 8)
    m = int(whole.sum())
    out = np.empty((k, n))
    out[whole] = np.frombuffer(raw, np.uint8, m * n, 8 + k).reshape(m, n)
    out[~whole] = np.frombuffer(raw, "<f8", (k - m) * n, 8 + k + m * n).reshape(k - m, n)
    return out


def _runs(batches: Iterable[pa.RecordBatch], names: list[str], shared: list[int], cands: list[int]):
    """(fold, shared with constant, candidates, y) of runs of rows of one fold;
    features x rows."""
    columns = _columns_of(names)
    for batch in batches:
        blocks = (_decode(raw.as_buffer()) for raw in batch.column(0)) if batch.schema.names == ["block"] else [_by_fold(batch, columns)]
        for x in blocks:
            z = np.concatenate([np.ones((1, x.shape[1])), x[2:][shared]])
            c, y, fold = x[2:][cands], x[0], x[1]
            starts = np.flatnonzero(np.diff(fold, prepend=np.nan) != 0)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(fold)]):
                yield fold[a], z[:, a:b], c[:, a:b], y[a:b]


def _scores(shared: np.ndarray, cand: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """outputs x models x rows; shared, cand: features x rows."""
    s = len(shared)
    eta = np.stack([beta[:, i, :s] @ shared for i in range(beta.shape[1])])
    if len(cand):
        for i in range(len(eta)):
            eta[i] += beta[:, i, s, None] * cand
    return eta


def _log_sum(d: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Sum over each row of the logs of numbers of 1 or more, as the logs of
    their products; ``room`` takes half of the numbers."""
    top, total = float(d.max()), 0.0
    while d.shape[1] > 1 and top < 1e150:
        half = d.shape[1] // 2
        if d.shape[1] % 2:
            total = total + np.log(d[:, -1])
        d, top = np.multiply(d[:, :half], d[:, half : 2 * half], out=room[:, :half]), top * top
    return total + np.log(d).sum(axis=1)


class _Sums:
    """Two classes: what a Newton step needs of ``models`` models, summed over
    rows: rows, loss, gradient (width), Hessian (width x width), score and its
    square. The arrays of a piece of ``most`` rows are made once: fresh ones
    cost more than the sums."""

    def __init__(self, models: int, s: int, own: bool, most: int):
        self.s, self.own = s, own
        self.upper = np.triu_indices(s)
        self.n = 0
        self.loss, self.score, self.square = (np.zeros(models) for _ in range(3))
        self.grad, self.hess = np.zeros((models, s)), np.zeros((models, len(self.upper[0])))
        self.grad_own, self.hess_own, self.hess_mixed = np.zeros(models), np.zeros(models), np.zeros((models, s))
        self.batched = models > s  # one product for the Hessians of all models
        self.rooms = [np.empty((models, most)) for _ in range(3)]

    def add_run(self, z: np.ndarray, c: np.ndarray, which: np.ndarray | None, y: np.ndarray, beta: np.ndarray) -> None:
        """z: shared features x rows; c: candidates x rows, of which model k has
        number which[k]; beta: models x width."""
        most = self.rooms[0].shape[1]
        squares = z[self.upper[0]] * z[self.upper[1]] if self.batched else None
        for a in range(0, len(y), most):
            own = slice(a, a + most)
            self.add(np.ascontiguousarray(z[:, own]), np.ascontiguousarray(c[:, own]), which, y[own], beta, squares[:, own] if self.batched else None)

    def add(self, z: np.ndarray, c: np.ndarray, which: np.ndarray | None, y: np.ndarray, beta: np.ndarray, squares: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The sums of a piece; gives what it held last, for each model and row:
        probability less y, and weight (with own features: times those)."""
        n = len(y)
        eta, d, x = (room[:, :n] for room in self.rooms)
        np.matmul(beta[:, : self.s], z, out=eta)
        if self.own:
            np.take(c, which, axis=0, out=x, mode="clip")
            np.multiply(x, beta[:, self.s, None], out=d)
            eta += d
        self.n += n
        self.score += eta.sum(axis=1)
        self.square += np.einsum("kn,kn->k", eta, eta)
        np.negative(eta, out=d)
        with np.errstate(over="ignore"):
            np.exp(d, out=d)
        d += 1.0
        if np.isfinite(d.max()):
            self.loss += eta @ (1.0 - y)
            self.loss += _log_sum(d, eta)
        else:
            self.loss += (np.logaddexp(0.0, eta) - y * eta).sum(axis=1)
        p = np.divide(1.0, d, out=d)
        w = np.subtract(1.0, p, out=eta)
        w *= p
        r = np.subtract(p, y, out=p)
        self.grad += r @ z.T
        if squares is not None:
            self.hess += w @ squares.T
        else:
            for k, own in enumerate(w):
                self.hess[k] += ((z * own) @ z.T)[self.upper]
        if self.own:
            self.grad_own += np.einsum("kn,kn->k", r, x)
            w *= x
            self.hess_mixed += w @ z.T
            self.hess_own += np.einsum("kn,kn->k", w, x)
        return r, w

    def flat(self) -> np.ndarray:
        models, s, k = len(self.loss), self.s, self.s + self.own
        hess = np.zeros((models, k, k))
        i, j = self.upper
        hess[:, i, j] = hess[:, j, i] = self.hess
        grad = self.grad
        if self.own:
            hess[:, :s, s] = hess[:, s, :s] = self.hess_mixed
            hess[:, s, s] = self.hess_own
            grad = np.column_stack([grad, self.grad_own])
        return np.column_stack([np.full(models, float(self.n)), self.loss, grad, hess.reshape(models, k * k), self.score, self.square])


class _FirstSums(_Sums):
    """The same at the start of a step, where all models of a fold have one
    score, as their own features count for nothing yet: rows are scored once
    a fold. ``models``: the numbers of each fold's models."""

    def __init__(self, models: list[np.ndarray], s: int, cands: int, most: int):
        super().__init__(len(models), s, False, most)
        self.models = models
        self.grads, self.hesses, self.mixed = np.zeros((len(models), cands)), np.zeros((len(models), cands)), np.zeros((len(models), s, cands))

    def add(self, z, c, which, y, beta, squares):
        r, w = super().add(z, c, which, y, beta, squares)
        self.grads += r @ c.T
        self.hesses += w @ (c * c).T
        for k, own in enumerate(w):
            self.mixed[k] += (z * own) @ c.T
        return r, w

    def flat(self) -> np.ndarray:
        out = _Sums(sum(map(len, self.models)), self.s, True, 0)
        out.n = self.n
        fold = np.repeat(np.arange(len(self.models)), [len(m) for m in self.models])
        which = np.concatenate(self.models)
        out.loss, out.score, out.square, out.grad, out.hess = self.loss[fold], self.score[fold], self.square[fold], self.grad[fold], self.hess[fold]
        out.grad_own, out.hess_own, out.hess_mixed = self.grads[fold, which], self.hesses[fold, which], self.mixed[fold, :, which]
        return out.flat()


def _softmax_sums(shared: np.ndarray, cand: np.ndarray, y: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """More classes: rows, loss, gradient (outputs x width) and Hessian (output
    pairs l <= m, width x width) per model, flat."""
    models, outputs, width = beta.shape
    s = len(shared)
    eta = _scores(shared, cand, beta)
    top = eta.max(axis=0)
    e = np.exp(eta - top)
    whole = e.sum(axis=0)
    prob = e / whole
    own = np.take_along_axis(eta, y.astype(int)[None, None, :], axis=0)[0]
    out = np.zeros((models, 2 + outputs * width + outputs * (outputs + 1) // 2 * width * width))
    out[:, 0] = len(y)
    out[:, 1] = (np.log(whole) + top - own).sum(axis=1)
    grad = np.zeros((models, outputs, width))
    hess = []
    squares = (shared[:, None] * shared[None]).reshape(s * s, len(y))
    for i in range(outputs):
        r = prob[i] - (y == i)
        grad[:, i, :s] = r @ shared.T
        if width > s:
            grad[:, i, s] = (cand * r).sum(axis=1)
        for j in range(i, outputs):
            w = prob[i] * ((i == j) - prob[j])
            h = np.zeros((models, width, width))
            h[:, :s, :s] = (w @ squares.T).reshape(models, s, s)
            if width > s:
                wx = w * cand
                h[:, :s, s] = wx @ shared.T
                h[:, s, :s] = h[:, :s, s]
                h[:, s, s] = (wx * cand).sum(axis=1)
            hess.append(h.reshape(models, -1))
    out[:, 2:] = np.concatenate([grad.reshape(models, -1), *hess], axis=1)
    return out


def _newton_pass(data: DataFrame, b: Batch, beta: np.ndarray, live: list[tuple[int, np.ndarray]]) -> dict[str, np.ndarray]:
    names, folds = b.names, b.folds
    shared, cands = [names.index(c) for c in b.shared], [names.index(c) for c in b.candidates]

    # all models of a fold have the same score
    alike = bool(cands) and all((beta[f, m, 0, -1] == 0).all() and (beta[f, m, 0] == beta[f, m[0], 0]).all() for f, m in live)

    def binary(batches) -> Blocks:
        held: dict[float, tuple] = {}  # by the rows' fold: the models that fit to it, and their sums
        for fold, z, c, y in _runs(batches, names, shared, cands):
            if fold not in held:
                fit = [(f, models) for f, models in live if folds[f] != fold]
                if not fit:
                    held[fold] = fit, None, None, None
                elif alike:
                    sums = _FirstSums([models for _, models in fit], len(z), len(c), max(64, CELLS // len(c)))
                    held[fold] = fit, None, np.stack([beta[f, models[0], 0, :-1] for f, models in fit]), sums
                else:
                    which = np.concatenate([models for _, models in fit])
                    sums = _Sums(len(which), len(z), bool(cands), max(64, CELLS // len(which)))
                    held[fold] = fit, which, np.concatenate([beta[f, models, 0] for f, models in fit]), sums
            fit, which, own, sums = held[fold]
            if fit:
                sums.add_run(z, c, which, y, own)
        acc: Blocks = {}
        for fit, _, _, sums in held.values():
            rows, at = sums.flat() if fit else None, 0
            for f, models in fit:
                acc[str(f)] = acc.get(str(f), 0) + rows[at : at + len(models)].ravel()
                at += len(models)
        return acc

    def softmax(batches) -> Blocks:
        acc: Blocks = {}
        for fold, z, c, y in _runs(batches, names, shared, cands):
            for f, models in live:
                most = max(64, CELLS // (len(models) * b.outputs))
                size = len(models) * (2 + b.outputs * b.width + b.outputs * (b.outputs + 1) // 2 * b.width**2)
                sums = acc.setdefault(str(f), np.zeros(size + len(models) * b.outputs**2))
                for a in range(0, len(y), most):
                    own, x, t = z[:, a : a + most], c[models, a : a + most] if cands else c[:, a : a + most], y[a : a + most]
                    if folds[f] != fold:
                        sums[:size] += _softmax_sums(own, x, t, beta[f, models]).ravel()
                    else:
                        said = _scores(own, x, beta[f, models]).argmax(axis=0)
                        at = (np.arange(len(models))[:, None] * b.outputs + t.astype(int)) * b.outputs + said
                        sums[size:] += np.bincount(at.ravel(), minlength=len(models) * b.outputs**2)
        return acc

    return tree_reduce(data, binary if b.outputs == 1 else softmax)


def fit_batch(data: DataFrame, b: Batch, c_value: float = 1.0, start: np.ndarray | None = None,
              max_steps: int = MAX_STEPS, tol: float = TOL) -> Fits:
    """Fit all models of the batch. ``data`` holds __y (0/1 or class number),
    __fold and columns x0.. in the order of ``b.names``; ``start`` (like
    ``Fits.beta``) gives warm starts."""
    folds, models, outputs, k = len(b.folds), b.models, b.outputs, b.width
    beta = np.zeros((folds, models, outputs, k)) if start is None else start.copy()
    step, last = np.zeros_like(beta), np.full((folds, models), np.inf)
    gradient = np.full((folds, models), np.inf)
    confusion = np.zeros((folds, models, outputs, outputs)) if outputs > 1 else None
    scale = np.zeros((folds, models, 2)) if outputs == 1 else None
    pen = np.full(k, 1.0 / c_value)
    pen[0] = 0.0
    open_ = np.ones((folds, models), bool)
    for _ in range(max_steps):
        live = [(f, np.flatnonzero(open_[f])) for f in range(folds) if open_[f].any()]
        if not live:
            break
        found = _newton_pass(data, b, beta, live)
        for f, which in live:
            if str(f) not in found:  # no rows at all
                open_[f] = False
                continue
            sums = found[str(f)]
            size = 2 + outputs * k + outputs * (outputs + 1) // 2 * k * k + 2 * (outputs == 1)
            rows = sums[: len(which) * size].reshape(len(which), size)
            if outputs > 1:
                confusion[f, which] = sums[len(which) * size :].reshape(len(which), outputs, outputs)
            else:
                mean, square = rows[:, -2:].T / np.maximum(rows[:, 0], 1)
                scale[f, which] = np.column_stack([mean, np.sqrt(np.maximum(square - mean * mean, 0))])
                rows = rows[:, :-2]
            for m, r in zip(which, rows):
                now = beta[f, m]
                loss = r[1] + 0.5 * float((pen * now * now).sum())
                g = r[2 : 2 + outputs * k].reshape(outputs, k) + pen * now
                gradient[f, m] = np.abs(g).max() / max(1.0, r[0])
                if gradient[f, m] <= tol:
                    open_[f, m] = False
                elif loss > last[f, m] + 1e-9 * abs(last[f, m]):
                    step[f, m] /= 2  # too far: back half the way
                    beta[f, m] = now - step[f, m]
                else:
                    h = np.zeros((outputs, k, outputs, k))
                    blocks = iter(r[2 + outputs * k :].reshape(-1, k, k))
                    for i in range(outputs):
                        for j in range(i, outputs):
                            h[i, :, j, :] = next(blocks)
                            h[j, :, i, :] = h[i, :, j, :].T
                    h = h.reshape(outputs * k, outputs * k) + np.diag(np.tile(pen, outputs))
                    # softmax intercepts are free up to a constant: least norm
                    solve = np.linalg.solve if outputs == 1 else lambda h, g: np.linalg.lstsq(h, g, rcond=1e-12)[0]
                    step[f, m] = -solve(h, g.ravel()).reshape(outputs, k)
                    last[f, m] = loss
                    beta[f, m] = now + step[f, m]
    return Fits(beta, gradient, confusion, scale)


def weighted_f1(confusion: np.ndarray) -> np.ndarray:
    """F1 per class weighted by the class's rows; the last two axes are
    (actual, predicted)."""
    hit = np.diagonal(confusion, axis1=-2, axis2=-1)
    actual, said = confusion.sum(axis=-1), confusion.sum(axis=-2)
    f1 = np.divide(2 * hit, actual + said, out=np.zeros_like(hit, dtype=float), where=actual + said > 0)
    n = actual.sum(axis=-1)
    return np.divide((f1 * actual).sum(axis=-1), n, out=np.full(n.shape, np.nan), where=n > 0)


# ----------------------------------------------------------------------------- AUC by bounds


@dataclass
class Histogram:
    """Held-out scores of one model by bucket, in rising order."""

    pos: np.ndarray
    neg: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def bounds(self) -> tuple[float, float]:
        """Least and largest AUC that the buckets allow."""
        total = self.pos.sum() * self.neg.sum()
        if not total:
            return float("nan"), float("nan")
        below = np.cumsum(self.neg) - self.neg
        sure = float((self.pos * below).sum())
        tied = self.pos * self.neg
        same = self.low == self.high  # one score: half
        sure += 0.5 * float(tied[same].sum())
        return sure / total, (sure + float(tied[~same].sum())) / total

    def contested(self) -> np.ndarray:
        return (self.pos > 0) & (self.neg > 0) & (self.low < self.high)

    def cuts(self, more: int) -> np.ndarray:
        """About ``more`` new edges, twice as many at most, inside the contested
        buckets that leave most open, in proportion to that."""
        at = np.flatnonzero(self.contested())
        open_ = self.pos[at] * self.neg[at]
        if len(at) > more // 2:
            own = np.sort(np.argsort(-open_, kind="stable")[: max(1, more // 2)])
            at, open_ = at[own], open_[own]
        parts = np.maximum(2, np.ceil(more * open_ / open_.sum())).astype(int)
        return np.concatenate([np.linspace(self.low[i], self.high[i], n + 1)[1:] for i, n in zip(at, parts)])


PARTS = ["pos", "neg", "low", "high"]


class Histograms(Mapping):
    """The histograms of a pass by (fold, model), a written table with a row per
    model. They stay there: the driver reads the bounds of all models
    (``bounds``: least and largest AUC, whether a bucket is contested) and the
    cuts of those that go on; a histogram itself is read on demand."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.bounds = {(r["f"], r["m"]): (r["least"], r["most"], r["open"]) for r in rows.select("f", "m", "least", "most", "open").collect()}

    def __iter__(self) -> Iterator[tuple[int, int]]:
        return iter(self.bounds)

    def __len__(self) -> int:
        return len(self.bounds)

    def __getitem__(self, key: tuple[int, int]) -> Histogram:
        row = self.rows.where((F.col("f") == key[0]) & (F.col("m") == key[1])).select(*PARTS).first()
        if row is None:
            raise KeyError(key)
        return Histogram(*map(np.array, row))

    def cuts(self, more: dict[tuple[int, int], int]) -> dict[tuple[int, int], np.ndarray]:
        """``Histogram.cuts`` of the models that ``more`` names."""

        def cut(batches):
            for batch in batches:
                f, m, *parts = batch.columns
                for i, key in enumerate(zip(f.to_pylist(), m.to_pylist())):
                    if key in more:
                        new = Histogram(*[v[i].values.to_numpy() for v in parts]).cuts(more[key])
                        yield pa.RecordBatch.from_arrays([f.slice(i, 1), m.slice(i, 1), pa.array([new.astype("<f8").tobytes()], pa.binary())], names=["f", "m", "cuts"])

        found = self.rows.select("f", "m", *PARTS).mapInArrow(cut, "f int, m int, cuts binary")
        return {(r["f"], r["m"]): np.frombuffer(bytes(r["cuts"]), "<f8") for r in found.collect()}


def _buckets(score: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, first, last place) of the buckets that sorted scores fall in."""
    if len(edges) < len(score):
        cut = np.searchsorted(score, edges, "left")
        first, last = np.append(0, cut), np.append(cut, len(score)) - 1
        own = np.flatnonzero(last >= first)
        return own, first[own], last[own]
    at = np.searchsorted(edges, score, "right")
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return at[first], first, np.append(first[1:], len(at)) - 1


def _histograms(data: DataFrame, b: Batch, beta: np.ndarray, edges: dict[tuple[int, int], np.ndarray]) -> Histograms:
    """One pass: a histogram for each (fold, model) of ``edges``; bucket i
    holds the scores from edge i - 1 up to, but not at, edge i."""
    names = b.names
    shared, cands = [names.index(c) for c in b.shared], [names.index(c) for c in b.candidates]
    asked = [(f, b.folds[f], sorted(m for g, m in edges if g == f)) for f in sorted({f for f, _ in edges})]

    def count(batches):
        acc: dict[tuple[int, int], np.ndarray] = {}
        for fold, z, c, y in _runs(batches, names, shared, cands):
            for f, held, models in asked:
                if fold != held:
                    continue
                hit = y == 1
                for part, own in ((0, hit), (1, ~hit)):
                    x = z[:, own]
                    if not x.shape[1]:
                        continue
                    eta = np.round(_scores(x, c[models][:, own] if cands else c[:, own], beta[f, models])[0], SCORE_DIGITS)
                    eta.sort(axis=1)
                    for score, m in zip(eta, models):
                        bucket, first, last = _buckets(score, edges[f, m])
                        if (f, m) not in acc:
                            h = acc[f, m] = np.zeros((4, len(edges[f, m]) + 1))
                            h[2], h[3] = np.inf, -np.inf
                        h = acc[f, m]
                        h[part, bucket] += last - first + 1
                        h[2, bucket] = np.minimum(h[2, bucket], score[first])
                        h[3, bucket] = np.maximum(h[3, bucket], score[last])
        for (f, m), h in acc.items():
            at = np.flatnonzero(h[0] + h[1])
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([m], pa.int32()), pa.array([np.vstack([at, h[:, at]]).astype("<f8").tobytes()], pa.binary())], names=["f", "m", "part"])

    def merge(batches):
        acc: dict[tuple[int, int], np.ndarray] = {}  # MOST_EDGES edges in all
        for batch in batches:
            for f, m, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                part = np.frombuffer(raw.as_buffer(), "<f8").reshape(5, -1)
                at = part[0].astype(np.int64)
                if (f, m) not in acc:
                    h = acc[f, m] = np.zeros((4, len(edges[f, m]) + 1))
                    h[2], h[3] = np.inf, -np.inf
                h = acc[f, m]
                h[:2, at] += part[1:3]
                h[2, at] = np.minimum(h[2, at], part[3])
                h[3, at] = np.maximum(h[3, at], part[4])
        for (f, m), h in acc.items():
            whole = Histogram(*h[:, np.flatnonzero(h[0] + h[1])])
            least, most = whole.bounds()
            cols = [pa.array([f], pa.int32()), pa.array([m], pa.int32()), pa.array([least]), pa.array([most]), pa.array([bool(whole.contested().any())]), *[pa.array([getattr(whole, c)]) for c in PARTS]]
            yield pa.RecordBatch.from_arrays(cols, names=["f", "m", "least", "most", "open", *PARTS])

    rows = data.mapInArrow(count, "f int, m int, part binary").repartition("f", "m")
    models = rows.mapInArrow(merge, "f int, m int, least double, most double, open boolean, " + ", ".join(f"{c} array<double>" for c in PARTS))
    return Histograms(materialize(models, "histograms"))


def exact_auc(data: DataFrame, b: Batch, beta: np.ndarray, model: int) -> np.ndarray:
    """Held-out AUC of one model of each fold: its scores are dealt to ranges of
    their order, each range counts its own pairs, and the pairs of two ranges
    follow from a row per range and fold."""
    names, folds = b.names, b.folds
    shared, cands = [names.index(c) for c in b.shared], [names.index(c) for c in b.candidates[model : model + 1]]

    def score(batches):
        for fold, z, c, y in _runs(batches, names, shared, cands):
            for f, held in enumerate(folds):
                if fold == held:
                    eta = np.round(_scores(z, c, beta[f, model : model + 1])[0, 0], SCORE_DIGITS) + 0.0
                    scores, at = np.unique(eta, return_inverse=True)
                    pos = np.bincount(at, y, minlength=len(scores))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), f), pa.int32()), pa.array(scores), pa.array(pos), pa.array(np.bincount(at, minlength=len(scores)) - pos)],
                                                     names=["f", "score", "pos", "neg"])

    def pairs(batches):
        part = TaskContext.get().partitionId()
        sums: dict[int, list[float]] = {}  # pairs in order, positives and negatives so far, and those of the last score
        last = (-1, np.nan)
        for batch in batches:
            f, s, pos, neg = (batch.column(i).to_numpy() for i in range(4))
            if not len(f):
                continue
            new = np.append((f[0], s[0]) != last, (np.diff(f) != 0) | (np.diff(s) != 0))
            if not new[0]:  # the batch goes on with the last score
                held = sums[int(f[0])]
                held[1], held[2] = held[1] - held[3], held[2] - held[4]
                held[0] -= held[3] * (held[2] + 0.5 * held[4])
                pos, neg = pos.copy(), neg.copy()
                pos[0], neg[0] = pos[0] + held[3], neg[0] + held[4]
                new[0] = True
            first = np.flatnonzero(new)
            fs, ps, ns = f[first], np.add.reduceat(pos, first), np.add.reduceat(neg, first)
            for own in np.unique(fs).tolist():
                i = fs == own
                p, n = ps[i], ns[i]
                held = sums.setdefault(own, [0.0, 0.0, 0.0, 0.0, 0.0])
                below = held[2] + np.cumsum(n) - n
                held[:] = held[0] + float((p * (below + 0.5 * n)).sum()), held[1] + p.sum(), held[2] + n.sum(), p[-1], n[-1]
            last = (f[-1], s[-1])
        for f, (u, p, n, _, _) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f], pa.int32()), *[pa.array([float(v)]) for v in (u, p, n)]], names=["part", "f", "u", "p", "n"])

    sc = data.mapInArrow(score, "f int, score double, pos double, neg double")
    ranges = sc.repartitionByRange("f", "score").sortWithinPartitions("f", "score").mapInArrow(pairs, "part int, f int, u double, p double, n double")
    total = np.zeros((3, len(folds)))
    for r in sorted(ranges.collect(), key=lambda r: r["part"]):  # a row per range and fold
        total[0, r["f"]] += r["u"] + r["p"] * total[2, r["f"]]
        total[1:, r["f"]] += r["p"], r["n"]
    whole = total[1] * total[2]
    return np.divide(total[0], whole, out=np.full(len(folds), np.nan), where=whole > 0)


def best_by_auc(data: DataFrame, b: Batch, beta: np.ndarray, first: int = FIRST_BUCKETS, more: tuple[int, ...] = MORE_BUCKETS, *, scale: np.ndarray | None = None) -> tuple[int, float]:
    """(candidate, score): the candidate with the highest mean held-out AUC
    (the first of those that agree to 12 decimals) and that mean, exactly.
    The first edges are quantiles of a normal law with the mean and deviation of
    ``scale``, without it of the logistic law; later ones follow the scores."""
    folds, models = range(len(b.folds)), range(b.models)
    first = max(2, min(first, MOST_EDGES // (len(folds) * len(models))))
    share = np.arange(1, first) / first
    if scale is None:
        start = np.log(share / (1.0 - share))
        edges = {(f, m): start for f in folds for m in models}
    else:
        start = np.array([NormalDist().inv_cdf(v) for v in share])
        edges = {(f, m): np.unique(scale[f, m, 0] + scale[f, m, 1] * start) for f in folds for m in models}
    found: dict[tuple[int, int], tuple[float, float, bool]] = {}
    alive = list(models)
    for step in range(len(more) + 1):
        held = _histograms(data, b, beta, edges)
        found |= held.bounds
        bounds = {m: np.mean([found[f, m][:2] for f in folds], axis=0) for m in alive}
        lowest = max(low for low, _ in bounds.values())
        alive = [m for m in alive if bounds[m][1] >= lowest - 1e-12]
        open_ = [(f, m) for m in alive for f in folds if found[f, m][2]]
        if not open_ or len(alive) == 1 or step == len(more):
            break
        edges = {key: edges[key] for key in open_}
        room = (MOST_EDGES - sum(len(e) for e in edges.values())) // (2 * len(open_))
        if room < 2:
            break
        new = held.cuts(dict.fromkeys(open_, min(more[step], room)))  # what is open was counted in this pass
        edges = {key: np.unique(np.concatenate([e, new[key]])) for key, e in edges.items()}
    score = {}
    for m in alive:
        if any(found[f, m][2] for f in folds):
            score[m] = float(np.mean(exact_auc(data, b, beta, m)))
        else:
            score[m] = float(np.mean([found[f, m][0] for f in folds]))
    best = max(alive, key=lambda m: (round(score[m], 12), -m))
    return best, score[best]
