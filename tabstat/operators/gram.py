"""Moment matrices in one pass: Z'WZ with Z = [1, x_1..x_p] per fold, and
centred co-moments.

Each task sums its rows into one dense block per key (NumPy on Arrow batches)
and sends it as one binary value. Blocks are merged in a tree of two levels:
tasks -> about sqrt(shuffle partitions) slots per key -> one block per key, so
the rows that move are tasks x keys, then slots x keys, whatever the number of
columns, and only a block per key reaches the driver. Several weights (e.g. 1
and squared residuals) share the same scan.

Centred states (count, means, co-moments) merge by the parallel update of
means and co-moments (Chan, Golub, LeVeque), so columns far from 0 keep their
digits without a pass for the means.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONST = "const"

Blocks = dict[str, np.ndarray]
_SCHEMA = "slot int, key string, block binary"


def tree_reduce(df: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], Blocks],
                merge: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add) -> Blocks:
    """``partial`` turns the batches of a task into a flat float64 block per
    key; blocks of a key are merged pairwise, in any order."""
    spark = df.sparkSession
    slots = max(1, math.isqrt(int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def rows(blocks: Blocks, slot: int) -> Iterator[pa.RecordBatch]:
        for key, block in blocks.items():
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([key]), pa.array([block.astype("<f8").tobytes()], pa.binary())],
                                             names=["slot", "key", "block"])

    def first(batches):
        yield from rows(partial(batches), TaskContext.get().partitionId() % slots)

    def again(batches):
        held: Blocks = {}
        for batch in batches:
            for key, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                block = np.frombuffer(raw, "<f8")
                held[key] = merge(held[key], block) if key in held else block
        yield from rows(held, 0)

    parts = df.mapInArrow(first, _SCHEMA)
    if slots > 1:
        parts = parts.repartition("slot", "key").mapInArrow(again, _SCHEMA)
    found: Blocks = {}
    for r in parts.repartition("key").mapInArrow(again, _SCHEMA).collect():
        found[r["key"]] = np.frombuffer(bytes(r["block"]), "<f8").copy()
    return found


def matrix_of(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Rows x columns as float64; null is NaN."""
    if not columns:
        return np.zeros((batch.num_rows, 0))
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64, copy=False) for c in columns])


@dataclass
class Gram:
    names: list[str]  # "const" first, then the columns
    matrix: np.ndarray  # (k+1) x (k+1)

    @property
    def n(self) -> float:
        return float(self.matrix[0, 0])

    def index(self, name: str) -> int:
        return self.names.index(name)

    def sub(self, names: list[str]) -> np.ndarray:
        idx = [self.index(c) for c in names]
        return self.matrix[np.ix_(idx, idx)]

    def vec(self, rows: list[str], col: str) -> np.ndarray:
        return self.matrix[[self.index(c) for c in rows], self.index(col)]

    def __add__(self, other: "Gram") -> "Gram":
        return Gram(self.names, self.matrix + other.matrix)

    def __sub__(self, other: "Gram") -> "Gram":
        return Gram(self.names, self.matrix - other.matrix)


def collect_gram(df: DataFrame, cols: list[str], fold: Column | None = None,
                 weights: dict[str, Column] | None = None) -> dict[tuple[int, str], Gram]:
    """{(fold, kind): Gram} over the rows without missing values; kind '1' is
    the plain Gram, other kinds are the named weights; fold 0 without folds."""
    weights = weights or {}
    labels = list(weights)
    names = [f"c{i}" for i in range(len(cols))]
    kinds = [f"w{i}" for i in range(len(labels))]
    proj = [F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(cols, names)]
    proj += [w.cast("double").alias(k) for w, k in zip(weights.values(), kinds)]
    proj.append((F.lit(0) if fold is None else fold).cast("double").alias("fold"))
    k = len(cols) + 1
    upper = np.triu_indices(k)

    def partial(batches):
        acc: Blocks = {}
        for batch in batches:
            rows = matrix_of(batch, [*names, *kinds, "fold"])
            rows = rows[~np.isnan(rows).any(axis=1)]
            z = np.column_stack([np.ones(len(rows)), rows[:, : k - 1]])
            for f in np.unique(rows[:, -1]):
                own = rows[:, -1] == f
                zf = z[own]
                for kind, w in [("1", None), *zip(labels, rows[own, k - 1 : -1].T)]:
                    m = (zf if w is None else zf * w[:, None]).T @ zf
                    key = f"{int(f)}|{kind}"
                    acc[key] = acc.get(key, 0) + m[upper]
        return acc

    out = {}
    for key, block in tree_reduce(df.select(*proj), partial).items():
        m = np.zeros((k, k))
        m[upper] = block
        m.T[upper] = block
        f, kind = key.split("|", 1)
        out[int(f), kind] = Gram([CONST, *cols], m)
    return out


def total(grams: dict[tuple[int, str], Gram], kind: str = "1") -> Gram:
    parts = [g for (f, k), g in grams.items() if k == kind]
    acc = parts[0]
    for g in parts[1:]:
        acc = acc + g
    return acc


# ----------------------------------------------------------------------------- centred co-moments


def merge_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge two pairwise states (flat: counts, means, squares, products, each
    p x p; [i, j] is over the rows that have both i and j)."""
    p = math.isqrt(len(a) // 4)
    (n1, m1, s1, c1), (n2, m2, s2, c2) = a.reshape(4, p, p), b.reshape(4, p, p)
    n = n1 + n2
    share = np.divide(n2, n, out=np.zeros_like(n), where=n > 0)
    d = m2 - m1
    between = n1 * share
    return np.stack([n, m1 + d * share, s1 + s2 + d * d * between, c1 + c2 + d * d.T * between]).ravel()


def pair_state(x: np.ndarray) -> np.ndarray:
    """The pairwise state of a batch (rows x columns, NaN missing)."""
    there = ~np.isnan(x)
    have = there.astype(np.float64)
    count = have.sum(axis=0)
    shift = np.where(count > 0, np.where(there, x, 0.0).sum(axis=0) / np.maximum(count, 1), 0.0)
    z = np.where(there, x - shift, 0.0)
    n = have.T @ have
    sums = z.T @ have  # of column i over the rows that have j
    mean = np.divide(sums, n, out=np.zeros_like(n), where=n > 0)
    squares = (z * z).T @ have - n * mean * mean
    products = z.T @ z - n * mean * mean.T
    return np.stack([n, np.where(n > 0, mean + shift[:, None], 0.0), squares, products]).ravel()


def pairwise_comoments(df: DataFrame, cols: list[str], complete: bool = False) -> tuple[np.ndarray, ...]:
    """(n, mean, squares, products), each p x p and centred, of every column
    pair over the rows that have both (``complete``: that have all columns);
    null and NaN are missing. One pass."""
    names = [f"c{i}" for i in range(len(cols))]
    proj = [F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(cols, names)]
    p = len(cols)

    def partial(batches):
        acc = None
        for batch in batches:
            x = matrix_of(batch, names)
            if complete:
                x = x[~np.isnan(x).any(axis=1)]
            if len(x):
                state = pair_state(x)
                acc = state if acc is None else merge_pairs(acc, state)
        return {} if acc is None else {"pairs": acc}

    found = tree_reduce(df.select(*proj), partial, merge_pairs)
    state = found.get("pairs", np.zeros(4 * p * p)).reshape(4, p, p)
    return state[0], state[1], state[2], state[3]


def centred_gram(df: DataFrame, cols: list[str]) -> tuple[Gram, np.ndarray]:
    """The Gram matrix of the columns less their means over the complete rows,
    and those means. One pass."""
    n, mean, _, products = pairwise_comoments(df, cols, complete=True)
    m = np.zeros((len(cols) + 1, len(cols) + 1))
    m[0, 0] = n[0, 0] if len(cols) else 0.0
    m[1:, 1:] = products
    return Gram([CONST, *cols], m), np.diag(mean).copy()
