"""PCA on standardised complete cases: one Gram pass gives the correlation
matrix (population scaling, constant columns scaled by 1), the driver
diagonalises the p x p matrix; scores are column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gram import centred_gram


def q(c: str) -> Column:
    return F.col(f"`{c}`")


@dataclass
class PCAResult:
    names: list[str]
    means: np.ndarray
    scales: np.ndarray
    eigenvalues: np.ndarray  # descending
    components: np.ndarray  # rows = components, columns = variables
    n: int

    @property
    def ratio(self) -> np.ndarray:
        s = self.eigenvalues.sum()
        return self.eigenvalues / s if s > 0 else self.eigenvalues

    @property
    def n_components_95(self) -> int:
        cum = np.cumsum(self.ratio)
        hit = np.nonzero(cum >= 0.95)[0]
        return int(hit[0] + 1) if hit.size else len(cum)

    def variance_rows(self) -> list[tuple]:
        cum = np.cumsum(self.ratio)
        return [(f"PC{i + 1}", round(float(r * 100), 2), round(float(c * 100), 2), i + 1)
                for i, (r, c) in enumerate(zip(self.ratio, cum))]

    def loading_rows(self, component: int, top: int = 10) -> list[tuple]:
        load = self.components[component]
        order = sorted(range(len(self.names)), key=lambda j: (-round(abs(load[j]), 12), self.names[j]))
        return [(self.names[j], float(load[j]), rank + 1) for rank, j in enumerate(order[:top])]

    def score_columns(self, k: int) -> list[Column]:
        """PC scores of the first k components as JVM expressions."""
        out = []
        for i in range(k):
            expr = F.lit(0.0)
            for j, c in enumerate(self.names):
                w = self.components[i, j] / self.scales[j]
                expr = expr + F.lit(float(w)) * (q(c) - F.lit(float(self.means[j])))
            out.append(expr.alias(f"PC{i + 1}"))
        return out


def pca_fit(df: DataFrame, columns: list[str]) -> PCAResult | None:
    """Complete cases of ``columns``, scaled by the population std, full PCA."""
    if not columns:
        return None
    g, means = centred_gram(df, columns)
    n = g.n
    if not n:
        return None
    cov = g.sub(columns) / n
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    scales = np.where(np.isclose(sd, 0.0), 1.0, sd)
    corr = cov / np.outer(scales, scales)
    vals, vecs = np.linalg.eigh(corr)
    order = np.argsort(vals)[::-1]
    vals = np.clip(vals[order], 0, None)
    comps = vecs[:, order].T
    for i in range(comps.shape[0]):
        a = np.abs(comps[i])
        j = int(np.nonzero(a >= a.max() - 1e-12)[0][0])  # first of the (near-)largest
        if comps[i, j] < 0:
            comps[i] = -comps[i]
    return PCAResult(list(columns), means, scales, vals, comps, int(round(n)))


def biplot_arrows(df: DataFrame, res: PCAResult) -> list[tuple]:
    """Arrow ends = loading x population std of the scores (PC1, PC2), plus
    the names of the ten variables with the largest |l1| + |l2|."""
    if res.components.shape[0] < 2:
        return []
    complete = df.select(*[q(c).cast("double").alias(c) for c in res.names]).dropna()
    scores = complete.select(*res.score_columns(2))
    st = scores.agg(F.stddev_pop("PC1").alias("s1"), F.stddev_pop("PC2").alias("s2")).collect()[0]
    s1, s2 = st["s1"] or 0.0, st["s2"] or 0.0
    weight = np.abs(res.components[0]) + np.abs(res.components[1])
    top = set(np.argsort(weight)[-10:].tolist())
    return [(c, float(res.components[0, j] * s1), float(res.components[1, j] * s2), j in top)
            for j, c in enumerate(res.names)]

