"""Forward feature selection with k-fold cross-validation.

Regression: one pass builds a Gram matrix per fold; every candidate's fit
on k-1 folds and its held-out error come from Gram blocks on the driver
(train Gram = total - fold Gram; SSE_f = y'y - 2 b'Z'y + b'Z'Z b on the
fold). No further pass over the data, whatever the number of candidates.
Score = mean over folds of -RMSE; exactly min(max_features, p) features are
chosen, no early stop; ties go to the first feature in order.

Classification: see ``classify.forward_select_classification``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame

from .gram import Gram, collect_gram


def _fold_rmse(train: Gram, held: Gram, xs: list[str], y: str) -> float:
    n = train.n
    idx = [train.index(c) for c in xs]
    iy = train.index(y)
    if xs:
        mx = train.matrix[idx, 0] / n
        my = train.matrix[iy, 0] / n
        sxx = train.matrix[np.ix_(idx, idx)] - n * np.outer(mx, mx)
        sxy = train.matrix[idx, iy] - n * mx * my
        b = np.linalg.lstsq(sxx, sxy, rcond=None)[0]
        b0 = my - mx @ b
        beta = np.concatenate([[b0], b])
    else:
        beta = np.array([train.matrix[iy, 0] / n])
    zi = [0] + idx
    zz = held.matrix[np.ix_(zi, zi)]
    zy = held.matrix[zi, iy]
    yy = held.matrix[iy, iy]
    sse = max(0.0, float(yy - 2 * beta @ zy + beta @ zz @ beta))
    return math.sqrt(sse / held.n) if held.n else float("nan")


def select_from_fold_grams(grams: dict, features: list[str], target: str,
                           max_features: int = 10) -> tuple[list[str], list[tuple]]:
    """Greedy forward selection from per-fold Grams {(fold, '1'): Gram}."""
    k_select = min(max_features, len(features))
    if k_select == 0:
        raise ValueError("no features available after preprocessing")
    folds = sorted(f for (f, kind) in grams if kind == "1")
    tot = grams[(folds[0], "1")]
    for f in folds[1:]:
        tot = tot + grams[(f, "1")]
    splits = [(tot - grams[(f, "1")], grams[(f, "1")]) for f in folds]
    selected: list[str] = []
    trace = []
    for step in range(1, k_select + 1):
        best, best_score = None, -math.inf
        for c in features:
            if c in selected:
                continue
            score = float(np.mean([-_fold_rmse(tr, te, selected + [c], target) for tr, te in splits]))
            if score > best_score:
                best, best_score = c, score
        selected.append(best)
        trace.append((step, best, best_score))
    return selected, trace


def forward_select_regression(df: DataFrame, features: list[str], target: str, fold: Column,
                              max_features: int = 10) -> tuple[list[str], list[tuple]]:
    """One pass for the fold Grams, then ``select_from_fold_grams``.
    Returns (selected features in order, [(step, feature, score)])."""
    if not features:
        raise ValueError("no features available after preprocessing")
    grams = collect_gram(df, features + [target], fold=fold)
    return select_from_fold_grams(grams, features, target, max_features)


__all__ = ["forward_select_regression", "select_from_fold_grams"]
