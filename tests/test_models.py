import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabstat.operators.gram import centred_gram, collect_gram, pairwise_comoments, total, tree_reduce
from tabstat.operators.linear import ols_with_checks, vif_table
from tabstat.operators.select import forward_select_regression


def _data(spark, n=600, p=4, seed=0):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, p))
    y = 1.5 + X @ np.arange(1, p + 1) * 0.3 + rng.normal(size=n) * (1 + np.abs(X[:, 0]))
    rows = [(i, *map(float, X[i]), float(y[i])) for i in range(n)]
    names = [f"x{j}" for j in range(p)]
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"{c} double" for c in names) + ", y double")
    return df, X, y, names


def test_gram_matches_numpy(spark):
    df, X, y, names = _data(spark)
    g = total(collect_gram(df.repartition(3), names + ["y"]))
    Z = np.column_stack([np.ones(len(y)), X, y])
    assert np.allclose(g.matrix, Z.T @ Z)


def test_ols_hc1_matches_numpy(spark):
    df, X, y, names = _data(spark)
    res = ols_with_checks(df, names, "y")
    Z = np.column_stack([np.ones(len(y)), X])
    beta = np.linalg.lstsq(Z, y, rcond=None)[0]
    e = y - Z @ beta
    bread = np.linalg.inv(Z.T @ Z)
    cov = bread @ (Z.T * e**2) @ Z @ bread * len(y) / (len(y) - Z.shape[1])
    assert res.source == "ols"
    assert np.allclose(res.coef, beta, atol=1e-9)
    assert np.allclose(res.std_err, np.sqrt(np.diag(cov)), rtol=1e-8)
    # Breusch-Pagan LM = n R^2 of e^2 on Z
    u = e**2
    b = np.linalg.lstsq(Z, u, rcond=None)[0]
    r2 = 1 - np.sum((u - Z @ b) ** 2) / np.sum((u - u.mean()) ** 2)
    assert res.diagnostics["bp_lm"] == pytest.approx(len(y) * r2, rel=1e-8)


def test_doubled_and_constant_columns_go_to_ridge(spark):
    df, X, y, names = _data(spark, n=200, p=2)
    df2 = df.withColumn("x0_copy", F.col("x0")).withColumn("flat", F.lit(3.0))
    res = ols_with_checks(df2, names + ["x0_copy", "flat"], "y", diagnostics=False)
    assert res.source == "ridge" and "rank<p" in res.issues
    assert res.dropped == ["flat"]
    rows = {r[0]: r for r in res.table_rows()}
    assert rows["flat"][4] == "columna_eliminada"
    assert rows["x0"][1] == pytest.approx(rows["x0_copy"][1])


def test_n_le_p_goes_to_ridge(spark):
    df, X, y, names = _data(spark, n=4, p=4)
    res = ols_with_checks(df, names, "y", diagnostics=False)
    assert res.source == "ridge" and "n<=p" in res.issues


def test_vif_matches_inverse_correlation(spark):
    df, X, y, names = _data(spark)
    got = dict(vif_table(df, names))
    R = np.corrcoef(X, rowvar=False)
    want = np.diag(np.linalg.inv(R))
    for j, c in enumerate(names):
        assert got[c] == pytest.approx(want[j], rel=1e-9)


def test_forward_selection_equals_refitting(spark):
    rng = np.random.default_rng(5)
    n, p = 400, 6
    X = rng.normal(size=(n, p))
    y = X[:, 2] * 2 - X[:, 4] + 0.5 * X[:, 0] + rng.normal(size=n)
    fold = rng.integers(0, 5, size=n)
    names = [f"x{j}" for j in range(p)]
    rows = [(int(fold[i]), *map(float, X[i]), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "fold int, " + ", ".join(f"{c} double" for c in names) + ", y double")
    sel, _ = forward_select_regression(df, names, "y", F.col("fold"), max_features=4)

    def cv(cols):
        scores = []
        for f in range(5):
            tr, te = fold != f, fold == f
            Z = np.column_stack([np.ones(tr.sum())] + [X[tr, names.index(c)] for c in cols])
            b = np.linalg.lstsq(Z, y[tr], rcond=None)[0]
            Zt = np.column_stack([np.ones(te.sum())] + [X[te, names.index(c)] for c in cols])
            scores.append(-math.sqrt(np.mean((y[te] - Zt @ b) ** 2)))
        return np.mean(scores)

    chosen = []
    for _ in range(4):
        best = max((c for c in names if c not in chosen), key=lambda c: (cv(chosen + [c]), -names.index(c)))
        chosen.append(best)
    assert sel == chosen


def test_tree_combined_gram_with_folds_and_weights(spark):
    """Blocks of many tasks, folds and weights add up; rows with a missing
    value are left out."""
    df, X, y, names = _data(spark)
    df = df.withColumn("x0", F.when(F.col("k") % 10 == 3, F.lit(float("nan"))).when(F.col("k") % 10 == 4, F.lit(None)).otherwise(F.col("x0")))
    grams = collect_gram(df.repartition(13), names, fold=F.col("k") % 3, weights={"w": F.col("y") * 2})
    k = np.arange(len(y))
    for f in range(3):
        own = (k % 3 == f) & (k % 10 != 3) & (k % 10 != 4)
        Z = np.column_stack([np.ones(own.sum()), X[own]])
        assert np.allclose(grams[f, "1"].matrix, Z.T @ Z)
        assert np.allclose(grams[f, "w"].matrix, (Z.T * (2 * y[own])) @ Z)


def test_comoments_merge_to_pandas(spark):
    """Far-off columns, NaN and null, a column without values, many tasks."""
    import pandas as pd

    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 4)) @ rng.normal(size=(4, 4)) + np.array([1e9, -1e7, 0.0, 5.0])
    x[rng.random((900, 4)) < 0.2] = np.nan
    names = ["a", "b", "c", "d"]
    rows = [[None if np.isnan(v) and rng.random() < 0.5 else float(v) for v in r] + [None] for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*names, "none"])).repartition(11)
    n, mean, squares, products = pairwise_comoments(df, [*names, "none"])
    frame = pd.DataFrame(x, columns=names)
    have = frame.notna()
    assert np.array_equal(n[:4, :4], have.T.astype(float).dot(have.astype(float)).to_numpy())
    assert (n[4] == 0).all()
    corr = products / np.sqrt(np.maximum(squares * squares.T, 1e-300))
    assert np.allclose(corr[:4, :4], frame.corr().to_numpy(), atol=1e-9)
    g, means = centred_gram(df, names)
    whole = frame.dropna()
    assert g.n == len(whole)
    assert np.allclose(means, whole.mean().to_numpy(), rtol=1e-14)
    assert np.allclose(g.sub(names), whole.cov(ddof=0).to_numpy() * len(whole), rtol=1e-7)


def test_blocks_meet_in_a_tree(spark):
    """Rows that move: a block per task and key, then one per slot and key."""
    df, X, y, names = _data(spark)
    acc = spark.sparkContext.accumulator(0)

    def merge(a, b):
        acc.add(1)
        return a + b

    found = tree_reduce(df.repartition(20), lambda batches: {"n": np.array([float(sum(b.num_rows for b in batches))])}, merge)
    assert found["n"][0] == len(y)
    assert acc.value <= 20


def test_far_target_keeps_its_digits(spark):
    """A target near 1e9 gives the fit of the same target near 0."""
    from tabstat.config import ModelOptions, Roles
    from tabstat.plans.model import run_regression
    from tabstat.plans.q_rows import _obs
    from tests.conftest import SF001

    df, _ = _obs(spark, SF001)
    options = ModelOptions(max_selected=3)
    near = run_regression(df, options, Roles())
    far = run_regression(df.withColumn("speed", F.col("speed") + 1e9), options, Roles())
    assert far.selected == near.selected
    assert [t[2] for t in far.trace] == pytest.approx([t[2] for t in near.trace], rel=1e-6)
    for a, b in zip(near.metrics, far.metrics):
        assert b[1:] == pytest.approx(a[1:], rel=1e-5, abs=1e-6)
    for x, y in ((near.ols1, far.ols1), (near.ols2, far.ols2)):
        assert y.coef[0] == pytest.approx(x.coef[0] + 1e9, rel=1e-13)
        assert np.allclose(y.coef[1:], x.coef[1:], rtol=1e-5, atol=1e-6) and y.source == x.source
        if x.std_err is not None:
            assert np.allclose(y.std_err, x.std_err, rtol=1e-5)
