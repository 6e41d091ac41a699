import numpy as np
import pytest
from pyspark.sql import functions as F

from tabstat.operators import classify as clf
from tabstat.operators import newton


def _data(spark, n=500, seed=0):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, 3))
    p = 1 / (1 + np.exp(-(0.3 + X @ np.array([1.0, -0.5, 0.0]))))
    y = np.where(rng.random(n) < p, "Alta", "Normal")
    rows = [(i, *map(float, X[i]), str(y[i]), int(rng.integers(0, 5))) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, y string, fold int")
    return df, X, y


def test_logistic_matches_c1_objective(spark):
    df, X, y = _data(spark)
    m = clf.fit_logistic(df, ["a", "b", "c"], "y", ["Alta", "Normal"])
    b0, b = m.coefficients()
    t = (y == "Alta").astype(float)
    Z = np.column_stack([np.ones(len(t)), X])
    w = np.concatenate([[b0], b])
    mu = 1 / (1 + np.exp(-Z @ w))
    grad = Z.T @ (mu - t) + np.concatenate([[0.0], w[1:]])  # C = 1 on the summed loss
    assert np.max(np.abs(grad)) < 1e-3


def test_batched_newton_matches_single_fit(spark):
    df, X, y = _data(spark)
    names = ["a", "b", "c"]
    data = clf.design(df, names, "y", ["Alta", "Normal"], F.col("fold"))
    fits = newton.fit_batch(data, newton.Batch(names, ["a"], ["b", "c"], [None, 2]))
    assert fits.converged().all()
    for m, other in enumerate(["b", "c"]):
        for f, rows in ((0, df), (1, df.where("fold <> 2"))):
            single = clf.fit_logistic(rows, ["a", other], "y", ["Alta", "Normal"])
            assert single.converged
            assert np.allclose(fits.beta[f, m], single.beta, atol=1e-8)


def _auc(score, y):
    pos, neg = score[y == 1], score[y == 0]
    return np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))


def _logit_fit(Z, y):
    """Penalised fit by plain Newton steps on the whole matrix."""
    b = np.zeros(Z.shape[1])
    pen = np.r_[0.0, np.ones(Z.shape[1] - 1)]
    for _ in range(60):
        mu = 1 / (1 + np.exp(-Z @ b))
        b -= np.linalg.solve((Z * (mu * (1 - mu))[:, None]).T @ Z + np.diag(pen), Z.T @ (mu - y) + pen * b)
    return b


@pytest.mark.parametrize("seed", [0, 1])
def test_selection_by_bounds_equals_exact_auc(spark, seed, monkeypatch):
    """Same order and scores as exact AUC of every candidate; a repeated
    feature ties and the first one wins; few buckets force refinements and
    the exact scan."""
    df, X, y = _data(spark, n=400, seed=seed)
    rng = np.random.default_rng(seed + 50)
    extra = {"flag": (X[:, 0] + rng.normal(size=400) > 0).astype(float), "noise": rng.normal(size=400), "again": X[:, 1]}
    frame = df.toPandas().assign(**extra)
    names = ["c", "flag", "b", "again", "a", "noise"]
    df = spark.createDataFrame(frame).repartition(5)
    t, fold = (y == "Alta").astype(float), frame["fold"].to_numpy()
    want, chosen = [], []
    for step in range(1, 4):
        scores = {}
        for c in [c for c in names if c not in chosen]:
            Z = np.column_stack([np.ones(400), frame[[*chosen, c]].to_numpy()])
            scores[c] = np.mean([_auc(np.round(Z[fold == f] @ _logit_fit(Z[fold != f], t[fold != f]), 9), t[fold == f]) for f in range(5)])
        best = max(scores, key=lambda c: (round(scores[c], 12), -names.index(c)))
        chosen.append(best)
        want.append((step, best, pytest.approx(scores[best], abs=1e-12), True))
    for first, more in ((256, newton.MORE_BUCKETS), (4, (3,)), (8, (8, 64, 512))):
        monkeypatch.setattr(newton.best_by_auc, "__defaults__", (first, more))
        got, trace = clf.forward_select_classification(df, names, "y", ["Alta", "Normal"], F.col("fold"), 3)
        assert got == chosen and trace == want


def test_selection_holds_a_bounded_number_of_edges(spark, monkeypatch):
    """However many candidates are close, a pass holds MOST_EDGES edges at
    most; the choice and its score stay exact."""
    df, X, y = _data(spark, n=400, seed=2)
    rng = np.random.default_rng(7)
    near = {f"n{i}": X[:, 0] + 0.01 * rng.normal(size=400) for i in range(8)}
    frame = df.toPandas().assign(**near)
    names = ["b", *near]
    data = clf.design(spark.createDataFrame(frame), names, "y", ["Alta", "Normal"], F.col("fold"))
    batch = newton.Batch(names, [], names, [0, 1, 2, 3, 4])
    fits = newton.fit_batch(data, batch)
    want = newton.best_by_auc(data, batch, fits.beta)
    held, whole = [], newton._histograms

    def counted(data, b, beta, edges):
        held.append(sum(len(e) for e in edges.values()))
        return whole(data, b, beta, edges)

    monkeypatch.setattr(newton, "_histograms", counted)
    for most in (90, 600, 2000):
        monkeypatch.setattr(newton, "MOST_EDGES", most)
        held.clear()
        assert newton.best_by_auc(data, batch, fits.beta) == (want[0], pytest.approx(want[1], abs=1e-12))
        assert held and max(held) <= most


def test_label_grid_counts_every_test_row(spark):
    """The grid holds every pair of classes with its count, empty ones too."""
    from tabstat.plans import q_model
    from tests.conftest import SF001

    rows = q_model.q_label_grid(spark, SF001).collect()
    pred, target, classes = q_model._baseline_pred(spark, SF001)
    assert {(r["actual"], r["predicted"]) for r in rows} == {(a, p) for a in classes for p in classes}
    assert sum(r["count"] for r in rows) == pred.count()
    want = {(r[0], r[1]): r[2] for r in pred.groupBy(target, "predicted").count().collect()}
    assert all(r["count"] == want.get((r["actual"], r["predicted"]), 0) and r["hit"] == (r["actual"] == r["predicted"]) for r in rows)


def test_histogram_bounds_hold_the_auc():
    rng = np.random.default_rng(3)
    score, y = np.round(rng.normal(size=500), 2), (rng.random(500) < 0.4).astype(float)
    for cuts in (2, 10, 100):
        at = np.searchsorted(np.linspace(-3, 3, cuts), score, "right")
        own = [score[at == i] for i in np.unique(at)]
        h = newton.Histogram(np.array([y[at == i].sum() for i in np.unique(at)]), np.array([(1 - y[at == i]).sum() for i in np.unique(at)]),
                             np.array([o.min() for o in own]), np.array([o.max() for o in own]))
        low, high = h.bounds()
        assert low - 1e-12 <= _auc(score, y) <= high + 1e-12


def test_moved_rows_do_not_grow_with_the_data(spark):
    """The histograms that meet are as many for five times the rows."""
    def buckets(n):
        df, X, y = _data(spark, n=n)
        names = ["a", "b"]
        data = clf.design(df.coalesce(1), names, "y", ["Alta", "Normal"], F.col("fold"))
        batch = newton.Batch(names, [], names, [0, 1, 2, 3, 4])
        found = newton._histograms(data, batch, np.ones((5, 2, 1, 2)), {(f, m): np.linspace(-2, 2, 20) for f in range(5) for m in range(2)})
        return sum(len(h.pos) for h in found.values())

    assert buckets(1000) <= buckets(5000) <= 5 * 2 * 21


def _three(spark, n=450, seed=4):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, 4))
    eta = np.stack([X[:, 0], 0.8 * X[:, 1], 0.3 - X[:, 0]], axis=1) + rng.gumbel(size=(n, 3))
    y = np.array(["Alta", "Baja", "Media"])[eta.argmax(axis=1)]
    fold = np.arange(n) % 3
    rows = [(*map(float, X[i]), str(y[i]), int(fold[i])) for i in range(n)]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, y string, fold int").repartition(4), X, y, fold


def _softmax_fit(Z, y, classes):
    k = Z.shape[1]
    b, pen = np.zeros((classes, k)), np.r_[0.0, np.ones(k - 1)]
    for _ in range(60):
        e = np.exp(Z @ b.T)
        p = e / e.sum(axis=1, keepdims=True)
        g = ((p - np.eye(classes)[y]).T @ Z + pen * b).ravel()
        h = np.zeros((classes * k, classes * k))
        for i in range(classes):
            for j in range(classes):
                h[i * k : i * k + k, j * k : j * k + k] = (Z * (p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ Z
        b -= np.linalg.lstsq(h + np.diag(np.tile(pen, classes)), g, rcond=1e-12)[0].reshape(classes, k)
    return b


def test_three_classes_equal_refitting_each_candidate(spark):
    df, X, y, fold = _three(spark)
    classes, names = ["Alta", "Baja", "Media"], ["d", "c", "b", "a"]
    t = np.array([classes.index(v) for v in y])
    cols = {n: X[:, i] for i, n in enumerate("abcd")}
    want, chosen = [], []
    for step in (1, 2):
        scores = {}
        for c in [c for c in names if c not in chosen]:
            Z = np.column_stack([np.ones(len(t)), *[cols[n] for n in [*chosen, c]]])
            f1 = []
            for f in range(3):
                said = (Z[fold == f] @ _softmax_fit(Z[fold != f], t[fold != f], 3).T).argmax(axis=1)
                conf = np.zeros((3, 3))
                np.add.at(conf, (t[fold == f], said), 1)
                own = [2 * conf[k, k] / max(1, conf[k].sum() + conf[:, k].sum()) for k in range(3)]
                f1.append(np.dot(own, conf.sum(axis=1)) / conf.sum())
            scores[c] = np.mean(f1)
        best = max(scores, key=lambda c: (round(scores[c], 12), -names.index(c)))
        chosen.append(best)
        want.append((step, best, pytest.approx(scores[best], abs=1e-11), True))
    got, trace = clf.forward_select_classification(df, names, "y", classes, F.col("fold"), 2)
    assert got == chosen and trace == want
    m = clf.fit_logistic(df, ["a", "b"], "y", classes)
    Z = np.column_stack([np.ones(len(t)), X[:, :2]])
    eta = Z @ _softmax_fit(Z, t, 3).T
    p = np.exp(eta) / np.exp(eta).sum(axis=1, keepdims=True)
    out = m.predict(df, ["a", "y"]).toPandas().set_index("a")
    for i in range(0, len(t), 37):
        assert out.loc[X[i, 0], "proba"] == pytest.approx(p[i, 0], abs=1e-8)
        assert out.loc[X[i, 0], "predicted"] == classes[p[i].argmax()]


def test_unfinished_fits_are_told(spark):
    df, X, y = _data(spark)
    m = clf.fit_logistic(df, ["a", "b"], "y", ["Alta", "Normal"], max_steps=1)
    assert not m.converged and m.gradient > newton.TOL


def test_logistic_model_is_stored(spark, tmp_path):
    from pyspark.ml import PipelineModel

    df, X, y = _data(spark)
    m = clf.fit_logistic(df, ["a", "b"], "y", ["Alta", "Normal"])
    PipelineModel(stages=[m.stage]).write().overwrite().save(str(tmp_path / "m"))
    back = PipelineModel.load(str(tmp_path / "m")).transform(df)
    a = {r.k: (r.probability, r.prediction) for r in m.stage.transform(df).collect()}
    assert {r.k: (r.probability, r.prediction) for r in back.collect()} == a


def test_auc_roc_pr_confusion(spark):
    rng = np.random.default_rng(3)
    s = np.round(rng.random(300), 2)
    yy = rng.random(300) < s
    df = spark.createDataFrame([(float(a), "Alta" if b else "Normal", "Alta" if a > 0.5 else "Normal") for a, b in zip(s, yy)],
                               "proba double, y string, predicted string")
    auc = clf.roc_auc(df, "y", "Alta")
    pos, neg = s[yy], s[~yy]
    brute = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert auc == pytest.approx(brute, abs=1e-12)
    roc = sorted((r.fpr, r.tpr) for r in clf.roc_curve(df, "y", "Alta").collect())
    assert roc[0] == (0.0, 0.0) and roc[-1] == (1.0, 1.0)
    assert all(a[1] <= b[1] for a, b in zip(roc, roc[1:]))
    pr = clf.pr_curve(df, "y", "Alta").collect()
    assert any(r.recall == 0.0 and r.precision == 1.0 for r in pr)
    grid = clf.confusion_grid(df, "y", ["Alta", "Normal"]).collect()
    assert len(grid) == 4 and sum(r["count"] for r in grid) == 300


def test_metrics_zero_division(spark):
    df = spark.createDataFrame([("Alta", "Normal"), ("Normal", "Normal")], "y string, predicted string")
    m = clf.classification_metrics(df, "y", "Alta")
    assert m["precision"] == 0.0 and m["recall"] == 0.0 and m["f1"] == 0.0 and m["accuracy"] == 0.5


def test_histograms_own_their_rows(spark):
    """F2 to F4: a histogram that is kept must not keep the rows of all
    models of its pass in the driver's memory."""
    df, _, _ = _data(spark)
    names = ["a", "b", "c"]
    data = clf.design(df, names, "y", ["Alta", "Normal"], F.col("fold"))
    batch = newton.Batch(names, [], names, [0, 1, 2, 3, 4])
    found = newton._histograms(data, batch, np.ones((5, 3, 1, 2)), {(f, m): np.linspace(-2, 2, 20) for f in range(5) for m in range(3)})
    assert sorted(found) == [(f, m) for f in range(5) for m in range(3)]
    assert sum(h.pos.sum() + h.neg.sum() for h in found.values()) == 3 * df.count()
    for h in found.values():
        assert all(column.base is None for column in (h.pos, h.neg, h.low, h.high))
        assert (h.low <= h.high).all() and (h.high[:-1] < h.low[1:]).all()


def test_histograms_stay_on_the_executors(spark, monkeypatch):
    """what the driver reads of a pass are bounds per model and the cuts of
    the models that go on, no row per bucket."""
    df, _, _ = _data(spark)
    names = ["a", "b", "c"]
    data = clf.design(df, names, "y", ["Alta", "Normal"], F.col("fold"))
    batch = newton.Batch(names, [], names, [0, 1, 2, 3, 4])
    monkeypatch.setattr(type(data), "toArrow", None)
    monkeypatch.setattr(type(data), "toPandas", None)
    read, collect = [], type(data).collect
    monkeypatch.setattr(type(data), "collect", lambda self: read.append(collect(self)) or read[-1])
    found = newton._histograms(data, batch, np.ones((5, 3, 1, 2)), {(f, m): np.linspace(-2, 2, 20) for f in range(5) for m in range(3)})
    assert [len(rows) for rows in read] == [15]
    cuts = found.cuts({(0, 1): 8, (3, 2): 8})
    assert [len(rows) for rows in read] == [15, 2] and sorted(cuts) == [(0, 1), (3, 2)]
    for key, new in cuts.items():
        h = found[key]
        assert found.bounds[key] == (*h.bounds(), bool(h.contested().any()))
        assert new.tolist() == h.cuts(8).tolist() and 8 <= len(new) <= 16


def test_selection_reads_the_rows_once(spark, monkeypatch):
    """F1 to F5: the passes of a selection read packed blocks, written once,
    which hold the very rows of the design."""
    df, X, y = _data(spark)
    names = ["a", "b", "c"]
    data = clf.design(df.repartition(3), names, "y", ["Alta", "Normal"], F.col("fold"))
    blocks = [newton._decode(r["block"]) for r in newton.packed(data, names).collect()]
    assert all((np.diff(x[1]) >= 0).all() for x in blocks)
    want = sorted(map(tuple, data.collect()))
    assert sorted(map(tuple, np.concatenate(blocks, axis=1).T.tolist())) == want
    odd = np.array([[0.0, 255.0, 3.0], [0.0, 256.0, 1.0], [-1.0, 0.0, 1.0], [np.nan, 1.0, np.inf], [0.5, 1.0, 2.0]])
    assert np.array_equal(newton._decode(newton._encode(odd)), odd, equal_nan=True)
    read, whole = [], newton.tree_reduce
    monkeypatch.setattr(newton, "tree_reduce", lambda data, *a: read.append(data.columns) or whole(data, *a))
    clf.forward_select_classification(df, names, "y", ["Alta", "Normal"], F.col("fold"), 1)
    assert read and all(columns == ["block"] for columns in read)


def test_sums_of_far_scores(spark):
    """The loss from products of a piece's rows is the sum of their logs, also
    for scores whose exponential overflows."""
    rng = np.random.default_rng(5)
    for size in (1.0, 30.0, 900.0):
        z, x, y = np.concatenate([np.ones((1, 301)), rng.normal(size=(2, 301))]), rng.normal(size=(4, 301)), (rng.random(301) < 0.5).astype(float)
        beta = size * rng.normal(size=(4, 4))
        sums = newton._Sums(4, 3, True, 100)
        sums.add_run(z, x, np.arange(4), y, beta)
        for k, row in enumerate(sums.flat()):
            Z = np.concatenate([z, x[k : k + 1]])
            eta = beta[k] @ Z
            p = 0.5 * (1 + np.tanh(eta / 2))
            want = [301, (np.logaddexp(0, eta) - y * eta).sum(), *(Z @ (p - y)), *((Z * (p * (1 - p))) @ Z.T).ravel(), eta.sum(), (eta * eta).sum()]
            assert np.allclose(row, want, rtol=1e-9, atol=1e-9)


def test_first_pass_of_a_step_scores_a_fold_once(spark, monkeypatch):
    """Models of a fold that start from one score have the sums that scoring
    each of them gives."""
    df, X, y = _data(spark)
    names = ["a", "b", "c"]
    data = clf.design(df, names, "y", ["Alta", "Normal"], F.col("fold"))
    for shared, cands in (([], names), (["a"], ["b", "c"])):
        batch = newton.Batch(names, shared, cands, [0, 1, 2, 3, 4])
        beta = np.zeros((5, len(cands), 1, batch.width))
        beta[..., :-1] = np.arange(5)[:, None, None, None] / 7
        live = [(f, np.arange(len(cands))) for f in range(4)]
        first = newton._newton_pass(data, batch, beta, live)
        beta[3, 0, 0, -1] = 1e-300  # no longer alike, to the machine the same
        each = newton._newton_pass(data, batch, beta, live)
        assert sorted(first) == sorted(each) == ["0", "1", "2", "3"]
        assert all(np.allclose(first[f], each[f], rtol=1e-10, atol=1e-10) for f in first)
