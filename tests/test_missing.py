"""NaN is missing, as null is, in every statistic of the profile: all tables
against pandas. Density against the exact sum."""

import math

import numpy as np
import pandas as pd
import pytest

from tabstat.config import Roles
from tabstat.operators import columns
from tabstat.operators import profile as prof

N = 400


@pytest.fixture(scope="module")
def both(spark):
    rng = np.random.default_rng(12)
    frame = pd.DataFrame({"a": rng.normal(10, 2, N), "b": rng.exponential(3, N), "c": np.round(rng.normal(size=N), 1)})
    frame["b"] += frame["a"]
    gone = rng.random((N, 3)) < 0.25
    frame = frame.mask(gone)
    # half of the missing values are null, half NaN
    null = rng.random((N, 3)) < 0.5
    rows = [[None if np.isnan(v) and null[i, j] else float(v) for j, v in enumerate(r)] for i, r in enumerate(frame.to_numpy())]
    df = spark.createDataFrame([(*r, f"g{i % 3}", i) for i, r in enumerate(rows)], "a double, b double, c double, g string, k long").repartition(5)
    return df, frame.assign(g=[f"g{i % 3}" for i in range(N)], k=range(N))


COLS = ["a", "b", "c"]


def test_missing_report_and_columns(both):
    df, frame = both
    got = {r.variable: r.n_missing for r in prof.missing_report(df).collect()}
    assert got == frame.isna().sum().to_dict()


def test_numeric_summary(both):
    df, frame = both
    for r in prof.numeric_summary(df, COLS, digits=None).collect():
        x = frame[r.variable]
        want = [x.count(), x.mean(), x.std(), x.min(), x.quantile(0.25), x.median(), x.quantile(0.75), x.max(), x.skew(), x.kurt()]
        assert list(r)[1:] == pytest.approx(want, rel=1e-9)


def test_correlation(both):
    df, frame = both
    want = frame[COLS].corr()
    for r in prof.correlation_long(df, COLS).collect():
        assert r["corr"] == pytest.approx(want.loc[r.var1, r.var2], abs=1e-12)


def test_histogram(both):
    df, frame = both
    got = prof.histogram_bins(df, COLS).toPandas()
    for c in COLS:
        counts, edges = np.histogram(frame[c].dropna(), bins="auto")
        own = got[got.variable == c].sort_values("bin")
        assert own["count"].tolist() == counts.tolist()
        assert own["lower"].tolist() == pytest.approx(edges[:-1].tolist())


def test_boxplot(both):
    df, frame = both
    for r in prof.boxplot_stats(df, COLS).collect():
        x = frame[r.variable].dropna()
        q1, q3 = x.quantile(0.25), x.quantile(0.75)
        inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
        assert (r.q1, r.median, r.q3, r.whisker_low, r.whisker_high) == pytest.approx((q1, x.median(), q3, inside.min(), inside.max()))
        assert r.n_outliers == len(x) - len(inside)


def test_group_means(both):
    df, frame = both
    want = frame.groupby("g")["a"].mean().round(2).to_dict()
    assert {r.g: r.m for r in prof.group_mean(df, "g", "a", "m").collect()} == pytest.approx(want)
    roles = Roles(district="g", seg_id="k", speed_num="a", length_num="b", duration_min="c")
    summary = {r.g: r for r in prof.group_summary(df, roles).collect()}
    for g, own in frame.groupby("g"):
        assert (summary[g].speed_mean, summary[g].speed_std, summary[g].length_mean) == pytest.approx((own.a.mean(), own.a.std(), own.b.mean()), abs=0.006)


def test_imputed_and_dropped(both):
    df, frame = both
    got = columns.impute_mean(df, COLS).toPandas()[COLS].mean()
    assert got.tolist() == pytest.approx(frame[COLS].mean().tolist())
    assert columns.drop_missing_rows(df, "a", ["b"]).count() == len(frame.dropna(subset=["a", "b"]))


def _exact_density(x, grid=200):
    h = x.std(ddof=1) * len(x) ** -0.2
    at = np.linspace(x.min(), x.max(), grid)
    return at, np.exp(-0.5 * ((at[:, None] - x) / h) ** 2).sum(axis=1) / (len(x) * h * math.sqrt(2 * math.pi)), h


@pytest.mark.parametrize("shape", ["normal", "tails", "ties", "far"])
def test_density_is_within_its_bound(spark, shape):
    rng = np.random.default_rng(3)
    x = {"normal": rng.normal(size=3000), "tails": rng.standard_cauchy(1500), "ties": rng.integers(0, 5, 2000) * 1.0,
         "far": rng.normal(1e6, 1e-2, 1000)}[shape]
    df = spark.createDataFrame([(float(v),) for v in x] + [(float("nan"),), (None,)], "x double").repartition(4)
    at, want, h = _exact_density(x)
    got = prof.density_grid(df, "x").orderBy("point").toPandas()
    assert got["x"].to_numpy() == pytest.approx(at, rel=1e-12)
    bound = max(1e-12, prof.gauss_error()) / (h * math.sqrt(2 * math.pi)) + 1e-9 * want.max()
    assert np.abs(got["density"].to_numpy() - want).max() <= bound
    assert prof.gauss_error() < 4e-12


def test_density_of_many_values(spark):
    df = spark.range(200_000).selectExpr("(id * 7919) % 200003 / 200003.0 as x")
    got = prof.density_grid(df, "x").orderBy("point").toPandas()
    assert len(got) == 200
    assert got["density"].iloc[50:150].to_numpy() == pytest.approx(1.0, abs=0.01)
