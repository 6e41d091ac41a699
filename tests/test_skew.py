"""A third of the rows on one value / one key: results stay exact and whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabstat.config import Roles
from tabstat.operators.normality import ks_statistic
from tabstat.operators.profile import group_summary
from tabstat.operators.quantile import exact_quantiles
from tabstat.operators.rank import expand_positions, value_counts_ranked


@pytest.fixture(scope="module")
def hot(spark):
    rng = np.random.default_rng(11)
    n = 9000
    x = rng.normal(50, 10, size=n)
    x[: n // 3] = 42.0  # one hot value holds a third of the rows
    district = np.where(np.arange(n) < n // 3, "HOT", rng.choice(["A", "B", "C"], size=n))
    rows = [(i, float(v), str(d)) for i, (v, d) in enumerate(zip(x, district))]
    return spark.createDataFrame(rows, "obs_id long, speed double, district string").repartition(6), x, district


def test_quantiles_with_hot_value(hot):
    df, x, _ = hot
    probs = [0.1, 0.2, 0.3, 0.34, 0.5, 0.9]
    got = exact_quantiles(df, ["speed"], probs, accuracy=50, cap=100)
    for p in probs:
        assert got[("speed", p)] == pytest.approx(np.quantile(x, p))


def test_ranks_collapse_hot_value_and_expand_in_chunks(hot):
    df, x, _ = hot
    ranked = value_counts_ranked(df, "speed")
    hot_row = ranked.where(F.col("value") == 42.0).first()
    assert hot_row.cnt == len(x) // 3
    pos = expand_positions(ranked, chunk=500)
    got = sorted(r.position for r in pos.collect())
    assert got == list(range(1, len(x) + 1))


def test_ks_with_heavy_ties(hot):
    from tabstat.functions.normal import norm_cdf

    df, x, _ = hot
    r = ks_statistic(df, "speed")
    z = np.sort((x - x.mean()) / x.std())
    n = len(z)
    vals, idx = np.unique(z, return_index=True)
    ends = np.searchsorted(z, vals, side="right")
    cdf = np.array([norm_cdf(v) for v in vals])
    d = max(np.max(ends / n - cdf), np.max(cdf - idx / n))
    assert r.statistic == pytest.approx(d, abs=1e-12)


def test_group_summary_hot_district(hot):
    df, x, district = hot
    df = df.withColumn("seg_id", F.col("obs_id").cast("string")).withColumn("length", F.lit(1.0)).withColumn(
        "duration_min", F.lit(2.0))
    out = {r.district: r for r in group_summary(df, Roles()).collect()}
    assert out["HOT"].n_segments == len(x) // 3
    assert out["HOT"].speed_mean == 42.0
    assert sum(r.n_segments for r in out.values()) == len(x)
