import numpy as np
import pytest
from pyspark.sql import functions as F

from tabstat.operators.quantile import exact_quantiles
from tabstat.operators.rank import cumsum_and_totals, global_cumsum, global_row_number, value_counts_ranked


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=3000), np.full(500, 0.25), rng.exponential(size=1500)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(7)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(df, ["x"], probs)
    for p in probs:
        assert got[("x", p)] == pytest.approx(np.quantile(x, p), abs=1e-12)


def test_exact_quantiles_refine_path(spark):
    """A tiny accuracy and cap force the bracket-refining passes."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 50, size=4000).astype(float)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = exact_quantiles(df, ["x"], [0.1, 0.5, 0.9], accuracy=20, cap=50)
    for p in (0.1, 0.5, 0.9):
        assert got[("x", p)] == pytest.approx(np.quantile(x, p))


def test_global_row_number_equals_sort(spark):
    rng = np.random.default_rng(3)
    vals = rng.integers(0, 300, size=5000)
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(vals)], "k long, v long").repartition(5)
    out = global_row_number(df, "v", tiebreak=["k"]).select("k", "row_number").collect()
    order = sorted(range(len(vals)), key=lambda i: (vals[i], i))
    expect = {k: r + 1 for r, k in enumerate(order)}
    assert {r.k: r.row_number for r in out} == expect


def test_grouped_cumsum(spark):
    rows = [(g, float(v), 1.0) for g in (0, 1) for v in range(100)]
    df = spark.createDataFrame(rows, "g int, v double, w double")
    out = global_cumsum(df, "v", ["w"], group_cols=["g"]).collect()
    for r in out:
        assert r.cum_w == r.v + 1


def test_value_counts_ranked(spark):
    df = spark.createDataFrame([(v,) for v in [3.0, 1.0, 3.0, 2.0, 3.0]], "x double")
    out = {r.value: (r.cnt, r.start, r.end) for r in value_counts_ranked(df, "x").collect()}
    assert out == {1.0: (1, 0, 1), 2.0: (1, 1, 2), 3.0: (3, 2, 5)}


def test_windows_are_partitioned(spark):
    """No single-partition window in the rank plan."""
    df = spark.range(1000).withColumn("v", F.rand(1))
    plan = global_row_number(df, "v", tiebreak=["id"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_exact_quantiles_ignore_nulls(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=2000)
    rows = [(float(v),) for v in x] + [(None,)] * 700
    df = spark.createDataFrame(rows, "x double").repartition(3)
    got = exact_quantiles(df, ["x"], [0.05, 0.25, 0.5, 0.75], accuracy=40, cap=100)
    for p in (0.05, 0.25, 0.5, 0.75):
        assert got[("x", p)] == pytest.approx(np.quantile(x, p), abs=1e-12)


def test_quantiles_of_few_values_need_no_narrowing(spark):
    """Eight distinct values: a tiny cap takes as many jobs as a large one."""
    df = spark.range(4000).select((F.col("id") % 8).cast("double").alias("x"))
    tracker = spark.sparkContext.statusTracker()
    jobs = []
    for cap in (9, 2_000_000):
        spark.sparkContext.setJobGroup(f"quantiles-{cap}", "count jobs")
        assert exact_quantiles(df, ["x"], [0.25, 0.5], cap=cap) == {("x", 0.25): 1.75, ("x", 0.5): 3.5}
        jobs.append(len(tracker.getJobIdsForGroup(f"quantiles-{cap}")))
    spark.sparkContext.setJobGroup("tests", "tests")
    assert jobs[0] <= jobs[1] + 2


def test_quantiles_ignore_nan(spark):
    df = spark.createDataFrame([(float(v),) for v in range(10)] + [(float("nan"),)] * 5, "x double")
    got = exact_quantiles(df, ["x"], [0.25, 0.5, 0.75, 0.95])
    assert [got["x", p] for p in (0.25, 0.5, 0.75, 0.95)] == pytest.approx([2.25, 4.5, 6.75, 8.55])


def test_row_numbers_of_large_integers_and_text(spark):
    top = 2**53
    df = spark.createDataFrame([(top + i,) for i in (3, 0, 5, 1, 4, 2)], "v long")
    assert {r.v - top: r.row_number for r in global_row_number(df, "v").collect()} == {i: i + 1 for i in range(6)}
    text = spark.createDataFrame([("b",), ("a",), ("c",)], "v string")
    assert [(r.v, r.row_number) for r in global_row_number(text, "v").orderBy("v").collect()] == [("a", 1), ("b", 2), ("c", 3)]


def test_hot_value_is_spread_over_ranges(spark):
    df = spark.range(9000).select("id", F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("v")).repartition(6)
    out = {r.id: r.row_number for r in global_row_number(df, "v", tiebreak=["id"]).collect()}
    order = sorted(range(9000), key=lambda i: (7 if i < 3000 else i, i))
    assert out == {i: n + 1 for n, i in enumerate(order)}


def test_rows_are_shuffled_once(spark):
    """The rows move to their ranges and never again; only the range table is
    sent on."""
    df = spark.range(5000).withColumn("v", F.rand(1)).withColumn("w", F.lit(1))
    for out in (global_row_number(df, "v", tiebreak=["id"]), global_cumsum(df, "v", ["w"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan and "Window" not in plan


def test_grouped_cumsum_carries_into_later_ranges(spark):
    """One group over all ranges, small and null groups, null values."""
    rng = np.random.default_rng(6)
    rows = [(g, i, None if v == 7 else int(v)) for i, (g, v) in enumerate(zip(rng.choice(["a", "hot", "hot", "hot", "z", None], 4000), rng.integers(0, 9, 4000)))]
    rows = [(None if g is None else str(g), i, v) for g, i, v in rows] + [(f"g{i}", i, 1) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, k long, w int").repartition(6)
    out = {(r.g, r.k): r.cum_w for r in global_cumsum(df, "k", ["w"], group_cols=["g"], descending=True).collect()}
    sums, want = {}, {}
    for g, k, w in sorted(rows, key=lambda r: -r[1]):
        sums[g] = sums.get(g, 0) + (w or 0)
        want[g, k] = sums[g]
    assert out == want


def test_cumsum_totals(spark):
    df = spark.createDataFrame([(float(i), 0.5, i) for i in range(50)], "v double, a double, b int")
    out, total = cumsum_and_totals(df, "v", ["a", "b"])
    assert total == {"a": 25.0, "b": 1225}
    assert out.orderBy("v").select("cum_a", "cum_b").collect()[-1] == (25.0, 1225)
    empty, total = cumsum_and_totals(df.limit(0), "v", ["a"])
    assert empty.count() == 0 and total == {"a": 0}


def test_missed_brackets_are_opened_and_narrowed_again(spark, monkeypatch):
    """Wrong first brackets: they are opened, and what they hold is narrowed
    to the cap again."""
    from tabstat.operators import quantile

    rng = np.random.default_rng(9)
    x = rng.normal(size=3000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(3)
    seen = []
    real = quantile._final

    def final(df, state):
        seen.append({k: (s["L"], s["U"]) for k, s in state.items()})
        return real(df, state)

    refine = quantile._refine

    def missed(df, state, accuracy, cap):
        for s in state.values():
            s["L"], s["U"] = 5.0, 6.0
        return refine(df, state, accuracy, cap)

    monkeypatch.setattr(quantile, "_final", final)
    monkeypatch.setattr(quantile, "_refine", missed)
    got = quantile.exact_quantiles(df, ["x"], [0.3], accuracy=200, cap=400)
    assert got["x", 0.3] == pytest.approx(np.quantile(x, 0.3), abs=1e-12)
    lo, hi = seen[-1]["x", 0.3]
    assert ((x >= lo) & (x <= hi)).sum() <= 600


def test_final_pass_of_many_columns_is_compiled(spark, monkeypatch):
    """the code of the last pass must stay under the size that the JVM
    compiles, however many columns there are."""
    from tabstat.operators import quantile

    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(400, 12)), 2)
    x[rng.random(x.shape) < 0.1] = np.nan
    cols = [f"c{i}" for i in range(12)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in cols))
    seen, explode = [], F.explode
    monkeypatch.setattr(quantile.F, "explode", lambda c: seen.append(c) or explode(c))
    got = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    for i, c in enumerate(cols):
        for p in (0.25, 0.5, 0.75):
            assert got[(c, p)] == pytest.approx(np.nanquantile(x[:, i], p), abs=1e-12)
    assert len(seen) >= 2  # the first pass and the last one, which missed brackets repeat
    for c in seen:  # a row carries its column and value, nothing per bracket
        assert len(df.select(c.alias("s")).schema["s"].dataType.elementType) == 2


def test_grouped_row_number(spark):
    """F8, F11: numbers within groups that span ranges, null groups included."""
    from tabstat.operators.rank import grouped_row_number

    rng = np.random.default_rng(6)
    rows = [(i, [None, "a", "b"][g], int(h)) for i, (g, h) in enumerate(zip(rng.choice(3, 3000, p=[0.01, 0.9, 0.09]), rng.integers(0, 50, 3000)))]
    df = spark.createDataFrame(rows, "id long, g string, h long").repartition(6)
    got = {r.id: r.n for r in grouped_row_number(df, "h", ["g"], tiebreak=["id"], name="n").collect()}
    for g in (None, "a", "b"):
        own = sorted((h, i) for i, k, h in rows if k == g)
        assert [got[i] for _, i in own] == list(range(1, len(own) + 1))
