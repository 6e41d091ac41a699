"""Exact quantiles (linear interpolation) without one big aggregation buffer.

``percentile`` keeps every distinct value of a column in one final buffer,
which does not survive 100 TB. Here:

1. one aggregate gives n per column and a bracket [L, U] around every target
   rank from ``percentile_approx`` (rank error <= n / accuracy); other
   aggregates of the caller ride along in the same pass;
2. when the data are so large that a bracket could still hold more than
   ``cap`` distinct values, refining aggregates narrow it with
   ``percentile_approx`` restricted to the bracket, until it holds fewer or
   no longer shrinks;
3. a last pass keeps only values inside the brackets (rows below a bracket
   are counted, not kept), counts them per distinct value, and a window
   *partitioned by column* over these (at most ``cap`` per bracket) finds the
   two order statistics. A bracket that missed its target is opened, counted
   and searched again.

Every pass is a plain aggregate with map-side combine; only scalars reach
the driver. Heavy ties collapse in the ``groupBy(value)``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_ACCURACY = 10_000
DEFAULT_CAP = 2_000_000


def _targets(n: int, p: float) -> tuple[int, int, float]:
    h = (n - 1) * p
    lo = int(math.floor(h))
    hi = int(math.ceil(h))
    return lo, hi, h - lo


def _x(c: str):
    """The column as double; NaN is missing, as in the rest of the profile."""
    x = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(x), x)


def _refine(df: DataFrame, state: dict, accuracy: int, cap: int) -> None:
    """Count below/inside every bracket; open missed brackets and narrow
    large ones until all are verified and small."""
    eps = 3.0 / accuracy
    while True:
        items = list(state.items())
        aggs = []
        for k, ((c, p), s) in enumerate(items):
            x = _x(c)
            below = (x < F.lit(s["L"])) if s["L"] is not None else F.lit(False)
            inside = x.isNotNull()
            if s["L"] is not None:
                inside = inside & (x >= F.lit(s["L"]))
            if s["U"] is not None:
                inside = inside & (x <= F.lit(s["U"]))
            aggs += [F.count_if(below).alias(f"below{k}"), F.count_if(inside).alias(f"in{k}"),
                     F.approx_count_distinct(F.when(inside, x)).alias(f"values{k}")]
        row = df.agg(*aggs).collect()[0]
        todo = []
        for k, ((c, p), s) in enumerate(items):
            s["below"], s["inside"] = row[f"below{k}"], row[f"in{k}"]
            if s["L"] is not None and s["below"] > s["lo"]:
                s["L"] = None
                todo.append(("open", k))
            elif s["U"] is not None and s["below"] + s["inside"] < s["hi"] + 1:
                s["U"] = None
                todo.append(("open", k))
            elif row[f"values{k}"] > cap and not s.get("least"):
                # what the final pass keeps is distinct values, not rows
                todo.append(("narrow", k))
        if not todo:
            return
        aggs = []
        for kind, k in todo:
            (c, p), s = items[k]
            x = _x(c)
            if kind == "open":
                cond = x.isNotNull()
                if s["L"] is not None:
                    cond = cond & (x >= F.lit(s["L"]))
                if s["U"] is not None:
                    cond = cond & (x <= F.lit(s["U"]))
                aggs += [F.min(F.when(cond, x)).alias(f"mn{k}"), F.max(F.when(cond, x)).alias(f"mx{k}")]
            else:
                inside = s["inside"]
                f_lo = (s["lo"] - s["below"]) / max(inside - 1, 1)
                f_hi = (s["hi"] - s["below"]) / max(inside - 1, 1)
                inner = F.when(x.between(F.lit(s["L"]), F.lit(s["U"])), x)
                aggs.append(F.percentile_approx(inner, [max(0.0, f_lo - eps * s.get("slack", 1)), min(1.0, f_hi + eps * s.get("slack", 1))], accuracy).alias(f"r{k}"))
        row = df.agg(*aggs).collect()[0]
        for kind, k in todo:
            s = items[k][1]
            if kind == "open":
                s["L"] = row[f"mn{k}"] if s["L"] is None else s["L"]
                s["U"] = row[f"mx{k}"] if s["U"] is None else s["U"]
                # a bracket that had missed is narrowed with more room, so it
                # either holds its target or stays whole in the end
                s["slack"], s["least"] = 4 * s.get("slack", 1), False
            else:
                now = tuple(row[f"r{k}"])
                s["least"] = now == (s["L"], s["U"])
                s["L"], s["U"] = now


def _final(df: DataFrame, state: dict) -> dict:
    """Order statistics at ranks lo and hi of every bracket, or a miss.

    Per column the brackets are merged into disjoint intervals; every row
    emits one record: its value when it falls inside an interval, else only
    the number of intervals below it (rows above the last interval are
    dropped). Counting by (column, interval index, value) and a running sum
    partitioned by column gives exact ranks inside the intervals."""
    by_col: dict[str, list] = {}
    for (c, p), s in state.items():
        by_col.setdefault(c, []).append((s["L"], s["U"]))
    intervals: dict[str, list[tuple[float, float]]] = {}
    for c, br in by_col.items():
        merged: list[list[float]] = []
        for lo_v, hi_v in sorted(br):
            if merged and lo_v <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], hi_v)
            else:
                merged.append([lo_v, hi_v])
        intervals[c] = [(a_, b_) for a_, b_ in merged]
    cols = list(intervals)
    # rows carry (column, value) only, and a column's bounds are looked up: the
    # code does not grow with the columns, so the JVM compiles it
    structs = [F.struct(F.lit(ci).alias("ci"), _x(c).alias("v")) for ci, c in enumerate(cols)]
    idx, inside = F.lit(0), F.lit(False)
    for i in range(max(len(ivs) for ivs in intervals.values())):
        lower, upper = (F.get(F.array(*[F.lit(intervals[c][i][side] if i < len(intervals[c]) else None).cast("double") for c in cols]), F.col("ci")) for side in (0, 1))
        idx = idx + F.when(F.col("v") > upper, 1).otherwise(0)
        inside = inside | F.coalesce(F.col("v").between(lower, upper), F.lit(False))
    known = F.get(F.array(*[F.lit(len(intervals[c])) for c in cols]), F.col("ci"))
    cand = (
        df.select(F.explode(F.array(*structs)).alias("s"))
        .select("s.ci", "s.v")
        .where(F.col("v").isNotNull())
        .select("ci", "v", idx.alias("idx"), inside.alias("inside"))
        .where(F.col("inside") | (F.col("idx") < known))
        .select("ci", "idx", "inside", F.when(F.col("inside"), F.col("v")).alias("v"))
        .groupBy("ci", "idx", "inside", "v")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    items = list(state.items())
    targets = df.sparkSession.createDataFrame(
        [(cols.index(c), k, s["lo"], s["hi"]) for k, ((c, _), s) in enumerate(items)],
        "ci int, qid int, lo long, hi long")
    w = (Window.partitionBy("ci").orderBy("idx", F.col("inside").asc(), F.col("v").asc_nulls_first())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = (
        cand.withColumn("cum", F.sum("cnt").over(w))
        .withColumn("first_rank", F.col("cum") - F.col("cnt"))
        .where(F.col("inside"))
        .join(F.broadcast(targets), "ci")
        .where(((F.col("first_rank") <= F.col("lo")) & (F.col("cum") > F.col("lo")))
               | ((F.col("first_rank") <= F.col("hi")) & (F.col("cum") > F.col("hi"))))
        .select("qid", "v", "first_rank", "cum", "lo", "hi")
    )
    picks: dict[int, dict[str, float]] = {}
    for r in ranked.collect():
        d = picks.setdefault(r["qid"], {})
        if r["first_rank"] <= r["lo"] < r["cum"]:
            d["lo"] = r["v"]
        if r["first_rank"] <= r["hi"] < r["cum"]:
            d["hi"] = r["v"]
    return {items[k][0]: d for k, d in picks.items()}


def column_stats(df: DataFrame, cols: list[str], probs: list[float] | None = None, accuracy: int = DEFAULT_ACCURACY,
                 moments: bool = True) -> dict[str, dict]:
    """Per column, in one pass over a long (variable, value) form: count,
    mean, sample std, min, max, population skewness/kurtosis/variance and,
    with ``probs``, approximate brackets around those quantiles. The long
    form keeps the aggregation buffer narrow (whole-stage codegen stays on
    for any number of columns)."""
    eps = 3.0 / accuracy
    structs = [F.struct(F.lit(i).alias("ci"), _x(c).alias("x")) for i, c in enumerate(cols)]
    long = df.select(F.explode(F.array(*structs)).alias("s")).select("s.ci", "s.x")
    aggs = [F.count("x").alias("n")]
    if moments:
        aggs += [F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"),
                 F.max("x").alias("max"), F.skewness("x").alias("g1"), F.kurtosis("x").alias("g2"),
                 F.var_pop("x").alias("var")]
    if probs:
        pcts = []
        for p in probs:
            pcts += [max(0.0, p - eps), min(1.0, p + eps)]
        aggs.append(F.percentile_approx("x", pcts, accuracy).alias("brackets"))
    out = {c: {"n": 0} for c in cols}
    for r in long.groupBy("ci").agg(*aggs).collect():
        out[cols[r["ci"]]] = r.asDict()
    return out


def exact_quantiles_with(
    df: DataFrame,
    cols: list[str],
    probs: list[float],
    accuracy: int = DEFAULT_ACCURACY,
    cap: int = DEFAULT_CAP,
    moments: bool = False,
):
    """({(column, p): quantile}, column_stats) with NumPy's default (linear)
    rule; the per-column moments share the first pass."""
    eps = 3.0 / accuracy
    stats = column_stats(df, cols, probs, accuracy, moments)
    result: dict[tuple[str, float], float | None] = {(c, p): None for c in cols for p in probs}
    state: dict[tuple[str, float], dict] = {}
    for c in cols:
        st = stats[c]
        bounds = st.get("brackets")
        for j, p in enumerate(probs):
            if not st["n"] or bounds is None:
                continue
            lo, hi, frac = _targets(st["n"], p)
            state[(c, p)] = {"L": bounds[2 * j], "U": bounds[2 * j + 1], "lo": lo, "hi": hi, "frac": frac}
    if state and max(st["n"] for st in stats.values()) * 2 * eps > cap:
        _refine(df, state, accuracy, cap)  # very large data: narrow before the final pass
    checked = False
    while state:
        picks = _final(df, state)
        missed = {}
        for key, s in state.items():
            d = picks.get(key, {})
            if "lo" in d and "hi" in d:
                result[key] = d["lo"] + s["frac"] * (d["hi"] - d["lo"])
            else:
                missed[key] = s
        if missed and checked:
            raise RuntimeError(f"quantiles {sorted(missed)} not found: the data changed between passes")
        if missed:
            _refine(df, missed, accuracy, cap)  # brackets are counted and hold their ranks after this
            checked = True
        state = missed
    return result, stats


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], accuracy: int = DEFAULT_ACCURACY,
                    cap: int = DEFAULT_CAP, counts: dict[str, int] | None = None) -> dict:
    """{(column, p): quantile} with NumPy's default (linear) rule."""
    if not cols or not probs:
        return {}
    return exact_quantiles_with(df, cols, probs, accuracy, cap)[0]
