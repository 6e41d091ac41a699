"""Profiling aggregates: one wide aggregate per statistic family, then a
long form with ``stack``. Only small per-column rows reach the driver."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MISSING_LABEL, Roles
from ..functions.numeric import known as value_of
from .quantile import column_stats, exact_quantiles, exact_quantiles_with


def q(c: str):
    return F.col(f"`{c}`")


def present(df: DataFrame, names: list[str]) -> list[str]:
    cols = set(df.columns)
    return [c for c in names if c in cols]


# ----------------------------------------------------------------------------- group summaries


def group_summary(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Per district: count of non-missing segment ids, mean and sample std of
    speed, mean length, mean duration; missing keys dropped; rounded to 2.

    ``groupBy`` aggregates partially on the map side, so a district holding a
    third of the rows is combined before the shuffle.
    """
    # fixed values: the result columns and what they aggregate
    g = df.where(q(roles.district).isNotNull()).groupBy(q(roles.district).alias(roles.district))
    aggs = {
        "n_segments": F.count(q(roles.seg_id)) if roles.seg_id in df.columns else F.lit(None).cast("long"),
        "speed_mean": F.avg(value_of(df, roles.speed_num)),
        "speed_std": F.stddev_samp(value_of(df, roles.speed_num)),
        "length_mean": F.avg(value_of(df, roles.length_num)),
        "duration_min_mean": F.avg(value_of(df, roles.duration_min)),
    }
    out = g.agg(*[v.alias(k) for k, v in aggs.items()])
    return out.select(
        roles.district,
        "n_segments",
        *[F.round(k, 2).alias(k) for k in ("speed_mean", "speed_std", "length_mean", "duration_min_mean")],
    )


def group_mean(df: DataFrame, by: str, value: str, alias: str = "mean_value", digits: int | None = 2) -> DataFrame:
    """Mean of ``value`` per ``by`` level (missing keys kept as their own group,
    like a plain groupby of a column without missing)."""
    m = F.avg(value_of(df, value))
    if digits is not None:
        m = F.round(m, digits)
    return df.groupBy(q(by).alias(by)).agg(m.alias(alias))


def group_argmin(summary: DataFrame, key: str, value: str) -> DataFrame:
    """The row with the smallest ``value`` (ties: smallest key)."""
    best = summary.where(F.col(value).isNotNull()).agg(
        F.min_by(F.struct(F.col(key), F.col(value)), F.struct(F.col(value), F.col(key))).alias("b")
    )
    return best.select(F.col(f"b.{key}").alias(key), F.col(f"b.{value}").alias(value)).where(F.col(key).isNotNull())


# ----------------------------------------------------------------------------- numeric summary


def _sample_skew(st: dict) -> float | None:
    n = st["n"]
    if n < 3 or st["var"] is None:
        return None
    if st["var"] == 0:
        return 0.0
    return st["g1"] * math.sqrt(n * (n - 1)) / (n - 2)


def _sample_kurtosis(st: dict) -> float | None:
    n = st["n"]
    if n < 4 or st["var"] is None:
        return None
    if st["var"] == 0:
        return 0.0
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * st["g2"] + 6)


def numeric_summary(df: DataFrame, columns: list[str], digits: int | None = 2, quantile_accuracy: int = 10_000,
                    keep: dict | None = None):
    """count, mean, std (n-1), min, q25, median, q75, max, bias-corrected skew
    and excess kurtosis per column: one long-form moments pass (with the
    quantile brackets) + the exact-quantile pass. ``keep`` (a dict) receives
    the unrounded quartiles and column stats for reuse by later steps."""
    cols = present(df, columns)
    if not cols:
        return None
    quant, stats = exact_quantiles_with(df, cols, [0.25, 0.5, 0.75], accuracy=quantile_accuracy, moments=True)
    if keep is not None:
        keep.update({"quantiles": quant, "stats": stats})
    records = []
    for c in cols:
        st = stats[c]
        if not st["n"]:
            records.append((c, 0.0) + (None,) * 9)
            continue
        records.append((c, float(st["n"]), st["mean"], st["std"], st["min"], quant[(c, 0.25)], quant[(c, 0.5)],
                        quant[(c, 0.75)], st["max"], _sample_skew(st), _sample_kurtosis(st)))
    schema = (
        "variable string, count double, mean double, std double, min double, q25 double, median double, "
        "q75 double, max double, skew double, kurtosis double"
    )
    out = df.sparkSession.createDataFrame(records, schema)
    if digits is not None:
        out = out.select("variable", *[F.round(c, digits).alias(c) for c in out.columns[1:]])
    return out


# ----------------------------------------------------------------------------- categorical


def _long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, value) pairs for the listed columns, as strings."""
    structs = [F.struct(F.lit(c).alias("variable"), q(c).cast("string").alias("value")) for c in columns]
    return df.select(F.explode(F.array(*structs)).alias("s")).select("s.variable", "s.value")


def categorical_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: distinct count, most frequent value and its count, missing
    ignored. Ties: highest count, then smallest value."""
    cols = present(df, columns)
    counts = (
        _long_form(df, cols)
        .where(F.col("value").isNotNull())
        .groupBy("variable", "value")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    # top value by a bounded aggregate (no window over a column's levels):
    # smallest (-count, value) = highest count, then smallest value
    prof = counts.groupBy("variable").agg(
        F.count(F.lit(1)).alias("n_distinct"),
        F.min_by(F.struct("value", "cnt"), F.struct(-F.col("cnt"), F.col("value"))).alias("t"),
    )
    top = prof.select("variable", "n_distinct", F.col("t.value").alias("top"), F.col("t.cnt").alias("freq_top"))
    base = df.sparkSession.createDataFrame([(c,) for c in cols], "variable string")
    return (
        base.join(F.broadcast(top), "variable", "left")
        .select("variable", F.coalesce("n_distinct", F.lit(0)).cast("long").alias("n_distinct"), "top", "freq_top")
    )


def category_counts(df: DataFrame, column: str, top_k: int | None = 20, label: str = MISSING_LABEL) -> DataFrame:
    """Value counts with missing shown as a label; top k by count, then value."""
    c = F.coalesce(q(column).cast("string"), F.lit(label)).alias("value")
    out = df.groupBy(c).agg(F.count(F.lit(1)).alias("count"))
    out = out.orderBy(F.col("count").desc(), F.col("value").asc())
    if top_k is not None:
        out = out.limit(top_k)
    return out.select(F.lit(column).alias("variable"), "value", "count")


def category_shares(df: DataFrame, column: str) -> DataFrame:
    """Relative frequency of each non-missing category. The total is one
    scalar aggregate, so no cross join and no global window is needed."""
    total = df.agg(F.count(q(column)).alias("t")).collect()[0]["t"]
    counts = df.where(q(column).isNotNull()).groupBy(q(column).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("count")
    )
    share = F.col("count") / F.lit(float(total)) if total else F.lit(None).cast("double")
    return counts.select(F.lit(column).alias("variable"), "value", "count", share.alias("share"))


# ----------------------------------------------------------------------------- missing values


def missing_report(df: DataFrame, digits: int = 2) -> DataFrame:
    """Per column missing count and percent (null or NaN), in column order."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("__n")] + [
        (F.count(F.lit(1)) - F.count(value_of(df, c))).alias(f"m{i}") for i, c in enumerate(cols)
    ]
    agg = df.agg(*aggs)
    structs = [
        F.struct(F.lit(i).alias("pos"), F.lit(c).alias("variable"), F.col(f"m{i}").alias("n_missing"))
        for i, c in enumerate(cols)
    ]
    long = agg.select("__n", F.explode(F.array(*structs)).alias("s"))
    pct = F.when(F.col("__n") > 0, F.round(F.col("s.n_missing") / F.col("__n") * 100.0, digits))
    return long.select(F.col("s.pos").alias("pos"), F.col("s.variable").alias("variable"),
                       F.col("s.n_missing").cast("long").alias("n_missing"), pct.alias("pct_missing"))


# ----------------------------------------------------------------------------- correlation


def correlation_long(df: DataFrame, columns: list[str], digits: int | None = None) -> DataFrame:
    """Pearson correlation, pairwise complete, every ordered pair (long form).

    One pass keeps, per column pair, the count, means and centred co-moments
    of the rows where both are present (null and NaN are missing), merged over
    batches and tasks; a constant column gives NULL."""
    from .gram import pairwise_comoments

    cols = present(df, columns)
    n, _, squares, products = pairwise_comoments(df, cols)
    records = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            va, vb = squares[i, j], squares[j, i]
            r = None
            if n[i, j] > 1 and va > 0 and vb > 0:
                r = float(max(-1.0, min(1.0, products[i, j] / math.sqrt(va * vb))))
            records.append((a, b, r))
    out = df.sparkSession.createDataFrame(records, "var1 string, var2 string, corr double")
    if digits is not None:
        out = out.withColumn("corr", F.round("corr", digits))
    return out


def correlation_pairs(corr_long: DataFrame, columns: list[str], threshold: float = 0.5) -> DataFrame:
    """Upper triangle (column order), |r| >= threshold, by |r| desc."""
    order = corr_long.sparkSession.createDataFrame(list(enumerate(columns)), "pos int, name string")
    o1 = order.select(F.col("pos").alias("p1"), F.col("name").alias("var1"))
    o2 = order.select(F.col("pos").alias("p2"), F.col("name").alias("var2"))
    return (
        corr_long.join(F.broadcast(o1), "var1")
        .join(F.broadcast(o2), "var2")
        .where((F.col("p1") < F.col("p2")) & F.col("corr").isNotNull() & (F.abs("corr") >= threshold))
        .orderBy(F.abs("corr").desc(), "p1", "p2")
        .select("var1", "var2", "corr")
    )


# ----------------------------------------------------------------------------- histogram / box plot / density


def _range_stats(df: DataFrame, cols: list[str]) -> dict[str, dict]:
    return column_stats(df, cols)


def auto_bins(n: int, lo: float, hi: float, iqr: float) -> int:
    """NumPy's 'auto' rule: width = min(Freedman-Diaconis, Sturges)."""
    ptp = hi - lo
    if n == 0 or ptp == 0:
        return 1
    sturges = ptp / (math.log2(n) + 1.0)
    fd = 2.0 * iqr * n ** (-1.0 / 3.0)
    width = min(fd, sturges) if fd > 0 else sturges
    return max(1, int(math.ceil(ptp / width)))


def histogram_bins(df: DataFrame, columns: list[str], known: dict | None = None) -> DataFrame:
    """Bin edges and counts per column (all bins, empty ones included; last
    bin closed). Bins come from one range pass and the exact quartiles (or
    ``known`` ones from ``numeric_summary``); the counting is one ``groupBy``
    over (variable, bin)."""
    cols = present(df, columns)
    if known:
        quart, st = known["quantiles"], known["stats"]
    else:
        quart, st = exact_quantiles_with(df, cols, [0.25, 0.75], moments=True)
    spec = []
    for c in cols:
        s = st[c]
        if not s["n"]:
            continue
        iqr = quart[(c, 0.75)] - quart[(c, 0.25)]
        nb = auto_bins(s["n"], s["min"], s["max"], iqr)
        spec.append((c, nb, s["min"], s["max"]))
    if not spec:
        return df.sparkSession.createDataFrame([], "variable string, bin int, lower double, upper double, count long")
    structs = []
    for c, nb, lo, hi in spec:
        x = value_of(df, c).cast("double")
        ptp = hi - lo
        idx = F.lit(0) if ptp == 0 else F.least(F.floor((x - F.lit(lo)) * F.lit(float(nb)) / F.lit(ptp)), F.lit(nb - 1))
        structs.append(F.struct(F.lit(c).alias("variable"), F.when(x.isNotNull(), idx.cast("int")).alias("bin")))
    counts = (
        df.select(F.explode(F.array(*structs)).alias("s")).select("s.variable", "s.bin")
        .where(F.col("bin").isNotNull()).groupBy("variable", "bin").agg(F.count(F.lit(1)).alias("count"))
    )
    spark = df.sparkSession
    grids = None
    for c, nb, lo, hi in spec:
        width = (hi - lo) / nb
        g = spark.range(nb).select(
            F.lit(c).alias("variable"), F.col("id").cast("int").alias("bin"),
            (F.lit(lo) + F.col("id") * F.lit(width)).alias("lower"),
            F.when(F.col("id") == nb - 1, F.lit(hi)).otherwise(F.lit(lo) + (F.col("id") + 1) * F.lit(width)).alias("upper"),
        )
        grids = g if grids is None else grids.unionByName(g)
    return grids.join(counts, ["variable", "bin"], "left").select(
        "variable", "bin", "lower", "upper", F.coalesce("count", F.lit(0)).cast("long").alias("count")
    )


def boxplot_stats(df: DataFrame, columns: list[str], whisker: float = 1.5, known: dict | None = None) -> DataFrame:
    """Quartiles, whiskers (extreme points inside 1.5 IQR) and outlier count;
    ``known`` quartiles from ``numeric_summary`` save the quantile passes."""
    cols = present(df, columns)
    quart = known["quantiles"] if known else exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    aggs, fences = [], {}
    for i, c in enumerate(cols):
        q1, q3 = quart[(c, 0.25)], quart[(c, 0.75)]
        if q1 is None:
            continue
        lo, hi = q1 - whisker * (q3 - q1), q3 + whisker * (q3 - q1)
        fences[c] = (lo, hi)
        x = value_of(df, c).cast("double")
        inside = x.between(F.lit(lo), F.lit(hi))
        aggs += [F.min(F.when(inside, x)).alias(f"wl{i}"), F.max(F.when(inside, x)).alias(f"wh{i}"),
                 F.count_if(x.isNotNull() & ~inside).alias(f"o{i}")]
    row = df.agg(*aggs).collect()[0] if aggs else None
    recs = []
    for i, c in enumerate(cols):
        if c not in fences:
            continue
        recs.append((c, quart[(c, 0.25)], quart[(c, 0.5)], quart[(c, 0.75)], row[f"wl{i}"], row[f"wh{i}"], row[f"o{i}"]))
    return df.sparkSession.createDataFrame(
        recs, "variable string, q1 double, median double, q3 double, whisker_low double, whisker_high double, n_outliers long"
    )


def _hermite(terms: int) -> list[list[float]]:
    """Coefficients of the Hermite polynomials H_0 .. H_(terms - 1)."""
    rows = [[1.0], [0.0, 2.0]]
    while len(rows) < terms:
        p = len(rows) - 1
        up = [0.0] + [2.0 * c for c in rows[p]]
        down = [2.0 * p * c for c in rows[p - 1]] + [0.0, 0.0]
        rows.append([a - b for a, b in zip(up, down)])
    return rows[:terms]


GAUSS_TERMS = 12  # moments per box
GAUSS_BOX = 0.5  # box width in bandwidths
GAUSS_REACH = 9.0  # bandwidths; beyond, a kernel is below 3e-18


def gauss_error(terms: int = GAUSS_TERMS, box: float = GAUSS_BOX) -> float:
    """Bound on the error of one kernel value (of at most 1): Cramer's bound
    on the Hermite functions, summed over the terms left out."""
    return 1.09 * sum((box / 2.0) ** p / math.sqrt(math.factorial(p)) for p in range(terms, terms + 60))


def density_grid(df: DataFrame, column: str, grid_size: int = 200, terms: int = GAUSS_TERMS) -> DataFrame:
    """Gaussian kernel density (Scott bandwidth h, sample std) on an even grid
    from min to max, by a fast Gauss transform.

    The value range is cut into boxes of ``GAUSS_BOX`` bandwidths. One
    aggregate over the rows gives each box the first ``terms`` moments about
    its centre; every grid point within ``GAUSS_REACH`` bandwidths then takes
    a box's share from its Hermite expansion. Work is linear in the rows, and
    what is evaluated are the boxes that hold a value, not the values. Every
    density is within ``gauss_error(terms)`` / (h sqrt(2 pi)) of the exact sum
    (with 12 terms 3e-12 / (h sqrt(2 pi))). Null and NaN are missing."""
    st = _range_stats(df, [column])[column]
    n, lo, hi, sd = st["n"], st["min"], st["max"], st["std"]
    spark = df.sparkSession
    if not n or sd is None or sd == 0:
        return spark.createDataFrame([], "variable string, point int, x double, density double")
    bw = sd * n ** (-1.0 / 5.0)
    step = (hi - lo) / (grid_size - 1) if grid_size > 1 else 0.0
    width, scale = GAUSS_BOX * bw, math.sqrt(2.0) * bw
    x = value_of(df, column).cast("double")
    rows = df.where(x.isNotNull()).select(x.alias("v"), F.floor((x - F.lit(lo)) / F.lit(width)).alias("box"))
    centre = F.lit(lo) + (F.col("box") + 0.5) * F.lit(width)
    rows = rows.select("box", ((F.col("v") - centre) / F.lit(scale)).alias("u"))
    moments = [F.sum(F.pow("u", F.lit(p)) / F.lit(float(math.factorial(p)))).alias(f"a{p}") for p in range(terms)]
    boxes = rows.groupBy("box").agg(*moments)
    # sum_p a_p H_p(t) as one polynomial in t
    poly = []
    table = _hermite(terms)
    for k in range(terms):
        c = F.lit(0.0)
        for p in range(k, terms, 2):
            c = c + F.lit(table[p][k]) * F.col(f"a{p}")
        poly.append(c.alias(f"c{k}"))
    reach = GAUSS_REACH * bw
    first = F.greatest(F.lit(0), F.ceil((centre - F.lit(lo + reach)) / F.lit(step)).cast("int")) if step else F.lit(0)
    last = F.least(F.lit(grid_size - 1), F.floor((centre - F.lit(lo - reach)) / F.lit(step)).cast("int")) if step else F.lit(0)
    parts = boxes.select(centre.alias("centre"), *poly, first.alias("first"), last.alias("last")).where("first <= last")
    parts = parts.select("centre", *[f"c{k}" for k in range(terms)], F.explode(F.sequence("first", "last")).alias("point"))
    parts = parts.withColumn("t", (F.lit(lo) + F.col("point") * F.lit(step) - F.col("centre")) / F.lit(scale))
    value = F.col(f"c{terms - 1}")
    for k in range(terms - 2, -1, -1):
        value = value * F.col("t") + F.col(f"c{k}")
    norm = 1.0 / (n * bw * math.sqrt(2.0 * math.pi))
    found = parts.groupBy("point").agg((F.sum(value * F.exp(-F.col("t") * F.col("t"))) * F.lit(norm)).alias("density"))
    grid = spark.range(grid_size).select(F.col("id").cast("int").alias("point"))
    return grid.join(F.broadcast(found), "point", "left").select(  # a row per grid point at most
        F.lit(column).alias("variable"), "point", (F.lit(lo) + F.col("point") * F.lit(step)).alias("x"),
        F.greatest(F.coalesce("density", F.lit(0.0)), F.lit(0.0)).alias("density"))


def point_grid(df: DataFrame, x: str, y: str, bins: int = 100) -> DataFrame:
    """A scatter plot of any size: the rows counted on an even ``bins`` x
    ``bins`` grid over the ranges of both columns (the last cell closed);
    rows that miss a value are left out. (x_bin, y_bin, x, y, count): x and y
    are the cell's centre, empty cells are absent. One aggregate for the
    ranges and one ``groupBy`` of at most bins^2 rows."""
    both = df.select(value_of(df, x).cast("double").alias("x"), value_of(df, y).cast("double").alias("y")).dropna()
    r = both.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if r["x0"] is None:
        return df.sparkSession.createDataFrame([], "x_bin int, y_bin int, x double, y double, count long")

    def cell(c, lo, hi):
        if hi <= lo:
            return F.lit(0)
        return F.least(F.floor((F.col(c) - F.lit(lo)) * F.lit(float(bins)) / F.lit(hi - lo)), F.lit(bins - 1)).cast("int")

    def centre(c, lo, hi):
        return F.lit(lo) + (F.col(c) + 0.5) * F.lit((hi - lo) / bins)

    cells = both.groupBy(cell("x", r["x0"], r["x1"]).alias("x_bin"), cell("y", r["y0"], r["y1"]).alias("y_bin")).agg(F.count(F.lit(1)).alias("count"))
    return cells.select("x_bin", "y_bin", centre("x_bin", r["x0"], r["x1"]).alias("x"), centre("y_bin", r["y0"], r["y1"]).alias("y"), "count")
