r"""Operator 7: quality rules with risk-controlled thresholds, in SQL functions
only.

Words are runs of characters other than blanks (\x20, \x09-\x0D). Each text
gets counts (words, characters in words, symbols, repeated lines, words in
repeated eight-word windows); two fixed base rules and a set of tunable rules
judge it. The cutoffs of the tunable rules come from labelled holdouts: per
stratum and rule, a cutoff is admitted if the exact binomial tail
P(Bin(n, limit) <= falsely rejected) is at most the error level, where n is the
number of good labelled documents of the stratum. The error level is divided
by the number of all hypotheses (strata x rules x cutoffs, Bonferroni) and the
risk limit by the number of rules, so with probability 1 - DELTA no stratum
loses more than LIMIT of its good documents to the tunable rules together.
Of the admitted cutoffs of a rule the one with the largest gain is used (share
of the bad documents rejected less WEIGHT times that of the good ones; of
equals the most lenient); a rule without an admitted gain is off in that
stratum, as are all in strata without labels.

Cases: a null or empty text has no words and fails the base rules; a null
stratum is a stratum; label rows that repeat an id count as one, good if all
say so, and null ids or qualities are no labels; repeated documents are judged
alike; the counts replace columns of their names in the report, and the filter
returns the columns it got.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .shared import sized

LIMIT = 0.02  # largest share of good documents that the tunable rules may reject
DELTA = 0.05  # probability of exceeding it in any stratum
WEIGHT = 10  # how much a rejected good document counts against a rejected bad one
WINDOW = 8

# rule: (value to judge, cutoffs from strict to lenient); rejected if value > cutoff
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols_per_word": ("n_symbols / greatest(n_words, 1)", [0.05, 0.1, 0.2, 0.3, 0.5, 1.0]),
    "repeat_share": ("n_repeat_words / greatest(n_words, 1)", [0.05, 0.1, 0.15, 0.2, 0.25]),
    "dup_lines_per_word": ("n_dup_lines / greatest(n_words, 1)", [0.01, 0.02, 0.05, 0.1]),
    "long_words": ("word_chars / greatest(n_words, 1)", [8.0, 9.0, 10.0, 12.0, 15.0]),
    "short_words": ("-word_chars / greatest(n_words, 1)", [-5.0, -4.0, -3.5, -3.0, -2.5]),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def features(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """keep columns plus the five counts. Each step stays a projection of its
    own, as its column is used more than once."""
    step = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__t"))
    step = step.select(*keep, "__t", F.filter(F.split("__t", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("__words"),
                       F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"))
    step = step.select(
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("__t", r"[^#*$%&|<>]++", "")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__h"))
    windows = F.expr(f"""CASE WHEN size(__h) < {WINDOW + 1} THEN array() ELSE
        transform(sequence(0, size(__h) - {WINDOW}), i -> xxhash64({', '.join(f'get(__h, i + {j})' for j in range(WINDOW))})) END""")
    step = step.select(*keep, *COUNTS[:4], windows.alias("__w"))
    # only texts with a repeated window sort them, to find the repeats' places
    step = step.select(*keep, *COUNTS[:4], F.expr("""CASE WHEN size(__w) = size(array_distinct(__w)) THEN array()
        ELSE array_sort(transform(__w, (h, i) -> struct(h, i))) END""").alias("__sorted"))
    step = step.select(*keep, *COUNTS[:4], F.expr("""array_sort(transform(filter(transform(__sorted, (x, i) -> struct(x.i AS p,
        coalesce(x.h = get(__sorted, i - 1).h, false) OR coalesce(x.h = get(__sorted, i + 1).h, false) AS twice)), x -> x.twice), x -> x.p))""").alias("__p"))
    covered = F.expr(f"""CASE WHEN size(__p) = 0 THEN 0L ELSE
        {WINDOW}L + aggregate(transform(__p, (p, i) -> CASE WHEN i = 0 THEN 0 ELSE least({WINDOW}, p - get(__p, i - 1)) END), 0L, (a, x) -> a + x) END""")
    return step.select(*keep, *COUNTS[:4], covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))


def log_gamma(x: str) -> str:
    """SQL for ln Gamma(x), x >= 1: Stirling's series at x + 10, brought back
    by the recurrence."""
    z = f"({x} + 10.0D)"
    back = " + ".join(f"ln({x} + {i}.0D)" for i in range(10))
    return f"(({z} - 0.5D) * ln({z}) - {z} + 0.5D * ln(2.0D * pi()) + 1.0D / (12.0D * {z}) - 1.0D / (360.0D * pow({z}, 3)) + 1.0D / (1260.0D * pow({z}, 5)) - ({back}))"


def binomial_tail(k: str, n: str, p: float) -> str:
    """SQL for P(Bin(n, p) <= k). The terms fall from k down where k <= n p;
    the sum stops where they no longer count, some 60 standard deviations
    below. Above n p the tail is no evidence and 1 is given."""
    top = f"exp({log_gamma(f'({n} + 1.0D)')} - {log_gamma(f'({k} + 1.0D)')} - {log_gamma(f'({n} - {k} + 1.0D)')} + {k} * ln({p}D) + ({n} - {k}) * ln1p(-{p}D))".replace("ln1p", "log1p")
    return f"""CASE WHEN {n} = 0 OR {k} >= {n} * {p}D THEN 1.0D ELSE {top} * aggregate(
        sequence(0L, least({k}, CAST(60 + 60 * sqrt({n} * {p}D) AS BIGINT))),
        struct(0.0D AS total, 1.0D AS term),
        (s, i) -> struct(s.total + s.term AS total, s.term * greatest({k} - i, 0L) / ({n} - {k} + i + 1) * {(1 - p) / p!r}D AS term),
        s -> s.total) END"""


def thresholds(feats: DataFrame, labels: DataFrame, id_col: str, stratum: str, label_id: str = "doc_id", quality: str = "quality",
               limit: float = LIMIT, delta: float = DELTA) -> DataFrame:
    """(stratum, one cutoff column per rule; null where the rule is off)."""
    known = labels.where(F.col(label_id).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(label_id).alias("__id"))
    known = known.agg((F.min(quality) == 1).alias("__good"))
    held = feats.where(~base_failed()).join(known, feats[id_col] == known["__id"])
    tests = [(r, value, cut) for r, (value, cuts) in RULES.items() for cut in cuts]
    rejected = lambda who: F.array(*[F.expr(f"count_if({who} AND {value} > {cut}D)") for _, value, cut in tests])
    by = held.groupBy(F.col(stratum).alias("__stratum")).agg(
        F.count_if("__good").alias("n"), F.count_if(~F.col("__good")).alias("n_bad"), F.arrays_zip(rejected("__good").alias("k"), rejected("NOT __good").alias("bad")).alias("cells"))
    by = materialize(by, "holdout")
    hypotheses = max(1, by.count()) * len(tests)
    each = by.select("__stratum", "n", "n_bad", F.posexplode("cells").alias("test", "c")).select("__stratum", "n", "n_bad", "test", "c.k", "c.bad")
    tail = F.expr(binomial_tail("k", "n", limit / len(RULES)))
    gain = F.col("bad") / F.greatest("n_bad", F.lit(1)) - F.lit(float(WEIGHT)) * F.col("k") / F.col("n")
    admitted = each.where(tail <= delta / hypotheses).withColumn("gain", gain).where("gain > 0")
    best = []
    for r in RULES:
        at = [i for i, t in enumerate(tests) if t[0] == r]
        # the largest gain; of equal ones the most lenient cutoff
        top = F.max(F.when(F.col("test").between(at[0], at[-1]), F.struct("gain", "test")))
        best.append(F.get(F.array(*[F.lit(t[2]) for t in tests]), top["test"]).alias(f"__cut_{r}"))
    return materialize(admitted.groupBy("__stratum").agg(*best), "cutoffs")


def judge(feats: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """feats plus base_failed and kept. ``cutoffs`` has a row per stratum."""
    joined = feats.join(sized(cutoffs, 256), F.col(stratum).eqNullSafe(F.col("__stratum")), "left")
    passed = F.lit(True)
    for r, (value, _) in RULES.items():
        passed = passed & ~F.coalesce(F.expr(f"{value} > __cut_{r}"), F.lit(False))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & passed).select(*feats.columns, "base_failed", "kept")


def quality_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang",
                   limit: float = LIMIT, delta: float = DELTA) -> DataFrame:
    """One row per document: id, stratum, counts, base_failed, kept."""
    slim = docs.select(F.col(id_col).alias("__doc"), F.col(stratum).cast("string").alias("__s"), F.col(text_col).alias("__text"))
    feats = materialize(features(slim, "__text", ["__doc", "__s"]), "features")
    out = judge(feats, thresholds(feats, labels, "__doc", "__s", limit=limit, delta=delta), "__s")
    return out.select(F.col("__doc").alias(id_col), F.col("__s").alias(stratum), *COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang",
              limit: float = LIMIT, delta: float = DELTA) -> DataFrame:
    """The rows of docs that are kept, with their columns."""
    slim = docs.select(F.col(id_col).alias("__doc"), F.col(stratum).cast("string").alias("__s"), F.col(text_col).alias("__text"))
    feats = materialize(features(slim, "__text", ["__doc", "__s"]), "features")
    cutoffs = thresholds(feats, labels, "__doc", "__s", limit=limit, delta=delta)
    # the counts are worked out again beside the row: cheaper than moving texts
    packed = docs.select(F.struct(*docs.columns).alias("__row"), F.col(stratum).cast("string").alias("__s"), F.col(text_col).alias("__text"))
    again = features(packed, "__text", ["__row", "__s"]).withColumn("__stop", F.monotonically_increasing_id())
    # a filter that needs __stop is not pushed below it, where each use of a
    # count would be replaced by all that computes it
    return judge(again, cutoffs, "__s").where("kept AND __stop >= 0").select("__row.*")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_report(docs, labels).select("doc_id", *COUNTS, "base_failed", "kept")


def _oracle() -> str:
    tests = [(r, j, v, c) for r, (v, cuts) in RULES.items() for j, c in enumerate(cuts)]
    share = LIMIT / len(RULES)
    tail = ("CASE WHEN n = 0 OR {k} >= n * {p} THEN 1.0 ELSE list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) "
            "+ i * ln({p}) + (n - i) * ln(1 - {p})) for i in range(0, {k} + 1)]) END")
    counts = lambda who: "[" + ", ".join(f"count(*) FILTER (WHERE {who} AND {v} > {c})" for _, _, v, c in tests) + "]"
    values = "[" + ", ".join(f"CAST({c} AS DOUBLE)" for _, _, _, c in tests) + "]"
    cuts = ", ".join(f"{values}[max(CASE WHEN rule = '{r}' AND place = 1 THEN test END) + 1] AS cut_{r}" for r in RULES)
    rules = "[" + ", ".join(f"'{t[0]}'" for t in tests) + "]"
    passed = " AND ".join(f"NOT coalesce({v} > cut_{r}, false)" for r, (v, _) in RULES.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i+7], ' ') AS k FROM (SELECT r, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d WHERE len(w) >= 8)),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (
      SELECT r, unnest(generate_series(i, i + 7)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1) GROUP BY r),
f AS (SELECT d.r, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
      coalesce(rep.n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN rep ON rep.r = d.r),
g AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
known AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
h AS (SELECT lang, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE NOT good) AS n_bad, {counts('good')} AS ks, {counts('NOT good')} AS bads
      FROM g JOIN known USING (doc_id) WHERE NOT base_failed GROUP BY lang),
e AS (SELECT lang, n, n_bad, strata, unnest(ks) AS k, unnest(bads) AS bad, unnest(range({len(tests)})) AS test, unnest({rules}) AS rule FROM (SELECT *, count(*) OVER () AS strata FROM h)),
a AS (SELECT *, bad / greatest(n_bad, 1) - CAST({WEIGHT} AS DOUBLE) * k / n AS gain FROM e WHERE {tail.format(k='k', p=share)} <= {DELTA} / ({len(tests)} * strata)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, rule ORDER BY gain DESC, test DESC) AS place FROM a WHERE gain > 0),
cuts AS (SELECT lang, {cuts} FROM o GROUP BY lang)
SELECT g.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {passed} AS kept
FROM g LEFT JOIN cuts ON cuts.lang IS NOT DISTINCT FROM g.lang
"""


ORACLE = _oracle()
