"""Features for modelling: target and task, feature lists, reproducible
split and folds, and three fitted transformers (population scaler, rare-label
bucketing, one-hot with the first level dropped).

The transformers are ``pyspark.ml`` Estimators/Models whose fitted state is
kept in Params (JSON), so ``DefaultParamsWritable`` saves them with a
``PipelineModel``. Every ``transform`` is a projection of built-in column
expressions (JVM side); fitting is one small aggregate each.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..config import HIGH_CONGESTION_LABEL, RARE_LABEL, ModelOptions, Roles
from .rank import grouped_row_number


def q(c: str) -> Column:
    return F.col(f"`{c}`")


# ----------------------------------------------------------------------------- target and features


_TASKS = {"reg": "regression", "clf": "classification"}


def choose_target_task(df: DataFrame, options: ModelOptions, roles: Roles = Roles()) -> tuple[str, str]:
    """(target, task): the first of the option's target, speed and label that
    the table has; the task by the option, else by the target's type."""
    target = next((c for c in (options.target, roles.speed_num, roles.label) if c in df.columns), None)
    if target is None:
        raise ValueError("no target column found for modelling")
    numeric = isinstance(df.schema[target].dataType, NumericType)
    task = _TASKS.get(options.task, _TASKS["reg" if numeric else "clf"])
    if task == _TASKS["reg"]:
        fits, want = numeric, "is not numeric for regression"
    else:
        # two different values are enough: the classes are not counted
        ends = df.agg(F.min(q(target)).alias("a"), F.max(q(target)).alias("b")).first()
        fits, want = ends["a"] != ends["b"], "has fewer than two classes"
    if not fits:
        raise ValueError(f"target {target} {want}")
    return target, task


@dataclass
class FeatureLists:
    numeric: list[str]
    categorical: list[str]
    rare: list[str]
    excluded_high_card: list[str] = field(default_factory=list)

    @property
    def all(self) -> list[str]:
        return [c for c in self.numeric + self.categorical]


def select_features(df: DataFrame, target: str, options: ModelOptions, roles: Roles = Roles()) -> FeatureLists:
    """The declared features (``Roles.features``) that the table has, without
    the target, its parent column (on demand) and those not opted in."""
    barred = {target} | ({roles.parents().get(target)} if options.exclude_parents else set())
    there = {f.column: f for f in roles.features() if f.column in df.columns and f.column not in barred}
    usable = [f for f in there.values() if f.stands_in_for not in there]
    opted = [f for f in usable if f.option is None or getattr(options, f.option)]
    return FeatureLists(
        numeric=[f.column for f in opted if f.numeric],
        categorical=[f.column for f in opted if not f.numeric],
        rare=sorted((f.column for f in opted if f.rare), key=[roles.district, roles.street, roles.seg_id].index),
        excluded_high_card=[f.column for f in usable if f not in opted],
    )


def model_frame(df: DataFrame, features: FeatureLists, target: str, key: str) -> DataFrame:
    """Rows with a target and complete features (key kept for split/folds)."""
    cols = [key] + features.all + [target]
    return df.select(*[q(c) for c in cols]).dropna(subset=features.all + [target])


# ----------------------------------------------------------------------------- split and folds


def hash_int(seed: int, key: Column, salt: str = "") -> Column:
    """60-bit integer from md5(seed:salt:key); identical in DuckDB."""
    text = F.concat(F.lit(f"{seed}:{salt}"), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


HASH_SPAN = 1 << 60  # hash_int values lie in [0, 2^60)
FEW_ROWS = 1000  # rows of a class that are looked at one by one


def _cuts(df: DataFrame, h: str, key: str, cls: str, take: dict, fanout: int = 4096, few: int = FEW_ROWS) -> dict:
    """{class: (h, key)} of the take[class]-th smallest row of each class, by
    radix selection of all classes together: each pass counts rows per (class,
    sub-range of the class's current range) in one aggregate and keeps the
    sub-range that holds the class's target, until it holds few rows or one
    hash; one more aggregate lists those. The number of passes follows from
    the largest class, not from how many there are."""
    spark = df.sparkSession
    fanout = max(2, min(fanout, (1 << 18) // max(1, len(take))))  # rows that reach the driver per pass
    state = {c: [0, HASH_SPAN, n] for c, n in take.items() if n > 0}
    kind = df.schema[cls].dataType.simpleString()
    open_ = set(state)

    def inside(classes) -> DataFrame:
        rows = [(c, state[c][0], state[c][1], max(1, -(-(state[c][1] - state[c][0]) // fanout))) for c in classes]
        ranges = spark.createDataFrame(rows, f"__c {kind}, __lo long, __hi long, __width long")
        near = df.join(F.broadcast(ranges), F.col(cls) == F.col("__c"))  # a row per class
        return near.where((F.col(h) >= F.col("__lo")) & (F.col(h) < F.col("__hi")))

    while open_:
        bucket = F.expr(f"(`{h}` - __lo) div __width")  # exact integer division
        counts: dict = {}
        for r in inside(open_).groupBy("__c", bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect():
            counts.setdefault(r["__c"], []).append((r["b"], r["n"]))
        for c in list(open_):
            lo, hi, need = state[c]
            width = max(1, -(-(hi - lo) // fanout))
            before = 0
            for b, n in sorted(counts.get(c, [])):
                if before + n >= need:
                    state[c] = [lo + b * width, min(hi, lo + (b + 1) * width), need - before]
                    if n <= few or width == 1:
                        open_.discard(c)
                    break
                before += n
            else:  # fewer rows than asked for: all of them
                open_.discard(c)
    # rows of one hash differ by key at most, so what is listed stays small
    listed: dict = {}
    if state:
        for r in inside(state).groupBy("__c", F.col(h).alias("h"), F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect():
            listed.setdefault(r["__c"], []).append((r["h"], r["k"], r["n"]))
    cuts = {}
    for c, rows in listed.items():
        need = state[c][2]
        for hash_, k, n in sorted(rows):
            need -= n
            cuts[c] = (hash_, k)
            if need <= 0:
                break
    return cuts


def split_train_test(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42,
                     stratify: str | None = None, exact: bool = True) -> DataFrame:
    """Add ``split`` ('train'/'test'). Test = the ceil(test_size * n) rows with
    the smallest md5(seed:key) (per class when stratified, class sizes by
    largest remainder). Independent of partitioning; ``exact=False`` uses a
    hash threshold (approximate size, no extra pass). Rows without a class
    train."""
    h, cls = "__h", "__class"
    base = df.withColumn(h, hash_int(seed, q(key)))
    if not exact:
        limit = int(test_size * (1 << 60))
        return base.withColumn("split", F.when(F.col(h) < F.lit(limit), "test").otherwise("train")).drop(h)
    base = base.withColumn(cls, F.lit("all") if stratify is None else q(stratify))
    classes = sorted(((r[0], r[1]) for r in base.where(F.col(cls).isNotNull()).groupBy(cls).count().collect()), key=lambda t: str(t[0]))
    n = sum(c for _, c in classes)
    n_test = int(math.ceil(test_size * n))
    alloc = {c: n_test * m // n for c, m in classes}
    rest = n_test - sum(alloc.values())
    for c, _ in sorted(classes, key=lambda t: (-(n_test * t[1] % n), str(t[0])))[:rest]:
        alloc[c] += 1
    cuts = _cuts(base, h, key, cls, alloc)
    if not cuts:
        return base.withColumn("split", F.lit("train")).drop(h, cls)
    kinds = f"__cut_class {base.schema[cls].dataType.simpleString()}, __cut_h long, __cut_key {base.schema[key].dataType.simpleString()}"
    table = df.sparkSession.createDataFrame([(c, *cut) for c, cut in cuts.items()], kinds)
    cut = base.join(F.broadcast(table), F.col(cls) == F.col("__cut_class"), "left")  # a row per class
    first = (F.col(h) < F.col("__cut_h")) | ((F.col(h) == F.col("__cut_h")) & (q(key) <= F.col("__cut_key")))
    return cut.select(*[q(c) for c in df.columns], F.when(first, "test").otherwise("train").alias("split"))


def fold_assign(df: DataFrame, key: str, k: int = 5, seed: int = 42, within: list[str] | None = None) -> DataFrame:
    """Fold number 0..k-1 from a second md5 of the key (balanced in
    expectation, partitioning independent). With ``within`` (split and class)
    the rows of each group are dealt in the order of that md5, so every fold
    has its share of every class, to within one row."""
    h = hash_int(seed, q(key), "fold:")
    if not within:
        return df.withColumn("fold", F.pmod(h, F.lit(k)).cast("int"))
    dealt = grouped_row_number(df.withColumn("__h", h), "__h", within, tiebreak=[key], name="__number")
    return dealt.select(*df.columns, F.pmod(F.col("__number") - 1, F.lit(k)).cast("int").alias("fold"))


# ----------------------------------------------------------------------------- fitted transformers


class _JsonState(Params):
    state = Param(Params._dummy(), "state", "fitted state as JSON", typeConverter=TypeConverters.toString)
    inputCols = Param(Params._dummy(), "inputCols", "input columns", typeConverter=TypeConverters.toListString)

    def _state(self) -> dict:
        return json.loads(self.getOrDefault(self.state))


class PopulationScaler(Estimator, _JsonState, DefaultParamsReadable, DefaultParamsWritable):
    """Centre and divide by the *population* std (a constant column is
    divided by 1). ML's StandardScaler uses the sample std, hence this one."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        cols = self.getOrDefault(self.inputCols)
        aggs = []
        for i, c in enumerate(cols):
            aggs += [F.avg(q(c)).alias(f"m{i}"), F.stddev_pop(q(c)).alias(f"s{i}")]
        row = df.agg(*aggs).collect()[0] if cols else {}
        st = {c: [row[f"m{i}"], row[f"s{i}"]] for i, c in enumerate(cols)}
        return PopulationScalerModel(inputCols=cols, state=json.dumps(st))


class PopulationScalerModel(Model, _JsonState, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, state=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        st = self._state()
        out = {}
        for c, (mu, sd) in st.items():
            scale = sd if (sd is not None and sd > 0 and not math.isclose(sd, 0.0, abs_tol=1e-300)) else 1.0
            out[c] = (q(c) - F.lit(mu if mu is not None else 0.0)) / F.lit(scale)
        return df.withColumns(out) if out else df


class RareLabel(Estimator, _JsonState, DefaultParamsReadable, DefaultParamsWritable):
    """Keep categories with share >= minProp (missing ignored); the rest
    become ``__RARE__``. Fitting is one ``groupBy`` per column; the kept
    set holds at most 1/minProp levels."""

    minProp = Param(Params._dummy(), "minProp", "minimum share", typeConverter=TypeConverters.toFloat)
    rareLabel = Param(Params._dummy(), "rareLabel", "label of rare levels", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCols=None, minProp=0.01, rareLabel=RARE_LABEL):
        super().__init__()
        self._setDefault(minProp=0.01, rareLabel=RARE_LABEL)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        cols = self.getOrDefault(self.inputCols)
        p = self.getOrDefault(self.minProp)
        keep = {}
        for c in cols:
            total = df.agg(F.count(q(c)).alias("t")).collect()[0]["t"]
            if not total:
                keep[c] = []
                continue
            kept = (df.where(q(c).isNotNull()).groupBy(q(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
                    .where(F.col("n") / F.lit(float(total)) >= F.lit(p)).select("v").collect())
            keep[c] = sorted(r["v"] for r in kept)
        return RareLabelModel(inputCols=cols, state=json.dumps(keep), rareLabel=self.getOrDefault(self.rareLabel))


class RareLabelModel(Model, _JsonState, DefaultParamsReadable, DefaultParamsWritable):
    rareLabel = Param(Params._dummy(), "rareLabel", "label of rare levels", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCols=None, state=None, rareLabel=RARE_LABEL):
        super().__init__()
        self._setDefault(rareLabel=RARE_LABEL)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        label = self.getOrDefault(self.rareLabel)
        out = {}
        for c, kept in self._state().items():
            if c not in df.columns:
                out[c] = F.lit(None).cast("string")
                continue
            member = q(c).isin(kept) if kept else F.lit(False)
            out[c] = F.when(q(c).isNull(), F.lit(None).cast("string")).when(member, q(c)).otherwise(F.lit(label))
        return df.withColumns(out) if out else df


class OneHotDropFirst(Estimator, _JsonState, DefaultParamsReadable, DefaultParamsWritable):
    """One 0/1 column per level except the first (code-point order); an
    unseen level gives all zeros. Levels are collected per column (bounded
    by the rare bucketing before it)."""

    maxLevels = Param(Params._dummy(), "maxLevels", "refuse more levels than this", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCols=None, maxLevels=10_000):
        super().__init__()
        self._setDefault(maxLevels=10_000)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        cols = self.getOrDefault(self.inputCols)
        limit = self.getOrDefault(self.maxLevels)
        levels = {}
        for c in cols:
            lv = df.where(q(c).isNotNull()).select(q(c).cast("string").alias("v")).distinct().limit(limit + 1).collect()
            if len(lv) > limit:
                raise ValueError(f"{c} has more than {limit} levels; bucket rare levels first")
            levels[c] = sorted((r["v"] for r in lv), key=lambda s: s.encode("utf-8"))
        return OneHotDropFirstModel(inputCols=cols, state=json.dumps(levels))


class OneHotDropFirstModel(Model, _JsonState, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, state=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def names(self) -> list[str]:
        return [f"{c}_{lv}" for c, lvs in self._state().items() for lv in lvs[1:]]

    def _transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, lvs in self._state().items():
            for lv in lvs[1:]:
                out[f"{c}_{lv}"] = F.when(q(c).cast("string") == F.lit(lv), F.lit(1.0)).otherwise(F.lit(0.0))
        return df.withColumns(out) if out else df


class FeatureSelector(Transformer, _JsonState, DefaultParamsReadable, DefaultParamsWritable):
    """Keep the listed feature columns (plus passthrough columns); an empty
    mask keeps everything (the reference's ArrayColumnSelector)."""

    @keyword_only
    def __init__(self, inputCols=None, state=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        st = self._state()
        keep, passthrough = st.get("keep"), st.get("passthrough", [])
        if not keep:
            return df
        return df.select(*[q(c) for c in passthrough + keep if c in df.columns])


@dataclass
class Preprocessor:
    """Fitted preprocessing: scaler, rare bucketing, one-hot; ``names`` is the
    feature order (numeric, then column_level)."""

    numeric: list[str]
    categorical: list[str]
    scaler: PopulationScalerModel | None
    rare: RareLabelModel | None
    onehot: OneHotDropFirstModel | None

    @property
    def names(self) -> list[str]:
        return list(self.numeric) + (self.onehot.names() if self.onehot else [])

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """Feature columns (named by ``names``) plus the ``keep`` columns."""
        out = df
        if self.scaler:
            out = self.scaler.transform(out)
        if self.rare:
            out = self.rare.transform(out)
        if self.onehot:
            out = self.onehot.transform(out)
        return out.select(*[q(c) for c in keep + self.names])

    def raw_variances(self) -> dict[str, float]:
        """Population variance of each numeric column before scaling."""
        return {c: (sd or 0.0) ** 2 for c, (_, sd) in self.scaler._state().items()} if self.scaler else {}

    def stages(self) -> list:
        return [s for s in (self.scaler, self.rare, self.onehot) if s is not None]


def fit_preprocessor(train: DataFrame, features: FeatureLists, min_prop: float) -> Preprocessor:
    scaler = PopulationScaler(inputCols=features.numeric).fit(train) if features.numeric else None
    rare = None
    cat_train = train
    if features.categorical and features.rare:
        rare = RareLabel(inputCols=features.rare, minProp=min_prop).fit(train)
        cat_train = rare.transform(train)
    onehot = OneHotDropFirst(inputCols=features.categorical).fit(cat_train) if features.categorical else None
    return Preprocessor(features.numeric, features.categorical, scaler, rare, onehot)


def positive_class(classes: list[str]) -> str:
    """``Alta`` when present, else the last class in order."""
    return HIGH_CONGESTION_LABEL if HIGH_CONGESTION_LABEL in classes else sorted(classes)[-1]
