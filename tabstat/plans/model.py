"""Modelling flows: regression (model 1 = all features, model 2 = forward
selection) and classification, with baseline, metrics and diagnostics.

Data passes of the regression flow: split (count + cut), VIF (one Gram),
preprocessing fit (small aggregates), one per-fold Gram over the training
rows (serves model 1, the whole selection and model 2), one metrics
aggregate over the test rows for all three models, one HC1 pass per model.
The feature table is written once to the shared checkpoint folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ModelOptions, Roles
from ..operators import features as feat
from ..operators.gram import collect_gram
from ..operators.linear import (
    COEF_SCHEMA,
    METRICS_SCHEMA,
    OLSResult,
    high_vif,
    linear_expr,
    ols_with_checks,
    solve_ls,
    vif_from_gram,
    vif_table,
)
from ..operators.select import select_from_fold_grams
from ..session import materialize


@dataclass
class ModelData:
    target: str
    task: str
    lists: feat.FeatureLists
    pre: feat.Preprocessor
    frame: DataFrame  # key, split, fold, target, feature columns
    names: list[str]
    key: str

    @property
    def train(self) -> DataFrame:
        return self.frame.where(F.col("split") == "train")

    @property
    def test(self) -> DataFrame:
        return self.frame.where(F.col("split") == "test")


def prepare_model_data(obs: DataFrame, options: ModelOptions = ModelOptions(), roles: Roles = Roles(),
                       write: bool = True) -> ModelData:
    target, task = feat.choose_target_task(obs, options, roles)
    lists = feat.select_features(obs, target, options, roles)
    base = feat.model_frame(obs, lists, target, roles.key)
    strat = target if task == "classification" else None
    split = feat.split_train_test(base, roles.key, options.test_size, options.seed, stratify=strat,
                                  exact=options.exact_split)
    split = feat.fold_assign(split, roles.key, options.folds, options.seed, within=["split", strat] if strat else None)
    train = split.where(F.col("split") == "train")
    pre = feat.fit_preprocessor(train, lists, options.rare_threshold)
    frame = pre.transform(split, [roles.key, "split", "fold", target])
    if write:
        frame = materialize(frame, "model-features")
    return ModelData(target, task, lists, pre, frame, pre.names, roles.key)


def feature_matrix(md: ModelData) -> DataFrame:
    """The exported feature table: key, split, one double per feature."""
    return md.frame.select(F.col(md.key), "split", *[F.col(f"`{c}`") for c in md.names])


@dataclass
class RegressionRun:
    data: ModelData
    metrics: list[tuple]
    ols1: OLSResult
    ols2: OLSResult
    selected: list[str]
    trace: list[tuple]
    vif: list[tuple]
    model1: tuple[float, dict]
    model2: tuple[float, dict]

    def metrics_df(self, spark) -> DataFrame:
        return spark.createDataFrame(self.metrics, METRICS_SCHEMA)

    def high_vif(self, options: ModelOptions) -> list[tuple]:
        """VIF rows above the option's threshold."""
        return high_vif(self.vif, options.vif_threshold)

    def coef_df(self, spark, which: int) -> DataFrame:
        res = self.ols1 if which == 1 else self.ols2
        return spark.createDataFrame(res.table_rows(), COEF_SCHEMA)


def regression_metrics_all(test: DataFrame, target: str, preds: dict[str, object]) -> list[tuple]:
    """Metrics of several predictions in one aggregate over the test rows."""
    y = F.col(f"`{target}`")
    aggs = [F.count(y).alias("n"), F.var_pop(y).alias("vy")]
    for i, (_, p) in enumerate(preds.items()):
        d = p - y
        aggs += [F.sum(d * d).alias(f"sse{i}"), F.avg(F.abs(d)).alias(f"mae{i}"), F.avg(d).alias(f"bias{i}")]
    r = test.agg(*aggs).collect()[0]
    n, vy = r["n"], r["vy"]
    out = []
    for i, name in enumerate(preds):
        sse = r[f"sse{i}"]
        rmse = (sse / n) ** 0.5 if n else None
        r2 = 1.0 - sse / (vy * n) if n and vy else float("nan")
        out.append((name, rmse, r2, r[f"mae{i}"], r[f"bias{i}"]))
    return out


def run_regression(obs: DataFrame, options: ModelOptions = ModelOptions(), roles: Roles = Roles(),
                   md: ModelData | None = None) -> RegressionRun:
    md = md or prepare_model_data(obs, options, roles)
    if md.task != "regression":
        raise ValueError("target is not a regression target")
    target, names = md.target, md.names
    # the target less its mean: sums of squares of a target far from 0 keep
    # their digits; the constants are moved back
    ybar = md.train.agg(F.avg(f"`{target}`")).first()[0]
    train = md.train.withColumn(target, F.col(f"`{target}`") - F.lit(ybar))
    grams = collect_gram(train, names + [target], fold=F.col("fold"))
    folds = sorted(f for (f, k) in grams if k == "1")
    g = grams[(folds[0], "1")]
    for f in folds[1:]:
        g = g + grams[(f, "1")]
    # training rows are complete (model frame) and VIF is scale-invariant:
    # the same Gram gives it, no extra pass
    vif = []
    if options.vif_max_cols is None or len(md.lists.numeric) <= options.vif_max_cols:
        vif = vif_from_gram(g, md.lists.numeric, md.pre.raw_variances())
    b0, b = solve_ls(g, names, target)
    m1 = (b0 + ybar, dict(zip(names, b)))

    # selection from the same fold Grams (no new pass)
    chosen, trace = select_from_fold_grams(grams, names, target, options.max_selected)
    selected = [c for c in names if c in chosen]  # model 2 keeps the features' order
    c0, c = solve_ls(g, selected, target)
    m2 = (c0 + ybar, dict(zip(selected, c)))

    metrics = regression_metrics_all(md.test, target, {
        "baseline": F.lit(float(ybar)),
        "modelo1": linear_expr(*m1),
        "modelo2": linear_expr(*m2),
    })
    how = {"test": options.normality_test, "shapiro_max_n": options.shapiro_max_n}
    ols1 = ols_with_checks(train, names, target, gram=g, **how).moved(ybar)
    ols2 = ols_with_checks(train, selected, target, gram=g, **how).moved(ybar)
    return RegressionRun(md, metrics, ols1, ols2, selected, trace, vif, m1, m2)


def residual_points(md: ModelData, model: tuple[float, dict]) -> DataFrame:
    """Train: fitted vs residual; test: actual, predicted, residual."""
    pred = linear_expr(*model)
    y = F.col(f"`{md.target}`")
    return md.frame.select(F.col(md.key), "split", y.alias("actual"), pred.alias("predicted"),
                           (y - pred).alias("residual"))


__all__ = ["prepare_model_data", "run_regression", "run_classification", "residual_points", "feature_matrix"]


# ----------------------------------------------------------------------------- classification


@dataclass
class ClassificationRun:
    data: ModelData
    classes: list[str]
    positive: str
    metrics: list[tuple]  # model, accuracy, precision, recall, f1, roc_auc
    coef1: list[tuple]
    coef2: list[tuple]
    selected: list[str]
    trace: list[tuple]
    model1: object
    model2: object
    vif: list[tuple]


CLF_METRICS_SCHEMA = "model string, accuracy double, precision double, recall double, f1 double, roc_auc double"


def run_classification(obs: DataFrame, options: ModelOptions = ModelOptions(task="clf"), roles: Roles = Roles(),
                       md: ModelData | None = None) -> ClassificationRun:
    from ..operators import classify as clf
    from ..operators.newton import packed

    if options.target is None:
        options = options.with_(target=roles.label)
    md = md or prepare_model_data(obs, options, roles)
    if md.task != "classification":
        raise ValueError("target is not a classification target")
    target, names = md.target, md.names
    classes = sorted(r[0] for r in md.frame.select(F.col(f"`{target}`")).distinct().collect() if r[0] is not None)
    train, test = md.train, md.test
    vif = vif_table(train, md.lists.numeric, options.vif_max_cols)

    data = packed(clf.design(train, names, target, classes, F.col("fold")), names)
    m1 = clf.fit_logistic(train, names, target, classes, data=data, columns=names)
    pos = m1.positive
    p1 = m1.predict(test, [md.key, target])
    met1 = clf.classification_metrics(p1, target, pos)
    auc1 = clf.roc_auc(tied(p1), target, pos) if len(classes) == 2 else None

    counts = train.groupBy(F.col(f"`{target}`").alias("c")).count().collect()
    majority = sorted(counts, key=lambda r: (-r["count"], classes.index(r["c"])))[0]["c"]
    base = test.select(F.col(f"`{target}`"), F.lit(majority).alias("predicted"))
    met0 = clf.classification_metrics(base, target, pos)

    coef1 = clf.logit_inference(train, names, target, pos, fallback=m1)
    chosen, trace = clf.forward_select_classification(train, names, target, classes, F.col("fold"), options.max_selected, data=data)
    selected = [c for c in names if c in chosen]
    m2 = clf.fit_logistic(train, selected, target, classes, data=data, columns=names)
    p2 = m2.predict(test, [md.key, target])
    met2 = clf.classification_metrics(p2, target, pos)
    test_classes = test.select(F.col(f"`{target}`")).distinct().count()
    auc2 = clf.roc_auc(tied(p2), target, pos) if test_classes == 2 else None
    coef2 = clf.logit_inference(train, selected, target, pos, fallback=m2)
    rows = [
        ("baseline", met0["accuracy"], met0["precision"], met0["recall"], met0["f1"], None),
        ("modelo1", met1["accuracy"], met1["precision"], met1["recall"], met1["f1"], auc1),
        ("modelo2", met2["accuracy"], met2["precision"], met2["recall"], met2["f1"], auc2),
    ]
    return ClassificationRun(md, classes, pos, rows, coef1, coef2, selected, trace, m1, m2, vif)


def tied(pred: DataFrame) -> DataFrame:
    """Predictions whose probabilities tie if they agree to SCORE_DIGITS
    decimals, whatever the order of the sums behind them."""
    from ..operators.newton import SCORE_DIGITS

    return pred.withColumn("proba", F.round("proba", SCORE_DIGITS))


def compare_classification(run: ClassificationRun) -> DataFrame:
    """What is drawn of both models, over the test rows: (model, part, name, x,
    y) with the parts prediction (key; probability of the positive class, 1 if
    predicted), confusion (actual|predicted; count) and, for two classes, roc
    (false and true positive rate) and pr (recall, precision)."""
    from ..operators import classify as clf

    md, none = run.data, F.lit(None)
    parts = []
    for label, model in (("modelo1", run.model1), ("modelo2", run.model2)):
        pred = model.predict(md.test, [md.key, md.target])
        said = (F.col("predicted") == F.lit(run.positive)).cast("double")
        rows = [("prediction", pred, F.col(f"`{md.key}`").cast("string"), F.col("proba"), said)]
        grid = clf.confusion_grid(pred, md.target, run.classes)
        rows.append(("confusion", grid, F.concat_ws("|", "actual", "predicted"), F.col("count").cast("double"), none.cast("double")))
        if len(run.classes) == 2:
            rows.append(("roc", clf.roc_curve(tied(pred), md.target, run.positive), none.cast("string"), F.col("fpr"), F.col("tpr")))
            rows.append(("pr", clf.pr_curve(tied(pred), md.target, run.positive), none.cast("string"), F.col("recall"), F.col("precision")))
        parts += [t.select(F.lit(label).alias("model"), F.lit(part).alias("part"), n.alias("name"), x.alias("x"), y.alias("y")) for part, t, n, x, y in rows]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
