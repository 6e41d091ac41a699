"""Classification: logistic model, unpenalised logit inference, metrics,
ROC / PR curves, AUC, confusion grid, forward selection.

* Model: L2-penalised logistic regression (C = 1 on the summed loss, intercept
  free) by Newton steps over tree-combined sums (``newton``); the gradient
  norm that is left certifies the fit.
* Inference: ``GeneralizedLinearRegression`` (binomial, logit) summary.
* Curves and AUC: one row per distinct score (``groupBy``), running sums by
  the one-shuffle global cumsum; ties handled exactly.
* Forward selection: all candidate x fold models are fitted together; two
  classes are scored by held-out AUC through bounds from score histograms,
  more classes by weighted F1 from confusion counts of the Newton pass.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from py4j.protocol import Py4JError
from pyspark import keyword_only
from pyspark.errors import PySparkException
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import _JsonState, positive_class
from .linear import linear_expr
from .newton import MAX_STEPS, TOL, Batch, best_by_auc, fit_batch, packed, weighted_f1
from .rank import cumsum_and_totals, global_cumsum


def q(c: str) -> Column:
    return F.col(f"`{c}`")


# ----------------------------------------------------------------------------- logistic model


class LogisticModel(Model, _JsonState, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted logistic model as a stage that adds ``probability`` (an array
    in the order of the classes) and ``prediction`` (the class): it is stored
    and loaded with the preprocessing that makes its features."""

    @keyword_only
    def __init__(self, inputCols=None, state=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        st = self._state()
        classes, scores = st["classes"], [linear_expr(s["intercept"], s["coefs"]) for s in st["scores"]]
        if len(scores) == 1:  # log odds of the positive class
            of = 1.0 / (1.0 + F.exp(-F.col("__score0")))
            probs = [of if c == st["positive"] else 1.0 - of for c in classes]
        else:
            top = F.greatest(*[F.col(f"__score{i}") for i in range(len(scores))])
            parts = [F.exp(F.col(f"__score{i}") - top) for i in range(len(scores))]
            whole = parts[0]
            for part in parts[1:]:
                whole = whole + part
            probs = [part / whole for part in parts]
        out = df.withColumns({f"__score{i}": s for i, s in enumerate(scores)}).withColumn("probability", F.array(*probs))
        if len(scores) == 1:
            other = [c for c in classes if c != st["positive"]][0]
            said = F.when(F.col("__score0") > 0, F.lit(st["positive"])).otherwise(F.lit(other))
        else:
            said = F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position("probability", F.array_max("probability")).cast("int"))
        return out.withColumn("prediction", said).drop(*[f"__score{i}" for i in range(len(scores))])


@dataclass
class LogitModel:
    stage: LogisticModel
    classes: list[str]
    positive: str
    names: list[str]
    beta: np.ndarray  # scores x (1 + features), intercept first
    gradient: float  # largest entry of the mean gradient of the penalised loss

    @property
    def converged(self) -> bool:
        return self.gradient <= TOL

    @property
    def binary(self) -> bool:
        return len(self.classes) == 2

    def predict(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """keep columns + ``proba`` (positive class) + ``predicted`` (class)."""
        out = self.stage.transform(df)
        proba = F.col("probability")[self.classes.index(self.positive)]
        return out.select(*[q(c) for c in keep], proba.alias("proba"), F.col("prediction").alias("predicted"))

    def coefficients(self) -> tuple[float, list[float]]:
        return float(self.beta[0, 0]), [float(v) for v in self.beta[0, 1:]]


def label_column(target: str, classes: list[str], positive: str) -> Column:
    if len(classes) == 2:
        return F.when(q(target) == F.lit(positive), F.lit(1.0)).otherwise(F.lit(0.0))
    out = F.lit(None).cast("double")
    for i, c in enumerate(classes):
        out = F.when(q(target) == F.lit(c), F.lit(float(i))).otherwise(out)
    return out


def design(df: DataFrame, names: list[str], target: str, classes: list[str], fold: Column | None = None) -> DataFrame:
    """__y (0/1, for more classes the class number), __fold and x0.. of the
    rows with a known class."""
    label = label_column(target, classes, positive_class(classes))
    out = df.where(q(target).isNotNull()).select(label.alias("__y"), (F.lit(0) if fold is None else fold).cast("double").alias("__fold"),
                                                 *[q(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    return out.where(F.col("__y").isNotNull())


def fit_logistic(train: DataFrame, names: list[str], target: str, classes: list[str], c_value: float = 1.0,
                 max_steps: int = MAX_STEPS, data: DataFrame | None = None, columns: list[str] | None = None) -> LogitModel:
    """``data``: the design of the training rows, if it is there already, with
    features ``columns`` (``names`` among them)."""
    pos = positive_class(classes)
    outputs = 1 if len(classes) == 2 else len(classes)
    if data is None:
        data = packed(design(train, names, target, classes), names)
    fits = fit_batch(data, Batch(columns or names, names, [], [None], outputs), c_value, max_steps=max_steps)
    beta = fits.beta[0, 0]
    scores = [{"intercept": float(b[0]), "coefs": {c: float(v) for c, v in zip(names, b[1:])}} for b in beta]
    stage = LogisticModel(inputCols=names, state=json.dumps({"classes": classes, "positive": pos, "scores": scores}))
    return LogitModel(stage, classes, pos, names, beta, float(fits.gradient[0, 0]))


def logit_inference(train: DataFrame, names: list[str], target: str, positive: str,
                    fallback: LogitModel | None = None, var_tol: float = 1e-8) -> list[tuple]:
    """Unpenalised logit: (variable, coef, std_err, p_value, odds_ratio, note).
    Near-constant columns are listed with empty numbers; on failure (no
    convergence, infinite or huge errors) the penalised model's coefficients
    are returned with note ``penalized_fallback``."""
    stats = train.agg(*[F.var_pop(q(c)).alias(f"v{i}") for i, c in enumerate(names)]).collect()[0] if names else {}
    kept = [c for i, c in enumerate(names) if (stats[f"v{i}"] or 0.0) > var_tol]
    dropped = [c for c in names if c not in kept]
    y = F.when(q(target) == F.lit(positive), F.lit(1.0)).otherwise(F.lit(0.0))
    try:
        data = VectorAssembler(inputCols=kept, outputCol="__f").transform(train.withColumn("__y", y))
        glm = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="__f", labelCol="__y",
                                          maxIter=100, regParam=0.0, fitIntercept=True, tol=1e-10)
        m = glm.fit(data)
        s = m.summary
        se, pv = list(s.coefficientStandardErrors), list(s.pValues)
        coefs = [float(m.intercept)] + [float(v) for v in m.coefficients.toArray()]
        ses = [se[-1]] + se[:-1]
        pvs = [pv[-1]] + pv[:-1]
        if not all(math.isfinite(v) for v in coefs + ses):
            raise ValueError("logit did not converge")
        rows = [(n, c, e, p, math.exp(c) if c < 700 else float("inf"), None)
                for n, c, e, p in zip(["const"] + kept, coefs, ses, pvs)]
        rows += [(d, None, None, None, None, None) for d in dropped]
        return rows
    except (ArithmeticError, ValueError, PySparkException, Py4JError):  # the fit failed
        if fallback is None:
            raise
        b0, b = fallback.coefficients()
        return [(n, c, None, None, None, "penalized_fallback") for n, c in zip(["const"] + fallback.names, [b0] + b)]


LOGIT_SCHEMA = "variable string, coef double, std_err double, p_value double, odds_ratio double, note string"


# ----------------------------------------------------------------------------- metrics and curves


def classification_metrics(pred: DataFrame, actual: str, positive: str) -> dict:
    """Accuracy; precision, recall, F1 of the positive class (0 on an empty
    denominator)."""
    a, p = q(actual), F.col("predicted")
    r = pred.agg(
        F.avg(F.when(a == p, 1.0).otherwise(0.0)).alias("acc"),
        F.sum(F.when((p == positive) & (a == positive), 1).otherwise(0)).alias("tp"),
        F.sum(F.when((p == positive) & (a != positive), 1).otherwise(0)).alias("fp"),
        F.sum(F.when((p != positive) & (a == positive), 1).otherwise(0)).alias("fn"),
    ).collect()[0]
    tp, fp, fn = r["tp"] or 0, r["fp"] or 0, r["fn"] or 0
    prec = tp / (tp + fp) if tp + fp else 0.0
    rec = tp / (tp + fn) if tp + fn else 0.0
    f1 = 2 * tp / (2 * tp + fp + fn) if (2 * tp + fp + fn) else 0.0
    return {"accuracy": r["acc"], "precision": prec, "recall": rec, "f1": f1}


def score_counts(pred: DataFrame, actual: str, positive: str, score: str = "proba") -> DataFrame:
    """One row per distinct score: positives and negatives."""
    y = F.when(q(actual) == F.lit(positive), 1).otherwise(0)
    return pred.groupBy(F.col(score).alias("score")).agg(F.sum(y).cast("double").alias("pos"),
                                                         F.sum(1 - y).cast("double").alias("neg"))


def roc_auc(pred: DataFrame, actual: str, positive: str, score: str = "proba") -> float | None:
    """Area under ROC = P(score_pos > score_neg) + 0.5 P(equal)."""
    sc = score_counts(pred, actual, positive, score)
    cum = global_cumsum(sc, "score", ["neg"])
    r = cum.agg(F.sum(F.col("pos") * (F.col("cum_neg") - 0.5 * F.col("neg"))).alias("u"),
                F.sum("pos").alias("P"), F.sum("neg").alias("N")).collect()[0]
    if not r["P"] or not r["N"]:
        return None
    return r["u"] / (r["P"] * r["N"])


def roc_curve(pred: DataFrame, actual: str, positive: str, score: str = "proba") -> DataFrame:
    """FPR/TPR at every distinct score (descending) plus the origin."""
    sc = score_counts(pred, actual, positive, score)
    cum, total = cumsum_and_totals(sc, "score", ["pos", "neg"], descending=True)
    P, N = float(total["pos"]), float(total["neg"])
    pts = cum.select(F.col("score").alias("threshold"),
                     (F.col("cum_neg") / F.lit(N) if N else F.lit(None).cast("double")).alias("fpr"),
                     (F.col("cum_pos") / F.lit(P) if P else F.lit(None).cast("double")).alias("tpr"))
    origin = pred.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return origin.unionByName(pts)


def pr_curve(pred: DataFrame, actual: str, positive: str, score: str = "proba") -> DataFrame:
    """Precision and recall at every distinct score, plus (recall 0, precision 1)."""
    sc = score_counts(pred, actual, positive, score)
    cum, total = cumsum_and_totals(sc, "score", ["pos", "neg"], descending=True)
    P = float(total["pos"])
    pts = cum.select(F.col("score").alias("threshold"),
                     (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
                     (F.col("cum_pos") / F.lit(P) if P else F.lit(None).cast("double")).alias("recall"))
    end = pred.sparkSession.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double")
    return pts.unionByName(end)


def label_grid(spark, classes: list[str]) -> DataFrame:
    """(actual, predicted, hit) for every pair of classes."""
    return spark.createDataFrame([(a, p, a == p) for a in classes for p in classes], "actual string, predicted string, hit boolean")


def confusion_grid(pred: DataFrame, actual: str, classes: list[str]) -> DataFrame:
    """Counts over the full class x class grid, zeros included. The grid is
    built from the (small) class list, then left-joined to the counts."""
    grid = label_grid(pred.sparkSession, classes).drop("hit")
    counts = pred.groupBy(q(actual).alias("actual"), F.col("predicted")).agg(F.count(F.lit(1)).alias("count"))
    return grid.join(F.broadcast(counts) if len(classes) <= 1000 else counts, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


# ----------------------------------------------------------------------------- forward selection


TRACE_SCHEMA = "step int, feature string, score double, converged boolean"


def forward_select_classification(train: DataFrame, names: list[str], target: str, classes: list[str],
                                  fold: Column, max_features: int = 10, c_value: float = 1.0,
                                  data: DataFrame | None = None) -> tuple[list[str], list[tuple]]:
    """Greedy forward selection scored by mean held-out AUC (two classes) or
    weighted F1 (more classes). Ties go to the first feature. The trace has a
    row per step: (step, feature, score, whether all of the step's fits
    converged). ``data``: the packed design, if it is there already."""
    k_select = min(max_features, len(names))
    if k_select == 0:
        raise ValueError("no features available after preprocessing")
    outputs = 1 if len(classes) == 2 else len(classes)
    rows = design(train, names, target, classes, fold)
    shares = {(int(r["__fold"]), r["__y"]): r["count"] for r in rows.groupBy("__fold", "__y").count().collect()}
    folds = sorted({f for f, _ in shares})
    if outputs == 1 and (short := [f for f in folds if (f, 0.0) not in shares or (f, 1.0) not in shares]):
        raise ValueError(f"folds {short} lack a class of {target}: a class has fewer rows than there are folds")
    data = packed(rows, names) if data is None else data
    selected: list[str] = []
    trace = []
    start = np.zeros((len(folds), outputs, 1))  # of the chosen model, warm start of the next step
    for step in range(1, k_select + 1):
        cands = [c for c in names if c not in selected]
        batch = Batch(names, list(selected), cands, folds, outputs)
        warm = np.concatenate([np.repeat(start[:, None], len(cands), axis=1), np.zeros((len(folds), len(cands), outputs, 1))], axis=3)
        fits = fit_batch(data, batch, c_value, start=warm)
        if outputs == 1:
            best, score = best_by_auc(data, batch, fits.beta, scale=fits.scale)
        else:
            mean = np.round(weighted_f1(fits.confusion).mean(axis=0), 12)
            best = int(np.argmax(mean))
            score = float(mean[best])
        start = fits.beta[:, best]
        selected.append(cands[best])
        trace.append((step, cands[best], score, bool(fits.converged().all())))
    return selected, trace
