"""Registered queries for features, split, ranks, Gram, normality tests,
one-feature linear models (closed-form SQL oracles), curves and PCA."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..config import ModelOptions, Roles
from ..operators import classify as clf
from ..operators import features as feat
from ..operators import normality as nt
from ..operators.gram import collect_gram, total
from ..operators.linear import breusch_pagan, linear_expr, ols_with_checks, vif_table
from ..operators.pca import pca_fit
from ..operators.rank import global_row_number
from ..operators.select import select_from_fold_grams
from ..sources.fixtures import content_key, table
from .q_rows import _obs

R = Roles()
REG = ModelOptions()
CLF = ModelOptions(task="clf", target=R.label)


_FRAMES: dict[tuple, tuple] = {}


def _cached(spark, sf_dir, kind, build):
    """Split frames are written once per application and input (shared
    checkpoint folder) and reused by every query of the family."""
    from ..session import materialize

    key = (content_key(spark, sf_dir), kind)
    if key not in _FRAMES:
        frame, fl, target = build()
        _FRAMES[key] = (materialize(frame, f"{kind}-frame"), fl, target)
    return _FRAMES[key]


def _reg_frame(spark, sf_dir):
    return _cached(spark, sf_dir, "reg", lambda: _build_reg_frame(spark, sf_dir))


def _clf_frame(spark, sf_dir):
    return _cached(spark, sf_dir, "clf", lambda: _build_clf_frame(spark, sf_dir))


def _build_reg_frame(spark, sf_dir):
    """Regression model frame with split and fold columns."""
    df, _ = _obs(spark, sf_dir)
    target, _ = feat.choose_target_task(df, REG, R)
    fl = feat.select_features(df, target, REG, R)
    base = feat.model_frame(df, fl, target, R.key)
    split = feat.split_train_test(base, R.key, REG.test_size, REG.seed)
    return feat.fold_assign(split, R.key, REG.folds, REG.seed), fl, target


def _build_clf_frame(spark, sf_dir):
    df, _ = _obs(spark, sf_dir)
    target, _ = feat.choose_target_task(df, CLF, R)
    fl = feat.select_features(df, target, CLF, R)
    base = feat.model_frame(df, fl, target, R.key)
    split = feat.split_train_test(base, R.key, CLF.test_size, CLF.seed, stratify=target)
    return feat.fold_assign(split, R.key, CLF.folds, CLF.seed, within=["split", target]), fl, target


def q_split_train_test(spark, sf_dir):
    s, _, _ = _reg_frame(spark, sf_dir)
    return s.select(R.key, "split")


def q_split_stratified(spark, sf_dir):
    s, _, t = _clf_frame(spark, sf_dir)
    return s.select(R.key, t, "split")


def q_fold_assign(spark, sf_dir):
    s, _, _ = _reg_frame(spark, sf_dir)
    c, _, _ = _clf_frame(spark, sf_dir)
    return s.where("split = 'train'").select(F.lit("reg").alias("task"), R.key, "fold").union(
        c.where("split = 'train'").select(F.lit("clf"), R.key, "fold"))


def q_distinct_classes(spark, sf_dir):
    s, _, t = _clf_frame(spark, sf_dir)
    tr = s.where("split = 'train'").select(t)
    te = s.where("split = 'test'").select(t)
    return tr.union(te).distinct().withColumnRenamed(t, "class")


def q_standard_scale(spark, sf_dir):
    s, fl, _ = _reg_frame(spark, sf_dir)
    model = feat.PopulationScaler(inputCols=fl.numeric).fit(s.where("split = 'train'"))
    out = model.transform(s)
    return out.select(R.key, *[F.round(c, 6).alias(c) for c in fl.numeric])


RARE_PROP = 0.03  # at sf0.01 district shares start near 2%, so both kept and rare levels occur


def q_rare_label_fit(spark, sf_dir):
    df, _ = _obs(spark, sf_dir)
    m = feat.RareLabel(inputCols=[R.district], minProp=RARE_PROP).fit(df)
    return spark.createDataFrame([(c, lv) for c, lvs in m._state().items() for lv in lvs], "variable string, level string")


def q_rare_bucket(spark, sf_dir):
    df, _ = _obs(spark, sf_dir)
    m = feat.RareLabel(inputCols=[R.district], minProp=RARE_PROP).fit(df)
    return m.transform(df).select(R.key, R.district)


def q_kept_lookup(spark, sf_dir):
    """The levels kept from the training rows, looked up for every district of
    the test rows: (level, bucket, n)."""
    s, _, _ = _reg_frame(spark, sf_dir)
    m = feat.RareLabel(inputCols=[R.district], minProp=RARE_PROP).fit(s.where("split = 'train'"))
    test = s.where("split = 'test'").withColumn("level", F.col(R.district))
    return m.transform(test).groupBy("level", F.col(R.district).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def q_one_hot(spark, sf_dir):
    """Long form of the one-hot matrix: the active dummy of each row (NULL for
    the dropped first level)."""
    df, _ = _obs(spark, sf_dir)
    rare = feat.RareLabel(inputCols=[R.district], minProp=RARE_PROP).fit(df)
    bucketed = rare.transform(df)
    oh = feat.OneHotDropFirst(inputCols=[R.district, R.peak]).fit(bucketed)
    out = oh.transform(bucketed)
    names = oh.names()
    pairs = [F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias("v")) for n in names]
    return (out.select(R.key, F.explode(F.array(*pairs)).alias("p")).where(F.col("p.v") == 1.0)
            .select(R.key, F.col("p.feature").alias("feature")))


def _preprocessed(spark, sf_dir):
    s, fl, target = _reg_frame(spark, sf_dir)
    pre = feat.fit_preprocessor(s.where("split = 'train'"), fl, REG.rare_threshold)
    return s, fl, target, pre


def q_feature_names(spark, sf_dir):
    _, _, _, pre = _preprocessed(spark, sf_dir)
    return spark.createDataFrame(list(enumerate(pre.names)), "pos int, feature string")


def q_mask_select(spark, sf_dir):
    s, fl, target, pre = _preprocessed(spark, sf_dir)
    frame = pre.transform(s, [R.key, "split"])
    keep = [n for n in pre.names if not n.startswith(R.district + "_")]
    sel = feat.FeatureSelector(state=json.dumps({"keep": keep, "passthrough": [R.key]}))
    out = sel.transform(frame)
    return out.select(R.key, *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in keep])


def q_preprocess(spark, sf_dir):
    s, fl, target, pre = _preprocessed(spark, sf_dir)
    frame = pre.transform(s, [R.key, "split"])
    num = [F.round(F.col(f"`{c}`"), 6).alias(c) for c in fl.numeric]
    return frame.select(R.key, "split", *num, active_dummies(pre.names, fl.numeric))


def active_dummies(names, numeric):
    """The dummies that are 1, by name."""
    named = [F.when(F.col(f"`{n}`") == 1, F.lit(n)) for n in sorted(names) if n not in numeric]
    return F.concat_ws(",", *named).alias("active")


def q_global_rank(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "value")
    return global_row_number(ev, "value", tiebreak=["event_id"], name="rn")


def q_gram_matrix(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    g = total(collect_gram(li, cols))
    rows = [(g.names[i], g.names[j], "%.9e" % g.matrix[i, j]) for i in range(len(g.names)) for j in range(i, len(g.names))]
    return spark.createDataFrame(rows, "var1 string, var2 string, value string")


# ----------------------------------------------------------------------------- normality


def _test_row(spark, res):
    rnd = (lambda v: None if v is None else round(v, 6))
    return spark.createDataFrame([(res.test, res.variable, rnd(res.statistic), rnd(res.p_value), res.n, res.rejected)],
                                 nt.RESULT_SCHEMA)


def q_normality_auto(spark, sf_dir):
    df, _ = _obs(spark, sf_dir)
    cols = [c for c in R.numeric_order() if c in df.columns]
    return _test_row(spark, nt.normality_auto(df, cols, R.speed_num))


def q_qq_thinned(spark, sf_dir):
    """500 evenly spread QQ positions and the largest rise between them."""
    df, _ = _obs(spark, sf_dir)
    pts, line = nt.qq_points(df, R.speed_num, thin=500)
    return pts.select("position", F.round("theoretical", 6).alias("theoretical"), "ordered", F.lit(round(line["largest_step"], 6)).alias("largest_step"))


def q_shapiro_wilk(spark, sf_dir):
    sup = table(spark, sf_dir, "supplier")
    return _test_row(spark, nt.shapiro_wilk(sup, "s_acctbal", key="s_suppkey"))


def q_ks_normal(spark, sf_dir):
    df, _ = _obs(spark, sf_dir)
    return _test_row(spark, nt.ks_statistic(df, R.speed_num, ddof=0))


def q_dagostino_k2(spark, sf_dir):
    df, _ = _obs(spark, sf_dir)
    return _test_row(spark, nt.dagostino_k2(df, R.speed_num))


def q_qq_points(spark, sf_dir):
    df, _ = _obs(spark, sf_dir)
    pts, line = nt.qq_points(df, R.speed_num)
    return pts.select("position", F.round("theoretical", 6).alias("theoretical"), "ordered",
                      F.lit(round(line["slope"], 6)).alias("slope"), F.lit(round(line["intercept"], 6)).alias("intercept"),
                      F.lit(round(line["r"], 6)).alias("r"))


# ----------------------------------------------------------------------------- one-feature linear model (SQL-1)

ONE_X = R.length_log1p


def _one(spark, sf_dir):
    s, _, target = _reg_frame(spark, sf_dir)
    s = s.select(R.key, "split", "fold", ONE_X, target)
    train = s.where("split = 'train'")
    res = ols_with_checks(train, [ONE_X], target, diagnostics=False)
    return s, train, target, res


def q_linear_fit_predict(spark, sf_dir):
    s, _, target, res = _one(spark, sf_dir)
    pred = linear_expr(*res.intercept_and_coefs())
    return s.where("split = 'test'").select(R.key, F.round(pred, 6).alias("prediction"))


def q_ols_robust(spark, sf_dir):
    _, _, _, res = _one(spark, sf_dir)
    rows = [(n, round(float(c), 6), round(float(e), 6)) for n, c, e in zip(res.names, res.coef, res.std_err)]
    return spark.createDataFrame(rows, "variable string, coef double, std_err double")


def q_breusch_pagan(spark, sf_dir):
    _, train, target, res = _one(spark, sf_dir)
    b0, b = res.intercept_and_coefs()
    e = F.col(target) - linear_expr(b0, b)
    e2 = e * e
    grams = collect_gram(train, [ONE_X], weights={"e2": e2, "e4": e2 * e2})
    g1 = total(grams, "1").matrix
    bp = breusch_pagan(g1, total(grams, "e2").matrix, total(grams, "e4").matrix[0, 0], int(g1[0, 0]), 2)
    return spark.createDataFrame([(round(bp["lm"], 6), round(bp["lm_pvalue"], 6))], "lm double, lm_pvalue double")


def q_residual_normality(spark, sf_dir):
    _, train, target, res = _one(spark, sf_dir)
    resid = train.select((F.col(target) - linear_expr(*res.intercept_and_coefs())).alias("resid"))
    n = resid.count()
    r = nt.shapiro_wilk(resid, "resid") if n <= nt.SHAPIRO_MAX_N else nt.dagostino_k2(resid, "resid")
    return _test_row(spark, r)


def q_regression_metrics(spark, sf_dir):
    from .model import regression_metrics_all

    s, train, target, res = _one(spark, sf_dir)
    rows = regression_metrics_all(s.where("split = 'test'"), target, {"one_feature": linear_expr(*res.intercept_and_coefs())})
    return spark.createDataFrame([tuple([r[0]] + [round(v, 6) for v in r[1:]]) for r in rows],
                                 "model string, rmse double, r2 double, mae double, bias double")


def q_baseline_regression(spark, sf_dir):
    from .model import regression_metrics_all

    s, train, target, _ = _one(spark, sf_dir)
    ybar = train.agg(F.avg(target)).collect()[0][0]
    rows = regression_metrics_all(s.where("split = 'test'"), target, {"baseline": F.lit(ybar)})
    return spark.createDataFrame([tuple([r[0]] + [round(v, 6) for v in r[1:]]) for r in rows],
                                 "model string, rmse double, r2 double, mae double, bias double")


def q_metrics_table(spark, sf_dir):
    return q_baseline_regression(spark, sf_dir).unionByName(q_regression_metrics(spark, sf_dir))


def q_residual_points(spark, sf_dir):
    s, _, target, res = _one(spark, sf_dir)
    pred = linear_expr(*res.intercept_and_coefs())
    return s.select(R.key, "split", F.col(target).alias("actual"), F.round(pred, 6).alias("predicted"),
                    F.round(F.col(target) - pred, 6).alias("residual"))


def q_axis_range(spark, sf_dir):
    s, _, target, res = _one(spark, sf_dir)
    pred = linear_expr(*res.intercept_and_coefs())
    t = s.where("split = 'test'")
    return t.agg(F.round(F.least(F.min(target), F.min(pred)), 6).alias("lo"),
                 F.round(F.greatest(F.max(target), F.max(pred)), 6).alias("hi"))


def q_candidate_scores(spark, sf_dir):
    """Step-1 cross-validated score of every single feature."""
    s, fl, target, pre = _preprocessed(spark, sf_dir)
    frame = pre.transform(s, [R.key, "split", "fold", target]).where("split = 'train'")
    grams = collect_gram(frame, pre.names + [target], fold=F.col("fold"))
    rows = []
    for name in pre.names:
        _, trace = select_from_fold_grams(grams, [name], target, 1)
        rows.append((name, round(trace[0][2], 6)))
    return spark.createDataFrame(rows, "feature string, score double")


def q_vif_pair(spark, sf_dir):
    s, _, _ = _reg_frame(spark, sf_dir)
    df, _ = _obs(spark, sf_dir)
    train = s.where("split = 'train'").select(R.key).join(df.select(R.key, R.length_num, R.length_log1p), R.key)
    rows = vif_table(train, [R.length_num, R.length_log1p])
    return spark.createDataFrame([(c, round(v, 6)) for c, v in rows], "variable string, vif double")


# ----------------------------------------------------------------------------- PCA on two features (SQL-1)

PAIR = [R.length_num, R.length_log1p]


def _pair_pca(spark, sf_dir):
    df, _ = _obs(spark, sf_dir)
    return df, pca_fit(df, PAIR)


def q_explained_variance(spark, sf_dir):
    _, res = _pair_pca(spark, sf_dir)
    return spark.createDataFrame([r[:3] for r in res.variance_rows()], "component string, var_exp double, var_exp_cum double")


def q_components_for_95(spark, sf_dir):
    _, res = _pair_pca(spark, sf_dir)
    return spark.createDataFrame([(res.n_components_95,)], "n_components int")


def q_loading_rank(spark, sf_dir):
    _, res = _pair_pca(spark, sf_dir)
    rows = [("PC1",) + (n, round(v, 6), r) for n, v, r in res.loading_rows(0)]
    rows += [("PC2",) + (n, round(v, 6), r) for n, v, r in res.loading_rows(1)]
    return spark.createDataFrame(rows, "component string, variable string, loading double, abs_loading_rank int")


def q_pca_scores(spark, sf_dir):
    df, res = _pair_pca(spark, sf_dir)
    comp = df.select(R.key, *PAIR).dropna()
    return comp.select(R.key, *[F.round(c, 6).alias(f"PC{i + 1}") for i, c in enumerate(res.score_columns(2))])


# ----------------------------------------------------------------------------- classification with a given score


def _scored(spark, sf_dir):
    """Classification test rows scored by a given column (duration)."""
    s, _, target = _clf_frame(spark, sf_dir)
    t = s.where("split = 'test'")
    return t.select(R.key, target, F.col(R.duration_min).alias("proba"),
                    F.when(F.col(R.duration_min) > 60, "Alta").otherwise("Normal").alias("predicted")), target


def q_classification_metrics(spark, sf_dir):
    p, target = _scored(spark, sf_dir)
    m = clf.classification_metrics(p, target, "Alta")
    return spark.createDataFrame([tuple(round(m[k], 6) for k in ("accuracy", "precision", "recall", "f1"))],
                                 "accuracy double, precision double, recall double, f1 double")


def q_roc_auc(spark, sf_dir):
    p, target = _scored(spark, sf_dir)
    return spark.createDataFrame([(round(clf.roc_auc(p, target, "Alta"), 6),)], "roc_auc double")


def q_roc_curve(spark, sf_dir):
    p, target = _scored(spark, sf_dir)
    c = clf.roc_curve(p, target, "Alta")
    return c.select("threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


def q_pr_curve(spark, sf_dir):
    p, target = _scored(spark, sf_dir)
    c = clf.pr_curve(p, target, "Alta")
    return c.select("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def _baseline_pred(spark, sf_dir):
    s, _, target = _clf_frame(spark, sf_dir)
    counts = s.where("split = 'train'").groupBy(target).count().collect()
    classes = sorted(r[0] for r in s.select(target).distinct().collect())
    majority = sorted(counts, key=lambda r: (-r["count"], classes.index(r[target])))[0][target]
    return s.where("split = 'test'").select(target, F.lit(majority).alias("predicted")), target, classes


def q_baseline_classification(spark, sf_dir):
    p, target, classes = _baseline_pred(spark, sf_dir)
    m = clf.classification_metrics(p, target, feat.positive_class(classes))
    return spark.createDataFrame([("baseline",) + tuple(round(m[k], 6) for k in ("accuracy", "precision", "recall", "f1")) + (None,)],
                                 "model string, accuracy double, precision double, recall double, f1 double, roc_auc double")


def q_confusion_grid(spark, sf_dir):
    p, target, classes = _baseline_pred(spark, sf_dir)
    return clf.confusion_grid(p, target, classes)


def q_label_grid(spark, sf_dir):
    """Every pair of classes of the target, with its count (zeros included)
    and whether both are the same."""
    p, target, classes = _baseline_pred(spark, sf_dir)
    counts = clf.confusion_grid(p, target, classes)
    return counts.withColumn("hit", F.col("actual") == F.col("predicted"))


QUERIES = {
    "split_train_test": q_split_train_test,
    "split_stratified": q_split_stratified,
    "fold_assign": q_fold_assign,
    "distinct_classes": q_distinct_classes,
    "standard_scale": q_standard_scale,
    "rare_label_fit": q_rare_label_fit,
    "rare_bucket": q_rare_bucket,
    "kept_lookup": q_kept_lookup,
    "one_hot": q_one_hot,
    "feature_names": q_feature_names,
    "mask_select": q_mask_select,
    "preprocess": q_preprocess,
    "global_rank": q_global_rank,
    "gram_matrix": q_gram_matrix,
    "normality_auto": q_normality_auto,
    "shapiro_wilk": q_shapiro_wilk,
    "ks_normal": q_ks_normal,
    "dagostino_k2": q_dagostino_k2,
    "qq_points": q_qq_points,
    "qq_thinned": q_qq_thinned,
    "linear_fit_predict": q_linear_fit_predict,
    "ols_robust": q_ols_robust,
    "breusch_pagan": q_breusch_pagan,
    "residual_normality": q_residual_normality,
    "regression_metrics": q_regression_metrics,
    "baseline_regression": q_baseline_regression,
    "metrics_table": q_metrics_table,
    "residual_points": q_residual_points,
    "axis_range": q_axis_range,
    "candidate_scores": q_candidate_scores,
    "vif_pair": q_vif_pair,
    "explained_variance": q_explained_variance,
    "components_for_95": q_components_for_95,
    "loading_rank": q_loading_rank,
    "pca_scores": q_pca_scores,
    "classification_metrics": q_classification_metrics,
    "roc_auc": q_roc_auc,
    "roc_curve": q_roc_curve,
    "pr_curve": q_pr_curve,
    "baseline_classification": q_baseline_classification,
    "confusion_grid": q_confusion_grid,
    "label_grid": q_label_grid,
}

