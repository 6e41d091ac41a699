"""DuckDB oracles for split, features, ranks, Gram, normality tests,
one-feature linear models (closed forms), curves and two-feature PCA."""

from __future__ import annotations

from .oracle_normal import MEAN_LN, SPREAD_LN, WEIGHT_LAST, WEIGHT_SECOND, cdf, quantile_ctes
from .oracle_sql import union, with_obs

NUM_FEATS = ["x", "y", "rank", "length_log1p", "duration_min", "hour_sin", "hour_cos"]


def _hash(salt: str) -> str:
    return f"('0x' || substr(md5('42:{salt}' || cast(obs_id as varchar)), 1, 15))::BIGINT"


REG = f""",
reg_h AS (select *, {_hash('')} as h, {_hash('fold:')} as h2 from obs where speed is not null),
reg AS (select *, case when row_number() over (order by h, obs_id) <= ceil(0.2 * count(*) over ()) then 'test' else 'train' end as split,
  h2 % 5 as fold from reg_h),
tr AS (select * from reg where split = 'train'),
te AS (select * from reg where split = 'test')"""

CLF = f""",
clf_h AS (select *, {_hash('')} as h from obs),
cls AS (select target_bin as c, count(*) as n_c from clf_h group by 1),
tot AS (select sum(n_c) as n, ceil(0.2 * sum(n_c)) as nt from cls),
al AS (select c, n_c, floor(nt * n_c / n) as base, nt * n_c / n - floor(nt * n_c / n) as frac from cls, tot),
al2 AS (select c, base + case when row_number() over (order by frac desc, c) <= (select nt from tot) - (select sum(base) from al) then 1 else 0 end as k from al),
clf AS (select h.*, case when row_number() over (partition by target_bin order by h, obs_id) <= al2.k then 'test' else 'train' end as split
  from clf_h h join al2 on h.target_bin = al2.c),
cte AS (select * from clf where split = 'test')"""

SCALE = """,
sc AS (select """ + ", ".join(f"avg({c}) as m_{c}, case when stddev_pop({c}) = 0 then 1 else stddev_pop({c}) end as s_{c}" for c in NUM_FEATS) + """ from tr)"""


def _scaled(c: str) -> str:
    return f"round(({c} - m_{c}) / s_{c}, 6) as {c}"


def _poly(c: list[float], x: str) -> str:
    return " + ".join(f"({v!r}) * pow({x}, {i})" for i, v in enumerate(c))


def _ks_p(d: str, n: str) -> str:
    lam = f"((sqrt({n}) + 0.12 + 0.11 / sqrt({n})) * {d})"
    small = f"(1 - sqrt(2 * pi()) / {lam} * (select sum(exp(-pow(2 * k - 1, 2) * pi() * pi() / (8 * {lam} * {lam}))) from range(1, 21) r(k)))"
    large = f"(select sum(2 * pow(-1, k - 1) * exp(-2 * k * k * {lam} * {lam})) from range(1, 200) r(k))"
    return f"least(1.0, greatest(0.0, case when {lam} < 1e-3 then 1.0 when {lam} < 1.18 then {small} else {large} end))"


def _k2(n: str, b1: str, b2: str) -> str:
    """K^2 of D'Agostino-Pearson as SQL from n, population skew b1 and kurtosis b2."""
    y = f"({b1} * sqrt((({n} + 1) * ({n} + 3)) / (6.0 * ({n} - 2))))"
    beta2 = f"(3.0 * ({n} * {n} + 27 * {n} - 70) * ({n} + 1) * ({n} + 3) / (({n} - 2.0) * ({n} + 5) * ({n} + 7) * ({n} + 9)))"
    w2 = f"(-1 + sqrt(2 * ({beta2} - 1)))"
    delta = f"(1 / sqrt(0.5 * ln({w2})))"
    alpha = f"sqrt(2.0 / ({w2} - 1))"
    yy = f"(case when {y} = 0 then 1 else {y} end)"
    zs = f"({delta} * ln({yy} / {alpha} + sqrt(pow({yy} / {alpha}, 2) + 1)))"
    e = f"(3.0 * ({n} - 1) / ({n} + 1))"
    varb2 = f"(24.0 * {n} * ({n} - 2) * ({n} - 3) / (({n} + 1) * ({n} + 1.0) * ({n} + 3) * ({n} + 5)))"
    x = f"(({b2} - {e}) / sqrt({varb2}))"
    sb1 = (f"(6.0 * ({n} * {n} - 5 * {n} + 2) / (({n} + 7) * ({n} + 9)) * sqrt((6.0 * ({n} + 3) * ({n} + 5)) / "
           f"({n} * ({n} - 2) * ({n} - 3))))")
    a = f"(6.0 + 8.0 / {sb1} * (2.0 / {sb1} + sqrt(1 + 4.0 / pow({sb1}, 2))))"
    term1 = f"(1 - 2 / (9.0 * {a}))"
    denom = f"(1 + {x} * sqrt(2 / ({a} - 4.0)))"
    term2 = f"(sign({denom}) * pow((1 - 2.0 / {a}) / abs({denom}), 1 / 3.0))"
    zk = f"(({term1} - {term2}) / sqrt(2 / (9.0 * {a})))"
    return f"({zs} * {zs} + {zk} * {zk})"


def _moments(col: str, src: str) -> str:
    return f"""select count({col}) as n, var_pop({col}) as m2,
  avg(pow({col} - (select avg({col}) from {src}), 3)) as m3, avg(pow({col} - (select avg({col}) from {src}), 4)) as m4 from {src}"""


def _test_row(test: str, var: str, stat: str, p: str, n: str, src: str) -> str:
    test = test.replace("'", "''")
    return (f"select '{test}' as test, '{var}' as variable, round({stat}, 6) as statistic, round({p}, 6) as p_value, "
            f"{n} as n, {p} <= 0.05 as rejected from {src}")


def oracles() -> dict[str, str]:
    q: dict[str, str] = {}
    q["split_train_test"] = with_obs(REG + "\nselect obs_id, split from reg")
    q["split_stratified"] = with_obs(CLF + "\nselect obs_id, target_bin, split from clf")
    clf_train = CLF.replace(f"{_hash('')} as h from obs", f"{_hash('')} as h, {_hash('fold:')} as h2 from obs")
    q["fold_assign"] = with_obs(REG + clf_train + """
select 'reg' as task, obs_id, fold from tr
union all select 'clf', obs_id, (row_number() over (partition by target_bin order by h2, obs_id) - 1) % 5 from clf where split = 'train'""")
    q["distinct_classes"] = with_obs(CLF + "\nselect distinct target_bin as class from clf")
    q["standard_scale"] = with_obs(REG + SCALE + "\nselect obs_id, " + ", ".join(_scaled(c) for c in NUM_FEATS) + " from reg, sc")

    kept = """,
shares AS (select district as lvl, count(*) / sum(count(*)) over () as share from obs where district is not null group by 1),
kept AS (select lvl from shares where share >= 0.03)"""
    q["rare_label_fit"] = with_obs(kept + "\nselect 'district' as variable, lvl as level from kept")
    bucket = "case when district is null then null when district in (select lvl from kept) then district else '__RARE__' end"
    q["rare_bucket"] = with_obs(kept + f"\nselect obs_id, {bucket} as district from obs")
    q["kept_lookup"] = with_obs(REG + """,
shares AS (select district as lvl, count(*) / sum(count(*)) over () as share from tr where district is not null group by 1)
select district as level, case when share >= 0.03 then district else '__RARE__' end as bucket, count(*) as n
from te left join shares on lvl = district where district is not null group by 1, 2""")
    q["one_hot"] = with_obs(kept + f""",
b AS (select obs_id, {bucket} as d, peak from obs),
first AS (select min(d) as f from b)
select obs_id, 'district_' || d as feature from b, first where d is not null and d <> f
union all select obs_id, 'peak_Valle' from b where peak = 'Valle'""")

    train_levels = """,
tshares AS (select district as lvl, count(*) / sum(count(*)) over () as share from tr where district is not null group by 1),
tkept AS (select lvl from tshares where share >= 0.01),
tb AS (select distinct case when district in (select lvl from tkept) then district else '__RARE__' end as lvl from tr where district is not null),
tfirst AS (select min(lvl) as f from tb)"""
    names = " union all ".join(f"select {i} as pos, '{c}' as feature" for i, c in enumerate(NUM_FEATS))
    q["feature_names"] = with_obs(REG + train_levels + f"""
{names}
union all select {len(NUM_FEATS) - 1} + row_number() over (order by lvl), 'district_' || lvl from tb, tfirst where lvl <> f
union all select (select count(*) from tb) + {len(NUM_FEATS) - 1}, 'peak_Valle'""")
    q["mask_select"] = with_obs(REG + SCALE + "\nselect obs_id, " + ", ".join(_scaled(c) for c in NUM_FEATS)
                                + ", case when peak = 'Valle' then 1.0 else 0.0 end::double as peak_Valle from reg, sc")
    bucketed = "case when district in (select lvl from tkept) then district else '__RARE__' end"
    active = f"""concat_ws(',', case when district is not null and {bucketed} <> (select f from tfirst) then 'district_' || {bucketed} end,
  case when peak = 'Valle' then 'peak_Valle' end) as active"""
    scaled = ", ".join(_scaled(c) for c in NUM_FEATS)
    q["preprocess"] = with_obs(REG + SCALE + train_levels + f"\nselect obs_id, split, {scaled}, {active} from reg, sc")
    q["model_store"] = with_obs(REG + SCALE + train_levels + f"\nselect obs_id, {scaled}, {active} from reg, sc")

    q["global_rank"] = "select event_id, value, row_number() over (order by value, event_id) as rn from events"
    cols = ["const", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if j < i:
                continue
            ea = "1.0" if a == "const" else a
            eb = "1.0" if b == "const" else b
            parts.append(f"select '{a}' as var1, '{b}' as var2, printf('%.9e', sum({ea} * {eb})) as value from lineitem")
    q["gram_matrix"] = union(parts)

    ks = f""",
st AS (select count(speed) as n, avg(speed) as mu, stddev_pop(speed) as sd from obs),
vc AS (select speed as v, count(*) as c from obs where speed is not null group by 1),
cum AS (select v, c, sum(c) over (order by v rows between unbounded preceding and current row) as e from vc),
zz AS (select v, c, e, e - c as s, (v - mu) / sd as z from cum, st),
cdf AS (select *, {cdf('z')} as fz from zz),
dd AS (select max(greatest(e / n - fz, fz - s / n)) as d, any_value(n) as n from cdf, st),
ksp AS (select d, n, {_ks_p('d', 'n')} as p from dd)"""
    q["ks_normal"] = with_obs(ks + "\n" + _test_row("Kolmogorov-Smirnov", "speed", "d", "p", "n", "ksp"))
    q["normality_auto"] = q["ks_normal"]

    k2 = f""",
mom AS ({_moments('speed', 'obs')}),
k2 AS (select n, {_k2('n', 'm3 / pow(m2, 1.5)', 'm4 / pow(m2, 2)')} as k from mom)"""
    q["dagostino_k2"] = with_obs(k2 + "\n" + _test_row("D'Agostino K²", "speed", "k", "exp(-k / 2)", "n", "k2"))

    sw = f"""WITH sw_x AS (select s_acctbal as x, row_number() over (order by s_acctbal, s_suppkey) as i, count(*) over () as n
  from supplier where s_acctbal is not null and not isnan(s_acctbal)),
sw_p AS (select x as v, i, n, (i - 0.375) / (n + 0.25) as pp from sw_x),
{quantile_ctes('sw_q', 'sw_p', 'pp')},
sw_m AS (select v as x, i, n, x as m from sw_q),
sw_s AS (select sum(m * m) as s2, min(m) as m1, min(case when i = 2 then m end) as m2, any_value(n) as n from sw_m),
sw_c AS (select *, sqrt(s2) as ss, 1 / sqrt(n) as u from sw_s),
sw_a AS (select *, {_poly(WEIGHT_LAST, 'u')} - m1 / ss as a1, {_poly(WEIGHT_SECOND, 'u')} - m2 / ss as a2 from sw_c),
sw_f AS (select *, sqrt((s2 - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) as fac from sw_a),
sw_w AS (select least(1.0, pow(corr(case when i = sw_f.n then a1 when i = 1 then -a1 when i = sw_f.n - 1 then a2
  when i = 2 then -a2 else m / fac end, x), 2)) as w, any_value(sw_f.n) as n from sw_m, sw_f),
sw_z AS (select w, n, (ln(1 - w) - ({_poly(MEAN_LN, 'ln(n)')})) / exp({_poly(SPREAD_LN, 'ln(n)')}) as z from sw_w),
sw_r AS (select w, n, z, -z as nz from sw_z),
sw_pv AS (select w, n, {cdf('nz')} as p from sw_r)
""" + _test_row("Shapiro-Wilk", "s_acctbal", "w", "p", "n", "sw_pv")
    q["shapiro_wilk"] = sw

    qq = f""",
qn AS (select speed as v, row_number() over (order by speed) as position, count(*) over () as n from obs where speed is not null),
qp AS (select *, case when position = n then pow(0.5, 1.0 / n) when position = 1 then 1 - pow(0.5, 1.0 / n)
  else (position - 0.3175) / (n + 0.365) end as pp from qn),
{quantile_ctes('q0', 'qp', 'pp')},
q1 AS (select * exclude (x), x as th from q0),
ql AS (select regr_slope(v, th) as slope, regr_intercept(v, th) as intercept, corr(v, th) as r from q1)"""
    q["qq_points"] = with_obs(qq + """
select position, round(th, 6) as theoretical, v as ordered, round(slope, 6) as slope, round(intercept, 6) as intercept,
  round(r, 6) as r from q1, ql""")

    q["qq_thinned"] = with_obs(qq + """,
keep AS (select 1 + (j * ((select count(*) from q1) - 1)) // 499 as position from range(500) r(j)),
thin AS (select q1.position, th, v, v - lag(v) over (order by q1.position) as step from q1 join keep using (position))
select position, round(th, 6) as theoretical, v as ordered, (select round(max(step), 6) from thin) as largest_step from thin""")

    one = REG + """,
fit AS (select regr_slope(speed, length_log1p) as b1, regr_intercept(speed, length_log1p) as b0,
  avg(length_log1p) as xbar, regr_sxx(speed, length_log1p) as sxx, count(*) as n, avg(speed) as ybar from tr),
res AS (select tr.*, speed - (b0 + b1 * length_log1p) as e, length_log1p - xbar as xc from tr, fit)"""
    q["linear_fit_predict"] = with_obs(one + "\nselect obs_id, round(b0 + b1 * length_log1p, 6) as prediction from te, fit")
    q["ols_robust"] = with_obs(one + """,
hc AS (select sum(e * e * xc * xc) / pow(any_value(sxx), 2) as vb1, sum(e * e) / pow(any_value(n), 2) as vb0c,
  sum(e * e * xc) / (any_value(n) * any_value(sxx)) as cov, any_value(n) as n from res, fit),
se AS (select b0, b1, sqrt((vb0c - 2 * xbar * cov + xbar * xbar * vb1) * hc.n / (hc.n - 2)) as se0,
  sqrt(vb1 * hc.n / (hc.n - 2)) as se1 from hc, fit)
select 'const' as variable, round(b0, 6) as coef, round(se0, 6) as std_err from se
union all select 'length_log1p', round(b1, 6), round(se1, 6) from se""")
    q["breusch_pagan"] = with_obs(one + """,
bp AS (select count(*) * pow(corr(e * e, length_log1p), 2) as lm from res),
bq AS (select lm, -sqrt(lm) as nz from bp)
select round(lm, 6) as lm, round(2 * """ + cdf("nz") + """, 6) as lm_pvalue from bq""")
    q["residual_normality"] = with_obs(one + f""",
rm AS ({_moments('e', 'res')}),
rk AS (select n, {_k2('n', 'm3 / pow(m2, 1.5)', 'm4 / pow(m2, 2)')} as k from rm)
""" + _test_row("D'Agostino K²", "resid", "k", "exp(-k / 2)", "n", "rk"))
    metric = """select '{name}' as model, round(sqrt(avg(pow(p - speed, 2))), 6) as rmse,
  round(1 - sum(pow(p - speed, 2)) / (var_pop(speed) * count(*)), 6) as r2, round(avg(abs(p - speed)), 6) as mae,
  round(avg(p - speed), 6) as bias from (select speed, {pred} as p from te, fit)"""
    q["regression_metrics"] = with_obs(one + "\n" + metric.format(name="one_feature", pred="b0 + b1 * length_log1p"))
    q["baseline_regression"] = with_obs(one + "\n" + metric.format(name="baseline", pred="ybar"))
    q["metrics_table"] = with_obs(one + "\n" + metric.format(name="baseline", pred="ybar") + "\nunion all\n"
                                  + metric.format(name="one_feature", pred="b0 + b1 * length_log1p"))
    q["residual_points"] = with_obs(one + """
select obs_id, split, speed as actual, round(b0 + b1 * length_log1p, 6) as predicted,
  round(speed - (b0 + b1 * length_log1p), 6) as residual from reg, fit""")
    q["axis_range"] = with_obs(one + """
select round(least(min(speed), min(b0 + b1 * length_log1p)), 6) as lo,
  round(greatest(max(speed), max(b0 + b1 * length_log1p)), 6) as hi from te, fit""")

    long_parts = [f"select fold, speed as y, '{c}' as f, {c} as v from tr" for c in NUM_FEATS]
    long_parts.append("select fold, speed, 'district_' || tb.lvl, case when tr.district = tb.lvl then 1.0 else 0.0 end "
                      "from tr, tb, tfirst where tb.lvl <> tfirst.f")
    long_parts.append("select fold, speed, 'peak_Valle', case when peak = 'Valle' then 1.0 else 0.0 end from tr")
    q["candidate_scores"] = with_obs(REG + train_levels + f""",
lf AS ({union(long_parts)}),
fs AS (select f, fold, count(*) as n, sum(v) as sx, sum(y) as sy, sum(v * v) as sxx, sum(v * y) as sxy, sum(y * y) as syy
  from lf group by f, fold),
ft AS (select f, sum(n) as n, sum(sx) as sx, sum(sy) as sy, sum(sxx) as sxx, sum(sxy) as sxy from fs group by f),
cv AS (select fs.*, ft.n - fs.n as tn, ft.sx - fs.sx as tx, ft.sy - fs.sy as ty, ft.sxx - fs.sxx as txx,
  ft.sxy - fs.sxy as txy from fs join ft using (f)),
cb AS (select *, (txy - tx * ty / tn) / (txx - tx * tx / tn) as b from cv),
ca AS (select *, (ty - b * tx) / tn as a from cb),
sse AS (select f, fold, n, syy - 2 * a * sy - 2 * b * sxy + a * a * n + 2 * a * b * sx + b * b * sxx as e from ca)
select f as feature, round(avg(-sqrt(greatest(e, 0) / n)), 6) as score from sse group by f""")

    q["vif_pair"] = with_obs(REG + """
select v as variable, round(1 / (1 - pow(r, 2)), 6) as vif from (select corr(length, length_log1p) as r from tr),
  (values ('length'), ('length_log1p')) t(v)""")

    pair = """,
pr AS (select corr(length, length_log1p) as r, avg(length) as m1, stddev_pop(length) as s1,
  avg(length_log1p) as m2, stddev_pop(length_log1p) as s2 from obs where length is not null and length_log1p is not null)"""
    q["explained_variance"] = with_obs(pair + """
select 'PC1' as component, round(100 * (1 + abs(r)) / 2, 2) as var_exp, round(100 * (1 + abs(r)) / 2, 2) as var_exp_cum from pr
union all select 'PC2', round(100 * (1 - abs(r)) / 2, 2), 100.0 from pr""")
    q["components_for_95"] = with_obs(pair + "\nselect case when (1 + abs(r)) / 2 >= 0.95 then 1 else 2 end as n_components from pr")
    q["loading_rank"] = with_obs(pair + """
select 'PC1' as component, 'length' as variable, round(sqrt(0.5), 6) as loading, 1 as abs_loading_rank
union all select 'PC1', 'length_log1p', round(case when r >= 0 then sqrt(0.5) else -sqrt(0.5) end, 6), 2 from pr
union all select 'PC2', 'length', round(sqrt(0.5), 6), 1
union all select 'PC2', 'length_log1p', round(case when r >= 0 then -sqrt(0.5) else sqrt(0.5) end, 6), 2 from pr""")
    q["pca_scores"] = with_obs(pair + """
select obs_id, round(((length - m1) / s1 + sign(r) * (length_log1p - m2) / s2) / sqrt(2), 6) as PC1,
  round(((length - m1) / s1 - sign(r) * (length_log1p - m2) / s2) / sqrt(2), 6) as PC2
from obs, pr where length is not null and length_log1p is not null""")

    scored = CLF + """,
sco AS (select obs_id, target_bin, duration_min as proba, case when duration_min > 60 then 'Alta' else 'Normal' end as predicted,
  case when target_bin = 'Alta' then 1 else 0 end as y from cte)"""
    q["classification_metrics"] = with_obs(scored + """
select round(avg(case when target_bin = predicted then 1.0 else 0.0 end), 6) as accuracy,
  round(coalesce(sum(case when predicted = 'Alta' and y = 1 then 1 else 0 end) / nullif(sum(case when predicted = 'Alta' then 1 else 0 end), 0), 0), 6) as precision,
  round(coalesce(sum(case when predicted = 'Alta' and y = 1 then 1 else 0 end) / nullif(sum(y), 0), 0), 6) as recall,
  round(coalesce(2 * sum(case when predicted = 'Alta' and y = 1 then 1 else 0 end) / nullif(sum(case when predicted = 'Alta' then 1 else 0 end) + sum(y), 0), 0), 6) as f1
from sco""")
    dist = """,
sv AS (select proba as score, sum(y)::double as pos, sum(1 - y)::double as neg from sco group by 1),
sd AS (select *, sum(pos) over (order by score desc rows between unbounded preceding and current row) as cp,
  sum(neg) over (order by score desc rows between unbounded preceding and current row) as cn,
  sum(neg) over (order by score rows between unbounded preceding and current row) as an,
  sum(pos) over () as P, sum(neg) over () as N from sv)"""
    q["roc_auc"] = with_obs(scored + dist + "\nselect round(sum(pos * (an - 0.5 * neg)) / (any_value(P) * any_value(N)), 6) as roc_auc from sd")
    q["roc_curve"] = with_obs(scored + dist + """
select 'inf'::double as threshold, 0.0 as fpr, 0.0 as tpr
union all select score, round(cn / N, 6), round(cp / P, 6) from sd""")
    q["pr_curve"] = with_obs(scored + dist + """
select score as threshold, round(cp / (cp + cn), 6) as precision, round(cp / P, 6) as recall from sd
union all select null, 1.0, 0.0""")
    base = CLF + """,
maj AS (select target_bin as m from clf where split = 'train' group by 1 order by count(*) desc, target_bin limit 1),
bp AS (select target_bin, m as predicted, case when target_bin = 'Alta' then 1 else 0 end as y from cte, maj)"""
    q["baseline_classification"] = with_obs(base + """
select 'baseline' as model, round(avg(case when target_bin = predicted then 1.0 else 0.0 end), 6) as accuracy,
  round(coalesce(sum(case when predicted = 'Alta' and y = 1 then 1 else 0 end) / nullif(sum(case when predicted = 'Alta' then 1 else 0 end), 0), 0), 6) as precision,
  round(coalesce(sum(case when predicted = 'Alta' and y = 1 then 1 else 0 end) / nullif(sum(y), 0), 0), 6) as recall,
  round(coalesce(2 * sum(case when predicted = 'Alta' and y = 1 then 1 else 0 end) / nullif(sum(case when predicted = 'Alta' then 1 else 0 end) + sum(y), 0), 0), 6) as f1,
  null::double as roc_auc from bp""")
    q["confusion_grid"] = with_obs(base + """,
cl AS (select distinct target_bin as c from clf)
select a.c as actual, p.c as predicted, coalesce(k.cnt, 0) as count from cl a cross join cl p
left join (select target_bin, predicted, count(*) as cnt from bp group by 1, 2) k on k.target_bin = a.c and k.predicted = p.c""")
    q["label_grid"] = with_obs(base + """,
cl AS (select distinct target_bin as c from clf)
select a.c as actual, p.c as predicted, coalesce(k.cnt, 0) as count, a.c = p.c as hit from cl a cross join cl p
left join (select target_bin, predicted, count(*) as cnt from bp group by 1, 2) k on k.target_bin = a.c and k.predicted = p.c""")
    return q
