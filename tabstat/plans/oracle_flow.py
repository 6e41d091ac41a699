"""DuckDB oracles for sources/sinks, the ridge path and the findings text."""

from __future__ import annotations

from ..plans.report import FIXED_ADVICE, FIXED_LIMITS, SECTION_ADVICE, SECTION_FINDINGS, SECTION_LIMITS
from ..sources.csv import DEFAULT_MISSING_TOKENS
from .oracle_model import NUM_FEATS, REG, SCALE, _ks_p, _scaled
from .oracle_normal import cdf
from .oracle_sql import RAW_OBS, with_obs

RAW_COLUMNS = ["obs_id", "seg_id", "district", "street", "day_text", "start_text", "end_text", "dur_text",
               "x_text", "y_text", "z_text", "rank_text", "length_text", "speed_text"]

GROUP = """select district, count(seg_id) as n_segments, round(avg(speed), 2) as speed_mean,
  round(case when count(speed) > 1 then stddev_samp(speed) end, 2) as speed_std, round(avg(length), 2) as length_mean,
  round(avg(duration_min), 2) as duration_min_mean from obs where district is not null group by district"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def findings_ctes(coefficients: str = "") -> str:
    """CTEs up to ``numbered``, the findings text; ``coefficients`` adds lines
    (section, ord, text) between the title and the correlations."""
    num = ["x", "y", "rank", "length", "length_log1p", "speed", "duration_min", "hour_sin", "hour_cos"]
    pos = ", ".join(f"('{c}', {i})" for i, c in enumerate(num))
    corr_parts = []
    for i, a in enumerate(num):
        for b in num[i + 1:]:
            corr_parts.append(f"select '{a}' as var1, '{b}' as var2, case when var_pop(case when {b} is not null then {a} end) > 0 "
                              f"and var_pop(case when {a} is not null then {b} end) > 0 then corr({a}, {b}) end as corr from obs")
    obs_cols = ["obs_id", "seg_id", "district", "street", "day_text", "start_text", "end_text", "dur_text", "x", "y", "rank",
                "length", "speed", "dt_start", "dt_end", "duration_min", "peak", "hour_sin", "hour_cos", "target_bin",
                "length_log1p"]
    miss = "\nunion all\n".join(f"select {i} as pos, '{c}' as variable, count(*) - count({c}) as n_missing from obs"
                                for i, c in enumerate(obs_cols))
    return f""",
cp AS ({' union all '.join(corr_parts)}),
cpp AS (select cp.*, p1.pos as p1, p2.pos as p2 from cp join (values {pos}) p1(name, pos) on cp.var1 = p1.name
  join (values {pos}) p2(name, pos) on cp.var2 = p2.name where corr is not null and abs(corr) >= 0.5),
top AS (select *, row_number() over (order by abs(corr) desc, var1, var2) as r from cpp),
pk AS (select peak, round(avg(speed), 2) as m from obs group by peak),
gs AS (select district, round(avg(speed), 2) as m from obs where district is not null group by district),
slow AS (select district, m from gs where m is not null order by m, district limit 1),
ms AS ({miss}),
mline AS (select '- Existen valores faltantes en ' || string_agg(variable || ' (' || cast(n_missing as varchar) || ')', ', ' order by pos) || '.' as t
  from ms where n_missing > 0 having count(*) > 0),
lines AS (
  select 'findings' as section, 0 as ord, {_q(SECTION_FINDINGS)} as text
  {coefficients}
  union all select 'findings', 1000 + r, printf('- Correlación destacada entre %s y %s: %.2f.', var1, var2, corr) from top where r <= 5
  union all select 'findings', 2000 + row_number() over (order by peak), '- Velocidad promedio en periodo ' || peak || ': ' || cast(m as varchar) || ' km/h.' from pk
  union all select 'findings', 3000, '- La comuna con menor velocidad promedio es ' || district || ' (' || cast(m as varchar) || ' km/h).' from slow
  union all select 'limits', 0, {_q(SECTION_LIMITS)}
  union all select 'limits', 1, t from mline
  union all select 'limits', 10, {_q(FIXED_LIMITS[0])} union all select 'limits', 11, {_q(FIXED_LIMITS[1])}
  union all select 'advice', 0, {_q(SECTION_ADVICE)}
  union all select 'advice', 1, {_q(FIXED_ADVICE[0])} union all select 'advice', 2, {_q(FIXED_ADVICE[1])}
  union all select 'advice', 3, {_q(FIXED_ADVICE[2])}),
numbered AS (select section, row_number() over (partition by section order by ord) as line_no, text from lines)"""


def oracles() -> dict[str, str]:
    q: dict[str, str] = {}
    tokens = ", ".join(_q(t) for t in DEFAULT_MISSING_TOKENS)
    cols = []
    for c in RAW_COLUMNS:
        v = f"ltrim(cast({c} as varchar), ' ')"
        cols.append(f"case when {v} in ({tokens}) then null else {v} end as {c}")
    q["scan_csv"] = f"WITH {RAW_OBS}\nselect {', '.join(cols)} from raw_obs"
    q["sink_table"] = with_obs(GROUP)
    q["scan_result_table"] = with_obs(f"""select district, round(speed_mean, 1) as speed_mean, round(speed_std, 1) as speed_std
from ({GROUP}) order by district limit 10""")
    q["sink_feature_matrix"] = with_obs(REG + SCALE + "\nselect obs_id, split, " + ", ".join(_scaled(c) for c in NUM_FEATS) + " from reg, sc")

    ks = f""",
st AS (select count(speed) as n, avg(speed) as mu, stddev_pop(speed) as sd from obs),
vc AS (select speed as v, count(*) as c from obs where speed is not null group by 1),
cum AS (select v, c, sum(c) over (order by v rows between unbounded preceding and current row) as e from vc),
zz AS (select v, c, e, e - c as s, (v - mu) / sd as z from cum, st),
cdf AS (select *, {cdf('z')} as fz from zz),
dd AS (select max(greatest(e / n - fz, fz - s / n)) as d, any_value(n) as n from cdf, st),
ksp AS (select d, n, {_ks_p('d', 'n')} as p from dd)"""
    q["sink_text"] = with_obs(ks + """
select 'normality' as section, 1 as line_no, 'Prueba de normalidad: Kolmogorov-Smirnov' as text
union all select 'normality', 2, 'Variable: speed'
union all select 'normality', 3, 'Estadístico: ' || printf('%.4f', d) from ksp
union all select 'normality', 4, 'p-valor: ' || printf('%.4f', p) from ksp
union all select 'normality', 5, 'n: ' || cast(n as varchar) from ksp
union all select 'normality', 6, 'Conclusión: ' || case when p > 0.05 then 'No se rechaza' else 'Se rechaza' end || ' la normalidad al 5%.' from ksp""")

    q["ridge_fallback"] = with_obs(REG + """,
rf AS (select avg(length_log1p) as xbar, avg(speed) as ybar, regr_sxx(speed, length_log1p) as sxx,
  covar_pop(length_log1p, speed) * count(*) as sxy from tr),
rb AS (select sxy / (2 * sxx + 1) as b, ybar - 2 * xbar * (sxy / (2 * sxx + 1)) as b0 from rf)
select 'const' as variable, round(b0, 6) as coef, null::double as std_err, null::double as p_value, 'ridge_fallback' as note from rb
union all select 'length_log1p', round(b, 6), null, null, 'ridge_fallback' from rb
union all select 'length_log1p_copy', round(b, 6), null, null, 'ridge_fallback' from rb""")

    find = findings_ctes()
    q["findings"] = with_obs(find + "\nselect * from numbered")
    return q
