"""DuckDB oracles of the fits over all features: least squares with HC1
errors, VIF and PCA. The linear systems are solved in SQL: Gauss-Jordan steps
and Jacobi rotations over a matrix held as nested lists, one recursion step
each."""

from __future__ import annotations

from .oracle_flow import findings_ctes
from .oracle_model import CLF, NUM_FEATS, REG, SCALE, _k2, _moments
from .oracle_normal import cdf
from .report import FEATURES_LINE, HC1_LINE, HOUR_NOTES, LENGTH_NOTES, SOURCE_LINES
from .oracle_sql import NUMERIC, with_obs

LEVELS = """,
tshares AS (select district as lvl, count(*) / sum(count(*)) over () as share from tr where district is not null group by 1),
tkept AS (select lvl from tshares where share >= 0.01),
bucketed AS (select *, case when district in (select lvl from tkept) then district else '__RARE__' end as dlvl from reg),
tb AS (select distinct dlvl as lvl from bucketed where split = 'train'),
dummies AS (select lvl, row_number() over (order by lvl) + {first} + 1 as j from tb where lvl <> (select min(lvl) from tb)),
size AS (select count(*) + {first} + 2 as p from dummies)"""


def gauss_jordan(name: str, start: str) -> str:
    """CTEs that reduce the matrix ``m`` of ``start`` (columns n, m) to
    [I | ...]: the result is in ``name`` as m."""
    return f"""
{name}_steps AS (
  select 0 as k, n, m from {start}
  union all
  select k + 1, n, list_transform(range(1, n + 1), lambda i: case when i = k + 1
      then list_transform(m[k + 1], lambda x: x / m[k + 1][k + 1])
      else list_transform(range(1, len(m[1]) + 1), lambda j: m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1]) end)
  from {name}_steps where k < n),
{name} AS (select n, m from {name}_steps where k = n)"""


def jacobi(name: str, start: str, sweeps: int = 12) -> str:
    """CTEs that rotate the symmetric matrix ``m`` of ``start`` to a diagonal
    one, all pairs of rows in turn, ``sweeps`` times."""
    # rotation of the pair (p, q): angle half of atan2(2 m_pq, m_qq - m_pp)
    return f"""
{name}_pairs AS (select list((p, q) order by p, q) as pairs from (select p, q from {start}, range(1, n + 1) a(p), range(1, n + 1) b(q) where p < q)),
{name}_steps AS (
  select 0 as k, n, m from {start}
  union all
  select k + 1, n, list_transform(range(1, n + 1), lambda i: list_transform(range(1, n + 1), lambda j:
      case when i = p and j = p then c * c * m[p][p] - 2 * s * c * m[p][q] + s * s * m[q][q]
           when i = q and j = q then s * s * m[p][p] + 2 * s * c * m[p][q] + c * c * m[q][q]
           when (i = p and j = q) or (i = q and j = p) then 0.0
           when i = p then c * m[p][j] - s * m[q][j] when i = q then s * m[p][j] + c * m[q][j]
           when j = p then c * m[i][p] - s * m[i][q] when j = q then s * m[i][p] + c * m[i][q]
           else m[i][j] end))
  from (select *, cos(t) as c, sin(t) as s from (select *, atan2(2 * m[p][q], m[q][q] - m[p][p]) / 2 as t from (
      select *, pairs[k % len(pairs) + 1][1] as p, pairs[k % len(pairs) + 1][2] as q from {name}_steps, {name}_pairs
      where k < {sweeps} * len(pairs))))),
{name} AS (select n, m from {name}_steps where k = (select max(k) from {name}_steps))"""


P_VALUE_STEPS = 2000  # Simpson intervals under Student's density


def design_ctes(rows: str = REG) -> str:
    """``design``: the feature columns of all rows in long form (j from 1, the
    constant; column p + 1 is the target), and ``names`` of the columns."""
    first = len(NUM_FEATS)
    key = "obs_id, split, fold, speed"
    parts = [f"select {key}, 1 as j, 1.0::double as v from reg"]
    parts += [f"select {key}, {i + 2}, ({c} - m_{c}) / s_{c} from reg, sc" for i, c in enumerate(NUM_FEATS)]
    parts.append(f"select {key}, j, 1.0 from bucketed join dummies on dlvl = lvl")
    parts.append(f"select {key}, p, 1.0 from reg, size where peak = 'Valle'")
    numeric = " union all ".join(f"select {i + 2}, '{c}'" for i, c in enumerate(NUM_FEATS))
    return rows + SCALE + LEVELS.format(first=first) + f""",
design AS ({' union all '.join(parts)}),
names AS (select 1 as j, 'const' as variable union all {numeric} union all select j, 'district_' || lvl from dummies union all select p, 'peak_Valle' from size)"""


def least_squares(m: str, columns: str) -> str:
    """CTEs of the fit on the design columns j of ``columns``: {m}_table
    (variable, b, se, pv; HC1 errors, two-sided t) and {m}_pred (all rows)."""
    return f""",
{m}_cols AS (select j, row_number() over (order by j) as pos, count(*) over () as n from {columns}),
{m}_z AS (select obs_id, speed, pos, v from design join {m}_cols using (j) where split = 'train'),
{m}_cells AS (select a.pos as i, t.j from {m}_cols a, range(1, 2 * a.n + 2) t(j)),
{m}_gram AS (select a.pos as i, b.pos as j, sum(a.v * b.v) as v from {m}_z a join {m}_z b using (obs_id) group by 1, 2
  union all select pos, (select count(*) + 1 from {m}_cols), sum(v * speed) from {m}_z group by 1
  union all select pos, n + 1 + pos, 1.0 from {m}_cols),
{m}_system AS (select (select count(*) from {m}_cols) as n, list(r order by i) as m from (
  select c.i, list(coalesce(g.v, 0.0) order by c.j) as r from {m}_cells c left join {m}_gram g on g.i = c.i and g.j = c.j group by c.i)),
{gauss_jordan(m + '_solved', m + '_system')},
{m}_beta AS (select i as pos, m[i][n + 1] as b from {m}_solved, range(1, n + 1) t(i)),
{m}_inv AS (select i, j, m[i][n + 1 + j] as v from {m}_solved, range(1, n + 1) a(i), range(1, n + 1) b(j)),
{m}_pred AS (select obs_id, any_value(split) as split, any_value(speed) as speed, sum(v * b) as p
  from design join {m}_cols using (j) join {m}_beta using (pos) group by obs_id),
{m}_meat AS (select a.pos as i, b.pos as j, sum(a.v * b.v * pow(r.speed - r.p, 2)) as v
  from {m}_z a join {m}_z b using (obs_id) join {m}_pred r using (obs_id) group by 1, 2),
{m}_half AS (select x.i, y.j, sum(x.v * y.v) as v from {m}_inv x join {m}_meat y on x.j = y.i group by 1, 2),
{m}_cov AS (select h.i as pos, sum(h.v * x.v) as v from {m}_half h join {m}_inv x on x.i = h.j and x.j = h.i group by 1),
{m}_shape AS (select count(*) as n, (select count(*) from {m}_cols) as p from {m}_pred where split = 'train'),
{m}_coefs AS (select pos, b, sqrt(v * n / (n - p)) as se, n - p as df from {m}_beta join {m}_cov using (pos), {m}_shape),
{m}_tail AS (select pos, greatest(0.0, 1 - 2 * any_value(exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()) * t) / {3 * P_VALUE_STEPS}
    * sum(case when k in (0, {P_VALUE_STEPS}) then 1 when k % 2 = 1 then 4 else 2 end * pow(1 + pow(t * k / {P_VALUE_STEPS}, 2) / df, -(df + 1) / 2.0))) as pv
  from (select pos, df, least(abs(b / se), 60) as t from {m}_coefs), range(0, {P_VALUE_STEPS + 1}) r(k) group by pos),
{m}_table AS (select variable, b, se, pv from {m}_coefs join {m}_tail using (pos) join {m}_cols using (pos) join names using (j))"""


# the classification rows under the names of the regression ones; the label is
# the target
LABELS = CLF + """,
reg AS (select * replace (case when target_bin = 'Alta' then 1.0 else 0.0 end as speed), 0 as fold from clf),
tr AS (select * from reg where split = 'train')"""


def logit(steps: int = 9) -> str:
    """CTEs of the unpenalised logit by Newton steps from 0: ``logit`` (j, b, se)."""
    out = """,
tz AS MATERIALIZED (select obs_id, speed, j, v from design where split = 'train'),
n0 AS (select j, 0.0 as b from names)"""
    for s in range(1, steps + 1):
        out += f""",
m{s} AS MATERIALIZED (select obs_id, any_value(speed) as y, 1 / (1 + exp(-sum(v * b))) as mu from tz join n{s - 1} using (j) group by obs_id),
cells{s} AS (select a.j as i, t.j from names a, size, range(1, 2 * p + 2) t(j)),
g{s} AS (select a.j as i, b.j as j, sum(a.v * b.v * mu * (1 - mu)) as v from tz a join tz b using (obs_id) join m{s} using (obs_id) group by 1, 2
  union all select j, p + 1, sum(v * (y - mu)) from tz join m{s} using (obs_id), size group by 1, 2
  union all select j, p + 1 + j, 1.0 from names, size),
system{s} AS (select (select p from size) as n, list(r order by i) as m from (
  select c.i, list(coalesce(g.v, 0.0) order by c.j) as r from cells{s} c left join g{s} g on g.i = c.i and g.j = c.j group by c.i)),
{gauss_jordan(f'x{s}', f'system{s}')},
n{s} AS MATERIALIZED (select i as j, b + m[i][n + 1] as b, sqrt(m[i][n + 1 + i]) as se from x{s}, range(1, n + 1) t(i) join n{s - 1} o on o.j = i)"""
    return out + f""",
logit AS (select * from n{steps})"""


def forward_selection(steps: int) -> str:
    """CTEs of the greedy selection: ``chosen`` has the design columns of model
    2. Per fold (and for all training rows, fold -1) the Gram matrix outside
    the fold is eliminated by the chosen columns; a candidate's coefficients
    follow from it, its error from the Gram matrix of the fold itself."""
    out = """,
target AS (select p + 1 as yj from size),
with_y AS (select obs_id, split, fold, j, v from design union all select obs_id, split, fold, yj, speed from reg, target),
met AS (select a.fold as f, a.j as i, b.j as j, sum(a.v * b.v) as v from with_y a join with_y b using (obs_id) where a.split = 'train' group by 1, 2, 3),
inside AS MATERIALIZED (select f, i, j, coalesce(met.v, 0.0) as v from (select f, i, j from (select distinct fold as f from tr) x, range(1, (select yj from target) + 1) a(i),
  range(1, (select yj from target) + 1) b(j)) left join met using (f, i, j)),
whole AS (select i, j, sum(v) as v from inside group by 1, 2),
sel0 AS (select 1 as j, 0 as step),
raw AS MATERIALIZED (select f, i, j, whole.v - inside.v as v from inside join whole using (i, j) union all select -1, i, j, v from whole),
t0 AS MATERIALIZED (""" + _eliminate("raw", "(select 1 as k)") + ")"
    for s in range(1, steps + 1):
        t, sel = f"t{s - 1}", f"sel{s - 1}"
        out += f""",
c{s} AS (select t.f, t.i as c, t.v / d.v as b from {t} t join {t} d on d.f = t.f and d.i = t.i and d.j = t.i, target
  where t.f >= 0 and t.j = yj and t.i < yj and t.i not in (select j from {sel})),
b{s} AS MATERIALIZED (select f, c, c as j, b from c{s} union all
  select c.f, c.c, s.j, u.v - w.v * c.b from c{s} c cross join {sel} s cross join target join {t} u on u.f = c.f and u.i = s.j and u.j = yj join {t} w on w.f = c.f and w.i = s.j and w.j = c.c),
e{s} AS (select f, c, sum(v) as sse from (
    select b.f, c, -2 * b * v as v from b{s} b join inside h on h.f = b.f and h.i = b.j, target where h.j = yj
    union all select x.f, x.c, x.b * z.b * h.v from b{s} x join b{s} z on z.f = x.f and z.c = x.c join inside h on h.f = x.f and h.i = x.j and h.j = z.j
    union all select c.f, c, v from c{s} c join inside h on h.f = c.f, target where h.i = yj and h.j = yj) group by 1, 2),
p{s} AS MATERIALIZED (select c as k, score from (select c, avg(-sqrt(greatest(sse, 0) / h.v)) as score from e{s} e join inside h on h.f = e.f and h.i = 1 and h.j = 1 group by c)
  order by score desc, c limit 1),
sel{s} AS MATERIALIZED (select j, step from {sel} union all select k, {s} from p{s}),
t{s} AS MATERIALIZED ({_eliminate(t, f'p{s}')})"""
    return out + f""",
chosen AS (select j from sel{steps})"""


def _eliminate(t: str, pick: str) -> str:
    """One Gauss-Jordan step of every fold's matrix on the picked column."""
    return f"""select t.f, t.i, t.j, case when t.i = k then r.v / d.v else t.v - c.v * r.v / d.v end as v from {t} t cross join {pick} pk
  join {t} r on r.f = t.f and r.i = k and r.j = t.j join {t} c on c.f = t.f and c.i = t.i and c.j = k join {t} d on d.f = t.f and d.i = k and d.j = k"""


def diagnostics(m: str) -> str:
    """CTEs of the diagnostics text of a model, {m}_lines (line_no, text):
    K^2 of the training residuals, Breusch-Pagan with the chi-square and F
    tails from the series of the incomplete gamma and beta functions."""
    return f""",
{m}_res AS MATERIALIZED (select obs_id, speed - p as e from {m}_pred where split = 'train'),
{m}_mom AS ({_moments('e', f'{m}_res')}),
{m}_k2 AS (select {_k2('n', 'm3 / pow(m2, 1.5)', 'm4 / pow(m2, 2)')} as k2 from {m}_mom),
{m}_zu AS (select pos, sum(v * e * e) as zu from {m}_z join {m}_res using (obs_id) group by pos),
{m}_ub AS (select i, sum(v * zu) as b from {m}_inv join {m}_zu on pos = j group by i),
{m}_ss AS (select sum(b * zu) - any_value(n) * pow(any_value(u), 2) as ess, any_value(t) - any_value(n) * pow(any_value(u), 2) as tss, any_value(n) as n, any_value(p) as p
  from {m}_ub join {m}_zu on pos = i, {m}_shape, (select avg(e * e) as u, sum(pow(e, 4)) as t from {m}_res)),
{m}_bp AS (select n * ess / tss as lm, (ess / tss / (p - 1)) / ((1 - ess / tss) / (n - p)) as f, (p - 1) / 2.0 as a, (n - p) / 2.0 as b from {m}_ss),
{m}_lmp AS (select 1 - sum(exp((a + i) * ln(lm / 2) - lm / 2 - lgamma(a + i + 1))) as pv from {m}_bp, range(0, 2000) r(i)),
{m}_fp AS (select 1 - sum(exp(a * ln(y) + b * ln(1 - y) + lgamma(a + b + i) - lgamma(a + i + 1) - lgamma(b) + i * ln(y))) as pv
  from (select *, a * f / (a * f + b) as y from {m}_bp), range(0, 3000) r(i)),
{m}_lines AS (select 1 as line_no, '{HC1_LINE}' as text
  union all select 2, 'Prueba de normalidad (D''Agostino K²): estadístico=' || printf('%.4f', k2) || ' p-value=' || printf('%.5f', exp(-k2 / 2)) from {m}_k2
  union all select 3, 'Breusch-Pagan: LM p-value=' || printf('%.5f', (select pv from {m}_lmp)) || ' | F p-value=' || printf('%.5f', (select pv from {m}_fp)))"""


def report_tables(q: dict[str, str], both: str) -> str:
    """The report's tables from the fits ``both`` and the SQL of ``vif`` and
    ``schema_profile``."""
    none = "null::double"
    top = lambda m, k, d: f"""(select row_number() over (order by abs(b) desc, variable) as r, variable, round(b, {d}) as b, round(pv, 4) as pv, round(se, 4) as se
  from {m}_table where variable <> 'const' order by 1 limit {k})"""  # noqa: E731
    metric = """(select unnest([2, 3, 4, 5]) as r, unnest([printf('• RMSE: %.3f', sqrt(avg(pow(p - speed, 2)))), printf('• R2: %.3f', 1 - sum(pow(p - speed, 2)) / (var_pop(speed) * count(*))),
  printf('• MAE: %.3f', avg(abs(p - speed))), printf('• Bias: %.3f', avg(p - speed))]) as t from {m}_pred where split = 'test')"""
    parts = [
        f"select 'vif' as part, row_number() over (order by vif desc, variable) as ord, variable as name, round(vif, 2) as value, {none} as p_value, {none} as std_err, null::varchar as text from ({q['vif']}) v",
        f"select 'coefficients', r, variable, b, pv, {none}, null from {top('m2', 10, 3)}",
        f"select 'data', row_number() over (), indicator, value::double, {none}, {none}, null from ({q['schema_profile']}) s",
    ]
    notes = ["Coeficientes mostrados: Modelo 2 (fuente: ols).", HOUR_NOTES[True], LENGTH_NOTES[True]]
    parts += [f"select 'notes', {i}, null, {none}, {none}, {none}, '{t.replace(chr(39), chr(39) * 2)}'" for i, t in enumerate(notes, 1)]
    for i in (1, 2):
        parts.append(f"select 'modelo{i}', r, variable, b, pv, se, null from {top(f'm{i}', 8, 4)}")
        first, last = FEATURES_LINE.format(num=len(NUM_FEATS), cat=2), SOURCE_LINES["ols"]
        parts.append(f"select 'modelo{i}_text', r, null, {none}, {none}, {none}, t from (select 1 as r, '{first}' as t union all select 6, '{last}' union all select * from {metric.format(m=f'm{i}')})")
    return recursive(both + "\n" + "\nunion all ".join(parts))


def recursive(sql: str) -> str:
    return with_obs(sql).replace("WITH ", "WITH RECURSIVE ", 1)


def oracles(known: dict[str, str]) -> dict[str, str]:
    """``known``: SQL of the queries that the flow's tables repeat."""
    q: dict[str, str] = {}
    one = design_ctes() + least_squares("m1", "names")
    q["coef_union_dropped"] = recursive(one + """
select variable, round(b, 6) as coef, round(se, 6) as std_err, round(pv, 6) as p_value, null::varchar as note from m1_table
union all select 'flat', null, null, null, null""")
    q["top_coefficients"] = recursive(one + """
select row_number() over (order by abs(b) desc, variable) as rank, variable, round(b, 3) as coef, round(pv, 4) as p_value
from m1_table where variable <> 'const' order by 1 limit 5""")
    both = one + forward_selection(10) + least_squares("m2", "chosen")
    check = """select '{label}' as model, 'ols' as source, n, p, (select count(*) from {m}_beta where isfinite(b)) as rank, (n - p)::double as df_resid,
  '' as issues, '' as dropped from {m}_shape"""
    q["ols_checks"] = recursive(both + "\n" + check.format(label="modelo1", m="m1") + "\nunion all " + check.format(label="modelo2", m="m2"))
    metric = """select '{label}' as model, round(sqrt(avg(pow(p - speed, 2))), 6) as rmse, round(1 - sum(pow(p - speed, 2)) / (var_pop(speed) * count(*)), 6) as r2,
  round(avg(abs(p - speed)), 6) as mae, round(avg(p - speed), 6) as bias from {source}"""
    base = "(select speed, (select avg(speed) from tr) as p from te)"
    test = "(select * from {m}_pred where split = 'test')"
    q["model_regression"] = recursive(both + "\n" + "\nunion all ".join(
        metric.format(label=n, source=s) for n, s in (("baseline", base), ("modelo1", test.format(m="m1")), ("modelo2", test.format(m="m2")))))
    q["compare_models"] = recursive(both + "\n" + "\nunion all ".join(
        f"select 'modelo{i}' as model, obs_id, speed as actual, round(p, 6) as predicted, round(speed - p, 6) as residual from m{i}_pred where split = 'test'" for i in (1, 2)))
    q["forward_select_regression"] = recursive(one + forward_selection(10) + "\n" + "\nunion all ".join(
        f"select {i} as step, variable as feature, round(score, 6) as score from p{i} join names on j = k" for i in range(1, 11)))
    q["residual_grid"] = recursive(one + """,
pts AS (select p as x, speed - p as y from m1_pred where split = 'train'),
span AS (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from pts),
cell AS (select least(floor((x - x0) * 40.0 / (x1 - x0)), 39)::int as x_bin, least(floor((y - y0) * 40.0 / (y1 - y0)), 39)::int as y_bin, count(*) as n from pts, span group by 1, 2)
select x_bin, y_bin, round(x0 + (x_bin + 0.5) * (x1 - x0) / 40, 6) as x, round(y0 + (y_bin + 0.5) * (y1 - y0) / 40, 6) as y, n as count from cell, span""")
    q["format_findings"] = recursive(both + findings_ctes() + diagnostics("m1") + diagnostics("m2") + """
select section, line_no, text from numbered where section = 'findings' and line_no > 1
union all select 'diagnostics_modelo1', line_no, text from m1_lines union all select 'diagnostics_modelo2', line_no, text from m2_lines""")
    lines = "\n  ".join(
        f"""union all select 'findings', {100 * i} + r, printf('- Modelo {i} {verb} a %s con coeficiente %.3f (p=%.3f).', variable, b, pv)
    from (select *, row_number() over (order by abs(b) desc, variable) as r from m{i}_table where variable <> 'const') where r <= 5"""
        for i, verb in ((1, "resalta"), (2, "identifica")))
    q["logit_inference"] = recursive(design_ctes(LABELS) + logit() + f""",
z AS (select j, b, se, -abs(b / se) as nz from logit)
select variable, round(b, 6) as coef, round(se, 4) as std_err, round(2 * {cdf('nz')}, 4) as p_value, round(exp(b), 4) as odds_ratio, null::varchar as note
from z join names using (j)""")
    text = recursive(both + findings_ctes(lines) + "\nselect * from numbered")
    k = len(NUM_FEATS)
    row = lambda a: "[" + ", ".join([f"corr({a}, {b})" for b in NUM_FEATS] + ["1.0" if a == b else "0.0" for b in NUM_FEATS]) + "]"
    q["vif"] = recursive(REG + f""",
square AS (select {k} as n, [{', '.join(row(a) for a in NUM_FEATS)}] as m from tr),
{gauss_jordan('inv', 'square')}
select [{', '.join(f"'{c}'" for c in NUM_FEATS)}][i] as variable, round(m[i][n + i], 6) as vif from inv, range(1, n + 1) t(i)""")
    whole = " and ".join(f"{c} is not null" for c in NUMERIC)
    corr = ", ".join("[" + ", ".join(f"corr({a}, {b})" for b in NUMERIC) + "]" for a in NUMERIC)
    q["pca_fit"] = recursive(f""",
complete AS (select * from obs where {whole}),
square AS (select {len(NUMERIC)} as n, [{corr}] as m from complete),
{jacobi('eig', 'square')},
vals AS (select row_number() over (order by m[i][i] desc) as k, m[i][i] / n as share from eig, range(1, n + 1) t(i))
select 'PC' || k as component, round(100 * share, 2) as var_exp, round(100 * sum(share) over (order by k), 2) as var_exp_cum, k from vals""")
    q["vif_sorted"] = f"""select row_number() over (order by vif desc, variable) as rank, variable, vif, vif > 10 as high from ({q['vif']}) v order by 1 limit 15"""
    q["report_tables"] = report_tables({**known, **q}, both)
    q["flow_text"] = text
    return q
