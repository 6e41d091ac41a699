"""DuckDB oracles of the classification flow: penalised logistic fits by
Newton steps, the forward selection by held-out AUC (every candidate, fold and
step), metrics, curves and predictions of both models."""

from __future__ import annotations

from .oracle_fits import design_ctes, gauss_jordan, recursive
from .oracle_model import CLF, _hash

NEWTON_STEPS = 8
SELECTED = 10

# the classification rows under the names of the regression ones; folds are
# dealt within split and class
ROWS = CLF.replace(f"{_hash('')} as h from obs", f"{_hash('')} as h, {_hash('fold:')} as h2 from obs") + """,
reg AS (select * replace (case when target_bin = 'Alta' then 1.0 else 0.0 end as speed),
  case when split = 'train' then (row_number() over (partition by split, target_bin order by h2, obs_id) - 1) % 5 else -1 end as fold from clf),
tr AS (select * from reg where split = 'train')"""

# the design matrix as one list per row
WIDE = """,
cells AS (select obs_id, n.j, coalesce(d.v, 0.0) as v from (select obs_id from reg) k cross join names n left join (select obs_id, j, v from design) d using (obs_id, j)),
wide AS MATERIALIZED (select r.obs_id, r.split, r.fold, r.speed as y, w.x from reg r join (select obs_id, list(v order by j) as x from cells group by obs_id) w on w.obs_id = r.obs_id)"""


def penalised(m: str, columns: str, steps: int = NEWTON_STEPS + 1) -> str:
    """CTEs of the L2-penalised logit (C = 1, intercept free) on the design
    columns j of ``columns``: {m}_pred (obs_id, split, y, eta)."""
    out = f""",
{m}_cols AS MATERIALIZED (select j, row_number() over (order by j) as pos, count(*) over () as n from {columns}),
{m}_z AS MATERIALIZED (select obs_id, speed as yy, pos, v from design join {m}_cols using (j) where split = 'train'),
{m}_b0 AS (select pos, 0.0 as b, case when j = 1 then 0.0 else 1.0 end as pen from {m}_cols)"""
    for s in range(1, steps + 1):
        b = f"{m}_b{s - 1}"
        out += f""",
{m}_mu{s} AS MATERIALIZED (select obs_id, any_value(yy) as y, 1 / (1 + exp(-sum(v * b))) as mu from {m}_z join {b} using (pos) group by obs_id),
{m}_g{s} AS (select i, j, sum(v) as v from (
  select a.pos as i, b.pos as j, a.v * b.v * mu * (1 - mu) as v from {m}_z a join {m}_z b using (obs_id) join {m}_mu{s} using (obs_id)
  union all select pos, (select max(n) + 1 from {m}_cols), v * (y - mu) from {m}_z join {m}_mu{s} using (obs_id)
  union all select pos, pos, pen from {b}
  union all select pos, (select max(n) + 1 from {m}_cols), -pen * b from {b}) group by 1, 2),
{m}_system{s} AS (select (select max(n) from {m}_cols) as n, list(r order by i) as m from (
  select c.pos as i, list(coalesce(g.v, 0.0) order by t.j) as r from {m}_cols c cross join (select unnest(range(1, max(n) + 2)) as j from {m}_cols) t
  left join {m}_g{s} g on g.i = c.pos and g.j = t.j group by c.pos)),
{gauss_jordan(f'{m}_x{s}', f'{m}_system{s}')},
{m}_b{s} AS MATERIALIZED (select pos, b + m[pos][n + 1] as b, pen from {m}_x{s}, {b})"""
    return out + f""",
{m}_pred AS MATERIALIZED (select obs_id, any_value(split) as split, any_value(target_bin) as target_bin, sum(v * b) as eta
  from design join {m}_cols using (j) join {m}_b{steps} using (pos) join (select obs_id, target_bin from clf) using (obs_id) group by obs_id)"""


def _eliminated(system: str, keys: str, k: int) -> str:
    """The k x (k + 1) systems m of ``system`` solved, one nested select per
    pivot."""
    sql = f"select {keys}, m from {system}"
    for p in range(1, k + 1):
        sql = f"""select {keys}, list_transform(range(1, {k + 1}), lambda i: case when i = {p} then list_transform(m[{p}], lambda x: x / m[{p}][{p}])
  else list_transform(range(1, {k + 2}), lambda j: m[i][j] - m[i][{p}] * m[{p}][j] / m[{p}][{p}]) end) as m from ({sql})"""
    return sql


def selection(steps: int = SELECTED) -> str:
    """CTEs of the greedy selection by mean held-out AUC: p{s} (c, score) of
    each step and ``chosen``, the design columns of model 2. Scores that agree
    to 9 decimals tie; of candidates that agree to 12 the first one wins."""
    out = """,
held AS (select unnest(range(0, 5)) as f),
sel0 AS (select []::bigint[] as s)"""
    for s in range(1, steps + 1):
        k = s + 1
        z = ["1.0"] + [f"z{i}" for i in range(1, k)]
        b = [f"b{i}" for i in range(k)]
        eta = " + ".join(f"{x} * {y}" for x, y in zip(b, z))
        out += f""",
cand{s} AS (select j as c from names, sel{s - 1} where j > 1 and not list_contains(s, j)),
z{s} AS MATERIALIZED (select fold, y, c, {''.join(f'x[s[{i}]] as z{i}, ' for i in range(1, s))}x[c] as z{s} from wide, cand{s}, sel{s - 1} where split = 'train'),
n{s}_0 AS (select c, f, {', '.join(f'0.0 as {x}' for x in b)} from cand{s}, held)"""
        for i in range(1, NEWTON_STEPS + 1):
            last, here = f"n{s}_{i - 1}", f"n{s}_{i}"
            cell = lambda p, q: f"sum(w * {z[min(p, q)]} * {z[max(p, q)]})" + (" + 1.0" if p == q > 0 else "")
            row = lambda p: "[" + ", ".join([*(cell(p, q) for q in range(k)), f"sum(r * {z[p]})" + (f" - any_value(b{p})" if p else "")]) + "]"
            out += f""",
a{s}_{i} AS MATERIALIZED (select c, f, [{', '.join(map(row, range(k)))}] as m from (
  select *, mu * (1 - mu) as w, y - mu as r from (select n.*, z.y, {''.join(f'z.z{j}, ' for j in range(1, k))}1 / (1 + exp(-({eta}))) as mu
  from z{s} z join {last} n on n.c = z.c and n.f <> z.fold)) group by c, f),
{here} AS MATERIALIZED (select c, f, {', '.join(f'b{j} + m[{j + 1}][{k + 1}] as b{j}' for j in range(k))} from ({_eliminated(f'a{s}_{i}', 'c, f', k)}) join {last} using (c, f))"""
        out += f""",
e{s} AS (select z.c, f, round({eta}, 9) as e, sum(y) as pos, sum(1 - y) as neg from z{s} z join n{s}_{NEWTON_STEPS} n on n.c = z.c and n.f = z.fold group by 1, 2, 3),
u{s} AS (select c, f, sum(pos * (an - 0.5 * neg)) / (sum(pos) * sum(neg)) as auc from (
  select *, sum(neg) over (partition by c, f order by e rows between unbounded preceding and current row) as an from e{s}) group by c, f),
p{s} AS MATERIALIZED (select c, avg(auc) as score from u{s} group by c order by round(avg(auc), 12) desc, c limit 1),
sel{s} AS MATERIALIZED (select list_append(s, c) as s from sel{s - 1}, p{s})"""
    return out + f""",
chosen AS (select 1 as j union all select unnest(s) from sel{steps})"""


def _answers(m: str) -> str:
    """{m}_test: test rows with probability and class; {m}_sd: running counts
    by distinct probability, from the top and (an) from the bottom."""
    return f""",
{m}_test AS MATERIALIZED (select obs_id, target_bin, case when target_bin = 'Alta' then 1 else 0 end as y, 1 / (1 + exp(-eta)) as proba,
  case when eta > 0 then 'Alta' else 'Normal' end as predicted from {m}_pred where split = 'test'),
{m}_sd AS (select *, sum(pos) over d as cp, sum(neg) over d as cn, sum(neg) over (order by score rows between unbounded preceding and current row) as an,
  sum(pos) over () as pp, sum(neg) over () as nn from (select round(proba, 9) as score, sum(y)::double as pos, sum(1 - y)::double as neg from {m}_test group by 1)
  window d as (order by score desc rows between unbounded preceding and current row))"""


def _metrics(label: str, source: str, auc: str) -> str:
    hit, said = "sum(case when predicted = 'Alta' and y = 1 then 1 else 0 end)", "sum(case when predicted = 'Alta' then 1 else 0 end)"
    return f"""select '{label}' as model, round(avg(case when target_bin = predicted then 1.0 else 0.0 end), 6) as accuracy,
  round(coalesce({hit} / nullif({said}, 0), 0), 6) as precision, round(coalesce({hit} / nullif(sum(y), 0), 0), 6) as recall,
  round(coalesce(2 * {hit} / nullif({said} + sum(y), 0), 0), 6) as f1, {auc} as roc_auc from {source}"""


def oracles() -> dict[str, str]:
    q: dict[str, str] = {}
    start = design_ctes(ROWS)
    one = start + penalised("m1", "names") + _answers("m1")
    q["logistic_fit_predict"] = recursive(one + "\nselect obs_id, round(proba, 6) as proba, predicted from m1_test")
    chosen = start + WIDE + selection()
    q["forward_select_classification"] = recursive(chosen + "\n" + "\nunion all ".join(
        f"select {s} as step, variable as feature, round(score, 6) as score, true as converged from p{s} join names on j = c" for s in range(1, SELECTED + 1)))
    both = one + WIDE + selection() + penalised("m2", "chosen") + _answers("m2")
    auc = "(select round(sum(pos * (an - 0.5 * neg)) / (any_value(pp) * any_value(nn)), 6) from {m}_sd)"
    base = """(select target_bin, case when target_bin = 'Alta' then 1 else 0 end as y,
  (select target_bin from clf where split = 'train' group by 1 order by count(*) desc, target_bin limit 1) as predicted from clf where split = 'test')"""
    q["model_classification"] = recursive(both + "\n" + "\nunion all ".join(
        [_metrics("baseline", base, "null::double"), *(_metrics(f"modelo{i}", f"m{i}_test", auc.format(m=f"m{i}")) for i in (1, 2))]))
    parts = []
    for i in (1, 2):
        label = f"select 'modelo{i}' as model"
        parts += [
            f"{label}, 'prediction' as part, cast(obs_id as varchar) as name, round(proba, 6) as x, case when predicted = 'Alta' then 1.0 else 0.0 end as y from m{i}_test",
            f"{label}, 'confusion', a.c || '|' || p.c, coalesce(n, 0)::double, null from (select distinct target_bin as c from clf) a cross join (select distinct target_bin as c from clf) p "
            f"left join (select target_bin, predicted, count(*) as n from m{i}_test group by 1, 2) t on t.target_bin = a.c and t.predicted = p.c",
            f"{label}, 'roc', null, round(cn / nn, 6), round(cp / pp, 6) from m{i}_sd", f"{label}, 'roc', null, 0.0, 0.0",
            f"{label}, 'pr', null, round(cp / pp, 6), round(cp / (cp + cn), 6) from m{i}_sd", f"{label}, 'pr', null, 0.0, 1.0",
        ]
    q["compare_models_classification"] = recursive(both + "\n" + "\nunion all ".join(parts))
    return q
