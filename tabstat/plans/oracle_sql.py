"""DuckDB SQL for every registered query that SQL can express.

The strings are written independently of the Spark code (so the check is a
real second implementation). Tables ``events customer nation ...`` are views
registered by the checker. Floats are rounded the same way on both sides.
"""

from __future__ import annotations

WS = r"'^\s+|\s+$'"
NUM_RE = r"'^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$'"
HOUR_RE = r"'(\d+(?:[.,]\d+)?)\s*(?:h|hr|hrs|hora|horas)'"
MIN_RE = r"'(\d+(?:[.,]\d+)?)\s*(?:m|min|mins|minutos)'"
ANY_RE = r"'(\d+(?:[.,]\d+)?)'"
FORMATS = "['%d-%m-%Y %H:%M:%S', '%d-%m-%Y %H:%M', '%d/%m/%Y %H:%M:%S', '%d/%m/%Y %H:%M', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M']"

RAW_OBS = """raw_obs AS (
select e.event_id as obs_id,
  concat(n.n_name, '-', cast(e.event_id as varchar)) as seg_id,
  concat(' ', n.n_name, '  ') as district,
  case when e.event_id % 90 = 0 then 'nan' else concat('Street ', cast(e.user_id % 40 as varchar)) end as street,
  strftime(e.ts, '%d-%m-%Y') as day_text,
  strftime(e.ts, '%H:%M:%S') as start_text,
  strftime(e.ts + to_minutes(cast(15 + e.event_id % 120 as integer)), '%H:%M:%S') as end_text,
  case e.event_id % 8 when 0 then '0.5' when 1 then '1,5 h' when 2 then '45 min' when 3 then '1 h 30 min'
       when 4 then '' when 5 then 'x' when 6 then '2 Horas' else '90m' end as dur_text,
  cast(cast(-70.6 + (e.user_id % 50) / 100.0 as decimal(12,4)) as varchar) as x_text,
  cast(cast(-33.4 - (e.user_id % 37) / 100.0 as decimal(12,4)) as varchar) as y_text,
  '0' as z_text,
  cast((e.event_id * 37) % 1009 as varchar) as rank_text,
  cast(cast((cast(json_extract_string(e.props, '$.k') as double) + 1) / 50 as decimal(12,2)) as varchar) as length_text,
  case when e.event_id % 101 = 0 then 's/d' else cast(cast(e.value as decimal(12,2)) as varchar) end as speed_text
from events e
join customer c on e.user_id = c.c_custkey
join nation n on c.c_nationkey = n.n_nationkey
)"""


def _clean(c: str) -> str:
    s = f"regexp_replace({c}, {WS}, '', 'g')"
    return f"nullif(nullif({s}, 'nan'), 'None')"


def _num(c: str) -> str:
    return f"(case when regexp_matches({c}, {NUM_RE}) then try_cast(regexp_replace({c}, {WS}, '', 'g') as double) end)"


def _extract(t: str, pattern: str) -> str:
    return f"try_cast(replace(nullif(regexp_extract({t}, {pattern}, 1), ''), ',', '.') as double)"


OBS_STEPS = f"""obs_a AS (
select obs_id, {_clean('seg_id')} as seg_id, {_clean('district')} as district, {_clean('street')} as street,
  {_clean('day_text')} as day_text, {_clean('start_text')} as start_text, {_clean('end_text')} as end_text,
  {_clean('dur_text')} as dur_text,
  {_num('x_text')} as x, {_num('y_text')} as y, {_num('z_text')} as z, {_num('rank_text')} as rank,
  {_num('length_text')} as length, {_num('speed_text')} as speed
from raw_obs),
obs_b AS (
select *,
  try_strptime(day_text || ' ' || start_text, {FORMATS}) as t0,
  try_strptime(day_text || ' ' || end_text, {FORMATS}) as t1_raw,
  lower(regexp_replace(dur_text, {WS}, '', 'g')) as dtxt
from obs_a),
obs_c AS (
select *,
  case when t1_raw < t0 then t1_raw + interval 1 day else t1_raw end as t1,
  {_extract('dtxt', HOUR_RE)} as h_0,
  {_extract('dtxt', MIN_RE)} as m_0,
  {_extract('dtxt', ANY_RE)} as f_0
from obs_b),
obs_d AS (
select *,
  case when dtxt is null or dtxt = '' or dtxt = 'nan' then null
       when h_0 is null and m_0 is null and not contains(dtxt, 'min') then f_0 else h_0 end as h_1,
  case when dtxt is null or dtxt = '' or dtxt = 'nan' then null
       when h_0 is null and m_0 is null and contains(dtxt, 'min') then f_0 else m_0 end as m_1,
  hour(t0) + minute(t0) / 60.0 as hs, hour(t1) + minute(t1) / 60.0 as he
from obs_c),
obs_e AS (
select *,
  coalesce(m_1, h_1 * 60.0, coalesce(h_1, m_1 / 60.0, (epoch_us(t1) - epoch_us(t0)) / 1000000.0 / 3600.0) * 60.0) as duration_min,
  case when hs is not null and he is not null
       then ((hs + case when he < hs then he + 24 else he end) / 2.0) % 24
       when hs is not null then hs else he end as hmid
from obs_d),
obs AS (
select obs_id, seg_id, district, street, day_text, start_text, end_text, dur_text,
  x, y, rank, length, speed,
  t0 as dt_start, t1 as dt_end, duration_min,
  case when hs between 7 and 10 or hs between 17 and 20 then 'Punta' else 'Valle' end as peak,
  sin(2 * pi() * (hmid / 24.0)) as hour_sin, cos(2 * pi() * (hmid / 24.0)) as hour_cos,
  case when speed < 20 then 'Alta' else 'Normal' end as target_bin,
  case when length is not null then ln(1 + greatest(length, 0.0)) end as length_log1p
from obs_e)"""


OBS_COLUMNS = [
    "obs_id", "seg_id", "district", "street", "day_text", "start_text", "end_text", "dur_text",
    "x", "y", "rank", "length", "speed", "dt_start", "dt_end", "duration_min", "peak",
    "hour_sin", "hour_cos", "target_bin", "length_log1p",
]
NUMERIC = ["x", "y", "rank", "length", "length_log1p", "speed", "duration_min", "hour_sin", "hour_cos"]
CATEGORICAL = ["street", "district", "seg_id", "peak"]


def union(parts: list[str]) -> str:
    return "\nunion all\n".join(parts)


def with_obs(select: str) -> str:
    """``select`` may start with ",\n<more CTEs>" to add CTEs after ``obs``."""
    return f"WITH {RAW_OBS},\n{OBS_STEPS}{'' if select.startswith(',') else chr(10)}{select}"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}

    q["prepare"] = with_obs(
        """select obs_id, seg_id, district, street, day_text, start_text, end_text, dur_text,
  x, y, rank, length, speed, cast(dt_start as varchar) as dt_start, cast(dt_end as varchar) as dt_end,
  round(duration_min, 6) as duration_min, peak, round(hour_sin, 9) as hour_sin, round(hour_cos, 9) as hour_cos,
  target_bin, round(length_log1p, 9) as length_log1p
from obs"""
    )

    q["group_summary"] = with_obs(
        """select district, count(seg_id) as n_segments,
  round(avg(speed), 2) as speed_mean,
  round(case when count(speed) > 1 then stddev_samp(speed) end, 2) as speed_std,
  round(avg(length), 2) as length_mean,
  round(avg(duration_min), 2) as duration_min_mean
from obs where district is not null group by district"""
    )

    q["numeric_summary"] = with_obs(union([
        f"""select '{c}' as variable, round(count({c})::double, 2) as count, round(avg({c}), 2) as mean,
  round(stddev_samp({c}), 2) as std, round(min({c}), 2) as min, round(quantile_cont({c}, 0.25), 2) as q25,
  round(quantile_cont({c}, 0.5), 2) as median, round(quantile_cont({c}, 0.75), 2) as q75,
  round(max({c}), 2) as max, round(skewness({c}), 2) as skew, round(kurtosis({c}), 2) as kurtosis from obs"""
        for c in NUMERIC]))

    q["column_skew"] = with_obs("select round(skewness(length), 6) as skew from obs")

    long_cat = union([f"select '{c}' as variable, cast({c} as varchar) as value from obs" for c in CATEGORICAL])
    q["categorical_profile"] = with_obs(f"""select variable, nd as n_distinct, value as top, cnt as freq_top from (
  select *, row_number() over (partition by variable order by cnt desc, value) as rk,
         count(*) over (partition by variable) as nd
  from (select variable, value, count(*) as cnt from ({long_cat}) where value is not null group by variable, value))
where rk = 1""")

    miss = union([
        f"select {i} as pos, '{c}' as variable, count(*) - count({c}) as n_missing, "
        f"round((count(*) - count({c})) / count(*) * 100.0, 2) as pct_missing from obs"
        for i, c in enumerate(OBS_COLUMNS)])
    q["missing_report"] = with_obs(miss)
    q["columns_with_missing"] = with_obs(f"select variable, n_missing from ({miss}) where n_missing > 0")
    q["missing_sorted"] = with_obs(f"select * from ({miss}) order by pct_missing desc, pos")

    q["group_mean"] = with_obs("select peak, round(avg(speed), 2) as speed_mean from obs group by peak")
    q["group_argmin"] = with_obs("""select district, speed_mean from (
  select district, round(avg(speed), 2) as speed_mean from obs where district is not null group by district)
where speed_mean is not null order by speed_mean, district limit 1""")

    q["category_counts_topk"] = with_obs(union([
        f"""select * from (select '{c}' as variable, coalesce(cast({c} as varchar), 'Desconocido') as value,
  count(*) as count from obs group by 2 order by count desc, value limit 20)""" for c in CATEGORICAL]))

    q["category_shares"] = with_obs("""select 'district' as variable, district as value, count(*) as count,
  round(count(*) / sum(count(*)) over (), 9) as share from obs where district is not null group by district""")

    corr_parts = []
    for a in NUMERIC:
        for b in NUMERIC:
            corr_parts.append(
                f"select '{a}' as var1, '{b}' as var2, round(case when count({a} + {b}) > 1 and var_pop(case when {b} is not null then {a} end) > 0 "
                f"and var_pop(case when {a} is not null then {b} end) > 0 then corr({a}, {b}) end, 6) as corr from obs")
    corr = union(corr_parts)
    q["correlation_matrix"] = with_obs(corr)
    pos = ", ".join(f"('{c}', {i})" for i, c in enumerate(NUMERIC))
    pairs = f"""select c.var1, c.var2, c.corr, p1.pos as p1, p2.pos as p2 from ({corr}) c
  join (values {pos}) p1(name, pos) on c.var1 = p1.name
  join (values {pos}) p2(name, pos) on c.var2 = p2.name
  where p1.pos < p2.pos and c.corr is not null and abs(c.corr) >= 0.5"""
    q["correlation_pairs"] = with_obs(f"select var1, var2, corr from ({pairs}) order by abs(corr) desc, p1, p2")
    q["top_correlations"] = with_obs(f"select var1, var2, corr from ({pairs}) order by abs(corr) desc, p1, p2 limit 5")

    hist = []
    for c in NUMERIC:
        hist.append(f"""select '{c}' as variable, g.bin, round(g.lower, 6) as lower, round(g.upper, 6) as upper,
  coalesce(k.cnt, 0) as count from (
    select i::integer as bin, s.mn + i * (s.mx - s.mn) / s.nb as lower,
      case when i = s.nb - 1 then s.mx else s.mn + (i + 1) * (s.mx - s.mn) / s.nb end as upper
    from st_{c} s, range(s.nb::bigint) r(i)) g
  left join (
    select least(floor(({c} - s.mn) * s.nb::double / (s.mx - s.mn)), s.nb - 1)::integer as bin, count(*) as cnt
    from obs, st_{c} s where {c} is not null group by 1) k on g.bin = k.bin""")
    stats = ",\n".join(
        f"""st_{c} AS (select mn, mx, n, case when mx = mn then 1 else cast(ceil((mx - mn) / case when fd > 0 then least(fd, (mx - mn) / (log2(n) + 1)) else (mx - mn) / (log2(n) + 1) end) as bigint) end as nb
  from (select min({c}) as mn, max({c}) as mx, count({c}) as n,
    2.0 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) * pow(count({c}), -1.0 / 3.0) as fd from obs))"""
        for c in NUMERIC)
    q["histogram_bins"] = f"WITH {RAW_OBS},\n{OBS_STEPS},\n{stats}\n" + union(hist)

    box = []
    for c in NUMERIC:
        box.append(f"""select '{c}' as variable, round(q1, 6) as q1, round(med, 6) as median, round(q3, 6) as q3,
  round(min(case when {c} between lo and hi then {c} end), 6) as whisker_low,
  round(max(case when {c} between lo and hi then {c} end), 6) as whisker_high,
  count(case when {c} is not null and not ({c} between lo and hi) then 1 end) as n_outliers
from obs, (select q1, med, q3, q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from (
  select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.5) as med, quantile_cont({c}, 0.75) as q3 from obs))
group by q1, med, q3""")
    q["boxplot_stats"] = with_obs(union(box))

    q["density_grid"] = with_obs("""select 'speed' as variable, g.point, round(g.x, 9) as x,
  round(sum(b.w * exp(-0.5 * pow((g.x - b.v) / s.bw, 2))) / (s.n * s.bw * sqrt(2 * pi())), 9) as density
from (select n, sd * pow(n, -1.0 / 5.0) as bw from (select count(speed) n, stddev_samp(speed) sd from obs)) s,
  (select i::integer as point, s2.mn + i * ((s2.mx - s2.mn) / 199) as x
   from (select min(speed) mn, max(speed) mx from obs) s2, range(200) r(i)) g,
  (select speed as v, count(*)::double as w from obs where speed is not null group by speed) b
group by g.point, g.x, s.n, s.bw""")
    from .oracle_classify import oracles as _classify
    from .oracle_fits import oracles as _fits
    from .oracle_flow import oracles as _flow
    from .oracle_model import oracles as _model
    from .oracle_rows import oracles as _rows

    q.update(_rows())
    q.update(_model())
    q.update(_flow())
    q.update(_fits(q))
    q.update(_classify())
    q["profile"] = _long(q, PROFILE)
    q["run_all"] = f"""select part, row, name, round(value, 6) as value, null::varchar as text from ({_long(q, PROFILE + FLOW)}) l
union all select 'findings', section || '|' || line_no, 'text', null, text from ({q.pop("flow_text")}) f"""
    return q


# parts of the profile and of the full flow: (part, query, key columns, value columns)
PROFILE = [
    ("numeric_summary", "numeric_summary", ["variable"], ["count", "mean", "std", "min", "q25", "median", "q75", "max", "skew", "kurtosis"]),
    ("categorical_profile", "categorical_profile", ["variable", "top"], ["n_distinct", "freq_top"]),
    ("category_counts", "category_counts_topk", ["variable", "value"], ["count"]),
    ("missing_report", "missing_report", ["variable"], ["n_missing", "pct_missing"]),
    ("correlation_matrix", "correlation_matrix", ["var1", "var2"], ["corr"]),
    ("histogram_bins", "histogram_bins", ["variable", "bin"], ["lower", "upper", "count"]),
    ("density_grid", "density_grid", ["variable", "point"], ["x", "density"]),
    ("boxplot_stats", "boxplot_stats", ["variable"], ["q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers"]),
    ("group_summary", "group_summary", ["district"], ["n_segments", "speed_mean", "speed_std", "length_mean", "duration_min_mean"]),
]
FLOW = [
    ("metrics", "model_regression", ["model"], ["rmse", "r2", "mae", "bias"]),
    ("vif", "vif", ["variable"], ["vif"]),
    ("selection_trace", "forward_select_regression", ["step", "feature"], ["score"]),
    ("report_tables", "report_tables", ["part", "ord", "name", "text"], ["value", "p_value", "std_err"]),
]


def _long(q: dict[str, str], parts: list[tuple]) -> str:
    """The parts, each from its own SQL, as (part, row, name, value)."""
    out = []
    for part, source, keys, values in parts:
        row = "concat_ws('|', " + ", ".join(f'cast("{k}" as varchar)' for k in keys) + ")"
        cells = ", ".join(f"""{{'name': '{v}', 'value': cast("{v}" as double)}}""" for v in values)
        out.append(f"select '{part}' as part, r as row, c.name as name, c.value as value from (select {row} as r, unnest([{cells}]) as c from ({q[source]}) t_{part}) u_{part}")
    return "\nunion all\n".join(out)
