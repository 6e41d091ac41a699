"""DuckDB oracles for the row-level and column-list queries."""

from __future__ import annotations

from .oracle_sql import ANY_RE, HOUR_RE, MIN_RE, NUMERIC, OBS_COLUMNS, RAW_OBS, WS, _extract, union, with_obs

TEXT = ["street", "district", "day_text", "end_text", "start_text", "seg_id", "dur_text"]
TYPED = ["x", "y", "z", "rank", "length", "speed"]
DERIVED_COLUMNS = [
    "obs_id", "seg_id", "district", "street", "day_text", "start_text", "end_text", "dur_text",
    "x", "y", "z", "rank", "length", "speed", "dt_start", "dt_end", "duration_min", "peak",
    "hour_sin", "hour_cos", "target_bin",
]


def oracles() -> dict[str, str]:
    q: dict[str, str] = {}
    q["obs_enriched"] = f"WITH {RAW_OBS}\nselect * from raw_obs"
    q["clean_text"] = with_obs(f"select obs_id, {', '.join(TEXT)} from obs_a")
    q["coerce_numeric"] = with_obs(f"select obs_id, {', '.join(TYPED)} from obs_a")
    q["parse_datetime"] = with_obs("select obs_id, cast(t0 as varchar) as dt_start, cast(t1_raw as varchar) as dt_end_raw from obs_b")
    q["midnight_rollover"] = with_obs("select obs_id, cast(t1 as varchar) as dt_end, t1_raw < t0 as rolled from obs_c")
    dur = f"""dur_a AS (select obs_id, dur_text, lower(regexp_replace(dur_text, {WS}, '', 'g')) as t from raw_obs),
dur_b AS (select *, {_extract('t', HOUR_RE)} as h0, {_extract('t', MIN_RE)} as m0, {_extract('t', ANY_RE)} as f0 from dur_a),
dur_c AS (select *,
  case when t is null or t = '' or t = 'nan' then null when h0 is null and m0 is null and not contains(t, 'min') then f0 else h0 end as h1,
  case when t is null or t = '' or t = 'nan' then null when h0 is null and m0 is null and contains(t, 'min') then f0 else m0 end as m1
  from dur_b)"""
    q["parse_duration"] = f"""WITH {RAW_OBS},
{dur}
select obs_id, dur_text, coalesce(h1, m1 / 60.0) as hours, coalesce(m1, h1 * 60.0) as minutes,
  round(coalesce(case when h1 is not null and m1 is not null then h1 * 60.0 + m1 end, m1, h1 * 60.0) / 60.0, 9) as hours_summed,
  coalesce(case when h1 is not null and m1 is not null then h1 * 60.0 + m1 end, m1, h1 * 60.0) as minutes_summed
from dur_c"""
    q["fill_duration"] = with_obs("select obs_id, round(duration_min, 6) as duration_min from obs_e")
    q["hour_fraction"] = with_obs("select obs_id, round(hs, 9) as start_hour, round(he, 9) as end_hour from obs_d")
    q["peak_flag"] = with_obs("select obs_id, case when hs between 7 and 10 or hs between 17 and 20 then 'Punta' else 'Valle' end as peak from obs_d")
    q["circular_midpoint"] = with_obs("select obs_id, round(hmid, 9) as mid_hour from obs_e")
    q["cyclic_encode"] = with_obs("select obs_id, round(sin(2 * pi() * (hmid / 24.0)), 9) as hour_sin, round(cos(2 * pi() * (hmid / 24.0)), 9) as hour_cos from obs_e")
    q["threshold_label"] = with_obs("select obs_id, case when speed < 20 then 'Alta' else 'Normal' end as target_bin from obs_a")
    q["log1p_clip"] = with_obs("select obs_id, round(case when length is not null then ln(1 + greatest(length, 0.0)) end, 9) as length_log1p from obs_a")
    q["winsorize"] = with_obs("""select obs_id, round(case when length is not null then least(greatest(length, lo), hi) end, 9) as length_winsor
from obs, (select quantile_cont(length, 0.01) as lo, quantile_cont(length, 0.99) as hi from obs)""")
    q["transform_dispatch"] = with_obs("""select m.method, m.method as applied, 'length_log1p' as feature, true as raw_excluded,
  (select round(skewness(length), 6) from obs) as skewness
from (values ('none'), ('log1p'), ('winsor')) m(method)""")
    before = DERIVED_COLUMNS + ["length_log1p"]
    const_parts = []
    for c in before:
        src = "obs_e" if c not in ("dt_start", "dt_end", "peak", "hour_sin", "hour_cos", "target_bin", "length_log1p") else "obs_full"
        const_parts.append(f"select '{c}' as variable from {src} having count({c}) = 0 or (count({c}) = count(*) and min({c}) = max({c}))")
    full = """obs_full AS (select *, t0 as dt_start, t1 as dt_end,
  case when hs between 7 and 10 or hs between 17 and 20 then 'Punta' else 'Valle' end as peak,
  sin(2 * pi() * (hmid / 24.0)) as hour_sin, cos(2 * pi() * (hmid / 24.0)) as hour_cos,
  case when speed < 20 then 'Alta' else 'Normal' end as target_bin,
  case when length is not null then ln(1 + greatest(length, 0.0)) end as length_log1p from obs_e)"""
    q["drop_columns"] = with_obs(",\n" + full + "\n" + union([
        f"select {i} as pos, '{c}' as variable, count({c}) as n_present from obs_full" for i, c in enumerate(DERIVED_COLUMNS)]))
    q["drop_constant_columns"] = with_obs(",\n" + full + "\n" + union(const_parts))
    num = NUMERIC
    q["near_constant_filter"] = with_obs(union([
        f"select '{c}' as variable, round(var_pop({c}), 6) as var_pop, var_pop({c}) > 1e-8 as kept from obs" for c in num]))
    zv = ["x", "y", "z", "rank", "length", "length_log1p", "speed", "duration_min", "hour_sin", "hour_cos"]
    q["zero_variance_drop"] = with_obs(",\n" + full + "\n" + union([
        f"select '{c}' as variable, round(var_pop({c}), 6) as var_pop, abs(var_pop({c})) <= 1e-8 as dropped from obs_full" for c in zv]))
    q["impute_mean"] = with_obs("select obs_id, " + ", ".join(
        f"round(coalesce({c}, avg({c}) over ()), 6) as {c}" for c in num) + " from obs")
    q["drop_missing_rows"] = with_obs("""select obs_id, (x is not null and y is not null and rank is not null and length_log1p is not null and duration_min is not null
  and hour_sin is not null and hour_cos is not null and district is not null and peak is not null) as complete from obs where speed is not null""")
    q["fill_label"] = with_obs("select obs_id, coalesce(street, 'Desconocido') as street from obs")
    feats = [("x", "numeric"), ("y", "numeric"), ("rank", "numeric"), ("length_log1p", "numeric"),
             ("duration_min", "numeric"), ("hour_sin", "numeric"), ("hour_cos", "numeric"),
             ("district", "categorical"), ("peak", "categorical")]
    q["select_features"] = with_obs(union([
        f"select {i} as pos, '{c}' as feature, '{k}' as kind, count({c}) as n_present from obs" for i, (c, k) in enumerate(feats)]))
    q["choose_target_task"] = with_obs("""select 'auto' as option, 'speed' as target, 'regression' as task, count(distinct speed) as n_distinct from obs
union all select 'clf', 'target_bin', 'classification', count(distinct target_bin) from obs""")
    q["schema_profile"] = with_obs(f"""select 'Observaciones' as indicator, count(*) as value from obs
union all select 'Variables', {len(OBS_COLUMNS)} union all select 'Numéricas', 10 union all select 'Categóricas', {len(OBS_COLUMNS) - 10}""")
    q["round_columns"] = with_obs("select obs_id, round(length_log1p, 2) as length_log1p, round(hour_sin, 3) as hour_sin, round(duration_min, 1) as duration_min, peak from obs")
    q["label_encode_binary"] = with_obs("select obs_id, case when target_bin = 'Alta' then 1 else 0 end as y from obs")
    return q
