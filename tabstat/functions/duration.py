"""Durations written in words ("1,5 h", "45 min", "90m", "2 Horas") as
Column expressions: three regex extracts, no Python UDF.

Rules (fixed, as in the reference):
* lower-case and strip; empty or ``nan`` gives no value;
* the first number followed by ``h`` is hours, the first number followed by
  ``m`` is minutes; comma or dot decimal;
* neither: the first number anywhere is minutes when the text holds ``min``,
  else hours;
* only minutes: hours = minutes / 60; only hours: minutes = hours * 60;
* both: kept apart (``1 h 30 min`` is 1 hour and 30 minutes), unless
  ``sum_parts`` asks for the total.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_ws

# Fixed patterns.
NUMBER = r"(\d+(?:[.,]\d+)?)"
HOUR_RE = NUMBER + r"\s*(?:h|hr|hrs|hora|horas)"
MINUTE_RE = NUMBER + r"\s*(?:m|min|mins|minutos)"
ANY_NUMBER_RE = NUMBER


def _number(text: Column, pattern: str) -> Column:
    raw = F.regexp_extract(text, pattern, 1)
    return F.when(raw != "", F.regexp_replace(raw, ",", ".").try_cast("double"))


def with_duration(df, c: str, hours_col: str, minutes_col: str, sum_parts: bool = False):
    """Staged form of ``parse_duration`` for wide plans: the lower-cased text
    and the three extracts become columns first, so each regex runs once and
    the generated code stays small (two projections)."""
    keep = [F.col(f"`{x}`") for x in df.columns]
    t = F.lower(strip_ws(F.col(f"`{c}`")))
    df = df.select(*keep, t.alias("__dtxt"))
    t = F.col("__dtxt")
    df = df.select(*keep, t, _number(t, HOUR_RE).alias("__h0"), _number(t, MINUTE_RE).alias("__m0"),
                   _number(t, ANY_NUMBER_RE).alias("__f0"))
    valid = t.isNotNull() & (t != "") & (t != "nan")
    neither = F.col("__h0").isNull() & F.col("__m0").isNull()
    has_min = t.contains("min")
    h1 = F.when(valid, F.when(neither & ~has_min, F.col("__f0")).otherwise(F.col("__h0")))
    m1 = F.when(valid, F.when(neither & has_min, F.col("__f0")).otherwise(F.col("__m0")))
    df = df.select(*keep, h1.alias("__h1"), m1.alias("__m1"))
    h1, m1 = F.col("__h1"), F.col("__m1")
    if sum_parts:
        total = F.when(h1.isNotNull() & m1.isNotNull(), h1 * 60.0 + m1)
        minutes = F.coalesce(total, m1, h1 * 60.0)
        hours = minutes / 60.0
    else:
        hours = F.coalesce(h1, m1 / 60.0)
        minutes = F.coalesce(m1, h1 * 60.0)
    return df.select(*keep, hours.alias(hours_col), minutes.alias(minutes_col))


def parse_duration(c, sum_parts: bool = False) -> tuple[Column, Column]:
    """Return (hours, minutes) Columns for a duration text column."""
    text = F.lower(strip_ws(F.col(c) if isinstance(c, str) else c))
    valid = text.isNotNull() & (text != "") & (text != "nan")
    hours0 = _number(text, HOUR_RE)
    minutes0 = _number(text, MINUTE_RE)
    fallback = _number(text, ANY_NUMBER_RE)
    neither = hours0.isNull() & minutes0.isNull()
    has_min = text.contains("min")
    hours1 = F.when(neither & ~has_min, fallback).otherwise(hours0)
    minutes1 = F.when(neither & has_min, fallback).otherwise(minutes0)
    if sum_parts:
        total = F.when(hours1.isNotNull() & minutes1.isNotNull(), hours1 * 60.0 + minutes1)
        minutes = F.coalesce(total, minutes1, hours1 * 60.0)
        hours = minutes / 60.0
    else:
        hours = F.coalesce(hours1, minutes1 / 60.0)
        minutes = F.coalesce(minutes1, hours1 * 60.0)
    return F.when(valid, hours), F.when(valid, minutes)


def fill_duration_minutes(hours: Column, minutes: Column, delta_seconds: Column) -> Column:
    """Missing hours come from the timestamp difference; missing minutes
    from hours * 60."""
    filled_hours = F.coalesce(hours, delta_seconds / F.lit(3600.0))
    return F.coalesce(minutes, filled_hours * F.lit(60.0))
