"""Date, time-of-day and cyclic features as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import OFF_PEAK_LABEL, PEAK_LABEL, PEAK_WINDOWS
from .text import strip_ws

_CLOCK = r"[ T]+\d{1,2}:\d{2}(:\d{2})?( ?[AaPp]\.?[Mm]\.?)?$"
DAY_FIRST = r"^\d{1,2}[-/. ]\d{1,2}[-/. ](\d{4}|\d{2})" + _CLOCK
YEAR_FIRST = r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}" + _CLOCK


def _looks(text: Column) -> dict[str, Column]:
    """What is read from a date and time text: its numbers, whether the year
    comes first, whether it is a date at all, and the letter of AM or PM."""
    return {
        # a text that is a date begins with a number; an empty last part is no number
        "parts": F.split(text, r"[^0-9]+"),
        "year_first": text.rlike(YEAR_FIRST),
        "day_first": text.rlike(DAY_FIRST),
        "half": F.lower(F.regexp_extract(text, r"([AaPp])\.?[Mm]\.?$", 1)),
    }


def _numbers(seen: dict[str, Column]) -> dict[str, Column]:
    """The six numbers, and the length of the third."""
    numbers = {f"n{i}": F.get(seen["parts"], F.lit(i)).try_cast("int") for i in range(6)}
    return numbers | {"short": F.char_length(F.get(seen["parts"], F.lit(2))) == 2} | {c: seen[c] for c in ("year_first", "day_first", "half")}


def _made(seen: dict[str, Column]) -> Column:
    first, second, third, hour, minute, second_of_minute = (seen[f"n{i}"] for i in range(6))
    year_first, half = seen["year_first"], seen["half"]
    swapped = (second > 12) & (first <= 12)
    day = F.when(year_first, third).when(swapped, second).otherwise(first)
    month = F.when(year_first | swapped, F.when(year_first, second).otherwise(first)).otherwise(second)
    year = F.when(year_first, first).when(seen["short"], third + F.when(third < 69, 2000).otherwise(1900)).otherwise(third)
    hour24 = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    made = F.try_make_timestamp_ntz(year, month, day, hour24, minute, F.coalesce(second_of_minute, F.lit(0)))
    return F.when(year_first | seen["day_first"], made)


def parse_datetime(date_text, time_text) -> Column:
    """Date and time text to TIMESTAMP_NTZ; bad text gives NULL.

    Day first (``14-03-2025``, ``14/3/25``, ``14.03.2025``) or year first;
    seconds optional, ``AM`` and ``PM`` accepted; two-digit years below 69 are
    in this century. Where the second number can only be a day, it is one. The
    value is made from its parts, so no time zone takes part."""
    return _made(_numbers(_looks(F.concat(strip_ws(date_text), F.lit(" "), strip_ws(time_text)))))


def with_datetimes(df: DataFrame, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """Staged form of ``parse_datetime`` for stripped texts, {new column: (date
    text, time text)}: the text, what is read from it and its numbers become columns first. As one
    expression every use of a number splits the text again, some twenty times a
    row."""
    keep = [F.col(f"`{c}`") for c in df.columns]
    df = df.select(*keep, *[F.concat(F.col(f"`{d}`"), F.lit(" "), F.col(f"`{t}`")).alias(f"__{c}_text") for c, (d, t) in wanted.items()])
    for read in (lambda c: _looks(F.col(f"__{c}_text")), lambda c: _numbers(_Columns(c))):
        df = df.select(*keep, *[v.alias(f"__{c}_{k}") for c in wanted for k, v in read(c).items()])
    return df.select(*keep, *[_made(_Columns(c)).alias(c) for c in wanted])


class _Columns(dict):
    """The staged columns of one date, by name."""

    def __init__(self, name: str):
        self.name = name

    def __missing__(self, part: str) -> Column:
        return F.col(f"__{self.name}_{part}")


def midnight_rollover(start: Column, end: Column) -> Column:
    """End before start means the slot crossed midnight: add one day."""
    return F.when(end < start, end + F.expr("INTERVAL 1 DAY")).otherwise(end)


def seconds_between(start: Column, end: Column) -> Column:
    """Exact difference in seconds (microsecond precision)."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1_000_000.0)


def hour_fraction(ts: Column) -> Column:
    """Hour plus minutes/60 (seconds ignored)."""
    return F.hour(ts) + F.minute(ts) / F.lit(60.0)


def peak_flag(hour: Column) -> Column:
    """Peak label when the start hour falls in a peak window (ends included)."""
    cond = None
    for lo, hi in PEAK_WINDOWS:
        part = hour.between(lo, hi)
        cond = part if cond is None else (cond | part)
    # a NULL condition falls to ``otherwise``: missing hour is off-peak
    return F.when(cond, F.lit(PEAK_LABEL)).otherwise(F.lit(OFF_PEAK_LABEL))


def circular_midpoint(start_hour: Column, end_hour: Column) -> Column:
    """Mid hour on a 24 h ring; one side missing gives the other side."""
    end_adj = F.when(end_hour < start_hour, end_hour + F.lit(24.0)).otherwise(end_hour)
    both = F.pmod((start_hour + end_adj) / F.lit(2.0), F.lit(24.0))
    return (
        F.when(start_hour.isNotNull() & end_hour.isNotNull(), both)
        .when(start_hour.isNotNull(), start_hour)
        .otherwise(end_hour)
    )


def cyclic_encode(hour: Column) -> tuple[Column, Column]:
    """(sin, cos) of the hour angle on a 24 h ring."""
    angle = F.lit(2.0 * math.pi) * (hour / F.lit(24.0))
    return F.sin(angle), F.cos(angle)
