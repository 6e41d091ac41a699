import math

import pytest
from pyspark.sql import functions as F

from tabstat.functions.duration import parse_duration, with_duration
from tabstat.functions.numeric import log1p_clip, threshold_label
from tabstat.functions.text import clean_text, coerce_numeric
from tabstat.functions.time import circular_midpoint, hour_fraction, midnight_rollover, parse_datetime, peak_flag, with_datetimes
from tabstat.operators.profile import correlation_long
from tabstat.plans.prepare import constant_columns, derived

DURATIONS = [
    ("0.5", 0.5, 30.0), ("1,5 h", 1.5, 90.0), ("45 min", 0.75, 45.0), ("2 Horas", 2.0, 120.0),
    ("1 h 30 min", 1.0, 30.0), ("min 45", 0.75, 45.0), ("90m", 1.5, 90.0),
    ("", None, None), ("nan", None, None), ("x", None, None), (None, None, None),
]


def test_parse_duration_rules(spark):
    df = spark.createDataFrame([(t,) for t, _, _ in DURATIONS], "t string")
    h, m = parse_duration("t")
    got = df.select("t", h.alias("h"), m.alias("m")).collect()
    staged = with_duration(df, "t", "h", "m").collect()
    for (text, eh, em), row, row2 in zip(DURATIONS, got, staged):
        assert row["h"] == pytest.approx(eh) if eh is not None else row["h"] is None, text
        assert row["m"] == pytest.approx(em) if em is not None else row["m"] is None, text
        assert (row2["h"], row2["m"]) == (row["h"], row["m"])


def test_duration_sum_option(spark):
    df = spark.createDataFrame([("1 h 30 min",)], "t string")
    h, m = parse_duration("t", sum_parts=True)
    r = df.select(h.alias("h"), m.alias("m")).first()
    assert r["m"] == 90.0 and r["h"] == 1.5


def test_text_and_numbers(spark):
    df = spark.createDataFrame([(" a\t", "1e3"), ("nan", "1.5d"), ("None", "1,5"), ("", "s/d"), (None, " 7 ")],
                               "t string, n string")
    rows = df.select(clean_text("t").alias("t"), coerce_numeric("n").alias("n")).collect()
    assert [r["t"] for r in rows] == ["a", None, None, "", None]
    assert [r["n"] for r in rows] == [1000.0, None, None, None, 7.0]


def test_times_midnight_and_peak(spark):
    df = spark.createDataFrame([("14-03-2025", "23:30", "00:10")], "d string, s string, e string")
    t = df.select(parse_datetime("d", "s").alias("t0"), parse_datetime("d", "e").alias("t1"))
    t = t.select("t0", midnight_rollover(F.col("t0"), F.col("t1")).alias("t1"))
    r = t.select(((F.unix_micros(F.col("t1").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))) / 6e7).alias("mins"),
                 circular_midpoint(hour_fraction(F.col("t0")), hour_fraction(F.col("t1"))).alias("mid")).first()
    assert r["mins"] == pytest.approx(40.0)
    assert r["mid"] == pytest.approx(23.8333333, abs=1e-6)
    hours = [7.0, 10.0, 10.0 + 1 / 60, 17.0, 20.0, 16.0 + 59 / 60, 20.0 + 1 / 60, None]
    want = ["Punta", "Punta", "Valle", "Punta", "Punta", "Valle", "Valle", "Valle"]
    hd = spark.createDataFrame([(h,) for h in hours], "h double")
    assert [r[0] for r in hd.select(peak_flag(F.col("h"))).collect()] == want


def test_midpoint_missing_sides(spark):
    df = spark.createDataFrame([(None, 5.0), (None, None)], "a double, b double")
    rows = df.select(circular_midpoint(F.col("a"), F.col("b")).alias("m")).collect()
    assert rows[0]["m"] == 5.0 and rows[1]["m"] is None


def test_label_and_length(spark):
    df = spark.createDataFrame([(19.99, -1.0), (20.0, None), (None, 0.5)], "v double, l double")
    rows = df.select(threshold_label("v").alias("y"), log1p_clip("l").alias("l")).collect()
    assert [r["y"] for r in rows] == ["Alta", "Normal", "Normal"]
    assert rows[0]["l"] == 0.0 and rows[1]["l"] is None and rows[2]["l"] == pytest.approx(math.log1p(0.5))


def test_constant_columns(spark):
    df = spark.createDataFrame(
        [(None, 1, 1, 1, 1), (None, 1, None, 2, 1)],
        "all_null int, one_value int, one_plus_null int, two_values int, protected int",
    )
    dropped, _ = constant_columns(df, protected=["protected"])
    assert dropped == ["all_null", "one_value"]


def test_correlation_pairwise_and_constant(spark):
    df = spark.createDataFrame([(1.0, 1.0, 3.0), (2.0, None, 3.0), (3.0, 2.0, 3.0), (4.0, 5.0, 3.0)], "a double, b double, c double")
    rows = {(r.var1, r.var2): r.corr for r in correlation_long(df, ["a", "b", "c"]).collect()}
    assert rows[("a", "b")] == pytest.approx(0.8910421112, abs=1e-9)
    assert rows[("a", "c")] is None


def test_datetimes_in_any_zone_and_form(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    rows = [("08-09-2024", "00:30:00", "2024-09-08 00:30:00"), ("14.03.2025", "7:05 PM", "2025-03-14 19:05:00"), ("14-03-25", "12:00 am", "2025-03-14 00:00:00"),
            ("2024/2/29", "23:59", "2024-02-29 23:59:00"), ("08/25/2024", "1:00", "2024-08-25 01:00:00"), ("\xa01/2/1999 ", "\u20030:01", "1999-02-01 00:01:00"),
            ("30-02-2024", "1:00", None), ("1-1-2024", "25:00", None), ("1-1-2024", "13:00 PM", None), ("x", "1:00", None), (None, "1:00", None), ("1-1-2024", None, None)]
    try:
        for z in ("UTC", "America/Santiago"):
            spark.conf.set("spark.sql.session.timeZone", z)
            df = spark.createDataFrame(rows, "d string, t string, want string")
            for r in df.select("d", "t", "want", parse_datetime("d", "t").cast("string").alias("got")).collect():
                assert r.got == r.want, (z, r)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_unicode_blanks(spark):
    from tabstat.functions.text import clean_text

    df = spark.createDataFrame([("\xa0Maipú\xa0",), ("\u2003nan",), ("a\xa0b\u3000",)], "x string")
    assert [r[0] for r in df.select(clean_text("x")).collect()] == ["Maipú", None, "a\xa0b"]


def test_staged_datetimes_agree(spark):
    from tabstat.functions.text import strip_ws

    dates = ["08-09-2024", "14.03.2025", "14-03-25", "2024/2/29", "08/25/2024", "\xa01/2/1999 ", "30-02-2024", "-1-1-2024", "1--2-2024", "1-1-1", "x", "", None]
    times = ["00:30:00", "7:05 PM", "12:00 am", "13:00 p.m.", "23:59", "25:00", "1:00:61", "x", "", None]
    df = spark.createDataFrame([(d, t) for d in dates for t in times], "d string, t string")
    df = df.withColumn("want", parse_datetime("d", "t")).select("want", strip_ws("d").alias("d"), strip_ws("t").alias("t"))
    rows = with_datetimes(df, {"a": ("d", "t"), "b": ("d", "t")}).collect()
    assert len(rows) == len(dates) * len(times) and sum(r.want is not None for r in rows) > 20
    assert all(r.a == r.want == r.b for r in rows)


def test_derived_reads_each_text_once(spark):
    """F7 to F12: the plan splits each date and time text once and strips each
    text column once, whatever uses the parts."""
    raw = spark.read.schema("day_text string, start_text string, end_text string, dur_text string, speed_text string, length_text string").parquet(_empty(spark))
    plan = derived(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2
    assert plan.count("trim(speed_text") == 1 and plan.count("trim(day_text") == 1


def _empty(spark):
    from tabstat.session import scratch_path

    path = scratch_path(spark, "empty")
    spark.createDataFrame([], "day_text string, start_text string, end_text string, dur_text string, speed_text string, length_text string").write.parquet(path)
    return path


def test_constant_text_columns(spark):
    df = spark.createDataFrame([("a", "a", None, "", None), ("a", "b", "a", "", None)], "one string, two string, some string, blank string, none string")
    assert constant_columns(df)[0] == ["one", "blank", "none"]
