import pytest

from tabstat.session import scratch_path
from tabstat.sources import csv as csvsrc
from tabstat.sources import sinks


def test_scan_csv_missing_file_raises(spark):
    with pytest.raises(FileNotFoundError):
        csvsrc.scan_csv(spark, scratch_path(spark, "does-not-exist") + "/x.csv")


def test_scan_csv_tokens_and_leading_blanks(spark):
    path = scratch_path(spark, "tokens")
    df = spark.createDataFrame([(" a", "NA"), ("b", "nan"), ("c", "7")], "t string, v string")
    df.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    rows = sorted(map(tuple, csvsrc.scan_csv(spark, path).collect()), key=str)
    assert rows == [("a", None), ("b", None), ("c", "7")]


def test_scan_result_table_absent_columns_head_round(spark):
    assert csvsrc.scan_result_table(spark, scratch_path(spark, "absent")).count() == 0
    path = scratch_path(spark, "result")
    sinks.sink_table(spark.createDataFrame([("b", 1.26), ("a", 2.34), ("c", 3.0)], "k string, v double"), path, fmt="csv")
    out = csvsrc.scan_result_table(spark, path, columns=["k", "v", "nope"], head=2, round_map={"v": 1}, order_by=["k"])
    assert [tuple(r) for r in out.collect()] == [("a", 2.3), ("b", 1.3)]
