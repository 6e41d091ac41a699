import __spark_entry__ as entry

from tabstat.plans.q_rows import _obs
from tests.conftest import SF01


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["district", "n_segments", "speed_mean", "speed_std", "length_mean", "duration_min_mean"]


def test_registry_keys():
    qs, orc = entry.queries(), entry.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) >= 100


def test_fixture_expectations(spark):
    df, rep = _obs(spark, SF01)
    assert df.count() == 10_000
    assert df.select("district").distinct().count() == 25
    assert df.where("street is null").count() == 112
    assert df.where("speed is null").count() == 100
    assert df.where("duration_min is null").count() == 0
    assert rep.constant_columns == ["z"]
