from tabstat.plans.prepare import derive
from tabstat.session import scratch_path
from tabstat.sources.csv import scan_csv
from tabstat.sources.fixtures import raw_obs
from tabstat.streaming.clean_stream import stream_prepare
from tests.conftest import SF001


def test_stream_equals_batch(spark):
    raw = raw_obs(spark, SF001)
    src = scratch_path(spark, "stream-in")
    (raw.repartition(2).write.option("header", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(src))
    out = scratch_path(spark, "stream-out")
    q = stream_prepare(spark, src, raw.columns, out)
    q.awaitTermination(120)
    streamed = spark.read.parquet(out)
    batch = derive(scan_csv(spark, src))
    cols = ["obs_id", "district", "duration_min", "peak", "hour_sin", "target_bin"]
    assert sorted(map(tuple, streamed.select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))
