import random

import pytest
from pyspark.sql import functions as F

from codesift.operators import run_hash
from codesift.operators.run_hash import run_fingerprint, summed_up


def plain(data, h=2166136261):
    for byte in data:
        h = ((h ^ byte) * 16777619) & 0xFFFFFFFF
    return h


def test_summary_acts_like_the_bytes():
    random_ = random.Random(1)
    for n in (0, 1, 63, 64, 65, 200, 64 * 5 + 3, 5000):
        data = random_.randbytes(n)
        factors, offsets = summed_up(data)
        for h in (0, 255, 2166136261, random_.getrandbits(32)):
            assert (h * int(factors[0]) + int(offsets[0][h & 255])) % 2**32 == plain(data, h)


@pytest.mark.parametrize(("n", "partitions", "fan"), [(0, 1, 4096), (1, 3, 4096), (500, 1, 4096), (500, 40, 4096), (700, 37, 7)])
def test_equals_the_sequential_hash(spark, monkeypatch, n, partitions, fan):
    monkeypatch.setattr(run_hash, "FAN", fan)
    monkeypatch.setattr(run_hash, "BLOCK", 300)
    random_ = random.Random(n)
    paths = list({"".join(random_.choice("ab/é🙂.") for _ in range(random_.randint(0, 40))) for _ in range(n)})
    stamp = spark.createDataFrame([("2024-01-02 03:04:05 UTC",)], "t string")
    sources = spark.createDataFrame([(p,) for p in paths] + [(None,)], "path string")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = run_fingerprint(sources, stamp).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = plain("2024-01-02 03:04:05 UTC".encode() + b"".join(sorted(p.encode() for p in paths)))
    assert [r.fingerprint for r in got] == [f"AUD-{want:08X}"]


def test_one_narrow_row_for_each_task(spark):
    sources = spark.range(10_000).select(F.concat(F.lit("/src/"), "id").alias("path"))
    parts = sources.select(F.spark_partition_id().alias("part"), F.col("path").cast("binary")).mapInArrow(run_hash._by_task, run_hash.SUMMARY)
    assert parts.count() == sources.rdd.getNumPartitions()
