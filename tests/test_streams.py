import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from codesift import audit
from codesift.solidity import solidity_rules
from codesift.streaming import live
from test_external import detector, document

SOURCE = "path string, content string, seq long"
LINES = ["tx.origin;", "admin = x;", "selfdestruct(a);", "pragma solidity ^0.8.0;", "x = 1;"]


def rows(seed, n):
    random_ = random.Random(seed)
    keys = random_.sample(range(10 * n), n)
    return [(f"/p{random_.choice([0, 0, 0, *range(n // 3)])}.sol", "\n".join(random_.choices(LINES, k=3)), key) for key in keys]


def arriving(spark, folder, data, batches):
    """Each batch is one file."""
    for k in range(batches):
        spark.createDataFrame(data[k::batches], SOURCE).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(SOURCE).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def forget_last_batch(state):
    """As after a failure between writing a batch and committing it."""
    last = max(glob.glob(f"{state}/commits/[0-9]*"), key=lambda f: int(os.path.basename(f)))
    os.remove(last)
    crc = os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")
    if os.path.exists(crc):
        os.remove(crc)


@pytest.mark.parametrize("batches", [1, 4])
def test_first_row_of_a_path_for_any_split(spark, tmp_path, batches):
    data = rows(batches, 60)
    folder = str(tmp_path)
    live.stream_first_per_path(arriving(spark, folder, data, batches), solidity_rules(), f"{folder}/l", f"{folder}/s").awaitTermination()
    want = audit(spark.createDataFrame(data, SOURCE), first_by="seq").report()
    got = live.first_rows(spark, f"{folder}/l")
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    # More arrives: only paths whose first row changes are written again.
    late = [("/p0.sol", "tx.origin;\nadmin = x;", -1), ("/p1.sol", "selfdestruct(a);", 10**6)]
    spark.createDataFrame(late, SOURCE).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(SOURCE).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    live.stream_first_per_path(stream, solidity_rules(), f"{folder}/l", f"{folder}/s").awaitTermination()
    want = audit(spark.createDataFrame(data + late, SOURCE), first_by="seq").report().collect()
    assert sorted(map(tuple, live.first_rows(spark, f"{folder}/l").collect())) == sorted(map(tuple, want))


def test_totals_count_a_replayed_batch_once(spark, tmp_path):
    data = [(f"/s{i}.sol", content, seq) for i, (_, content, seq) in enumerate(rows(9, 50))]
    folder = str(tmp_path)
    ledger, state = f"{folder}/l", f"{folder}/s"
    live.stream_totals(arriving(spark, folder, data, 3), solidity_rules(), ledger, state).awaitTermination()
    want = audit(spark.createDataFrame(data, SOURCE)).summary().first()
    got = live.totals(spark, ledger)
    assert got.columns == list(want.asDict()) and tuple(got.first()) == tuple(want)
    before = len(glob.glob(f"{ledger}/batch=*"))
    forget_last_batch(state)
    stream = spark.readStream.schema(SOURCE).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    live.stream_totals(stream, solidity_rules(), ledger, state).awaitTermination()
    assert tuple(live.totals(spark, ledger).first()) == tuple(want) and len(glob.glob(f"{ledger}/batch=*")) == before == 3


def test_streams_without_rows(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], SOURCE).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(SOURCE).parquet(f"{folder}/in")
    live.stream_totals(stream, solidity_rules(), f"{folder}/l", f"{folder}/s").awaitTermination()
    assert live.totals(spark, f"{folder}/l").first().total_contracts == 0
    live.stream_first_per_path(stream, solidity_rules(), f"{folder}/f", f"{folder}/t").awaitTermination()
    assert live.first_rows(spark, f"{folder}/f").count() == 0


def test_rows_without_content_are_not_first(spark, tmp_path):
    data = [("/a.sol", None, 1), ("/a.sol", "tx.origin;", 2)]
    folder = str(tmp_path)
    live.stream_first_per_path(arriving(spark, folder, data, 2), solidity_rules(), f"{folder}/l", f"{folder}/s").awaitTermination()
    assert [(r.path, r.n_findings) for r in live.first_rows(spark, f"{folder}/l").where(F.col("high") > 0).collect()] == [("/a.sol", 1)]


def test_external_results_in_any_order(spark, tmp_path):
    folder = str(tmp_path)
    data = [(f"/s{i}.sol", content, seq) for i, (_, content, seq) in enumerate(rows(4, 30))]
    results = [(f"/s{i % 12 if i % 3 else 0}.sol", document(detector(impact=["High", "Low", "Odd"][i % 3]))) for i in range(40)]
    results += results[:5] + [("/not/there.sol", document(detector())), ("/s1.sol", "{broken"), ("/s2.sol", None)]
    want = audit(spark.createDataFrame(data, SOURCE), external=spark.createDataFrame(results, "path string, json string")).report().collect()
    for k in range(4):
        spark.createDataFrame(results[k::4], "path string, json string").coalesce(1).write.mode("append").parquet(f"{folder}/ext")

    def run_external():
        stream = spark.readStream.schema("path string, json string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/ext")
        live.stream_external(stream, f"{folder}/x", f"{folder}/xs").awaitTermination()

    run_external()
    assert live.live_report(spark, f"{folder}/f", f"{folder}/x").count() == 0
    live.stream_figures(arriving(spark, folder, data, 3), solidity_rules(), f"{folder}/f", f"{folder}/s").awaitTermination()
    assert sorted(map(tuple, live.live_report(spark, f"{folder}/f", f"{folder}/x").collect())) == sorted(map(tuple, want))
    forget_last_batch(f"{folder}/xs")
    run_external()
    assert sorted(map(tuple, live.live_report(spark, f"{folder}/f", f"{folder}/x").collect())) == sorted(map(tuple, want))
