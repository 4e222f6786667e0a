"""One fingerprint over all files of a run.

FNV-1a reads its bytes one after the other: ``h = (h ^ byte) * prime``. Of the state only the low byte
decides what the exclusive or adds, so any stretch of bytes acts on a state as ``h * prime ** n + offsets[h & 255]``
modulo 2^32, and a stretch is summed up by one factor and 256 offsets. Two summaries in a row make
one, whatever was before them. Tasks sum up their part of the sorted paths, and the summaries, a row of
some kilobytes for each task, are folded in order, ``FAN`` at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.functions.stamps import FNV_PRIME, MASK_32, fnv1a_32
from codesift.functions.text import let

FAN = 4096
STRIDE = 64
BLOCK = STRIDE * 1024
SUMMARY = "part int, factor long, offsets array<long>"
LOW = np.arange(256, dtype=np.uint32)


def _joined(factors: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches that follow each other as one: factors by row, offsets by row and low byte."""
    while len(factors) > 1:
        if len(factors) % 2:
            factors = np.append(factors, np.uint32(1))
            offsets = np.concatenate([offsets, np.zeros((1, 256), np.uint32)])
        first, second = factors[::2], factors[1::2]
        low = (LOW * first[:, None] + offsets[::2]) & np.uint32(255)
        offsets = offsets[::2] * second[:, None] + np.take_along_axis(offsets[1::2], low.astype(np.int64), axis=1)
        factors = first * second
    return factors, offsets


def summed_up(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Factor and offsets of a stretch: strides run side by side, from each low byte."""
    rest = len(data) % STRIDE
    strides = np.frombuffer(data, np.uint8, len(data) - rest).reshape(-1, STRIDE)
    parts = []
    for rows in (strides, np.frombuffer(data, np.uint8, rest, len(data) - rest).reshape(1, rest)):
        state = np.tile(LOW, (len(rows), 1))
        for k in range(rows.shape[1]):
            state = (state ^ rows[:, k, None]) * np.uint32(FNV_PRIME)
        factor = np.uint32(pow(FNV_PRIME, rows.shape[1], 1 << 32))
        parts.append((np.full(len(rows), factor), state - LOW * factor))
    return _joined(*(np.concatenate(c) for c in zip(*parts, strict=True)))


def _by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, held = None, bytearray()
    factors, offsets = np.ones(1, np.uint32), np.zeros((1, 256), np.uint32)
    for batch in batches:
        if batch.num_rows:
            part = batch.column(0)[0].as_py()
        for path in batch.column(1).to_pylist():
            held += path
            if len(held) >= BLOCK:
                more = summed_up(bytes(held))
                factors, offsets = _joined(np.concatenate([factors, more[0]]), np.concatenate([offsets, more[1]]))
                held.clear()
    if part is not None:
        more = summed_up(bytes(held))
        factors, offsets = _joined(np.concatenate([factors, more[0]]), np.concatenate([offsets, more[1]]))
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([part], pa.int32()), "factor": [int(factors[0])], "offsets": [offsets[0].astype(np.int64)]})


def _times(a: Column, b: Column) -> Column:
    """The product modulo 2^32, in halves, as 64 bits do not hold it."""
    high = F.shiftright(a, 16) * b
    return (F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16) + a.bitwiseAND(F.lit(0xFFFF)) * b).bitwiseAND(F.lit(MASK_32))


def _folded(summaries: DataFrame) -> DataFrame:
    """``FAN`` neighbouring summaries to one."""
    row = F.struct("part", "factor", "offsets")
    ordered = F.sort_array(F.collect_list(row))
    none = F.struct(F.lit(1).cast("long").alias("factor"), F.array_repeat(F.lit(0).cast("long"), 256).alias("offsets"))

    def then(done: Column, one: Column) -> Column:
        def offset(value: Column, low: Column) -> Column:
            after = (low * done["factor"] + value).bitwiseAND(F.lit(255)).cast("int")
            return (_times(value, one["factor"]) + F.get(one["offsets"], after)).bitwiseAND(F.lit(MASK_32))

        return F.struct(
            _times(done["factor"], one["factor"]).alias("factor"),
            F.transform(done["offsets"], offset).alias("offsets"))

    grouped = summaries.groupBy(F.floor(F.col("part") / FAN).cast("int").alias("part")).agg(F.aggregate(ordered, none, then).alias("sum"))
    return grouped.select("part", "sum.*")


def run_fingerprint(sources: DataFrame, timestamp: DataFrame) -> DataFrame:
    """One row ``fingerprint`` over the run's ``timestamp`` (a frame of one text) and every path in order.

    Paths are unique; null ones are left out.
    """
    paths = sources.select("path").where("path IS NOT NULL").repartitionByRange("path").sortWithinPartitions("path")
    parts = paths.select(F.spark_partition_id().alias("part"), F.col("path").cast("binary")).mapInArrow(_by_task, SUMMARY)
    # Two levels take FAN * FAN tasks, 16 million; the last agg only gives a run without files its row.
    whole = _folded(_folded(parts)).agg(F.first("factor").alias("factor"), F.first("offsets").alias("offsets"))
    started = timestamp.select(fnv1a_32(F.col(timestamp.columns[0])).alias("start"))
    known = whole.withColumn("start", started.scalar())
    after = let(F.col("start"), lambda h: F.when(F.col("factor").isNull(), h).otherwise(
        (_times(h, F.col("factor")) + F.get("offsets", h.bitwiseAND(F.lit(255)).cast("int"))).bitwiseAND(F.lit(MASK_32))))
    return known.select(F.concat(F.lit("AUD-"), F.lpad(F.hex(after), 8, "0")).alias("fingerprint"))
