"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.session import shared_folder

# White space that parts words: blank and U+0009 to U+000D.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text as an array, none for a null or blank one."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP, -1))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(doc_id: Column, parts: int) -> Column:
    """``crc32(doc_id as text) mod parts``: the fold of a document. A null id has none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Write ``rows`` once to the shared folder and go on from the files.

    Zstandard keeps its buffers on the heap; the default codec takes direct memory for
    every column of every file, which adds up over many small files.
    """
    spark = rows.sparkSession
    target = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(target)
    return spark.read.schema(rows.schema).parquet(target)


def portions(batches: Iterator[pa.RecordBatch], text: str, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` some at a time, each time about ``size`` bytes of the binary column
    ``text`` or one longer row, so that a task's memory does not follow the size of a batch."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy()
        ends = np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(at, upto - at)
            at = upto
