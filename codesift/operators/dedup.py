"""The same input given twice counts once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per_path(rows: DataFrame, order: str) -> DataFrame:
    """Keep the row with the smallest ``order`` of each path.

    Meant for scanned rows, where the text is gone already: copies are reduced
    before the shuffle, so a path with many copies is no hot spot. Rows of one path
    must differ in ``order``.
    """
    rest = [c for c in rows.columns if c != "path"]
    first = rows.groupBy("path").agg(F.min_by(F.struct(*rest), F.col(order)).alias("row"))
    return first.select("path", *[F.col("row")[c].alias(c) for c in rest])
