"""Scans of a corpus that changes little from one time to the next.

What a scan finds in a file follows from its text and the rules. The store is a table of results by the
digest of the text, in a folder for each version of the rules. A snapshot is matched with it by digests;
texts that are not there are scanned, each different one once, and added.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.functions.text import base_name
from codesift.operators.scan import FINDING, scan_sources
from codesift.rules import RulePack
from codesift.session import written

RESULT = f"text_key string, lines_of_code int, solidity_version string, findings array<{FINDING}>"


def pack_key(pack: RulePack) -> str:
    """A digest of all that a scan takes from the rules: their order, rank and pattern."""
    return hashlib.sha256(repr([(r.order, r.rule.rank, r.rule.regex) for r in pack.rules]).encode()).hexdigest()


def stored_results(spark: SparkSession, pack: RulePack, store: str) -> DataFrame:
    """``text_key`` and what the rules found in the text."""
    folder = f"{store}/{pack_key(pack)}"
    # The folder is there even if nothing has been scanned.
    spark.createDataFrame([], RESULT).write.mode("append").parquet(folder)
    # Two runs at a time may have added one text each.
    return spark.read.schema(RESULT).parquet(folder).dropDuplicates(["text_key"])


def rescan(sources: DataFrame, pack: RulePack, store: str, min_severity: str | None = None) -> DataFrame:
    """The rows of ``scan_sources`` for ``path, content``, from the store where it has the text.

    Texts are read to take their digest, and once more where they are new; only paths and digests are
    shuffled, unless the new texts are too many to broadcast their paths.
    """
    spark, pack = sources.sparkSession, pack.at_least(min_severity)
    keyed = sources.select("path", F.sha2("content", 256).alias("text_key")).where("text_key IS NOT NULL")
    keyed = written(keyed, "text-keys")
    known = stored_results(spark, pack, store)
    # One path of each new text.
    new = written(keyed.join(known, "text_key", "left_anti").groupBy("text_key").agg(F.min("path").alias("path")), "new-texts")
    texts = sources.withColumn("digest", F.sha2("content", 256)).join(new, "path").where("digest = text_key").dropDuplicates(["text_key"])
    found = scan_sources(texts, pack, keep=("text_key",))
    found.select(*[c.split()[0] for c in RESULT.split(", ")[:3]], "findings").write.mode("append").parquet(f"{store}/{pack_key(pack)}")
    return keyed.join(stored_results(spark, pack, store), "text_key").select(
        "path", base_name(F.col("path")).alias("file_name"), "lines_of_code", "solidity_version", "findings")
