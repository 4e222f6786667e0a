"""Results of external detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.functions.severity import impact_severity
from codesift.functions.text import let
from codesift.sources.files import plain_path

RESULT_SCHEMA = (
    "success boolean, results struct<detectors: array<struct<check: string, impact: string, "
    "description: string, elements: array<struct<source_mapping: struct<lines: array<int>>>>>>>, "
    "unreadable string"
)
# Prefixes and links of external findings.
ID_PREFIX = "SL-"
TITLE_PREFIX = "[Slither] "
SWC_PREFIX = "slither:"
HELP_PREFIX = "See https://github.com/crytic/slither/wiki/Detector-Documentation#"
REFERENCE_URL = "https://github.com/crytic/slither"
# Hexadecimal digits of a document's key that part the documents of one path.
BUCKET_DIGITS = 4


def read_detector_files(spark: SparkSession, directory: str) -> DataFrame:
    """``path, json`` from files named like the source file with ``.json`` added."""
    files = spark.read.text(directory, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True)
    path = plain_path(F.col("_metadata.file_path"))
    return files.select(F.regexp_replace(path, r"\.json\z", "").alias("path"), F.col("value").alias("json"))


def _detector(detector: Column) -> Column:
    """What a finding depends on; its constant texts follow in ``finding_columns``."""
    first = F.get(detector["elements"], F.lit(0))["source_mapping"]["lines"]
    return F.struct(
        F.coalesce(detector["check"], F.lit("")).alias("check"),
        F.coalesce(detector["description"], F.lit("")).alias("description"),
        impact_severity(detector["impact"]).alias("severity"),
        F.coalesce(F.get(first, F.lit(0)), F.lit(0)).alias("line"),
    )


def finding_columns() -> list[Column]:
    """The columns of a finding from ``path`` and the fields of a detector result."""
    check = F.col("check")
    return [
        F.lit("").alias("number"),
        F.concat(F.lit(ID_PREFIX), check).alias("rule_id"),
        F.concat(F.lit(TITLE_PREFIX), check).alias("title"),
        F.col("description"),
        F.col("severity"),
        F.concat(F.lit(SWC_PREFIX), check).alias("swc"),
        F.lit("").alias("cwe"),
        F.col("path").alias("file"),
        F.col("line"),
        F.lit("").alias("code_snippet"),
        F.concat(F.lit(HELP_PREFIX), check).alias("recommendation"),
        F.array(F.lit(REFERENCE_URL)).alias("references"),
    ]


def _one_value(text: Column) -> Column:
    """Is the text one JSON value with nothing behind it? The parser alone stops after the first."""
    return F.json_array_length(F.concat(F.lit("["), text, F.lit(",0]"))) == 2


def detector_documents(results: DataFrame) -> DataFrame:
    """``path, json`` to ``path, doc_key, bucket, detectors``.

    Malformed and unsuccessful results are dropped, and so are texts with anything
    behind the JSON value. A document delivered twice counts twice. The bucket
    spreads the documents of one path and keeps the order of the keys.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "unreadable"}

    def found(result: Column) -> Column:
        usable = result["success"] & result["unreadable"].isNull() & _one_value(F.col("json"))
        return F.when(usable, F.transform(result["results"]["detectors"], _detector))

    parsed = let(F.from_json("json", RESULT_SCHEMA, options), found)
    key = F.sha2("json", 256)
    # As in the scan, the generator keeps the parse from being copied into filters.
    documents = results.select("path", key.alias("doc_key"), F.explode_outer(F.array(parsed)).alias("detectors"))
    return documents.where(F.size("detectors") > 0).select(
        "path", "doc_key", F.substring("doc_key", 1, BUCKET_DIGITS).alias("bucket"), "detectors"
    )


def external_findings(documents: DataFrame) -> DataFrame:
    """One row per detector result, with its place in the document."""
    return documents.select("path", "doc_key", F.posexplode("detectors")).select(
        "path", "doc_key", F.col("pos").alias("detector_index"), "col.*"
    ).select("path", "doc_key", "detector_index", *finding_columns())


def external_severities(documents: DataFrame) -> DataFrame:
    """``path, severity`` of each detector result: all that figures need."""
    return documents.select("path", F.explode("detectors.severity").alias("severity"))
