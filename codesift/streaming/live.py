"""Audits of source tables that keep growing.

A result that later rows can change is kept as a ledger: a folder with one part for each micro-batch, named
by the number of the batch. A batch that runs again after a failure writes its own part anew, so it
counts once; what the ledger says is read from all its parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codesift.functions.severity import overall_risk
from codesift.operators.dedup import first_per_path
from codesift.operators.metrics import (
    COUNTS, added_external, contract_metrics, contract_report, external_metrics, merge_figures, summary,
)
from codesift.operators.scan import scan_sources
from codesift.rules import RulePack
from codesift.sources.detectors import detector_documents, external_severities

BATCH = "batch"
FIRST_ROW = (
    "path string, file_name string, n_findings long, risk_score double, lines_of_code int, solidity_version string, "
    "critical long, high long, medium long, low long, info long, seq long"
)
FIGURES = (
    "path string, file_name string, lines_of_code int, solidity_version string, n_findings long, critical long, high long, "
    "medium long, low long, info long, max_weight double, sum_weight double"
)
EXTERNAL = (
    "path string, x_n_findings long, x_critical long, x_high long, x_medium long, x_low long, x_info long, "
    "x_max_weight double, x_sum_weight double"
)
TOTALS = "total_contracts long, total_findings long, critical long, high long, medium long, low long, info long"


def stream_contracts(
    sources: DataFrame,
    pack: RulePack,
    output: str,
    checkpoint: str,
    min_severity: str | None = None,
) -> StreamingQuery:
    """Scan new rows of a streaming ``path, content`` frame and append the results.

    The scan keeps no state; each micro-batch is the batch plan over new rows. The
    query stops when it has read all that is there.
    """
    scanned = scan_sources(sources, pack, min_severity)
    # The folder is there even if the stream never has a row.
    sources.sparkSession.createDataFrame([], scanned.schema).write.mode("append").parquet(output)
    return (
        scanned.writeStream.format("parquet").outputMode("append")
        .option("path", output).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def _ledger(rows: DataFrame, part: Callable[[DataFrame], DataFrame], mode: str, ledger: str, checkpoint: str) -> StreamingQuery:
    """Write ``part`` of each micro-batch to the ledger, until all that is there is read."""
    def write(batch: DataFrame, number: int) -> None:
        part(batch).write.mode("overwrite").parquet(f"{ledger}/{BATCH}={number}")

    return (
        rows.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _parts(spark: SparkSession, ledger: str, schema: str) -> DataFrame:
    """All parts of a ledger; none if no batch has been written."""
    # The folder is there even if the stream never had a row.
    spark.createDataFrame([], schema).write.mode("append").parquet(ledger)
    return spark.read.schema(schema).parquet(ledger).select(*_names(schema))


def stream_first_per_path(
    sources: DataFrame, pack: RulePack, ledger: str, checkpoint: str, order: str = "seq", min_severity: str | None = None,
) -> StreamingQuery:
    """Scan a streaming ``path, content, order`` frame and keep the row with the smallest order of each path.

    The state holds the report row of each path, no text and no findings. A row that comes
    later with a smaller order replaces it, in whichever batch; only such changes are written.
    """
    scanned = scan_sources(sources.withColumn("seq", F.col(order).cast("long")), pack, min_severity, keep=("seq",))
    report = contract_report(contract_metrics(scanned, keep=("seq",)), keep=("seq",))
    return _ledger(first_per_path(report, "seq"), lambda rows: rows.select(*_names(FIRST_ROW)), "update", ledger, checkpoint)


def _names(schema: str) -> list[str]:
    return [column.split()[0] for column in schema.split(", ")]


def first_rows(spark: SparkSession, ledger: str) -> DataFrame:
    """The report rows of ``stream_first_per_path``: of what was written for a path, the row with the smallest order."""
    return first_per_path(_parts(spark, ledger, FIRST_ROW), "seq").drop("seq")


def stream_totals(sources: DataFrame, pack: RulePack, ledger: str, checkpoint: str, min_severity: str | None = None) -> StreamingQuery:
    """Scan a streaming ``path, content`` frame and keep its corpus totals; paths do not come twice.

    A micro-batch adds one row of totals to the ledger. Nothing is kept in the state.
    """
    report = contract_report(contract_metrics(scan_sources(sources, pack, min_severity)))
    return _ledger(report, lambda rows: summary(rows).select(*_names(TOTALS)), "append", ledger, checkpoint)


def totals(spark: SparkSession, ledger: str) -> DataFrame:
    """The row of ``summary`` over all batches that ``stream_totals`` has written."""
    parts = _parts(spark, ledger, TOTALS)
    added = parts.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in _names(TOTALS)])
    return added.withColumn("overall_risk", overall_risk(*[F.col(c) for c in COUNTS[:4]]))


def stream_figures(sources: DataFrame, pack: RulePack, ledger: str, checkpoint: str, min_severity: str | None = None) -> StreamingQuery:
    """Scan a streaming ``path, content`` frame and keep the figures of each file; paths do not come twice."""
    figures = contract_metrics(scan_sources(sources, pack, min_severity))
    return _ledger(figures, lambda rows: rows.select(*_names(FIGURES)), "append", ledger, checkpoint)


def stream_external(results: DataFrame, ledger: str, checkpoint: str) -> StreamingQuery:
    """Keep the figures of streaming detector results (``path, json``).

    A micro-batch adds one row for each path. Results may come before their file, after it, or for a path of many batches:
    nothing waits for anything, so no row is late.
    """
    def figures(batch: DataFrame) -> DataFrame:
        return external_metrics(external_severities(detector_documents(batch))).select(*_names(EXTERNAL))

    return _ledger(results, figures, "append", ledger, checkpoint)


def live_report(spark: SparkSession, figures: str, external: str) -> DataFrame:
    """The report over all that the two ledgers hold by now, files without results included."""
    added = added_external(_parts(spark, external, EXTERNAL))
    return contract_report(merge_figures(_parts(spark, figures, FIGURES), added))
