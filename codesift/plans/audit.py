"""The audit of a corpus, from sources to reports."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesift.functions.stamps import run_id, run_timestamp
from codesift.operators import findings as long_form
from codesift.operators import metrics
from codesift.operators.dedup import first_per_path
from codesift.operators.scan import scan_sources
from codesift.reports.frames import nested_report
from codesift.reports.parts import TITLE, VERSION
from codesift.rules import RulePack
from codesift.session import removed, run_folder, written
from codesift.solidity import solidity_rules
from codesift.sources.detectors import detector_documents, external_severities


@dataclass(frozen=True)
class Audit:
    """``scanned`` has one row per source with its findings; the rest is derived.

    ``skipped`` holds the paths of rows without content. ``first_by`` orders
    the rows of one path, of which the first counts.
    """

    scanned: DataFrame
    pack: RulePack
    documents: DataFrame | None
    started: datetime
    skipped: DataFrame
    first_by: str | None = None
    folder: str | None = None

    @property
    def contracts(self) -> DataFrame:
        """One row per file with its findings."""
        if self.first_by is None:
            return self.scanned
        return first_per_path(self.scanned, self.first_by).drop(self.first_by)

    def materialized(self, folder: str | None = None) -> Audit:
        """Write the scanned rows once; every result then starts from that table.

        The rows hold no source text, so the table is small next to the corpus. The
        tables lie in a folder of their own until ``close``.
        """
        if self.folder:
            return self
        own = run_folder(self.scanned.sparkSession, "audit", folder)
        documents = None if self.documents is None else written(self.documents, "detector-documents", own)
        return replace(
            self, scanned=written(self.contracts, "contracts", own), documents=documents, first_by=None, folder=own)

    def close(self) -> None:
        """Remove the tables of ``materialized``; frames derived from them cannot be read any more."""
        if self.folder:
            removed(self.scanned.sparkSession, self.folder)

    def findings(self) -> DataFrame:
        """All findings, rule findings first and external ones behind them."""
        rows = long_form.findings_table(self.contracts, self.pack)
        if self.documents is None:
            return rows.select(*long_form.FINDING_COLUMNS)
        return long_form.with_external(rows, self.contracts, self.documents)

    def report(self) -> DataFrame:
        # Figures are made before the first row of a path is chosen, so no snippet is shuffled.
        keep = (self.first_by,) if self.first_by else ()
        figures = metrics.contract_metrics(self.scanned, keep=keep)
        if self.first_by:
            figures = first_per_path(figures, self.first_by).drop(self.first_by)
        if self.documents is not None:
            figures = metrics.merge_external(figures, external_severities(self.documents))
        return metrics.contract_report(figures)

    def summary(self) -> DataFrame:
        return metrics.summary(self.report())

    def nested(self) -> DataFrame:
        """Rule findings inside their file's row."""
        return nested_report(self.contracts, self.pack)

    def run(self, finished: datetime | None = None) -> DataFrame:
        """The run's id and time stamps, one row."""
        finished = finished or datetime.now(timezone.utc)
        millis = int((finished - self.started).total_seconds() * 1000)
        spark = self.scanned.sparkSession
        # Without a zone, so that a session in another zone shows the same UTC text.
        utc = self.started.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        stamp = F.lit(utc).cast("timestamp_ntz")
        return spark.range(1).select(
            run_id(stamp).alias("report_id"), F.lit(TITLE).alias("title"), F.lit(VERSION).alias("version"),
            run_timestamp(stamp).alias("timestamp"), F.lit(f"{millis / 1000:g}s").alias("duration"),
        )


def audit(
    sources: DataFrame,
    pack: RulePack | None = None,
    min_severity: str | None = None,
    external: DataFrame | None = None,
    first_by: str | None = None,
    started: datetime | None = None,
) -> Audit:
    """Plan an audit of ``path, content`` rows.

    ``external`` holds ``path, json`` detector results. ``first_by`` names a column
    that orders rows of the same path, of which the first is kept; it is applied to
    the scanned rows, so source texts are never shuffled.
    """
    pack = solidity_rules() if pack is None else pack
    keep = (first_by,) if first_by else ()
    scanned = scan_sources(sources, pack, min_severity, keep=keep)
    skipped = sources.where(F.col("content").isNull()).select("path")
    documents = None if external is None else detector_documents(external)
    return Audit(
        scanned, pack.at_least(min_severity), documents, started or datetime.now(timezone.utc), skipped, first_by)
