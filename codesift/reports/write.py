"""Report sinks. A report is a directory of datasets, written by the executors."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import functions as F

from codesift.reports import frames, html, markdown
from codesift.session import must_be_new, published, removed

# Accepted format names; any other name means html.
FORMAT_NAMES = {"json": "json", "md": "md", "markdown": "md"}


def normalize_format(name: str | None) -> str:
    return FORMAT_NAMES.get((name or "").lower(), "html")


def write_report(audit, folder: str, fmt: str = "html") -> str:
    """Write one audit below ``folder`` and return the format used.

    The corpus is scanned once: the scanned rows are written to the shared folder,
    all datasets start from there, and the rows are removed at the end, unless the audit
    was materialized by its owner.

    The report appears as a whole: its datasets are written to a folder beside it, which gets the name at the end. A run that
    fails leaves nothing, and one that is killed leaves only a folder whose name starts with ``_writing``. ``folder`` must be new or
    empty. (Where a file system copies to rename, as object stores do, readers wait for the return of this call.)
    """
    fmt = normalize_format(fmt)
    spark, folder = audit.scanned.sparkSession, folder.rstrip("/")
    must_be_new(spark, folder)
    made = posixpath.join(posixpath.dirname(folder), f"_writing-{uuid.uuid4().hex}")
    stored = audit.materialized()
    try:
        REPORTERS[fmt](stored, made)
        published(spark, made, folder)
    except BaseException:
        removed(spark, made)
        raise
    finally:
        if stored is not audit:
            stored.close()
    return fmt


def _json(audit, folder: str) -> None:
    def write(rows, name: str) -> None:
        rows.write.json(f"{folder}/{name}", ignoreNullFields=False)

    write(frames.json_rows(audit.run(), frames.JSON_RUN), "run")
    write(frames.json_rows(audit.summary(), frames.JSON_SUMMARY), "summary")
    if audit.documents is None:
        write(frames.json_contracts(audit.nested()), "contracts")
    else:
        names = {k: v for k, v in frames.JSON_CONTRACT.items() if k != "Findings"}
        write(frames.json_rows(audit.report(), names), "contracts")
        write(frames.json_findings(audit.findings()), "findings")


def _merged_blocks(audit, fmt):
    return frames.ordered(frames.block_rows(audit.report(), audit.findings(), fmt)).select("text")


def _markdown(audit, folder: str) -> None:
    markdown.opening(audit.summary(), audit.run()).write.text(f"{folder}/summary")
    if audit.documents is None:
        nested = frames.contract_markdown(audit.nested())
        blocks = nested.repartitionByRange("path").sortWithinPartitions("path").select("text")
    else:
        blocks = _merged_blocks(audit, markdown)
    blocks.write.text(f"{folder}/contracts")
    audit.run().select(F.lit(markdown.FOOTER).alias("text")).write.text(f"{folder}/footer")


def _html(audit, folder: str) -> None:
    frames.severity_cards(audit.summary()).write.text(f"{folder}/summary")
    c = {name: F.col(name) for name in frames.CONTRACT}
    audit.report().select(html.scope_row(c).alias("text")).write.text(f"{folder}/scope")
    if audit.documents is None:
        fragments = frames.contract_html(audit.contracts, audit.pack)
        fragments = fragments.repartitionByRange("path").sortWithinPartitions("path")
        blocks = fragments.select(F.col("findings_html").alias("text"))
    else:
        blocks = _merged_blocks(audit, html)
    blocks.write.text(f"{folder}/contracts")


# A format is a function of the audit and the folder; add an entry to add one.
REPORTERS = {"json": _json, "md": _markdown, "html": _html}
