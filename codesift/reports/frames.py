"""Report datasets as DataFrames."""

from __future__ import annotations

from types import ModuleType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.functions.severity import overall_class, severity_text, share
from codesift.operators.findings import RULE_TEXTS, nested_findings
from codesift.operators.metrics import COUNTS, contract_metrics, contract_report
from codesift.reports import html, markdown
from codesift.reports.parts import one_digit, text
from codesift.rules import RulePack

CONTRACT = ("file_name", "lines_of_code", "solidity_version", "risk_score", "n_findings")
# Field names of the JSON report.
JSON_FINDING = {
    "Number": "number", "ID": "rule_id", "Title": "title", "Description": "description",
    "Severity": "severity", "SWC": "swc", "CWE": "cwe", "File": "file", "Line": "line",
    "CodeSnippet": "code_snippet", "Recommendation": "recommendation", "References": "references",
}
JSON_CONTRACT = {
    "FileName": "file_name", "FilePath": "path", "Findings": "findings", "RiskScore": "risk_score",
    "LinesOfCode": "lines_of_code", "SolidityVersion": "solidity_version",
}
JSON_SUMMARY = {
    "TotalContracts": "total_contracts", "TotalFindings": "total_findings", "Critical": "critical",
    "High": "high", "Medium": "medium", "Low": "low", "Info": "info", "OverallRisk": "overall_risk",
}
JSON_RUN = {
    "ReportID": "report_id", "Title": "title", "Version": "version",
    "Timestamp": "timestamp", "Duration": "duration",
}


def nested_report(contracts: DataFrame, pack: RulePack) -> DataFrame:
    """Per-file figures with the full findings inside. Nothing is joined or shuffled."""
    figures = contract_report(contract_metrics(contracts, keep=("findings",)), keep=("findings",))
    return nested_findings(figures, pack)


def _renamed(names: dict[str, str], get) -> list[Column]:
    return [get(column).alias(key) for key, column in names.items()]


def json_contracts(nested: DataFrame) -> DataFrame:
    """Rows named as in the JSON report; a file without findings has null there."""
    findings = F.when(
        F.size("findings") > 0,
        F.transform("findings", lambda f: F.struct(*_renamed(JSON_FINDING, lambda c: f[c]))),
    )
    return nested.withColumn("findings", findings).select(*_renamed(JSON_CONTRACT, F.col))


def json_findings(findings: DataFrame) -> DataFrame:
    """The long form, for reports that include external findings."""
    return findings.select(F.col("path").alias("FilePath"), F.col("position").alias("Position"), *_renamed(JSON_FINDING, F.col))


def json_rows(frame: DataFrame, names: dict[str, str]) -> DataFrame:
    return frame.select(*_renamed(names, F.col))


def contract_markdown(nested: DataFrame) -> DataFrame:
    """``path, text``: each file's header and findings in one string."""
    c = {name: F.col(name) for name in CONTRACT}
    blocks = F.transform("findings", lambda f, i: markdown.finding(f, i + 1))
    return nested.select("path", text(markdown.header(c), F.array_join(blocks, "")).alias("text"))


def contract_html(contracts: DataFrame, pack: RulePack) -> DataFrame:
    """``path``, scope row and findings block of each file.

    The rule texts are escaped once for each rule, not for each finding.
    """
    c = {name: F.col(name) for name in CONTRACT}
    nested = nested_report(contracts, pack.with_texts(html.escape_text, html.reference_text))
    same = lambda t: t
    blocks = F.transform("findings", lambda f, i: html.finding(f, i + 1, rule_text=same, link=same))
    return nested.select(
        "path", html.scope_row(c).alias("scope_html"),
        text(html.header(c), F.array_join(blocks, "")).alias("findings_html"),
    )


def block_rows(report: DataFrame, findings: DataFrame, fmt: ModuleType) -> DataFrame:
    """``path, position, text``: the same blocks as rows, for reports with external
    findings. A file with very many of them is never gathered."""
    c = {name: F.col(name) for name in CONTRACT}
    f = {name: F.col(name) for name in (*RULE_TEXTS, "file", "line", "code_snippet")}
    heads = report.select("path", F.lit(0).alias("position"), fmt.header(c).alias("text"))
    return heads.unionByName(findings.select("path", "position", fmt.finding(f, F.col("position")).alias("text")))


def ordered(blocks: DataFrame) -> DataFrame:
    """Blocks in reading order across the part files; one file may span parts."""
    return blocks.repartitionByRange("path", "position").sortWithinPartitions("path", "position")


def listing_head() -> Column:
    """One line per file: its name alone, or with the count and the score."""
    n = F.col("n_findings")
    return F.when(n == 0, text("✓ ", F.col("file_name"))).otherwise(
        text("⚠ ", F.col("file_name"), "  [", n, " finding(s) · Risk ", one_digit(F.col("risk_score")), "/10]")
    )


def contract_listing(nested: DataFrame) -> DataFrame:
    """Per-file listing: heading and one line for each finding, in report order."""
    def line(f: Column) -> Column:
        return text("[", severity_text(f["severity"]), "] ", f["title"], "  (line ", f["line"], ")")

    return nested.select(
        "path", "n_findings", one_digit(F.col("risk_score")).alias("risk_text"),
        listing_head().alias("head_text"),
        F.array_join(F.transform("findings", line), "\n").alias("line_text"),
    )


def listing_rows(report: DataFrame, findings: DataFrame) -> DataFrame:
    """``path, position, text``: the listing as rows, for reports with external findings."""
    heads = report.select("path", F.lit(0).alias("position"), listing_head().alias("text"))
    line = text("[", severity_text(F.col("severity")), "] ", F.col("title"), "  (line ", F.col("line"), ")")
    return heads.unionByName(findings.select("path", "position", line.alias("text")))


def severity_cards(summary: DataFrame) -> DataFrame:
    s = {name: F.col(name) for name in (*COUNTS, "total_findings", "overall_risk")}
    shares = {name: share(s[name], s["total_findings"]) for name in COUNTS}
    overall = text('<div class="', overall_class(s["overall_risk"]), '">', s["overall_risk"], "</div>")
    return summary.select(text(overall, html.severity_cards(s, shares)).alias("text"))
