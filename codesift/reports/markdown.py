"""Markdown: one text per file, and the opening block of the corpus.

Fixed values: the headings, labels, marks and sentences of the report, which stand as literals in the functions below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.reports.parts import TITLE, TOOL, VERSION, one_digit, text

FOOTER = (
    f"\n*Generated by {TOOL} — automated static analysis. "
    "Always combine automated tools with manual review before mainnet deployment.*\n"
)


def header(c) -> Column:
    opening = text(
        "### 📄 ", c["file_name"], "\n\n",
        "- **Lines of Code:** ", c["lines_of_code"], "\n",
        "- **Solidity Version:** `", c["solidity_version"], "`\n",
        "- **Risk Score:** ", one_digit(c["risk_score"]), " / 10\n",
        "- **Findings:** ", c["n_findings"], "\n\n",
    )
    nothing = F.when(c["n_findings"] == 0, "✅ No issues detected by the current rule set.\n\n").otherwise("")
    return text(opening, nothing)


def finding(f, position: Column) -> Column:
    def row(name: str, value: Column) -> Column:
        return F.when(value != "", text(f"| **{name}** | ", value, " |\n")).otherwise("")

    code = F.when(
        f["code_snippet"] != "", text("**Code**\n\n```solidity\n", f["code_snippet"], "\n```\n\n")
    ).otherwise("")
    links = F.when(
        F.size(f["references"]) > 0,
        text("**References**\n\n", F.array_join(F.transform(f["references"], lambda r: text("- ", r, "\n")), ""), "\n"),
    ).otherwise("")
    return text(
        "#### [", f["severity"], "] ", f["title"], "\n\n",
        "| | |\n|---|---|\n",
        "| **ID** | ", f["rule_id"], " |\n",
        row("SWC", f["swc"]), row("CWE", f["cwe"]),
        "| **Location** | `", f["file"], ":", f["line"], "` |\n\n",
        "**Description**\n\n", f["description"], "\n\n",
        code,
        "**Recommendation**\n\n", f["recommendation"], "\n\n",
        links,
        "---\n\n",
    )


def opening(summary: DataFrame, run: DataFrame) -> DataFrame:
    """Title, run facts and the table of counts; both inputs have one row."""
    def line(name: str, column: str) -> Column:
        return text(f"| {name} | ", F.col(column), " |\n")

    # Both sides are single rows by construction (a global aggregate and the run row).
    keyed = summary.withColumn("one", F.lit(1)).join(F.broadcast(run.withColumn("one", F.lit(1))), "one")
    return keyed.select(text(
        "# ", F.col("title"), "\n\n",
        "**Generated:** ", F.col("timestamp"), "  \n",
        "**Duration:** ", F.col("duration"), "  \n",
        f"**Tool:** {TOOL} v", F.col("version"), "\n\n",
        "---\n\n## Executive Summary\n\n",
        "| Metric | Count |\n|---|---|\n",
        line("Contracts Scanned", "total_contracts"),
        line("Total Findings", "total_findings"),
        line("🔴 Critical", "critical"),
        line("🟠 High", "high"),
        line("🟡 Medium", "medium"),
        line("🔵 Low", "low"),
        line("⚪ Info", "info"),
        "| **Overall Risk** | **", F.col("overall_risk"), "** |\n\n",
        "---\n\n## Findings by Contract\n\n",
    ).alias("text"))
