"""Per-file and corpus aggregates.

Per-file figures are computed inside the file's row. Only the corpus totals and
the merge with external findings shuffle, and those shuffles carry counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.functions.severity import (
    RANK, SEVERITIES, overall_risk, rank_weight, risk_score, severity_weight, share,
)

COUNTS = ("critical", "high", "medium", "low", "info")


def _rank_count(rank: int) -> Column:
    return F.size(F.filter("findings", lambda f: f["rank"] == rank)).cast("bigint")


def contract_metrics(contracts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts and weights of each file's findings; unknown severities count as INFO."""
    weights = F.transform("findings", lambda f: rank_weight(f["rank"]))
    counted = contracts.select(
        "path", "file_name", "lines_of_code", "solidity_version", *keep,
        F.size("findings").cast("bigint").alias("n_findings"),
        *[_rank_count(RANK[s]).alias(s.lower()) for s in SEVERITIES[:4]],
        F.coalesce(F.array_max(weights), F.lit(0.0)).alias("max_weight"),
        F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w).alias("sum_weight"),
    )
    known = F.col("critical") + F.col("high") + F.col("medium") + F.col("low")
    return counted.withColumn("info", F.col("n_findings") - known)


def external_metrics(external: DataFrame) -> DataFrame:
    """The same figures for external finding rows, by path."""
    severity, weight = F.upper("severity"), severity_weight(F.col("severity"))
    return external.groupBy("path").agg(
        F.count(F.lit(1)).alias("x_n_findings"),
        *[F.count_if(severity == s).alias(f"x_{s.lower()}") for s in SEVERITIES[:4]],
        F.count_if(~severity.isin(*SEVERITIES[:4])).alias("x_info"),
        F.max(weight).alias("x_max_weight"),
        F.sum(weight).alias("x_sum_weight"),
    )


def added_external(figures: DataFrame) -> DataFrame:
    """Rows of ``external_metrics`` of several sets of findings, by path as one."""
    kinds = {"x_max_weight": F.max}
    return figures.groupBy("path").agg(*[kinds.get(c, F.sum)(c).alias(c) for c in figures.columns if c != "path"])


def merge_external(metrics: DataFrame, external: DataFrame) -> DataFrame:
    """Add external findings to the figures of their files."""
    return merge_figures(metrics, external_metrics(external))


def merge_figures(metrics: DataFrame, external: DataFrame) -> DataFrame:
    """The same with the figures of the external findings."""
    def added(name: str) -> Column:
        return (F.col(name) + F.coalesce(F.col(f"x_{name}"), F.lit(0))).alias(name)

    return metrics.join(external, "path", "left").select(
        "path", "file_name", "lines_of_code", "solidity_version",
        *[added(name) for name in ("n_findings", *COUNTS)],
        F.greatest("max_weight", F.coalesce("x_max_weight", F.lit(0.0))).alias("max_weight"),
        (F.col("sum_weight") + F.coalesce("x_sum_weight", F.lit(0.0))).alias("sum_weight"),
    )


def contract_report(metrics: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per file, files without findings included."""
    score = risk_score(F.col("max_weight"), F.col("sum_weight"), F.col("n_findings"))
    return metrics.select(
        "path", "file_name", "n_findings", score.alias("risk_score"),
        "lines_of_code", "solidity_version", *COUNTS, *keep,
    )


def summary(report: DataFrame) -> DataFrame:
    """One row over the whole corpus."""
    totals = report.agg(
        F.count(F.lit(1)).alias("total_contracts"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(a)
          for c, a in (("n_findings", "total_findings"), *zip(COUNTS, COUNTS))],
    )
    return totals.withColumn("overall_risk", overall_risk(*[F.col(c) for c in COUNTS[:4]]))


def severity_share(summary_row: DataFrame) -> DataFrame:
    """Five rows: severity, count and whole percent of all findings."""
    rows = F.array(*[
        F.struct(F.lit(s).alias("severity"), F.col(s.lower()).alias("n")) for s in SEVERITIES
    ])
    return summary_row.select("total_findings", F.inline(rows)).select(
        "severity", "n", share(F.col("n"), F.col("total_findings")).alias("pct")
    )


def severity_rollup(report: DataFrame) -> DataFrame:
    """Counts per file and for the corpus in one result; ``level`` 1 is the total."""
    return report.rollup("path").agg(
        F.grouping_id().cast("int").alias("level"),
        *[F.sum(c).alias(c) for c in ("n_findings", *COUNTS)],
    )


def severity_gate(report: DataFrame) -> DataFrame:
    """Files with any finding of HIGH or CRITICAL severity."""
    return report.where(F.col("critical") + F.col("high") > 0).select("path", "critical", "high")


def top_risky(report: DataFrame, n: int) -> DataFrame:
    return report.orderBy(F.desc("risk_score"), F.desc("n_findings"), "path").limit(n)
