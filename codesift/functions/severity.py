"""Severity, score and display columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Order, weight and display of the five severities, highest first.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
RANK = {"CRITICAL": 5, "HIGH": 4, "MEDIUM": 3, "LOW": 2, "INFO": 1}
WEIGHT = {"CRITICAL": 10.0, "HIGH": 7.0, "MEDIUM": 4.0, "LOW": 1.5, "INFO": 0.5}
CSS_CLASS = {
    "CRITICAL": "sev-critical", "HIGH": "sev-high", "MEDIUM": "sev-medium",
    "LOW": "sev-low", "INFO": "sev-info",
}
ICON = {"CRITICAL": "⬟", "HIGH": "▲", "MEDIUM": "◆", "LOW": "●", "INFO": "○"}
LABEL = {"CRITICAL": "Critical", "HIGH": "High", "MEDIUM": "Medium", "LOW": "Low", "INFO": "Info"}
# External detector impact to severity; anything else is MEDIUM.
IMPACT = {"High": "HIGH", "Medium": "MEDIUM", "Low": "LOW", "Informational": "INFO"}
OVERALL_CLASS = {"CRITICAL": "ov-critical", "HIGH": "ov-high", "MEDIUM": "ov-medium"}
MAX_SHARE, MEAN_SHARE, MAX_SCORE = 0.6, 0.4, 10.0


def pick(key: Column, table: dict, default) -> Column:
    """CASE chain over a small constant table."""
    (first, result), *rest = table.items()
    column = F.when(key == first, F.lit(result))
    for value, result in rest:
        column = column.when(key == value, F.lit(result))
    return column.otherwise(F.lit(default))


def severity_rank(severity: Column) -> Column:
    return pick(F.upper(severity), RANK, 0)


def rank_of(severity: str | None) -> int:
    """Rank of a threshold given by name; unknown or empty keeps everything."""
    return RANK.get((severity or "").upper(), 1)


def severity_weight(severity: Column) -> Column:
    return pick(F.upper(severity), WEIGHT, 0.0)


def rank_weight(rank: Column) -> Column:
    return pick(rank, {RANK[s]: WEIGHT[s] for s in SEVERITIES}, 0.0)


def severity_class(severity: Column) -> Column:
    return pick(F.upper(severity), CSS_CLASS, CSS_CLASS["INFO"])


def severity_icon(severity: Column) -> Column:
    return pick(F.upper(severity), ICON, ICON["INFO"])


def severity_label(severity: Column) -> Column:
    return pick(F.upper(severity), LABEL, LABEL["INFO"])


def severity_text(severity: Column) -> Column:
    """Name padded to eight characters; unknown severities read INFO."""
    return F.rpad(pick(F.upper(severity), {s: s for s in SEVERITIES}, "INFO"), 8, " ")


def impact_severity(impact: Column) -> Column:
    return pick(impact, IMPACT, "MEDIUM")


def one_decimal(value: Column) -> Column:
    """Half up, on non-negative doubles."""
    return F.floor(value * 10 + 0.5).cast("double") / 10


def risk_score(max_weight: Column, sum_weight: Column, n: Column) -> Column:
    """Worst finding blended with the mean, 0 to 10; 0 without findings."""
    blend = max_weight * MAX_SHARE + sum_weight / n * MEAN_SHARE
    return F.when(n == 0, F.lit(0.0)).otherwise(one_decimal(F.least(blend, F.lit(MAX_SCORE))))


def risk_class(score: Column) -> Column:
    return (
        F.when(score >= 7, "risk-critical").when(score >= 4, "risk-high")
        .when(score >= 2, "risk-medium").otherwise("risk-low")
    )


def risk_bar(score: Column) -> Column:
    """Width in percent, truncated."""
    return (score * 10).cast("int")


def overall_class(overall: Column) -> Column:
    return pick(overall, OVERALL_CLASS, "ov-low")


def overall_risk(critical: Column, high: Column, medium: Column, low: Column) -> Column:
    """Worst severity present."""
    return (
        F.when(critical > 0, "CRITICAL").when(high > 0, "HIGH")
        .when(medium > 0, "MEDIUM").when(low > 0, "LOW").otherwise("INFO")
    )


def share(n: Column, total: Column) -> Column:
    """Whole percent, truncated; 0 of nothing is 0."""
    return F.when(total == 0, F.lit(0)).otherwise(
        F.call_function("div", n * 100, F.nullif(total, F.lit(0)))
    ).cast("bigint")


def finding_number(position: Column) -> Column:
    return F.format_string("F-%02d", position)


def has_swc_link(swc: Column) -> Column:
    return (swc != "") & (swc != "custom") & ~swc.startswith("slither:")


def swc_link(swc: Column) -> Column:
    return F.when(has_swc_link(swc), F.concat(F.lit("https://swcregistry.io/docs/"), swc))
