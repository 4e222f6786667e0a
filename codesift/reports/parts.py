"""Small helpers shared by the report formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Report title, tool name and version.
TITLE = "Smart Contract Security Audit Report"
TOOL = "codesift"
VERSION = "1.0.0"


def text(*parts: str | Column) -> Column:
    """Concatenate plain strings and columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def one_digit(score: Column) -> Column:
    return F.format_string("%.1f", score)
