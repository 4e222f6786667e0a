"""Audits of large corpora of source text on Spark."""

from codesift.plans.audit import Audit, audit
from codesift.reports.write import write_report
from codesift.rules import Rule, RulePack
from codesift.solidity import solidity_rules
from codesift.sources.files import read_sources, table_sources

__all__ = [
    "Audit", "Rule", "RulePack", "audit", "read_sources", "solidity_rules", "table_sources", "write_report",
]
