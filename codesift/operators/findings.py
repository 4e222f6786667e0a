"""Long findings tables made from the per-file rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from codesift.functions.severity import finding_number, rank_of, severity_rank
from codesift.functions.text import literal_rows
from codesift.rules import RulePack
from codesift.sources.detectors import finding_columns

RULE_TEXTS = ("rule_id", "title", "description", "severity", "swc", "cwe", "recommendation", "references")
FINDING_COLUMNS = (
    "path", "position", "number", "rule_id", "title", "description", "severity", "swc", "cwe",
    "file", "line", "code_snippet", "recommendation", "references",
)


def explode_findings(contracts: DataFrame) -> DataFrame:
    """One narrow row per finding: ids, line and snippet, no rule texts."""
    return contracts.select("path", "file_name", F.inline("findings"))


def findings_table(contracts: DataFrame, pack: RulePack) -> DataFrame:
    """Findings with the rule texts attached by a broadcast join on the rule order."""
    rules = pack.broadcast(contracts.sparkSession).select("rule_order", *RULE_TEXTS)
    return (
        explode_findings(contracts)
        .join(rules, "rule_order")
        .withColumn("number", finding_number(F.col("position")))
        .withColumnRenamed("file_name", "file")
        .select(*FINDING_COLUMNS, "rule_order", "occ")
    )


def at_least(findings: DataFrame, min_severity: str | None) -> DataFrame:
    return findings.where(severity_rank(F.col("severity")) >= rank_of(min_severity))


def nested_findings(contracts: DataFrame, pack: RulePack) -> DataFrame:
    """Per-file rows whose findings carry the rule texts; a literal lookup, no join."""
    texts = _rule_lookup(pack)

    def full(f: Column) -> Column:
        rule = F.get(texts, f["rule_order"])
        return F.struct(
            finding_number(f["position"]).alias("number"),
            *[rule[name].alias(name) for name in RULE_TEXTS[:6]],
            F.col("file_name").alias("file"),
            f["line"].alias("line"),
            f["code_snippet"].alias("code_snippet"),
            rule["recommendation"].alias("recommendation"),
            rule["references"].alias("references"),
        )

    return contracts.withColumn("findings", F.transform("findings", full))


def _rule_lookup(pack: RulePack) -> Column:
    """Literal array of rule texts, indexed by rule order."""
    fields = ",".join(f"{n}:{'array<string>' if n == 'references' else 'string'}" for n in RULE_TEXTS)
    by_order = {r.order: {n: getattr(r.rule, n) for n in RULE_TEXTS} for r in pack.rules}
    rows = [by_order.get(order) for order in range(max(by_order, default=-1) + 1)]
    return literal_rows(rows, f"struct<{fields}>")


def with_external(findings: DataFrame, contracts: DataFrame, documents: DataFrame) -> DataFrame:
    """Append external findings behind the rule findings of their file.

    ``documents`` comes from ``detector_documents``. External rows have no number,
    but a position that continues the file's count, in document and detector order.
    The severity filter does not apply to them, and documents of files that were
    not scanned are left out.

    One file may own a large part of all documents, so positions are prefix sums in
    two levels: inside a bucket of documents, then over the buckets of a file. The
    bucket is the head of the document key, so both levels follow one order.
    """
    inside = Window.partitionBy("path", "bucket").orderBy("doc_key").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("path").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # The file's own row sorts first (empty bucket), so its count is always ahead.
    totals = (
        documents.groupBy("path", "bucket").agg(F.sum(F.size("detectors")).alias("n"))
        .unionByName(contracts.select("path", F.lit("").alias("bucket"), F.size("findings").cast("bigint").alias("n")))
        .select("path", "bucket", F.sum("n").over(before).alias("offset"), F.min("bucket").over(before).alias("first"))
        .where((F.col("bucket") != "") & (F.col("first") == ""))
        .select("path", "bucket", "offset")
    )
    external = (
        documents
        .withColumn("earlier", F.coalesce(F.sum(F.size("detectors")).over(inside), F.lit(0)))
        .join(totals, ["path", "bucket"])
        .select("path", (F.col("offset") + F.col("earlier")).alias("start"), F.posexplode("detectors"))
        .select("path", (F.col("start") + F.col("pos") + 1).cast("int").alias("position"), "col.*")
        .select("path", "position", *finding_columns())
    )
    return (
        findings.select(*FINDING_COLUMNS, F.lit(0).alias("source_rank"))
        .unionByName(external.withColumn("source_rank", F.lit(1)), allowMissingColumns=True)
    )
