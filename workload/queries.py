"""The queries, by name. Each takes a session and a data folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.functions import severity as sev
from codesift.functions.comments import strip_comments as strip
from codesift.functions.stamps import fingerprint as fingerprint_of
from codesift.functions.stamps import run_id, run_timestamp
from codesift.functions.text import lines_of_code, solidity_version
from codesift.operators import findings as long_form
from codesift.operators import metrics
from codesift.operators import scan
from codesift.operators.chunks import lines_of_chunks, strip_chunks
from codesift.operators.literals import scan_by_literals as scan_by_keys
from codesift.operators.run_hash import run_fingerprint as fingerprint_of_run
from codesift.operators.signatures import rule_hit_flags_indexed as flags_by_signature
from codesift.operators.signatures import store_corpus
from codesift.plans.audit import Audit, audit
from codesift.plans.rescan import rescan as scan_of_changes
from codesift.reports import frames, html, markdown, parts
from codesift.rules import Rule, RulePack
from codesift.session import shared_folder
from codesift.solidity import RULES, solidity_rules
from codesift.sources.detectors import detector_documents, external_findings as external_rows
from codesift.streaming import live
from codesift.streaming.live import stream_contracts
from workload import corpus

TOP = 100

# A user rule for contracts and a pack of user rules for plain text.
MINT_RULE = Rule(
    "CX-001", "Privileged Supply Function", "A single role can change the supply.", "HIGH", "custom",
    "CWE-284", "Put the role behind a delay.", (), r"\bmint\b.{0,80}\bonlyOwner\b",
)
# A rule whose references are no plain links.
LINK_RULE = Rule(
    "CX-002", "Odd links", "A rule with links of all kinds.", "LOW", "custom", "", "Check them.",
    ("javascript:alert(1)", "https://a.example/b c?d=\"e\"&f=é#g", "mailto:x@y.z", "/path:1/%2F%zz", "HTTPS://up.example/'(1)'", ""),
    r"\bfunction\s+mint\b",
)
# Rules with repeated groups, quoted text, octal numbers and scripts.
SYNTAX_RULES = [
    Rule("SX-001", "Run of words", "Words after a comma up to a stop.", "LOW", "", "", "", (), r",(?: [a-z]+)+\."),
    Rule("SX-002", "Marked run", "Words with marks behind them.", "LOW", "", "", "", (), r"(?:[a-z]+[*$&])+"),
    Rule("SX-003", "Quoted", "A string that starts like a text.", "INFO", "", "", "", (), r"\Qtx.origin;\E"),
    Rule("SX-004", "Octal", "A slash and a star.", "INFO", "", "", "", (), r"\057\052"),
    Rule("SX-005", "Script", "A Latin letter before a colon or semicolon.", "INFO", "", "", "", (), r"\p{Latin}[:;]"),
]
TEXT_RULES = [
    Rule("TX-001", "Assigned token", "A token value in the text.", "CRITICAL", "custom", "", "Remove it.", (),
         r'token\s*=\s*"[0-9a-f]+"'),
    Rule("TX-002", "Mail address", "A mail address in the text.", "MEDIUM", "custom", "", "Mask it.", (),
         r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}"),
    Rule("TX-003", "Network address", "An IPv4 address in the text.", "LOW", "custom", "", "Mask it.", (),
         r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
    Rule("TX-004", "License mention", "The text names a license.", "INFO", "custom", "", "Check it.", (),
         r"(?i)\blicen[sc]e[ds]?\b"),
    Rule("TX-005", "Single word line", "A line that holds one word.", "LOW", "custom", "", "Check it.", (),
         r"(?m)^\S+$"),
]


def contracts_audit(spark: SparkSession, sf_dir: str, **options) -> Audit:
    return audit(corpus.contracts(spark, sf_dir), **options)


def external_audit(spark: SparkSession, sf_dir: str) -> Audit:
    return contracts_audit(spark, sf_dir, external=corpus.detector_results(spark, sf_dir))


def stored_audit(spark: SparkSession, sf_dir: str) -> Audit:
    """Findings with external ones need the scanned rows more than once, so those
    are written to the shared folder first."""
    return external_audit(spark, sf_dir).materialized()


# --- Sources ---------------------------------------------------------------

def source_dedup(spark, sf_dir):
    return audit(corpus.shared_contracts(spark, sf_dir), first_by="seq").report()


def rule_catalog(spark, sf_dir):
    """Every rule of the pack with its number of findings, hit or not."""
    pack = solidity_rules()
    hits = long_form.explode_findings(contracts_audit(spark, sf_dir).contracts)
    counted = hits.groupBy("rule_order").agg(F.count(F.lit(1)).alias("n_findings"))
    return (
        pack.to_df(spark).join(counted, "rule_order", "left")
        .select("rule_order", "rule_id", "title", "description", "severity", "swc", "cwe", "recommendation",
                F.array_join("references", " ").alias("reference_text"), "regex",
                F.coalesce("n_findings", F.lit(0)).alias("n_findings"))
    )


def external_findings(spark, sf_dir):
    rows = external_rows(detector_documents(corpus.detector_results(spark, sf_dir)))
    return rows.select(
        "path", "doc_key", "detector_index", "rule_id", "title", "description", "severity", "swc", "cwe",
        "file", "line", "code_snippet", "recommendation", F.array_join("references", " ").alias("reference_text"),
    )


def skipped_sources(spark, sf_dir):
    """Orders of which some have no text: those are named, the others are contracts."""
    texts = F.when(F.col("content").rlike("SPDX"), F.col("content"))
    sources = corpus.contracts(spark, sf_dir).withColumn("content", texts)
    found = audit(sources)
    scanned = found.report().select("path", F.lit("scanned").alias("state"), "n_findings")
    return scanned.unionByName(found.skipped.select("path", F.lit("skipped").alias("state"), F.lit(None).cast("bigint").alias("n_findings")))


def external_repeated(spark, sf_dir):
    """Every detector document given twice: its results count twice."""
    results = corpus.detector_results(spark, sf_dir)
    found = contracts_audit(spark, sf_dir, external=results.unionByName(results))
    return found.report().select("path", "n_findings", "risk_score", "high", "info")


def rescan(spark, sf_dir):
    """Two snapshots: in the second a third of the files are new or changed, and only those are scanned."""
    store = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    now = corpus.contracts(spark, sf_dir)
    kind = F.pmod(F.crc32(F.col("path").cast("binary")), F.lit(6))
    before = now.where(kind > 0).withColumn("content", F.when(kind == 1, F.lit("old text")).otherwise(F.col("content")))
    scan_of_changes(before, solidity_rules(), store)
    return metrics.contract_report(metrics.contract_metrics(scan_of_changes(now, solidity_rules(), store)))


# --- Text ------------------------------------------------------------------

def _stripped(source: Callable, spark, sf_dir):
    return source(spark, sf_dir).select("path", strip(F.col("content")).alias("clean"))


def strip_comments_chunked(spark, sf_dir):
    """Lines of texts that come in chunks, stripped chunk by chunk."""
    return lines_of_chunks(strip_chunks(corpus.chunked_documents(spark, sf_dir)))


def loc(spark, sf_dir):
    rows = corpus.contracts(spark, sf_dir).unionByName(corpus.documents(spark, sf_dir))
    return rows.select("path", lines_of_code(F.col("content")).alias("lines_of_code"))


def pragma_version(spark, sf_dir):
    cleaned = _stripped(corpus.contracts, spark, sf_dir)
    return cleaned.select("path", solidity_version(F.col("clean")).alias("solidity_version"))


# --- Matching --------------------------------------------------------------

def rule_matches(spark, sf_dir):
    hits = long_form.explode_findings(contracts_audit(spark, sf_dir).contracts)
    return hits.select("path", "rule_order", "line", "occ")


def scan_unrolled(spark, sf_dir):
    rows = scan.scan_sources(corpus.contracts(spark, sf_dir), solidity_rules(), unroll=True)
    return long_form.explode_findings(rows).select("path", "rule_order", "line", "occ")


def scan_by_literals(spark, sf_dir):
    """The pack and one more rule for each contract."""
    pack = solidity_rules()
    rules = pack.to_df(spark).unionByName(corpus.contract_rules(spark, sf_dir, len(pack)))
    rows = scan_by_keys(corpus.contracts(spark, sf_dir), rules)
    return long_form.explode_findings(rows).select("path", "rule_order", "line", "occ")


def one_rule(rule_id: str, spark, sf_dir):
    rows = scan.scan_sources(corpus.contracts(spark, sf_dir), solidity_rules().only(rule_id))
    return long_form.explode_findings(rows).select("path", "line", "occ")


def rule_hit_flags(spark, sf_dir):
    flags = scan.rule_hit_flags(corpus.contracts(spark, sf_dir), solidity_rules())
    return flags.select("path", F.array_join("rule_ids", ",").alias("rule_ids"))


def rule_hit_flags_indexed(spark, sf_dir):
    """The same from a stored corpus, whose parts are searched for those rules only that their signature allows."""
    store = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    store_corpus(corpus.contracts(spark, sf_dir), store, parts=16)
    flags = flags_by_signature(spark, store, solidity_rules())
    return flags.select("path", F.array_join("rule_ids", ",").alias("rule_ids"))


def snippets(spark, sf_dir):
    hits = long_form.explode_findings(contracts_audit(spark, sf_dir).contracts)
    return hits.select("path", "rule_order", "line", "occ", "code_snippet")


def noted_scan(spark, sf_dir):
    rows = scan.scan_sources(corpus.noted_documents(spark, sf_dir), solidity_rules())
    return long_form.explode_findings(rows).select("path", "rule_order", "line", "occ", "code_snippet")


def custom_rule_pack(spark, sf_dir):
    found = audit(corpus.documents(spark, sf_dir), RulePack(TEXT_RULES))
    return found.findings().select("path", "position", "rule_id", "severity", "line", "code_snippet")


def custom_rule_syntax(spark, sf_dir):
    found = audit(corpus.noted_documents(spark, sf_dir), RulePack(SYNTAX_RULES))
    return found.findings().select("path", "position", "rule_id", "line")


def custom_rule_added(spark, sf_dir):
    found = contracts_audit(spark, sf_dir, pack=solidity_rules().plus(MINT_RULE))
    return found.findings().where(F.col("rule_id") == "CX-001").select("path", "number", "line", "code_snippet")


# --- Findings --------------------------------------------------------------

def findings_enriched(spark, sf_dir):
    rows = contracts_audit(spark, sf_dir).findings()
    return rows.withColumn("reference_text", F.array_join("references", " ")).drop("references")


def findings_numbered(spark, sf_dir):
    return contracts_audit(spark, sf_dir).findings().select("path", "number", "rule_id", "line")


def findings_sorted(spark, sf_dir):
    return contracts_audit(spark, sf_dir).findings().select("path", "position", "severity", "rule_id", "line")


def findings_min_high(spark, sf_dir):
    rows = contracts_audit(spark, sf_dir, min_severity="High").findings()
    return rows.select("path", "number", "severity", "rule_id", "line")


def findings_filtered(spark, sf_dir):
    """The same threshold on finished findings; numbers are those of the full list."""
    rows = long_form.at_least(contracts_audit(spark, sf_dir).findings(), "high")
    return rows.select("path", "number", "severity", "rule_id", "line")


def findings_with_external(spark, sf_dir):
    rows = stored_audit(spark, sf_dir).findings()
    return rows.select("path", "position", "number", "rule_id", "severity", "line", "source_rank")


def findings_min_high_external(spark, sf_dir):
    """The threshold holds for rules and not for external results."""
    found = contracts_audit(spark, sf_dir, min_severity="high", external=corpus.detector_results(spark, sf_dir)).materialized()
    return found.findings().select("path", "position", "number", "severity", "rule_id", "line")


def finding_links(spark, sf_dir):
    rows = stored_audit(spark, sf_dir).findings()
    return rows.select("path", "position", "swc", sev.swc_link(F.col("swc")).alias("url"))


# --- Figures ---------------------------------------------------------------

def contract_report(spark, sf_dir):
    return contracts_audit(spark, sf_dir).report()


def contract_report_external(spark, sf_dir):
    return external_audit(spark, sf_dir).report()


def contract_risk(spark, sf_dir):
    return contracts_audit(spark, sf_dir).report().select("path", "n_findings", "risk_score")


def clean_contracts(spark, sf_dir):
    report = contracts_audit(spark, sf_dir).report()
    return report.where(F.col("n_findings") == 0).select("path", "file_name", "lines_of_code")


def severity_gate(spark, sf_dir):
    return metrics.severity_gate(contracts_audit(spark, sf_dir).report())


def severity_rollup(spark, sf_dir):
    return metrics.severity_rollup(contracts_audit(spark, sf_dir).report())


def summary(spark, sf_dir):
    return contracts_audit(spark, sf_dir).summary()


def summary_external(spark, sf_dir):
    return external_audit(spark, sf_dir).summary()


def severity_share(spark, sf_dir):
    return metrics.severity_share(external_audit(spark, sf_dir).summary())


def risk_bands(spark, sf_dir):
    score = F.col("risk_score")
    return contracts_audit(spark, sf_dir).report().select(
        "path", "risk_score", sev.risk_class(score).alias("risk_class"), sev.risk_bar(score).alias("risk_bar")
    )


def top_risky(spark, sf_dir):
    report = metrics.top_risky(contracts_audit(spark, sf_dir).report(), TOP)
    return report.select("path", "risk_score", "n_findings", "lines_of_code", "solidity_version")


# --- Display and reports ---------------------------------------------------

def severity_display(spark, sf_dir):
    name = F.col("severity")
    rows = stored_audit(spark, sf_dir).findings().groupBy("severity").count()
    return rows.select(
        "severity", F.col("count").alias("n"), sev.severity_text(name).alias("severity_text"),
        sev.severity_class(name).alias("severity_class"), sev.severity_icon(name).alias("severity_icon"),
        sev.severity_label(name).alias("severity_label"), sev.overall_class(name).alias("overall_class"),
    )


def contract_nested(spark, sf_dir):
    """The nested form, shown through figures of each file's array."""
    nested = contracts_audit(spark, sf_dir).nested()
    order = F.array_join(F.transform("findings", lambda f: F.concat_ws("@", f["rule_id"], f["line"])), " ")
    return nested.select("path", F.size("findings").cast("bigint").alias("n_findings"), order.alias("order_text"))


def contract_listing(spark, sf_dir):
    return frames.contract_listing(contracts_audit(spark, sf_dir).nested())


def contract_listing_external(spark, sf_dir):
    found = stored_audit(spark, sf_dir)
    return frames.listing_rows(found.report(), found.findings())


def report_json_external(spark, sf_dir):
    """One JSON row for each finding, external ones included."""
    rows = frames.json_findings(stored_audit(spark, sf_dir).findings())
    return rows.select("FilePath", "Position", F.to_json(F.struct(*frames.JSON_FINDING), {"ignoreNullFields": "false"}).alias("json"))


def report_html_external(spark, sf_dir):
    found = stored_audit(spark, sf_dir)
    return frames.block_rows(found.report(), found.findings(), html)


def report_html_links(spark, sf_dir):
    """Links of a rule in the file blocks and in single blocks."""
    found = contracts_audit(spark, sf_dir, pack=RulePack([LINK_RULE]))
    whole = frames.contract_html(found.contracts, found.pack).select("path", F.lit(-1).alias("position"), F.col("findings_html").alias("text"))
    return whole.unionByName(frames.block_rows(found.report(), found.findings(), html))


def report_json(spark, sf_dir):
    rows = frames.json_contracts(contracts_audit(spark, sf_dir).nested())
    return rows.select("FilePath", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def report_markdown(spark, sf_dir):
    return frames.contract_markdown(contracts_audit(spark, sf_dir).nested())


def report_markdown_external(spark, sf_dir):
    """Blocks with external findings, one row per block."""
    found = stored_audit(spark, sf_dir)
    return frames.block_rows(found.report(), found.findings(), markdown)


def report_markdown_summary(spark, sf_dir):
    """The opening block, stamped with the time of the last event."""
    last = corpus.table(spark, sf_dir, "events").agg(F.max("ts").alias("ts"))
    run = last.select(
        F.lit(parts.TITLE).alias("title"), F.lit(parts.VERSION).alias("version"),
        run_timestamp(F.col("ts")).alias("timestamp"), F.lit("0s").alias("duration"),
    )
    return markdown.opening(contracts_audit(spark, sf_dir).summary(), run)


def report_html_fragment(spark, sf_dir):
    found = contracts_audit(spark, sf_dir)
    return frames.contract_html(found.contracts, found.pack)


def report_html_summary(spark, sf_dir):
    return frames.severity_cards(external_audit(spark, sf_dir).summary())


# --- Stamps and streams ----------------------------------------------------

def run_stamp(spark, sf_dir):
    ts = F.col("ts")
    return corpus.table(spark, sf_dir, "events").select(
        "event_id", run_id(ts).alias("report_id"), run_timestamp(ts).alias("timestamp")
    )


def fingerprint(spark, sf_dir):
    path = F.concat(F.lit("/é/"), F.col("event_type"), F.col("event_id").cast("string"))
    rows = corpus.spread_keys(corpus.table(spark, sf_dir, "events").select("event_id", "ts", "event_type"), "event_id")
    return rows.select("event_id", fingerprint_of(run_timestamp(F.col("ts")), path).alias("fingerprint"))


def run_fingerprint(spark, sf_dir):
    """All contracts of a run, stamped with the time of the last event."""
    last = corpus.table(spark, sf_dir, "events").agg(F.max("ts").alias("ts"))
    return fingerprint_of_run(corpus.contracts(spark, sf_dir), last.select(run_timestamp(F.col("ts")).alias("timestamp")))


def stream_scan(spark, sf_dir):
    """The orders table read as a stream, scanned, and reported from the sink."""
    sources = corpus.streamed_contracts(spark, sf_dir)
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = stream_contracts(sources, solidity_rules(), f"{folder}/contracts", f"{folder}/state")
    query.awaitTermination()
    # With the schema given, a stream without rows is an empty table.
    scanned = spark.read.schema(scan.scan_sources(sources, solidity_rules()).schema).parquet(f"{folder}/contracts")
    return metrics.contract_report(metrics.contract_metrics(scanned))


def _stream_folder(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def stream_dedup(spark, sf_dir):
    """Orders that claim one path arrive in several batches; the smallest key counts."""
    folder = _stream_folder(spark)
    sources = corpus.arriving_shared_contracts(spark, sf_dir, f"{folder}/orders")
    live.stream_first_per_path(sources, solidity_rules(), f"{folder}/ledger", f"{folder}/state").awaitTermination()
    return live.first_rows(spark, f"{folder}/ledger")


def stream_summary(spark, sf_dir):
    """Running totals over all batches."""
    folder = _stream_folder(spark)
    sources = corpus.arriving_contracts(spark, sf_dir, f"{folder}/orders")
    live.stream_totals(sources, solidity_rules(), f"{folder}/ledger", f"{folder}/state").awaitTermination()
    return live.totals(spark, f"{folder}/ledger")


def stream_external(spark, sf_dir):
    """Contracts and detector results arrive apart from each other."""
    folder = _stream_folder(spark)
    results = corpus.arriving_results(spark, sf_dir, f"{folder}/events")
    live.stream_external(results, f"{folder}/external", f"{folder}/external-state").awaitTermination()
    sources = corpus.arriving_contracts(spark, sf_dir, f"{folder}/orders")
    live.stream_figures(sources, solidity_rules(), f"{folder}/figures", f"{folder}/state").awaitTermination()
    return live.live_report(spark, f"{folder}/figures", f"{folder}/external")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{f.__name__: f for f in (
        top_risky, source_dedup, rule_catalog, external_findings, loc, pragma_version,
        rule_matches, scan_unrolled, rule_hit_flags, rule_hit_flags_indexed, snippets, noted_scan, custom_rule_pack,
        custom_rule_added, findings_enriched, findings_numbered, findings_sorted, findings_min_high,
        findings_filtered, findings_with_external, finding_links, contract_report,
        contract_report_external, contract_risk, clean_contracts, severity_gate, severity_rollup,
        summary, summary_external, severity_share, risk_bands, severity_display, contract_nested,
        contract_listing, report_json, report_markdown, report_markdown_external,
        report_markdown_summary, report_html_fragment, report_html_summary, run_stamp, fingerprint, run_fingerprint, strip_comments_chunked, stream_dedup, stream_summary, rescan, scan_by_literals, stream_external,
        stream_scan, skipped_sources, external_repeated, findings_min_high_external, contract_listing_external,
        report_json_external, report_html_external, report_html_links, custom_rule_syntax,
    )},
    "strip_comments": partial(_stripped, corpus.contracts),
    "strip_comments_documents": partial(_stripped, corpus.noted_documents),
    "strip_comments_pages": partial(_stripped, corpus.pages),
    **{f"rule_{r.rule_id.lower().replace('-', '_')}": partial(one_rule, r.rule_id) for r in RULES},
}
