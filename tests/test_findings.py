import os

import brute
import pytest
from pyspark.sql import functions as F

from codesift import audit, read_sources, solidity_rules
from codesift.operators import findings as long_form
from codesift.operators import metrics
from codesift.operators.dedup import first_per_path
from codesift.rules import RULE_SCHEMA, RulePack
from codesift.solidity import RULES
from test_dialect import make_rule

DATA = os.path.join(os.path.dirname(__file__), "data")

# One text per rule; SA-001 also shows the unchecked call.
ONE_EACH = {
    "SA-001": '(bool ok, ) = a.call{value: v}("");', "SA-002": "require(tx.origin == boss);",
    "SA-003": "pragma solidity ^0.8.0;", "SA-004": "selfdestruct(payable(msg.sender));",
    "SA-005": "uint t = block.timestamp;", "SA-006": "impl.delegatecall(data);", "SA-007": "target.call(data);",
    "SA-008": "keccak256(abi.encodePacked(block.number, a));", "SA-009": "bytes32 h = sha3(x);",
    "SA-010": "address keeper = _keeper;", "SA-011": "pragma solidity 0.6.12;", "SA-012": "assembly { let x := 1 }",
    "SA-013": "address token = 0xdAC17F958D2ee523a2206206994597C13D831ec7;",
    "SA-014": "(uint r0, uint r1, ) = pair.getReserves();", "SA-015": "unchecked { n += 1; }", "SA-016": "admin = next;",
    "SA-017": "address s = ecrecover(h, v, r, s2);", "SA-018": "for (uint i = 0; i < users.length; i++) {}",
}
CASES = {
    "// tx.origin\ntx.origin": [("SA-002", 2)],
    "/* a\n b */ tx.origin": [("SA-002", 2)],
    'x = "tx.origin";': [("SA-002", 1)],
    'x = "//"; tx.origin': [("SA-002", 1)],
    "it's // tx.origin\n tx.origin": [("SA-002", 1), ("SA-002", 2)],
    "tx./**/origin": [("SA-002", 1)],
    "/* tx.origin": [],
    "for (uint i;\n i < a.length;": [("SA-018", 1)],
    "tx.origin; tx.origin": [("SA-002", 1), ("SA-002", 1)],
    "owner == x": [],
    "éowner = x": [("SA-016", 1)],
    "0x" + "a" * 41: [],
    "pragma solidity <0.9.0;": [],
    "pragma solidity =0.8.1;": [("SA-003", 1)],
    "pragma solidity >=0.4.22 <0.9.0;": [("SA-011", 1), ("SA-003", 1)],
    "owner\x0b= x": [],
    "\x01tx.origin\x01\n\x01": [("SA-002", 1)],
    'assembly ("memory-safe") {': [],
    "": [],
}


def test_each_rule_hits_its_own_text(scan_text):
    found = scan_text(ONE_EACH)
    for rule_id, hits in found.items():
        want = ["SA-001", "SA-007"] if rule_id == "SA-001" else [rule_id]
        assert [h[0] for h in hits] == want


def test_edge_cases(scan_text):
    found = scan_text({f"{n}": text for n, text in enumerate(CASES)})
    assert [[(r, line) for r, line, _ in hits] for hits in found.values()] == list(CASES.values())


def test_golden_files(spark):
    found = audit(read_sources(spark, DATA))
    rows = found.findings().where("file = 'Escrow.sol'").orderBy("position").collect()
    assert [(r.number, r.rule_id, r.line) for r in rows] == [
        ("F-01", "SA-001", 13), ("F-02", "SA-004", 18),
        ("F-03", "SA-011", 2), ("F-04", "SA-002", 8), ("F-05", "SA-008", 23), ("F-06", "SA-017", 27),
        ("F-07", "SA-014", 29), ("F-08", "SA-006", 30),
        ("F-09", "SA-010", 10), ("F-10", "SA-007", 13), ("F-11", "SA-005", 14), ("F-12", "SA-005", 14),
        ("F-13", "SA-018", 21), ("F-14", "SA-012", 28), ("F-15", "SA-015", 28), ("F-16", "SA-007", 30),
        ("F-17", "SA-003", 2), ("F-18", "SA-013", 7), ("F-19", "SA-016", 7), ("F-20", "SA-016", 27), ("F-21", "SA-009", 29),
    ]
    with open(f"{DATA}/Escrow.sol") as file:
        assert [(r.rule_id, r.line, r.code_snippet) for r in rows] == brute.findings(file.read(), RULES)
    assert rows[0].title == "Reentrancy Vulnerability" and rows[0].references[0].endswith("SWC-107")
    report = {r.file_name: r for r in found.report().collect()}
    assert (report["Escrow.sol"].risk_score, report["Escrow.sol"].lines_of_code) == (brute.risk([r.severity for r in rows]), 26)
    assert (report["Plain.sol"].n_findings, report["Plain.sol"].risk_score, report["Plain.sol"].solidity_version) == (0, 0.0, "0.8.20")
    summary = found.summary().first()
    assert (summary.total_contracts, summary.total_findings, summary.critical, summary.high, summary.medium, summary.low) == (2, 21, 2, 6, 8, 5)
    assert summary.overall_risk == "CRITICAL"


def test_numbers_over_99(scan_text, spark):
    sources = spark.createDataFrame([("a.sol", "admin = x;\n" * 120)], "path string, content string")
    numbers = [r.number for r in audit(sources).findings().orderBy("position").collect()]
    assert numbers[0] == "F-01" and numbers[99] == "F-100" and len(numbers) == 120


@pytest.mark.parametrize("threshold,ids", [
    ("HIGH", ["SA-004", "SA-002"]), ("high", ["SA-004", "SA-002"]), ("bogus", ["SA-004", "SA-002", "SA-005", "SA-016"]),
    (None, ["SA-004", "SA-002", "SA-005", "SA-016"]), ("Critical", ["SA-004"]), ("low", ["SA-004", "SA-002", "SA-005", "SA-016"]),
])
def test_min_severity(spark, threshold, ids):
    text = "owner = x; selfdestruct(a);\ntx.origin block.timestamp"
    sources = spark.createDataFrame([("a.sol", text)], "path string, content string")
    found = audit(sources, min_severity=threshold).findings().orderBy("position").collect()
    assert [r.rule_id for r in found] == ids
    assert [r.position for r in found] == list(range(1, len(ids) + 1))
    kept = long_form.at_least(audit(sources).findings(), threshold).orderBy("position").collect()
    assert [r.rule_id for r in kept] == ids


def test_rules_of_unknown_severity_rank_below_every_threshold(spark):
    pack = RulePack([make_rule("a", "X-1", "odd"), make_rule("b", "X-2", "info"), make_rule("c", "X-3", "low")])
    sources = spark.createDataFrame([("p", "a b c"), ("q", "a")], "path string, content string")
    rows = {r.path: r for r in audit(sources, pack).report().collect()}
    assert (rows["p"].info, rows["p"].low, rows["p"].risk_score) == (1, 1, brute.risk(["info", "low"]))
    assert (rows["q"].n_findings, rows["q"].risk_score) == (0, 0.0)


def test_unknown_severity_counts_as_info_without_weight(spark):
    """Finished findings may hold any severity text."""
    rows = spark.createDataFrame([("p", "odd"), ("p", "info"), ("p", "Low")], "path string, severity string")
    row = metrics.external_metrics(rows).first()
    assert (row.x_n_findings, row.x_info, row.x_low, row.x_max_weight, row.x_sum_weight) == (3, 2, 1, 1.5, 2.0)


def test_risk_scores_against_brute_force(spark):
    names = ["CRITICAL", "high", "MEDIUM", "low", "INFO"]
    pack = RulePack(make_rule(letter, letter, s) for letter, s in zip("abcde", names))
    texts = ["".join(c * (n >> (2 * k) & 3) for k, c in enumerate("abcde")) for n in range(0, 1024, 3)]
    sources = spark.createDataFrame(list(zip(map(str, range(len(texts))), texts)), "path string, content string")
    got = {r.path: r.risk_score for r in audit(sources, pack).report().collect()}
    by_letter = dict(zip("abcde", names))
    assert got == {str(n): brute.risk([by_letter[c] for c in t]) for n, t in enumerate(texts)}


def test_rule_table_and_added_rule(spark):
    table = solidity_rules().to_df(spark)
    pack = RulePack.from_df(table.orderBy(F.desc("rule_order")))
    assert [r.rule for r in pack.rules] == RULES and ", ".join(table.columns) == ", ".join(
        part.split()[0] for part in RULE_SCHEMA.split(", "))
    pack = pack.plus(make_rule(r"\bonlyOwner\b.{0,200}\b(mint|burn)\b", "X-19"))
    text = "modifier onlyOwner() { mint(); }\nonlyOwner\nmint"
    sources = spark.createDataFrame([("a", text)], "path string, content string")
    assert [(r.rule_id, r.line) for r in audit(sources, pack).findings().collect()] == [("X-19", 1)]


def test_table_rules_run_like_built_in_ones(spark):
    """Rules read from a table lose the hand-made forms but not a result."""
    sources = spark.createDataFrame(list(ONE_EACH.items()), "path string, content string")
    pick = lambda a: sorted((r.path, r.rule_id, r.line) for r in a.findings().collect())
    assert pick(audit(sources, RulePack.from_df(solidity_rules().to_df(spark)))) == pick(audit(sources))


def test_empty_pack_and_empty_corpus(spark):
    sources = spark.createDataFrame([("a", "tx.origin")], "path string, content string")
    assert audit(sources, RulePack([])).summary().first().overall_risk == "INFO"
    assert audit(sources, min_severity="critical").report().first().n_findings == 0
    nothing = audit(sources.where("path = 'b'")).summary().first()
    assert (nothing.total_contracts, nothing.total_findings, nothing.overall_risk) == (0, 0, "INFO")
    assert [r.pct for r in metrics.severity_share(audit(sources.where("false")).summary()).collect()] == [0] * 5


def test_first_row_of_a_path_wins(spark):
    rows = [("hot", "tx.origin" if n == 3 else "", n) for n in range(3, 2000)] + [("b", "", 1), ("b", "tx.origin", 0)]
    sources = spark.createDataFrame(rows, "path string, content string, seq int").repartition(8)
    report = audit(sources, first_by="seq").report().collect()
    assert {(r.path, r.n_findings) for r in report} == {("hot", 1), ("b", 1)}
    assert first_per_path(sources, "seq").count() == 2


def test_scan_plan(spark):
    """One pass: no shuffle, no Python, the text and its clean form made once."""
    sources = spark.createDataFrame([("a", "b")], "path string, content string")
    found = audit(sources)
    for frame in (found.report(), found.nested(), metrics.severity_gate(found.report()), found.report().where("n_findings = 0")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan
        assert "from_json" not in plan  # the pack is a literal by then
        assert plan.count("array_join(transform(regexp_extract_all") == 1 and plan.count("Generate explode") == 1
    plan = found.findings()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    plan = found.summary()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SinglePartition" in plan
