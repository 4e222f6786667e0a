import hashlib
import json
import random

import brute
import pytest
from pyspark.sql import functions as F

from codesift import audit
from codesift.sources.detectors import detector_documents, external_findings, read_detector_files


def document(*detectors, success=True):
    return json.dumps({"success": success, "error": None, "results": {"detectors": list(detectors)}})


def detector(check="c", impact="High", lines=(3,), **more):
    return {"check": check, "impact": impact, "description": f"about {check}",
            "elements": [{"source_mapping": {"lines": list(lines), "start": 1}}], **more}


def parse(spark, documents):
    rows = spark.createDataFrame(documents, "path string, json string")
    return external_findings(detector_documents(rows)).orderBy("path", "doc_key", "detector_index").collect()


def test_fields(spark):
    row = parse(spark, [("/s/a.sol", document(detector("reentrancy-eth", lines=[7, 8])))])[0]
    assert (row.rule_id, row.title, row.swc, row.file, row.line) == (
        "SL-reentrancy-eth", "[Slither] reentrancy-eth", "slither:reentrancy-eth", "/s/a.sol", 7)
    assert (row.description, row.severity, row.cwe, row.code_snippet, row.number) == ("about reentrancy-eth", "HIGH", "", "", "")
    assert row.recommendation == "See https://github.com/crytic/slither/wiki/Detector-Documentation#reentrancy-eth"
    assert row.references == ["https://github.com/crytic/slither"]


@pytest.mark.parametrize("impact,severity", [
    ("High", "HIGH"), ("Medium", "MEDIUM"), ("Low", "LOW"), ("Informational", "INFO"), ("Optimization", "MEDIUM"),
    ("high", "MEDIUM"), (None, "MEDIUM"),
])
def test_impacts(spark, impact, severity):
    assert [r.severity for r in parse(spark, [("a", document(detector(impact=impact)))])] == [severity]


@pytest.mark.parametrize("text", [
    "", "{", "[]", "null", '{"success": true}', document(detector(), success=False), document(),
    document(detector()) + " oops", document(detector()) * 2, document(detector()) + "," + document(detector()),
    document(detector()) + "] [" + document(detector()),
    '{"results": {"detectors": [{"check": "c"}]}}', document(detector(lines=["x"])), document(detector(check=5) | {"elements": 3}),
])
def test_unusable_documents(spark, text):
    assert parse(spark, [("a", text)]) == []


def test_lines(spark):
    rows = parse(spark, [("a", document(
        detector(lines=[]), detector() | {"elements": []}, {"check": "bare", "impact": "Low"},
        detector() | {"elements": [{"source_mapping": {}}, {"source_mapping": {"lines": [9]}}]},
    ))])
    assert [r.line for r in rows] == [0, 0, 0, 0]
    assert rows[2].description == ""


def test_positions_against_brute_force(spark):
    """Half of all documents belong to one file; some are delivered twice."""
    rng = random.Random(3)
    texts = {f"/s/{n}.sol": "tx.origin\n" * rng.randint(0, 3) for n in range(20)}
    documents = []
    for n in range(600):
        path = "/s/0.sol" if n % 2 else f"/s/{rng.randint(0, 24)}.sol"
        documents.append((path, document(*[detector(f"d{n}-{k}", rng.choice(["High", "Low"])) for k in range(rng.randint(0, 3))])))
    documents += documents[:50]
    sources = spark.createDataFrame(list(texts.items()), "path string, content string")
    external = spark.createDataFrame(documents, "path string, json string").repartition(6)
    found = audit(sources, external=external, min_severity="high")
    want = {}
    for path, text in texts.items():
        rules = [("SA-002", 0)] * text.count("tx.origin")
        # Documents delivered twice count twice.
        mine = sorted((hashlib.sha256(d.encode()).hexdigest(), d) for p, d in documents if p == path)
        extra = [("SL-" + x["check"], 1) for _, d in mine for x in json.loads(d)["results"]["detectors"]]
        want[path] = rules + extra
    got = {path: [] for path in texts}
    for row in found.findings().orderBy("path", "position").collect():
        got[row.path].append((row.rule_id, row.source_rank))
        assert row.position == len(got[row.path])
        assert row.number == ("" if row.source_rank else f"F-{row.position:02d}")
    assert got == want
    severities = {}
    for row in found.findings().collect():
        severities.setdefault(row.path, []).append(row.severity)
    for row in found.report().collect():
        assert (row.n_findings, row.risk_score) == (len(want[row.path]), brute.risk(severities.get(row.path, [])))
    assert found.summary().first().total_findings == sum(map(len, want.values()))
    stored = found.materialized()
    assert stored.findings().exceptAll(found.findings()).isEmpty() and stored.report().exceptAll(found.report()).isEmpty()


def test_files(spark, tmp_path):
    (tmp_path / "a b.sol.json").write_text(document(detector()))
    (tmp_path / "notes.txt").write_text("x")
    rows = read_detector_files(spark, str(tmp_path)).collect()
    assert [r.path for r in rows] == [f"{tmp_path}/a b.sol"]
    assert F.__name__ and len(parse(spark, [tuple(r) for r in rows])) == 1
