import glob
import json
import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from codesift import audit, write_report
from codesift.functions import severity as sev
from codesift.reports import frames, html
from codesift.reports.write import REPORTERS, normalize_format
from test_external import detector, document

START = datetime(2025, 7, 1, 14, 30, 22, tzinfo=timezone.utc)
TEXTS = [("/s/a.sol", "pragma solidity 0.8.24;\n  tx.origin <b> & \"q\" + 'x';"), ("/s/clean.sol", "x"), ("/s/b.sol", "pair.getReserves();")]


@pytest.fixture
def found(spark):
    return audit(spark.createDataFrame(TEXTS, "path string, content string"), started=START)


@pytest.fixture
def found_external(spark):
    external = spark.createDataFrame(
        [("/s/a.sol", document(detector("x<y", lines=[4]))), ("/s/gone.sol", document(detector()))], "path string, json string")
    return audit(spark.createDataFrame(TEXTS, "path string, content string"), external=external, started=START)


def lines(folder, kind="*"):
    out = []
    for name in sorted(glob.glob(f"{folder}/part-*{kind}")):
        with open(name, encoding="utf8") as file:
            out.append(file.read())
    return "".join(out)


def test_markdown_of_a_file(found):
    text = {r.path: r.text for r in frames.contract_markdown(found.nested()).collect()}
    assert text["/s/clean.sol"] == (
        "### 📄 clean.sol\n\n- **Lines of Code:** 1\n- **Solidity Version:** `unknown`\n- **Risk Score:** 0.0 / 10\n"
        "- **Findings:** 0\n\n✅ No issues detected by the current rule set.\n\n")
    assert text["/s/a.sol"].startswith(
        "### 📄 a.sol\n\n- **Lines of Code:** 2\n- **Solidity Version:** `0.8.24`\n- **Risk Score:** 7.0 / 10\n- **Findings:** 1\n\n"
        "#### [HIGH] tx.origin Used for Authentication\n\n| | |\n|---|---|\n| **ID** | SA-002 |\n| **SWC** | SWC-115 |\n"
        "| **CWE** | CWE-287 |\n| **Location** | `a.sol:2` |\n\n**Description**\n\ntx.origin refers")
    assert "**Code**\n\n```solidity\ntx.origin <b> & \"q\" + 'x';\n```\n\n**Recommendation**\n\nReplace all" in text["/s/a.sol"]
    assert text["/s/a.sol"].endswith("#tx-origin\n\n---\n\n")


def test_html_of_a_file(found):
    rows = {r.path: r for r in frames.contract_html(found.contracts, found.pack).collect()}
    body = rows["/s/a.sol"].findings_html
    assert "<pre>tx.origin &lt;b&gt; &amp; &#34;q&#34; &#43; &#39;x&#39;;</pre>" in body
    assert 'class="sbadge sev-high">▲ High<' in body and 'href="https://swcregistry.io/docs/SWC-115"' in body and "F-01 · SA-002" in body
    assert "swctag" not in rows["/s/b.sol"].findings_html  # a custom class has no link
    assert "No vulnerabilities detected" in rows["/s/clean.sol"].findings_html
    assert 'rpill risk-critical">7.0/10' in rows["/s/a.sol"].scope_html and "width:70%" in rows["/s/a.sol"].scope_html


def test_listing(found):
    rows = {r.path: r for r in frames.contract_listing(found.nested()).collect()}
    assert rows["/s/clean.sol"].head_text == "✓ clean.sol" and rows["/s/clean.sol"].line_text == ""
    assert rows["/s/a.sol"].head_text == "⚠ a.sol  [1 finding(s) · Risk 7.0/10]"
    assert rows["/s/a.sol"].line_text == "[HIGH    ] tx.origin Used for Authentication  (line 2)"


def test_json_report(found, tmp_path):
    assert write_report(found, f"{tmp_path}/r", "JSON") == "json"
    run = json.loads(lines(f"{tmp_path}/r/run"))
    assert (run["ReportID"], run["Timestamp"], run["Version"]) == ("SA-20250701-143022", "2025-07-01 14:30:22 UTC", "1.0.0")
    assert json.loads(lines(f"{tmp_path}/r/summary")) == {
        "TotalContracts": 3, "TotalFindings": 2, "Critical": 0, "High": 2, "Medium": 0, "Low": 0, "Info": 0, "OverallRisk": "HIGH"}
    rows = {r["FileName"]: r for r in map(json.loads, lines(f"{tmp_path}/r/contracts").splitlines())}
    assert rows["clean.sol"] == {"FileName": "clean.sol", "FilePath": "/s/clean.sol", "Findings": None,
                                 "RiskScore": 0.0, "LinesOfCode": 1, "SolidityVersion": "unknown"}
    finding = rows["a.sol"]["Findings"][0]
    assert list(finding) == list(frames.JSON_FINDING)
    assert (finding["Number"], finding["ID"], finding["Line"], finding["File"]) == ("F-01", "SA-002", 2, "a.sol")


def test_markdown_report_with_external_findings(found_external, tmp_path):
    assert write_report(found_external.materialized(), f"{tmp_path}/r", "markdown") == "md"
    assert "| 🟠 High | 3 |\n" in lines(f"{tmp_path}/r/summary") and "**Overall Risk** | **HIGH**" in lines(f"{tmp_path}/r/summary")
    text = lines(f"{tmp_path}/r/contracts")
    order = [text.index(s) for s in ("📄 a.sol", "tx.origin Used", "[Slither] x<y", "📄 b.sol", "Flash-Loan", "📄 clean.sol")]
    assert order == sorted(order) and "gone.sol" not in text and "`/s/a.sol:4`" in text


def test_html_report(found_external, tmp_path):
    assert write_report(found_external, f"{tmp_path}/r", "pdf") == "html"
    text = lines(f"{tmp_path}/r/contracts")
    assert "F-02 · SL-x&lt;y" in text and text.count("<details") == 3
    assert lines(f"{tmp_path}/r/scope").count("<tr>") == 3
    assert '<span class="bh" style="width:100%">' in lines(f"{tmp_path}/r/summary")


def test_json_report_with_external_findings(found_external, tmp_path):
    write_report(found_external, f"{tmp_path}/r", "json")
    rows = [json.loads(r) for r in lines(f"{tmp_path}/r/findings").splitlines()]
    assert [(r["ID"], r["Number"]) for r in rows if r["FilePath"] == "/s/a.sol"] in (
        [("SA-002", "F-01"), ("SL-x<y", "")], [("SL-x<y", ""), ("SA-002", "F-01")])
    assert "Findings" not in json.loads(lines(f"{tmp_path}/r/contracts").splitlines()[0])


@pytest.mark.parametrize("fmt", ["json", "md", "html"])
def test_a_failed_report_leaves_nothing(found, tmp_path, monkeypatch, fmt):
    whole = REPORTERS[fmt]

    def fails(audit, folder):
        whole(audit, folder)
        audit.report().select(F.raise_error(F.lit("no disk"))).write.text(f"{folder}/more")

    monkeypatch.setitem(REPORTERS, fmt, fails)
    with pytest.raises(Exception, match="no disk"):
        write_report(found, f"{tmp_path}/all/r", fmt)
    assert not os.path.exists(f"{tmp_path}/all/r") and not os.listdir(f"{tmp_path}/all")
    monkeypatch.setitem(REPORTERS, fmt, whole)
    write_report(found, f"{tmp_path}/all/r/", fmt)
    assert os.listdir(f"{tmp_path}/all") == ["r"] and {"summary", "contracts"} <= set(os.listdir(f"{tmp_path}/all/r"))
    with pytest.raises(FileExistsError):
        write_report(found, f"{tmp_path}/all/r", fmt)
    assert os.listdir(f"{tmp_path}/all") == ["r"]


def test_a_report_into_an_empty_folder(found, tmp_path):
    os.mkdir(f"{tmp_path}/r")
    write_report(found, f"{tmp_path}/r", "md")
    assert "summary" in os.listdir(f"{tmp_path}/r")
    (tmp_path / "file").write_text("x")
    with pytest.raises(FileExistsError):
        write_report(found, f"{tmp_path}/file", "md")


def test_format_names():
    names = {"json": "json", "JSON": "json", "md": "md", "Markdown": "md", "html": "html", "x": "html", None: "html"}
    assert {n: normalize_format(n) for n in names} == names and set(REPORTERS) == {"json", "md", "html"}


def test_display_columns(spark):
    rows = spark.createDataFrame([("critical",), ("Low",), ("odd",)], "s string").select(
        sev.severity_text(F.col("s")).alias("t"), sev.severity_class(F.col("s")).alias("c"),
        sev.severity_icon(F.col("s")).alias("i"), sev.severity_label(F.col("s")).alias("l")).collect()
    assert [tuple(r) for r in rows] == [("CRITICAL", "sev-critical", "⬟", "Critical"), ("LOW     ", "sev-low", "●", "Low"),
                                        ("INFO    ", "sev-info", "○", "Info")]
    bands = spark.createDataFrame([(7.0,), (6.9,), (4.0,), (2.0,), (1.9,), (0.7,)], "x double").select(
        sev.risk_class(F.col("x")).alias("c"), sev.risk_bar(F.col("x")).alias("b")).collect()
    assert [tuple(r) for r in bands] == [("risk-critical", 70), ("risk-high", int(6.9 * 10)), ("risk-high", 40), ("risk-medium", 20),
                                         ("risk-low", int(1.9 * 10)), ("risk-low", int(0.7 * 10))]
    links = spark.createDataFrame([("",), ("custom",), ("slither:x",), ("SWC-1",)], "s string").select(sev.swc_link(F.col("s")).alias("u"))
    assert [r.u for r in links.collect()] == [None, None, None, "https://swcregistry.io/docs/SWC-1"]
    assert html.ESCAPES["&"] == "&amp;"


def test_html_forms_agree(found, found_external):
    """Texts escaped by the rule and texts escaped by the finding give one result."""
    whole = {r.path: r.findings_html for r in frames.contract_html(found.contracts, found.pack).collect()}
    rows = frames.block_rows(found.report(), found.findings(), html).orderBy("path", "position").collect()
    joined = {path: "".join(r.text for r in rows if r.path == path) for path in whole}
    assert joined == whole


def test_stamps_are_utc_in_any_session_zone(spark, found):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert found.run().first().report_id == "SA-20250701-143022"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
