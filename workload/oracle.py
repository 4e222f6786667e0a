"""The same queries in SQL, written another way where there is a choice: rule
patterns are used as they stand (this engine matches with RE2), lines are counted
from the texts between matches, and numbering is a window over all findings."""

from __future__ import annotations

from codesift.reports import parts
from codesift.rules import Rule
from codesift.solidity import RULES
from workload import corpus
from workload.queries import LINK_RULE, MINT_RULE, SYNTAX_RULES, TEXT_RULES, TOP

WS = " || ".join(f"chr({n})" for n in (
    9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
))
TOKEN = (
    r"""(?:"(?:[^"\\]|\\[\s\S])*(?:"|\\?\z)|'(?:[^'\\]|\\[\s\S])*(?:'|\\?\z)"""
    r"""|//[^\n]*|/\*(?:[^*]|\*+[^*/])*(?:\*+/|\**\z)|[^"'/]+|/)"""
)
RANKS = "CASE upper(severity) WHEN 'CRITICAL' THEN 5 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 2 WHEN 'INFO' THEN 1 ELSE 0 END"
WEIGHTS = "CASE upper(severity) WHEN 'CRITICAL' THEN 10 WHEN 'HIGH' THEN 7 WHEN 'MEDIUM' THEN 4 WHEN 'LOW' THEN 1.5 WHEN 'INFO' THEN 0.5 ELSE 0 END::DOUBLE"

ORDERS = f"SELECT {corpus.ORDER_PATH} AS path, {corpus.ORDER_TEXT} AS content FROM orders"
DOCUMENTS = f"SELECT {corpus.DOCUMENT_PATH} AS path, text AS content FROM documents"
NOTED = f"SELECT {corpus.DOCUMENT_PATH} AS path, {corpus.NOTED_TEXT} AS content FROM documents"
PAGES = f"SELECT {corpus.PAGE_PATH} AS path, html AS content FROM pages"
SHARED = f"""SELECT path, content FROM (
    SELECT {corpus.SHARED_PATH} AS path, {corpus.ORDER_TEXT} AS content,
           row_number() OVER (PARTITION BY {corpus.SHARED_PATH} ORDER BY o_orderkey) AS nth FROM orders) WHERE nth = 1"""


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def newlines(column: str) -> str:
    return f"(length({column}) - length(replace({column}, chr(10), '')))"


def cleaned(source: str) -> str:
    return f"""
src AS MATERIALIZED ({source}),
clean AS MATERIALIZED (
    SELECT path, content, coalesce(array_to_string(list_transform(regexp_extract_all(content, {text(TOKEN)}),
        lambda t: CASE WHEN starts_with(t, '//') THEN '' WHEN starts_with(t, '/*') THEN regexp_replace(t, '[^\\n]', '', 'g')
                  ELSE t END), ''), '') AS clean
    FROM src)"""


def rule_rows(rules: list[Rule]) -> str:
    rows = ",\n".join(
        "(" + ", ".join([
            f"{n}::INTEGER", *map(text, (r.rule_id, r.title, r.description, r.severity, r.swc, r.cwe, r.recommendation)),
            "[" + ", ".join(map(text, r.references)) + "]::VARCHAR[]", text(r.regex),
        ]) + ")"
        for n, r in enumerate(rules)
    )
    return f"""
rules AS (SELECT *, {RANKS} AS rank, {WEIGHTS} AS weight FROM (VALUES {rows}) AS v(
    rule_order, rule_id, title, description, severity, swc, cwe, recommendation, refs, regex))"""


def hits(rules: list[Rule], orders: list[int] | None = None) -> str:
    one = """SELECT path, {n} AS rule_order, unnest(regexp_extract_all(clean, {prefix}, 1)) AS before,
        unnest(regexp_extract_all(clean, {prefix}, 2)) AS hit, generate_subscripts(regexp_extract_all(clean, {prefix}, 1), 1) AS nth
        FROM clean WHERE regexp_matches(clean, {plain})"""
    parts_ = [
        one.format(n=n, prefix=text(r"([\s\S]*?)((?:" + r.regex + "))"), plain=text(r.regex))
        for n, r in enumerate(rules) if orders is None or n in orders
    ]
    return f"""
raw AS ({' UNION ALL '.join(parts_)}),
hits AS (
    SELECT path, rule_order, line, (row_number() OVER (PARTITION BY path, rule_order, line ORDER BY nth))::INTEGER AS occ
    FROM (SELECT path, rule_order, nth, (1 + sum({newlines('before')} + {newlines('hit')}) OVER (
            PARTITION BY path, rule_order ORDER BY nth) - {newlines('hit')})::INTEGER AS line FROM raw))"""


SNIPPETS = f"""
lines AS (SELECT h.*, trim(coalesce(string_split(content, chr(10))[line], ''), {WS}) AS whole
    FROM hits h JOIN src USING (path)),
snips AS (SELECT * EXCLUDE (whole), CASE WHEN strlen(whole) > 140 THEN left(whole, list_max(list_filter(
        range(1, 141), lambda n: strlen(left(whole, n)) <= 140))) || '…' ELSE whole END AS code_snippet FROM lines)"""

FINDINGS = """
findings AS (
    SELECT path, p.position::INTEGER AS position, printf('F-%02d', p.position) AS number, rule_id, title, description, severity,
           swc, cwe, string_split(path, '/')[-1] AS file, line, code_snippet, recommendation, refs, rank, weight, rule_order
    FROM (SELECT s.*, r.* EXCLUDE (rule_order),
              row_number() OVER (PARTITION BY path ORDER BY rank DESC, line, rule_order, occ) AS position
          FROM snips s JOIN rules r USING (rule_order)) p)"""

EXTERNAL = f"""
docs AS (SELECT {corpus.EVENT_PATH} AS path, {corpus.DETECTOR_TEXT} AS doc FROM events),
runs AS (SELECT path, sha256(doc) AS doc_key, from_json(doc, '{{"success": "BOOLEAN", "results": {{"detectors":
        [{{"check": "VARCHAR", "impact": "VARCHAR", "description": "VARCHAR",
           "elements": [{{"source_mapping": {{"lines": ["INTEGER"]}}}}]}}]}}}}') AS run
    FROM docs WHERE json_valid(doc)),
detected AS (SELECT path, doc_key, unnest(run.results.detectors) AS d,
        generate_subscripts(run.results.detectors, 1) - 1 AS detector_index FROM runs WHERE run.success),
external AS (SELECT path, doc_key, detector_index::INTEGER AS detector_index, 'SL-' || d.check AS rule_id,
        '[Slither] ' || d.check AS title, coalesce(d.description, '') AS description,
        CASE d.impact WHEN 'High' THEN 'HIGH' WHEN 'Low' THEN 'LOW' WHEN 'Informational' THEN 'INFO' ELSE 'MEDIUM' END AS severity,
        'slither:' || d.check AS swc, '' AS cwe, path AS file,
        coalesce(d.elements[1].source_mapping.lines[1], 0)::INTEGER AS line, '' AS code_snippet,
        'See https://github.com/crytic/slither/wiki/Detector-Documentation#' || d.check AS recommendation,
        ['https://github.com/crytic/slither'] AS refs FROM detected)"""

ALL_FINDINGS = f"""
merged AS (
    SELECT *, 0::INTEGER AS source_rank, '' AS doc_key, position AS detector_index FROM findings
    UNION ALL BY NAME
    SELECT *, '' AS number, 1::INTEGER AS source_rank, {RANKS} AS rank, {WEIGHTS} AS weight FROM external
    WHERE path IN (SELECT path FROM src)),
all_findings AS (SELECT * EXCLUDE (position), (row_number() OVER (
        PARTITION BY path ORDER BY source_rank, doc_key, detector_index))::INTEGER AS position FROM merged)"""


def figures(findings: str = "findings") -> str:
    kinds = "".join(
        f", count(*) FILTER (WHERE upper(severity) = '{s}') AS {s.lower()}" for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")
    )
    return f"""
counted AS (SELECT path, count(*) AS n, max(weight) AS top, sum(weight) AS total{kinds} FROM {findings} GROUP BY path),
report AS (
    SELECT path, string_split(path, '/')[-1] AS file_name, coalesce(n, 0) AS n_findings,
        CASE WHEN n IS NULL THEN 0.0 ELSE floor((top * 0.6 + total / n * 0.4) * 10 + 0.5) / 10 END AS risk_score,
        len(list_filter(string_split(content, chr(10)), lambda l: trim(l, {WS}) <> ''))::INTEGER AS lines_of_code,
        CASE WHEN regexp_matches(clean, 'pragma\\s+solidity\\s+([^;]+);')
             THEN trim(regexp_extract(clean, 'pragma\\s+solidity\\s+([^;]+);', 1), {WS}) ELSE 'unknown' END AS solidity_version,
        coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low,
        coalesce(n - critical - high - medium - low, 0) AS info
    FROM clean LEFT JOIN counted USING (path)),
summary AS (SELECT *, CASE WHEN critical > 0 THEN 'CRITICAL' WHEN high > 0 THEN 'HIGH' WHEN medium > 0 THEN 'MEDIUM'
        WHEN low > 0 THEN 'LOW' ELSE 'INFO' END AS overall_risk
    FROM (SELECT count(*) AS total_contracts, sum(n_findings)::BIGINT AS total_findings, sum(critical)::BIGINT AS critical,
        sum(high)::BIGINT AS high, sum(medium)::BIGINT AS medium, sum(low)::BIGINT AS low, sum(info)::BIGINT AS info FROM report))"""


def query(select: str, *ctes: str) -> str:
    return f"WITH {','.join(ctes)}\n{select}"


SCAN = (cleaned(ORDERS), rule_rows(RULES), hits(RULES))
FOUND = (*SCAN, SNIPPETS, FINDINGS)
REPORT = (*FOUND, figures())
FOUND_ALL = (*FOUND, EXTERNAL, ALL_FINDINGS)
REPORT_ALL = (*FOUND_ALL, figures("all_findings"))
REPORT_COLUMNS = "path, file_name, n_findings, risk_score, lines_of_code, solidity_version, critical, high, medium, low, info"


def display(column: str, css: dict[str, str], default: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in css.items())
    return f"CASE upper({column}) {cases} ELSE '{default}' END"


SEV_CLASS = {"CRITICAL": "sev-critical", "HIGH": "sev-high", "MEDIUM": "sev-medium", "LOW": "sev-low"}
SEV_ICON = {"CRITICAL": "⬟", "HIGH": "▲", "MEDIUM": "◆", "LOW": "●"}
SEV_LABEL = {"CRITICAL": "Critical", "HIGH": "High", "MEDIUM": "Medium", "LOW": "Low"}
OVERALL = {"CRITICAL": "ov-critical", "HIGH": "ov-high", "MEDIUM": "ov-medium"}
HAS_LINK = "swc <> '' AND swc <> 'custom' AND NOT starts_with(swc, 'slither:')"
RISK_CLASS = "CASE WHEN risk_score >= 7 THEN 'risk-critical' WHEN risk_score >= 4 THEN 'risk-high' WHEN risk_score >= 2 THEN 'risk-medium' ELSE 'risk-low' END"
RISK_TEXT = "printf('%.1f', risk_score)"
N = "chr(10)"

MD_HEADER = f"""'### 📄 ' || file_name || {N} || {N} || '- **Lines of Code:** ' || lines_of_code || {N} || '- **Solidity Version:** `'
    || solidity_version || '`' || {N} || '- **Risk Score:** ' || {RISK_TEXT} || ' / 10' || {N} || '- **Findings:** ' || n_findings
    || {N} || {N} || CASE WHEN n_findings = 0 THEN '✅ No issues detected by the current rule set.' || {N} || {N} ELSE '' END"""
MD_FINDING = f"""'#### [' || severity || '] ' || title || {N} || {N} || '| | |' || {N} || '|---|---|' || {N}
    || '| **ID** | ' || rule_id || ' |' || {N}
    || CASE WHEN swc <> '' THEN '| **SWC** | ' || swc || ' |' || {N} ELSE '' END
    || CASE WHEN cwe <> '' THEN '| **CWE** | ' || cwe || ' |' || {N} ELSE '' END
    || '| **Location** | `' || file || ':' || line || '` |' || {N} || {N} || '**Description**' || {N} || {N} || description || {N} || {N}
    || CASE WHEN code_snippet <> '' THEN '**Code**' || {N} || {N} || '```solidity' || {N} || code_snippet || {N} || '```' || {N} || {N} ELSE '' END
    || '**Recommendation**' || {N} || {N} || recommendation || {N} || {N}
    || CASE WHEN len(refs) > 0 THEN '**References**' || {N} || {N} || array_to_string(list_transform(refs, lambda r: '- ' || r || {N}), '') || {N} ELSE '' END
    || '---' || {N} || {N}"""


def esc(column: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("''", "&#39;"), ("+", "&#43;")):
        column = f"replace({column}, '{char}', '{entity}')"
    return column


LINK = r"""CASE WHEN regexp_matches(r, '^[^/:]*:') AND lower(regexp_extract(r, '^([^/:]*):', 1)) NOT IN ('http', 'https', 'mailto')
    THEN '#ZgotmplZ' ELSE array_to_string(list_transform(regexp_extract_all(r, '%[0-9A-Fa-f]{2}|[A-Za-z0-9!#$&*+,/:;=?@\[\]._~-]+|(?s:.)'),
    lambda p: CASE WHEN regexp_full_match(p, '%[0-9A-Fa-f]{2}|[A-Za-z0-9!#$&*+,/:;=?@\[\]._~-]+') THEN p
    ELSE regexp_replace(lower(hex(encode(p))), '(..)', '%\1', 'g') END), '') END"""
HTML_SCOPE = f"""'<tr><td><span class="fname">📄 ' || {esc('file_name')} || '</span></td><td><span class="sver">' || {esc('solidity_version')}
    || '</span></td><td>' || lines_of_code || '</td><td>' || n_findings || '</td><td><span class="rpill ' || {RISK_CLASS} || '">' || {RISK_TEXT}
    || '/10<span class="mbar"><span class="mbf" style="width:' || trunc(risk_score * 10)::INTEGER || '%"></span></span></span></td></tr>'"""
HTML_HEADER = f"""'<div class="cname">' || {esc('file_name')} || '</div><div class="cstat">' || lines_of_code || ' LOC · Solidity '
    || {esc('solidity_version')} || ' · Risk ' || {RISK_TEXT} || '/10</div>' || CASE WHEN n_findings = 0
    THEN '<div class="noiss">✅ No vulnerabilities detected in this contract.</div>' ELSE '' END"""
HTML_FINDING = f"""'<details class="finding"><summary class="fhead"><span class="sbadge ' || {display('severity', SEV_CLASS, 'sev-info')} || '">'
    || {display('severity', SEV_ICON, '○')} || ' ' || {display('severity', SEV_LABEL, 'Info')} || '</span><div class="fid">'
    || printf('F-%02d', position) || ' · ' || {esc('rule_id')} || CASE WHEN {HAS_LINK} THEN ' <a class="swctag" href="'
    || {esc("'https://swcregistry.io/docs/' || swc")} || '" target="_blank" rel="noopener">' || {esc('swc')} || '</a>' ELSE '' END
    || '</div><div class="ftitle">' || {esc('title')} || '</div><div class="floc">' || {esc('file')} || ':' || line || '</div></summary>'
    || '<div class="fblk"><div class="flbl">Description</div><div class="fdesc">' || {esc('description')} || '</div></div>'
    || CASE WHEN code_snippet <> '' THEN '<div class="fblk"><div class="flbl">Vulnerable Code — line ' || line
       || '</div><div class="codebox"><pre>' || {esc('code_snippet')} || '</pre></div></div>' ELSE '' END
    || '<div class="fblk"><div class="flbl">Recommendation</div><div class="rec">' || {esc('recommendation')} || '</div></div>'
    || CASE WHEN len(refs) > 0 THEN '<div class="fblk"><div class="flbl">References</div><div class="refs">' || array_to_string(
       list_transform(refs, lambda r: '<a href="' || {esc('(' + LINK + ')')} || '" target="_blank" rel="noopener">→ ' || {esc('r')} || '</a>'), '') || '</div></div>' ELSE '' END
    || '</details>'"""


def joined(block: str, separator: str = "''", name: str = "body") -> str:
    return f"bodies AS (SELECT path, string_agg({block}, {separator} ORDER BY position) AS {name} FROM findings GROUP BY path)"


JSON_FINDING = """{'Number': number, 'ID': rule_id, 'Title': title, 'Description': description, 'Severity': severity,
    'SWC': swc, 'CWE': cwe, 'File': file, 'Line': line, 'CodeSnippet': code_snippet, 'Recommendation': recommendation, 'References': refs}"""

CARDS = ("critical", "high", "medium", "low", "info")
HTML_CARDS = (
    f"'<div class=\"' || {display('overall_risk', OVERALL, 'ov-low')} || '\">' || overall_risk || '</div><div class=\"cards\">' || "
    + " || ".join(f"'<div class=\"card c-{c}\"><div class=\"cnum\">' || {c} || '</div><div class=\"clbl\">{c.capitalize()}</div></div>'" for c in CARDS)
    + " || '</div>' || CASE WHEN total_findings > 0 THEN '<div class=\"sbar-track\">' || "
    + " || ".join(f"'<span class=\"b{c[0]}\" style=\"width:' || ({c} * 100) // total_findings || '%\"></span>'" for c in CARDS)
    + " || '</div>' ELSE '' END"
)

MD_COUNTS = (("Contracts Scanned", "total_contracts"), ("Total Findings", "total_findings"), ("🔴 Critical", "critical"),
             ("🟠 High", "high"), ("🟡 Medium", "medium"), ("🔵 Low", "low"), ("⚪ Info", "info"))
MD_SUMMARY = (
    f"'# {parts.TITLE}' || {N} || {N} || '**Generated:** ' || (SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S UTC') FROM events) || '  ' || {N}"
    f" || '**Duration:** 0s  ' || {N} || '**Tool:** {parts.TOOL} v{parts.VERSION}' || {N} || {N} || '---' || {N} || {N} || '## Executive Summary'"
    f" || {N} || {N} || '| Metric | Count |' || {N} || '|---|---|' || {N} || "
    + " || ".join(f"'| {name} | ' || {column} || ' |' || {N}" for name, column in MD_COUNTS)
    + f" || '| **Overall Risk** | **' || overall_risk || '** |' || {N} || {N} || '---' || {N} || {N} || '## Findings by Contract' || {N} || {N}"
)
MATCH = "rule_order, line, occ"
STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S UTC')"

ORACLE: dict[str, str] = {
    "source_dedup": query(f"SELECT {REPORT_COLUMNS} FROM report",
                          cleaned(SHARED), rule_rows(RULES), hits(RULES), SNIPPETS, FINDINGS, figures()),
    "stream_dedup": query(f"SELECT {REPORT_COLUMNS} FROM report",
                          cleaned(SHARED), rule_rows(RULES), hits(RULES), SNIPPETS, FINDINGS, figures()),
    "rescan": query(f"SELECT {REPORT_COLUMNS} FROM report", *REPORT),
    "stream_summary": query("SELECT * FROM summary", *REPORT),
    "rule_catalog": query(
        """SELECT rule_order, rule_id, title, description, severity, swc, cwe, recommendation,
        array_to_string(refs, ' ') AS reference_text, regex, coalesce(n, 0) AS n_findings
        FROM rules LEFT JOIN (SELECT rule_order, count(*) AS n FROM hits GROUP BY 1) USING (rule_order)""", *SCAN),
    "external_findings": query(
        """SELECT path, doc_key, detector_index, rule_id, title, description, severity, swc, cwe, file, line,
        code_snippet, recommendation, array_to_string(refs, ' ') AS reference_text FROM external""", EXTERNAL),
    "loc": query(f"""SELECT path, len(list_filter(string_split(content, chr(10)), lambda l: trim(l, {WS}) <> ''))::INTEGER
        AS lines_of_code FROM src""", f"src AS ({ORDERS} UNION ALL {DOCUMENTS})"),
    "pragma_version": query("SELECT path, solidity_version FROM report", *REPORT),
    "rule_matches": query(f"SELECT path, {MATCH} FROM hits", *SCAN),
    "scan_by_literals": query(
        f"""SELECT path, {MATCH} FROM hits UNION ALL SELECT path, rule_order, (1 + {newlines('before')})::INTEGER, 1::INTEGER
        FROM (SELECT path, (o_orderkey + {len(RULES)})::INTEGER AS rule_order, left(clean, strpos(clean, 'contract C' || o_orderkey || ' {{') - 1) AS before
            FROM clean JOIN (SELECT {corpus.ORDER_PATH} AS path, o_orderkey FROM orders) USING (path))""", *SCAN),
    "scan_unrolled": query(f"SELECT path, {MATCH} FROM hits", *SCAN),
    **dict.fromkeys(("rule_hit_flags", "rule_hit_flags_indexed"), query(
        """SELECT path, coalesce(ids, '') AS rule_ids FROM src LEFT JOIN (SELECT path, string_agg(rule_id, ',' ORDER BY rule_order)
        AS ids FROM (SELECT DISTINCT path, rule_order, rule_id FROM hits JOIN rules USING (rule_order)) GROUP BY path) USING (path)""", *SCAN)),
    "snippets": query(f"SELECT path, {MATCH}, code_snippet FROM snips", *SCAN, SNIPPETS),
    "noted_scan": query(f"SELECT path, {MATCH}, code_snippet FROM snips",
                        cleaned(NOTED), rule_rows(RULES), hits(RULES), SNIPPETS),
    "custom_rule_pack": query("SELECT path, position, rule_id, severity, line, code_snippet FROM findings",
                              cleaned(DOCUMENTS), rule_rows(TEXT_RULES), hits(TEXT_RULES), SNIPPETS, FINDINGS),
    "custom_rule_syntax": query("SELECT path, position, rule_id, line FROM findings",
                                cleaned(NOTED), rule_rows(SYNTAX_RULES), hits(SYNTAX_RULES), SNIPPETS, FINDINGS),
    "custom_rule_added": query(
        "SELECT path, number, line, code_snippet FROM findings WHERE rule_id = 'CX-001'",
        cleaned(ORDERS), rule_rows([*RULES, MINT_RULE]), hits([*RULES, MINT_RULE]), SNIPPETS, FINDINGS),
    "findings_enriched": query(
        """SELECT path, position, number, rule_id, title, description, severity, swc, cwe, file, line, code_snippet,
        recommendation, array_to_string(refs, ' ') AS reference_text FROM findings""", *FOUND),
    "findings_numbered": query("SELECT path, number, rule_id, line FROM findings", *FOUND),
    "findings_sorted": query("SELECT path, position, severity, rule_id, line FROM findings", *FOUND),
    "findings_min_high": query(
        "SELECT path, number, severity, rule_id, line FROM findings", cleaned(ORDERS), rule_rows(RULES),
        hits(RULES, [n for n, r in enumerate(RULES) if r.severity in ("CRITICAL", "HIGH")]), SNIPPETS, FINDINGS),
    "findings_filtered": query(
        "SELECT path, number, severity, rule_id, line FROM findings WHERE severity IN ('HIGH', 'CRITICAL')", *FOUND),
    "findings_with_external": query(
        "SELECT path, position, number, rule_id, severity, line, source_rank FROM all_findings", *FOUND_ALL),
    "finding_links": query(
        f"SELECT path, position, swc, CASE WHEN {HAS_LINK} THEN 'https://swcregistry.io/docs/' || swc END AS url FROM all_findings", *FOUND_ALL),
    "contract_report": query(f"SELECT {REPORT_COLUMNS} FROM report", *REPORT),
    "stream_scan": query(f"SELECT {REPORT_COLUMNS} FROM report", *REPORT),
    "stream_external": query(f"SELECT {REPORT_COLUMNS} FROM report", *REPORT_ALL),
    "contract_report_external": query(f"SELECT {REPORT_COLUMNS} FROM report", *REPORT_ALL),
    "contract_risk": query("SELECT path, n_findings, risk_score FROM report", *REPORT),
    "clean_contracts": query("SELECT path, file_name, lines_of_code FROM report WHERE n_findings = 0", *REPORT),
    "severity_gate": query("SELECT path, critical, high FROM report WHERE critical > 0 OR high > 0", *REPORT),
    "severity_rollup": query(
        """SELECT path, grouping(path)::INTEGER AS level, sum(n_findings)::BIGINT AS n_findings, sum(critical)::BIGINT AS critical,
        sum(high)::BIGINT AS high, sum(medium)::BIGINT AS medium, sum(low)::BIGINT AS low, sum(info)::BIGINT AS info
        FROM report GROUP BY ROLLUP (path)""", *REPORT),
    "summary": query("SELECT * FROM summary", *REPORT),
    "summary_external": query("SELECT * FROM summary", *REPORT_ALL),
    "severity_share": query(
        " UNION ALL ".join(
            f"SELECT '{s}' AS severity, {s.lower()} AS n, CASE WHEN total_findings = 0 THEN 0 ELSE ({s.lower()} * 100) // total_findings END::BIGINT AS pct FROM summary"
            for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")), *REPORT_ALL),
    "risk_bands": query(
        f"SELECT path, risk_score, {RISK_CLASS} AS risk_class, trunc(risk_score * 10)::INTEGER AS risk_bar FROM report", *REPORT),
    "top_risky": query(
        f"""SELECT path, risk_score, n_findings, lines_of_code, solidity_version FROM report
        ORDER BY risk_score DESC, n_findings DESC, path LIMIT {TOP}""", *REPORT),
    "severity_display": query(
        f"""SELECT severity, count(*) AS n, rpad(severity, 8, ' ') AS severity_text,
        {display('severity', SEV_CLASS, 'sev-info')} AS severity_class, {display('severity', SEV_ICON, '○')} AS severity_icon,
        {display('severity', SEV_LABEL, 'Info')} AS severity_label, {display('severity', OVERALL, 'ov-low')} AS overall_class
        FROM all_findings GROUP BY severity""", *FOUND_ALL),
    "contract_nested": query(
        "SELECT path, n_findings, coalesce(body, '') AS order_text FROM report LEFT JOIN bodies USING (path)",
        *REPORT, joined("rule_id || '@' || line", "' '")),
    "contract_listing": query(
        f"""SELECT path, n_findings, {RISK_TEXT} AS risk_text, CASE WHEN n_findings = 0 THEN '✓ ' || file_name ELSE '⚠ ' || file_name
        || '  [' || n_findings || ' finding(s) · Risk ' || {RISK_TEXT} || '/10]' END AS head_text, coalesce(body, '') AS line_text
        FROM report LEFT JOIN bodies USING (path)""",
        *REPORT, joined("'[' || rpad(severity, 8, ' ') || '] ' || title || '  (line ' || line || ')'", N)),
    "report_json": query(
        """SELECT path AS FilePath, to_json({'FileName': file_name, 'FilePath': path, 'Findings': body, 'RiskScore': risk_score,
        'LinesOfCode': lines_of_code, 'SolidityVersion': solidity_version})::VARCHAR AS json FROM report LEFT JOIN bodies USING (path)""",
        *REPORT, f"bodies AS (SELECT path, list({JSON_FINDING} ORDER BY position) AS body FROM findings GROUP BY path)"),
    "report_markdown": query(
        f"SELECT path, {MD_HEADER} || coalesce(body, '') AS text FROM report LEFT JOIN bodies USING (path)", *REPORT, joined(MD_FINDING)),
    "report_markdown_external": query(
        f"SELECT path, 0::INTEGER AS position, {MD_HEADER} AS text FROM report UNION ALL SELECT path, position, {MD_FINDING} FROM all_findings",
        *REPORT_ALL),
    "report_html_external": query(
        f"SELECT path, 0::INTEGER AS position, {HTML_HEADER} AS text FROM report UNION ALL SELECT path, position, {HTML_FINDING} FROM all_findings",
        *REPORT_ALL),
    "report_html_links": query(
        f"""SELECT path, -1::INTEGER AS position, {HTML_HEADER} || coalesce(body, '') AS text FROM report LEFT JOIN bodies USING (path)
        UNION ALL SELECT path, 0::INTEGER, {HTML_HEADER} FROM report UNION ALL SELECT path, position, {HTML_FINDING} FROM findings""",
        cleaned(ORDERS), rule_rows([LINK_RULE]), hits([LINK_RULE]), SNIPPETS, FINDINGS, figures(), joined(HTML_FINDING)),
    "report_json_external": query(
        f"SELECT path AS FilePath, position AS Position, to_json({JSON_FINDING})::VARCHAR AS json FROM all_findings", *FOUND_ALL),
    "contract_listing_external": query(
        f"""SELECT path, 0::INTEGER AS position, CASE WHEN n_findings = 0 THEN '✓ ' || file_name ELSE '⚠ ' || file_name
        || '  [' || n_findings || ' finding(s) · Risk ' || {RISK_TEXT} || '/10]' END AS text FROM report
        UNION ALL SELECT path, position, '[' || rpad(severity, 8, ' ') || '] ' || title || '  (line ' || line || ')' FROM all_findings""",
        *REPORT_ALL),
    "findings_min_high_external": query(
        "SELECT path, position, number, severity, rule_id, line FROM all_findings", cleaned(ORDERS), rule_rows(RULES),
        hits(RULES, [n for n, r in enumerate(RULES) if r.severity in ("CRITICAL", "HIGH")]), SNIPPETS, FINDINGS, EXTERNAL, ALL_FINDINGS),
    "external_repeated": query(
        "SELECT path, n_findings, risk_score, high, info FROM report", *FOUND,
        EXTERNAL.replace("AS doc FROM events)", "AS doc FROM (SELECT * FROM events UNION ALL SELECT * FROM events))"),
        ALL_FINDINGS, figures("all_findings")),
    "skipped_sources": query(
        """SELECT path, 'scanned' AS state, n_findings FROM report WHERE path IN (SELECT path FROM src WHERE content LIKE '%SPDX%')
        UNION ALL SELECT path, 'skipped', NULL FROM src WHERE content NOT LIKE '%SPDX%'""", *REPORT),
    "report_markdown_summary": query(f"SELECT {MD_SUMMARY} AS text FROM summary", *REPORT),
    "report_html_fragment": query(
        f"SELECT path, {HTML_SCOPE} AS scope_html, {HTML_HEADER} || coalesce(body, '') AS findings_html FROM report LEFT JOIN bodies USING (path)",
        *REPORT, joined(HTML_FINDING)),
    "report_html_summary": query(f"SELECT {HTML_CARDS} AS text FROM summary", *REPORT_ALL),
    "run_stamp": f"SELECT event_id, strftime(ts, 'SA-%Y%m%d-%H%M%S') AS report_id, {STAMP} AS timestamp FROM events",
    "fingerprint": f"""SELECT event_id, printf('AUD-%08X', list_reduce(list_transform(range(0, len(h) // 2),
        lambda i: ('0x' || substring(h, 2 * i + 1, 2))::BIGINT), lambda a, b: (xor(a, b) * 16777619) & 4294967295,
        2166136261::BIGINT)) AS fingerprint
        FROM (SELECT event_id, hex(encode({STAMP} || '/é/' || event_type || event_id)) AS h FROM events)""",
    "run_fingerprint": f"""SELECT printf('AUD-%08X', list_reduce(bytes, lambda a, b: (xor(a, b) * 16777619) & 4294967295, 2166136261::BIGINT)) AS fingerprint
        FROM (SELECT flatten(list(list_transform(range(0, len(h) // 2), lambda i: ('0x' || substring(h, 2 * i + 1, 2))::BIGINT) ORDER BY place, path)) AS bytes
        FROM (SELECT 0 AS place, '' AS path, hex(encode({STAMP})) AS h FROM (SELECT max(ts) AS ts FROM events)
            UNION ALL SELECT 1, path, hex(encode(path)) FROM ({ORDERS})))""",
    "strip_comments_chunked": query(
        """SELECT path, line, text FROM (SELECT path, unnest(lines) AS text, generate_subscripts(lines, 1) AS line
        FROM (SELECT path, string_split(clean, chr(10)) AS lines FROM clean)) WHERE text <> ''""", cleaned(NOTED)),
    "strip_comments": query("SELECT path, clean FROM clean", cleaned(ORDERS)),
    "strip_comments_documents": query("SELECT path, clean FROM clean", cleaned(NOTED)),
    "strip_comments_pages": query("SELECT path, clean FROM clean", cleaned(PAGES)),
    **{
        f"rule_{r.rule_id.lower().replace('-', '_')}": query(
            "SELECT path, line, occ FROM hits", cleaned(ORDERS), hits(RULES, [n]))
        for n, r in enumerate(RULES)
    },
}
