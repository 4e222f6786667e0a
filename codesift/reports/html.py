"""HTML fragments: a scope row and a block of findings for each file.

Fixed values: the class names, labels and marks of the page, which stand as literals in the functions below.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from codesift.functions.severity import (
    finding_number, has_swc_link, risk_bar, risk_class, severity_class, severity_icon, severity_label, swc_link,
)
from codesift.reports.parts import one_digit, text

# Characters escaped in text, the ampersand first.
ESCAPES = {"\0": "\ufffd", "&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&#34;", "'": "&#39;", "+": "&#43;"}


def escape_text(value: str) -> str:
    for char, entity in ESCAPES.items():
        value = value.replace(char, entity)
    return value


def escape(value: Column) -> Column:
    for char, entity in ESCAPES.items():
        value = F.replace(value, F.lit(char), F.lit(entity))
    return value


# What a link may start with, what stands for a link that may not, and
# the characters besides letters and digits that stay as they are in one.
SCHEMES = ("http", "https", "mailto")
UNSAFE_LINK = "#ZgotmplZ"
LINK_MARKS = "!#$&*+,/:;=?@[]-._~"


def safe_link(url: str) -> str:
    """The URL as it stands in a link: other schemes are refused, other characters written as %xx."""
    scheme, colon, _ = url.partition(":")
    if colon and "/" not in scheme and scheme.lower() not in SCHEMES:
        return UNSAFE_LINK
    kept = re.compile("[A-Za-z0-9" + re.escape(LINK_MARKS) + "]|%[0-9A-Fa-f]{2}")
    parts = re.split(f"({kept.pattern})", url)
    return "".join(
        part if kept.fullmatch(part) else "".join(f"%{byte:02x}" for byte in part.encode("utf-8", "surrogatepass"))
        for part in parts)


def link_column(url: Column) -> Column:
    """``safe_link`` of a column."""
    scheme = F.regexp_extract(url, r"\A([^/:]*+):", 1)
    refused = F.rlike(url, F.lit(r"\A[^/:]*+:")) & ~F.lower(scheme).isin(*SCHEMES)
    plain = "A-Za-z0-9" + re.escape(LINK_MARKS).replace("&", r"\&")
    parts = F.regexp_extract_all(url, F.lit(rf"%[0-9A-Fa-f]{{2}}|[{plain}]++|(?s:.)"), F.lit(0))
    coded = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-8"))), F.lit("(..)"), F.lit("%$1"))
    kept = F.lit(rf"\A(?:%[0-9A-Fa-f]{{2}}|[{plain}]+)\z")
    written = F.array_join(F.transform(parts, lambda p: F.when(F.rlike(p, kept), p).otherwise(coded(p))), "")
    # Most links need no change, and then no character of theirs is looked at alone.
    same = F.rlike(url, F.lit(rf"\A[{plain}]*+\z"))
    return F.when(refused, F.lit(UNSAFE_LINK)).when(same, url).otherwise(written)


def reference_link(url: Column) -> Column:
    return _link(escape(link_column(url)), text("→ ", escape(url)))


def reference_text(url: str) -> str:
    """The same for the text of a rule, made once for each rule."""
    return (f'<a href="{escape_text(safe_link(url))}" target="_blank" rel="noopener">→ {escape_text(url)}</a>')


def _tag(css: str, *body: str | Column, tag: str = "div") -> Column:
    return text(f'<{tag} class="{css}">', *body, f"</{tag}>")


def _link(url: Column, label: Column, css: str = "") -> Column:
    """Both arguments are escaped already."""
    opening = f'<a class="{css}" href="' if css else '<a href="'
    return text(opening, url, '" target="_blank" rel="noopener">', label, "</a>")


def scope_row(c) -> Column:
    score = c["risk_score"]
    bar = text('<span class="mbar"><span class="mbf" style="width:', risk_bar(score), '%"></span></span>')
    cells = [
        _tag("fname", "📄 ", escape(c["file_name"]), tag="span"),
        _tag("sver", escape(c["solidity_version"]), tag="span"),
        c["lines_of_code"],
        c["n_findings"],
        text('<span class="rpill ', risk_class(score), '">', one_digit(score), "/10", bar, "</span>"),
    ]
    return text("<tr>", *[text("<td>", cell, "</td>") for cell in cells], "</tr>")


def header(c) -> Column:
    stat = text(c["lines_of_code"], " LOC · Solidity ", escape(c["solidity_version"]),
                " · Risk ", one_digit(c["risk_score"]), "/10")
    nothing = F.when(
        c["n_findings"] == 0, '<div class="noiss">✅ No vulnerabilities detected in this contract.</div>'
    ).otherwise("")
    return text(_tag("cname", escape(c["file_name"])), _tag("cstat", stat), nothing)


def finding(
    f, position: Column, rule_text: Callable[[Column], Column] = escape, link: Callable[[Column], Column] = reference_link
) -> Column:
    """``rule_text`` escapes the texts that come from the rule and ``link`` writes its
    references; rules whose texts are written already pass functions that return
    their argument."""
    def block(label: str | Column, css: str, body: Column) -> Column:
        return _tag("fblk", _tag("flbl", label), _tag(css, body))

    badge = text(
        '<span class="sbadge ', severity_class(f["severity"]), '">',
        severity_icon(f["severity"]), " ", severity_label(f["severity"]), "</span>",
    )
    swc = rule_text(f["swc"])
    # The class is escaped by now; a link is safe as its start is fixed.
    swc_tag = F.when(has_swc_link(swc), text(" ", _link(swc_link(swc), swc, "swctag"))).otherwise("")
    code = F.when(
        f["code_snippet"] != "",
        block(text("Vulnerable Code — line ", f["line"]), "codebox", text("<pre>", escape(f["code_snippet"]), "</pre>")),
    ).otherwise("")
    links = F.transform(f["references"], link)
    references = F.when(
        F.size(f["references"]) > 0, block("References", "refs", F.array_join(links, ""))
    ).otherwise("")
    return text(
        '<details class="finding"><summary class="fhead">', badge,
        _tag("fid", finding_number(position), " · ", rule_text(f["rule_id"]), swc_tag),
        _tag("ftitle", rule_text(f["title"])),
        _tag("floc", escape(f["file"]), ":", f["line"]),
        "</summary>",
        block("Description", "fdesc", rule_text(f["description"])),
        code,
        block("Recommendation", "rec", rule_text(f["recommendation"])),
        references,
        "</details>",
    )


def severity_cards(s, shares) -> Column:
    """Count cards of the corpus and, when there are findings, the share bar."""
    cards = [
        _tag("card c-" + name, _tag("cnum", s[name]), _tag("clbl", name.capitalize()))
        for name in ("critical", "high", "medium", "low", "info")
    ]
    bar = [
        text(f'<span class="b{name[0]}" style="width:', shares[name], '%"></span>')
        for name in ("critical", "high", "medium", "low", "info")
    ]
    track = F.when(s["total_findings"] > 0, _tag("sbar-track", *bar)).otherwise("")
    return text(_tag("cards", *cards), track)
