"""Plain Python forms of the scan, one character or one match at a time."""

import re

WS = "\t\n\x0b\f\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"


def strip(text):
    out, state, quote, i = [], "code", "", 0
    while i < len(text):
        c, two = text[i], text[i:i + 2]
        if state == "line":
            if c == "\n":
                out.append(c)
                state = "code"
        elif state == "block":
            if two == "*/":
                state, i = "code", i + 1
            elif c == "\n":
                out.append(c)
        elif state == "string":
            out.append(c)
            if c == "\\":
                if len(two) == 2 and two[1] != "\0":
                    out.append(two[1])
                    i += 1
            elif c == quote:
                state = "code"
        elif c in "\"'":
            state, quote = "string", c
            out.append(c)
        elif two == "//":
            state, i = "line", i + 1
        elif two == "/*":
            state, i = "block", i + 1
        else:
            out.append(c)
        i += 1
    return "".join(out)


def python_regex(rule):
    """The rule pattern with ASCII classes and without the vertical tab in blanks."""
    return re.compile(rule.regex.replace(r"\s", r"[\t\n\f\r ]"), re.ASCII)


def findings(text, rules):
    """(rule_id, line, snippet) in report order."""
    clean, lines, found = strip(text), text.split("\n"), []
    for order, rule in enumerate(rules):
        for match in python_regex(rule).finditer(clean):
            line = clean.count("\n", 0, match.start()) + 1
            found.append((-rule.rank, line, order, match.start(), rule.rule_id, snippet(lines[line - 1])))
    return [(f[4], f[1], f[5]) for f in sorted(found)]


def snippet(line):
    line = line.strip(WS)
    raw = line.encode()
    return raw[:140].decode(errors="ignore") + "…" if len(raw) > 140 else line


def lines_of_code(text):
    return sum(bool(line.strip(WS)) for line in text.split("\n"))


def version(text):
    match = re.search(r"pragma[\t\n\f\r ]+solidity[\t\n\f\r ]+([^;]+);", strip(text))
    return match[1].strip(WS) if match else "unknown"


def risk(severities):
    weights = {"CRITICAL": 10, "HIGH": 7, "MEDIUM": 4, "LOW": 1.5, "INFO": 0.5}
    values = [weights.get(s.upper(), 0) for s in severities]
    if not values:
        return 0.0
    score = max(values) * 0.6 + (sum(values) / len(values)) * 0.4
    return int(min(score, 10) * 10 + 0.5) / 10
