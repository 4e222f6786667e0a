import random
import re
import time

import brute
import pytest
from pyspark.sql import functions as F

from codesift.functions.dialect import UnsupportedPattern, can_match_nothing, to_jvm
from codesift.operators.scan import rule_hit_flags, scan_sources
from codesift.rules import Rule, RulePack
from codesift.solidity import RULES, solidity_rules


def make_rule(regex, rule_id="X-1", severity="HIGH"):
    return Rule(rule_id, "t", "d", severity, "custom", "", "r", (), regex)


@pytest.mark.parametrize("pattern", [
    r"(?=a)b", r"(?!a)b", r"(?<=a)b", r"(?<!a)b", r"(a)\1", r"a*+", r"a++", r"(?>a)", r"\Z", r"[a", r"(a", r"a)",
    r"*a", r"a{1001}", r"\p{Klingon}", r"\1", r"\8", r"\k<n>", "a\\", r"(?#c)a", r"\h", r"[[:nope:]]",
])
def test_not_translated(pattern):
    with pytest.raises(UnsupportedPattern):
        to_jvm(pattern)


def test_required_literals():
    assert to_jvm(r"\.call\s*\{\s*value\s*:").required == ((".call",), ("value",))
    assert to_jvm(r"\b(owner|admin)\s*=").required == (("owner", "admin"),)
    assert to_jvm(r"abc?d+e(xy)?").required == (("ab",),)
    assert to_jvm(r"ab|cd").required == ()
    assert to_jvm(r"(?i)abc").required == ()
    assert to_jvm(r"(ab|c*)d").required == (("d",),)
    assert to_jvm(r"[^x]@").required == (("@",),)


def test_empty_matches_are_refused():
    assert all(can_match_nothing(p) for p in (r"\b", r"(?m)^", r"\b|x", r"\Q\E", "$"))
    assert not any(can_match_nothing(p) for p in (r"\Qa*\E", r"\bx", r"\p{Greek}+", r"(?m)^a"))
    assert can_match_nothing("a*") and can_match_nothing("a|") and not can_match_nothing("a+")
    with pytest.raises(UnsupportedPattern):
        RulePack([make_rule("a*")])


def test_pack_checks():
    with pytest.raises(ValueError):
        RulePack([make_rule("a"), make_rule("b")])
    assert len(RulePack(make_rule("a", f"X-{n}") for n in range(6000))) == 6000
    with pytest.raises(UnsupportedPattern, match="X-1"):
        RulePack([make_rule("(?=a)")])


# Pattern in RE2 syntax and the same in Python syntax with ASCII classes.
PAIRS = [
    (r"\bab\b", r"\bab\b"), (r"a\b", r"a\b"), (r"\b[aé]", r"\b[aé]"), (r"\B-", r"\B-"), (r"\ba+\B", r"\ba+\B"),
    (r"\b(ab|b)\s", r"\b(ab|b)[\t\n\f\r ]"), (r"\b(a|é)", r"\b(a|é)"), (r"a.b", r"a[^\n]b"), (r"(?s)a.b", r"(?s)a.b"),
    (r"(?i)AB", r"(?i)ab"), (r"(?m)^a", r"(?m)^a"), (r"(?m)b$", r"(?m)b$"), (r"^a", r"\Aa"), (r"b$", r"b\Z"),
    (r"[[:alpha:]]b", r"[A-Za-z]b"), (r"\Qa.\Eb", r"a\.b"), (r"\Qa+", r"a\+"), (r"\141\0", "a\0"), (r"\060b", "0b"), (r"\p{Latin}-", "[A-Za-zéÉ]-"), (r"\P{Latin}b", "[^A-Za-zéÉ]b"), (r"\p{^Latin}b", "[^A-Za-zéÉ]b"), (r"[^[:space:]]b", r"[^\t\n\x0b\f\r ]b"), (r"(?P<n>a)b", r"ab"), (r"\x61\x{62}", r"ab"),
    (r"[\s-]a", r"[\t\n\f\r \-]a"), (r"[a&&b]+", r"[a&b]+"), (r"a{2,3}?", r"a{2,3}?"), (r"a{x", r"a\{x"), (r"\S\W", r"[^\t\n\f\r ]\W"),
    (r"\v", "\x0b"), (r"(?:ab|a)b?", r"(?:ab|a)b?"), (r"\ba{2}", r"\ba{2}"), (r"\b(?i:A)b", r"\b[aA]b"), (r"[]a]b", r"[\]a]b"),
]


def test_translated_patterns_match_alike(spark):
    rng = random.Random(11)
    pieces = ["a", "b", "A", "B", "é", " ", "\n", "\r", "\t", "\x0b", "\x85", " ", "_", "-", "&", "1", "{x", "\\", "]", "[", "\x01"]
    texts = {f"{n}": "".join(rng.choices(pieces, k=rng.randint(0, 30))) for n in range(800)}
    pack = RulePack(make_rule(p, f"P-{n:02d}") for n, (p, _) in enumerate(PAIRS))
    # Quotes and slashes are absent, so the texts hold no comments.
    rows = spark.createDataFrame(list(texts.items()), "path string, content string")
    flags = {r.path: set(r.rule_ids) for r in rule_hit_flags(rows, pack).collect()}
    got = {}
    for row in scan_sources(rows, pack).select("path", F.inline("findings")).collect():
        got.setdefault((row.path, row.rule_order), []).append(row.line)
    for n, (_, python) in enumerate(PAIRS):
        compiled = re.compile(python, re.ASCII)
        for path, text in texts.items():
            want = [text.count("\n", 0, m.start()) + 1 for m in compiled.finditer(text)]
            assert got.get((path, n), []) == want, (PAIRS[n], text)
            assert (f"P-{n:02d}" in flags[path]) == bool(want)


def test_both_rule_forms_and_brute_force_agree(spark):
    rng = random.Random(5)
    pieces = [
        "for", "for (", " (", "(", ")", ".length", ".", "\n", " ", "keccak256(abi.encodePacked(", "keccak256", "block.", "number",
        "timestamp", "a", "\x0b", "owner", "=", "x", "admin = ", "tx.origin", "address", "_k;", "address k = _k;", "0x" + "aB" * 20, "pragma solidity ",
        "^0.7.1;", ".call", "{", "value:", "assembly", "unchecked", "/*", "*/", "//", "'", '"', "\x01", "é", "sha3(", "suicide", "forfor(",
    ]
    texts = {f"{n}": "".join(rng.choices(pieces, k=rng.randint(5, 60))) for n in range(1500)}
    rows = spark.createDataFrame(list(texts.items()), "path string, content string").repartition(4)
    want = {p: brute.findings(t, RULES) for p, t in texts.items()}
    for unroll in (False, True):
        got = {p: [] for p in texts}
        for row in scan_sources(rows, solidity_rules(), unroll=unroll).collect():
            assert [f.position for f in row.findings] == list(range(1, len(row.findings) + 1))
            got[row.path] = [(RULES[f.rule_order].rule_id, f.line, f.code_snippet) for f in row.findings]
        assert got == want
    assert sum(map(len, want.values())) > 2000
    assert {rule for found in want.values() for rule, _, _ in found} >= {"SA-008", "SA-018", "SA-010", "SA-013"}


@pytest.mark.parametrize("rule_id,pieces", [
    ("SA-010", ["address", "address ", "a", " ", "=", "= ", "_k", "_", ";", "\n", "xaddress", "addresses", "address a = _b;", "_ ;", "é", "\x0b"]),
    ("SA-011", ["pragma", " ", "\t", "solidity", "pragma solidity ", "^", ">=", "<", "~", "0.", "1.", "0.6.", "0.8.", "\n", "\x0b", ";"]),
    ("SA-008", ["keccak256", "(", ")", "abi.encodePacked", "keccak256(abi.encodePacked(", "block.", "number", "block.number", " ", "\n", "k", "b"]),
    ("SA-018", ["for", "for(", "for (", "(", ")", ".length", ".", "f", " ", "\n", "forfor("]),
])
def test_linear_forms_against_brute_force(spark, rule_id, pieces):
    rng = random.Random(rule_id)
    texts = {f"{n}": "".join(rng.choices(pieces, k=rng.randint(1, 25))) for n in range(3000)}
    rows = spark.createDataFrame(list(texts.items()), "path string, content string")
    rule = next(r for r in RULES if r.rule_id == rule_id)
    got = {r.path: [f.line for f in r.findings] for r in scan_sources(rows, solidity_rules().only(rule_id)).collect()}
    want = {p: [line for _, line, _ in brute.findings(t, [rule])] for p, t in texts.items()}
    assert got == want and sum(map(len, want.values())) > 100


def test_built_in_rules_stay_linear(spark):
    texts = {
        "address": "address " * 60_000 + "\n" + "address a " * 30_000 + "= x", "blanks": "pragma solidity" + " " * 300_000 + "1",
        "loops": "for (a " * 60_000 + ".length", "no-length": ".length) " + "for (a " * 60_000,
        "random": "block.number keccak256(abi.encodePacked( " * 30_000,
    }
    rows = spark.createDataFrame(list(texts.items()), "path string, content string")
    started = time.time()
    found = {r.path: len(r.findings) for r in scan_sources(rows, solidity_rules()).collect()}
    assert found == {"address": 0, "blanks": 0, "loops": 1, "no-length": 0, "random": 1}
    assert time.time() - started < 30


# Groups repeated without a bound, in RE2 and in Python syntax.
REPEATED = [
    (r"x(?:a|b|\s)*y", r"x(?:a|b|[\t\n\f\r ])*y"), (r"x(?:ab)*abc", r"x(?:ab)*abc"), (r"x(?:ab|cd)*y", r"x(?:ab|cd)*y"),
    (r"x(?:a+b|cd?)+y", r"x(?:a+b|cd?)+y"), (r"(?i)x(?:ab|cd)*y", r"(?i)x(?:ab|cd)*y"), (r"x(?:[a-c]y|d)*", r"x(?:[a-c]y|d)*"),
    (r"(ab|c)+", r"(ab|c)+"), (r"x(?i:a|b)*y", r"x(?i:a|b)*y"), (r"x(?:\w+[ ,])*\.", r"x(?:\w+[ ,])*\."),
]


@pytest.mark.parametrize("pattern,plain", REPEATED)
def test_repeated_groups(spark, pattern, plain):
    rng = random.Random(11)
    texts = ["".join(rng.choice("xabcdyAB ,.") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.regexp_extract_all("t", F.lit(to_jvm(pattern).pattern), F.lit(0)))
    for text, found in rows.collect():
        assert found == [m[0] for m in re.finditer(plain, text, re.ASCII)], text


@pytest.mark.parametrize("pattern", [
    r"x(?:ab|a)*y", r"x(?:a*)*y", r"x(?:a+b?)*y", r"x(?:ab|cd)*a", r"x(?:ab|cd)*?y", r"x(?:(a|b)c)*y", r"x(?:ab|cd)*\b", r"x(?:a+a)*y",
])
def test_ambiguous_repeats_are_refused(pattern):
    with pytest.raises(UnsupportedPattern, match="unbounded repeat"):
        to_jvm(pattern)


@pytest.mark.parametrize("pattern,_", REPEATED)
def test_repeated_groups_on_a_long_text(spark, pattern, _):
    jvm = to_jvm(pattern).pattern
    texts = ["x" + piece * (1_000_000 // len(piece)) for piece in ("ab", "a ", "cd", "abcd", "ab, ")]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    started = time.time()
    rows.select(F.regexp_count("t", F.lit(jvm))).collect()
    assert time.time() - started < 60
