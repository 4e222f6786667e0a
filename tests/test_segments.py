import random
import re
import time

import pytest
from pyspark.sql import functions as F

from codesift.functions.dialect import UnsupportedPattern, to_jvm
from codesift.functions.segments import linear_form
from codesift.solidity import RULES

MARK = "\x01"


def starts(spark, patterns, texts):
    """Match starts by the linear forms, as the scan marks them."""
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    columns = [F.regexp_replace("t", F.lit(linear_form(p)), "$1" + MARK + "$2").alias(f"c{i}") for i, p in enumerate(patterns)]
    found = {}
    for r in frame.select("id", *columns).collect():
        for i in range(len(patterns)):
            at, out = 0, []
            for part in r[f"c{i}"].split(MARK)[:-1]:
                at += len(part)
                out.append(at)
            found[i, r.id] = out
    return found


def plain(pattern, text):
    python = re.compile(pattern.replace(r"[^\s]", r"[^\t\n\f\r ]").replace(r"\s", r"[\t\n\f\r ]").replace(r"\z", r"\Z"), re.ASCII)
    return [m.start() for m in python.finditer(text)]


def random_pattern(random_):
    head = random_.choice([r"\ba", "a", "ab", r"a\s*b", r"a\s+b", r"ab\b", "a[bc]", r"\bab\b", "aa", r"a\s*a"])
    gap = random_.choice(["[^x]", "[^xy]", "[^)]", "[^x\\n]", ".", r"[^\s]", "[^=\\n]"])
    gap += random_.choice(["*", "*", "+", "*?", "+?", "{0,}"])
    tail = random_.choice(["c", "x", "bc", "xb", r"\bc", r"=\s*_\w+\s*;", "(b|cc)", r"x(b|c)?", "[bc]c", r"c\b", r"b\s*c", ")", "[xy]a", "cb?", r"\n"])
    return head + gap + tail


@pytest.mark.parametrize("seed", range(3))
def test_random_patterns_match_at_the_same_places(spark, seed):
    random_ = random.Random(seed)
    patterns = list(dict.fromkeys(p for p in (random_pattern(random_) for _ in range(150)) if linear_form(p)))
    assert len(patterns) > 25
    texts = ["".join(random_.choice("aaabbccxy) =_;\n\té") for _ in range(random_.randint(0, 40))) for _ in range(400)]
    found = starts(spark, patterns, texts)
    for (i, n), got in found.items():
        assert got == plain(patterns[i], texts[n]), (patterns[i], linear_form(patterns[i]), texts[n])


def test_rules_with_a_form_by_hand_get_one(spark):
    by_hand = [r.regex for r in RULES if r.rule_id in ("SA-008", "SA-010", "SA-018")]
    assert all(map(linear_form, by_hand))
    random_ = random.Random(5)
    pieces = ["for (", "for(", ".length", ")", "address", "address ", "=", " _x", ";", "\n", "keccak256(abi.encodePacked(", "block.timestamp", "a", "xaddress", " "]
    texts = ["".join(random_.choice(pieces) for _ in range(random_.randint(0, 25))) for _ in range(800)]
    found = starts(spark, by_hand, texts)
    assert all(got == plain(by_hand[i], texts[n]) for (i, n), got in found.items()) and sum(map(len, found.values())) > 50


def test_other_patterns_are_left_alone():
    for pattern in ("abc", "a.{0,80}b", "(?i)a[^x]*b", "a[^x]*", "(a|b)[^x]*c", "[^x]*a", "a[^x]*b[^y]*c", "a[^x]*b|c", "a+[^x]*b", "é[^x]*b", "a[^x]*é", r"a\s*[^x]*b", r"(?s)a.*b"):
        assert linear_form(pattern) is None, pattern


@pytest.mark.parametrize("pattern", [r"head[^x]*tail", r"\bhead\b[^=\n]*=\s*tail", r"h.*tail", r"head[^x]+?tail"])
def test_linear_on_a_megabyte(spark, pattern):
    text = "head " * 200_000
    frame = spark.createDataFrame([(text,)], "t string")
    started = time.perf_counter()
    assert frame.select(F.rlike("t", F.lit(linear_form(pattern)))).first()[0] is False
    assert time.perf_counter() - started < 5
    try:
        to_jvm(pattern)
    except UnsupportedPattern as error:  # pragma: no cover
        raise AssertionError(pattern) from error
