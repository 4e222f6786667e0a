import random

import brute
import pytest
from pyspark.sql import functions as F

from codesift.functions.comments import strip_comments
from codesift.functions.stamps import fingerprint, run_id, run_timestamp
from codesift.functions.text import base_name, clip_bytes, lines_of_code, solidity_version, trim_blank

CASES = {
    "// tx.origin\ntx.origin": "\ntx.origin",
    "/* a\n b */ tx.origin": "\n tx.origin",
    'x = "tx.origin";': 'x = "tx.origin";',
    's = "http://a"; tx.origin': 's = "http://a"; tx.origin',
    's = "a\\"// b"; tx.origin': 's = "a\\"// b"; tx.origin',
    "it's // tx.origin\n tx.origin": "it's // tx.origin\n tx.origin",
    "tx./**/origin": "tx.origin",
    "/* tx.origin": "",
    "/*/ tx.origin */ tx.origin": " tx.origin",
    "a / b // c": "a / b ",
    "/** x **/y/***/z": "yz",
    '"open // string': '"open // string',
    '"ends in a backslash\\': '"ends in a backslash\\',
    "": "",
}


def column(spark, texts, expression):
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    return [r.v for r in rows.select("n", expression(F.col("t")).alias("v")).orderBy("n").collect()]


def test_comment_cases(spark):
    assert column(spark, list(CASES), strip_comments) == list(CASES.values())
    assert [brute.strip(t) for t in CASES] == list(CASES.values())


def test_comments_against_state_machine(spark):
    rng = random.Random(7)
    pieces = ["//", "/*", "*/", "/", "*", '"', "'", "\\", "\n", "\r\n", "a", " tx.origin ", "é", "\x01", "/*/", "\\\"", "😀"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 40))) for _ in range(3000)]
    assert column(spark, texts, strip_comments) == list(map(brute.strip, texts))


def test_long_tokens_do_not_recurse(spark):
    texts = ['"' + "\\n" * 200_000 + '" // x', "/*" + "* \n" * 200_000 + "*/x", "'" * 100_001 + "// y", "/" * 300_000]
    assert column(spark, texts, strip_comments) == list(map(brute.strip, texts))


def test_lines_and_versions(spark):
    texts = [
        "// a\r\ntx.origin;\t\xa0\r\n", "", "tx.origin", "\x01tx.origin\x01\n\x01", "a\n \n\t\r\n\xa0\nb",
        "pragma solidity  ;", "pragma solidity ;", "pragma\nsolidity\n 0.8.1 ;", "// pragma solidity ^0.7.0;",
        "pragma solidity 0.8.24;", "pragma solidity ^0.8.0; pragma solidity 1;", "pragma solidity 0.8", "x;",
        "pragma solidity ; pragma solidity 0.4.1;", "pragma solidity 1\x0b　;", "xpragma solidity\f>=1 <2;",
    ]
    assert column(spark, texts, lines_of_code) == list(map(brute.lines_of_code, texts))
    cleaned = lambda c: solidity_version(strip_comments(c))
    assert column(spark, texts, cleaned) == list(map(brute.version, texts))


def test_many_open_pragmas_are_fast(spark):
    assert column(spark, ["pragma solidity 0 " * 60_000], solidity_version) == ["unknown"]


def test_trim_and_clip(spark):
    texts = ["\x85 tx.origin　", "tx.origin " + "é" * 100, "tx.origin  " + "é" * 100, "a" * 140, "a" * 141,
             "x" * 138 + "😀y", "", "​ kept"]
    both = lambda c: clip_bytes(trim_blank(c))
    assert column(spark, texts, both) == list(map(brute.snippet, texts))


def test_base_name(spark):
    assert column(spark, ["/a/b.sol", "b.sol"], base_name) == ["b.sol", "b.sol"]


def test_stamps(spark):
    row = spark.sql("SELECT timestamp'2025-07-01 14:30:22.9' AS ts").select(
        run_id(F.col("ts")).alias("id"), run_timestamp(F.col("ts")).alias("at")
    ).first()
    assert (row.id, row.at) == ("SA-20250701-143022", "2025-07-01 14:30:22 UTC")


@pytest.mark.parametrize("text", ["", "a", "/src/é😀.sol", "2025-07-01 14:30:22 UTC/x.sol"])
def test_fingerprint(spark, text):
    h = 2166136261
    for byte in text.encode():
        h = ((h ^ byte) * 16777619) % 2**32
    assert column(spark, [text], lambda c: fingerprint(F.lit(""), c)) == [f"AUD-{h:08X}"]
