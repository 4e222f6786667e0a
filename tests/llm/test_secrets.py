import hashlib
import math
import random
import re

import pytest
from cases import clashing, documents, empty

from codesift.llm import secrets

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+")


def base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def entropy(text):
    found = []
    for m in CANDIDATE.finditer(text):
        value = m[0]
        if len(value) < 20 or not re.search("[0-9]", value) or not re.search("[A-Za-z]", value):
            continue
        if any(re.search(p, value) for p in secrets.ALLOWED):
            continue
        kind = next(c for c in secrets.CLASSES if re.search(c.pattern, value))
        windows = [value[i:i + kind.window] for i in range(len(value) - kind.window + 1)]
        bits = max(-sum(w.count(c) / len(w) * math.log2(w.count(c) / len(w)) for c in set(w)) for w in windows)
        if bits >= kind.bits:
            found.append((m.start(), 3, m.end()))
    return found


def joined(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def made(seed):
    random_ = random.Random(seed)
    pieces = [
        "password: hunter22", 'API_KEY = "abc', "token='a.b/c=d", "secret=abc", "AKIA" + "A1B2C3D4" * 2, "AKIAAKIA0", "é🙂",
        "deadbeef" * 3, "deadbeef" * 2, "Zx9" * 7, "aB3dE6gH9jK2mN5pQ8sT", "123e4567-e89b-12d3-a456-426614174000", "\n", " ",
        "0123456789abcdefghij", "EXAMPLEkey0123xyzuvw88q", "passwd=token=abcdefgh", "aaaaaaaaaaaaaaaaaaaaaaaa1", "q8" * 40,
    ]
    return "".join(random_.choice(pieces) + random_.choice(["", " ", "x", ","]) for _ in range(random_.randint(0, 12)))


def test_spans_equal_plain_search(spark):
    texts = [made(i) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in secrets.secret_report(docs).collect():
        spans = base(texts[row.doc_id])
        assert row.base_sha256 == hashlib.sha256(joined(spans).encode()).hexdigest(), texts[row.doc_id]
        assert row.spans == joined(spans + entropy(texts[row.doc_id])), texts[row.doc_id]
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))


SSH_KEY = "b3BlbnNzaC1rZXktdjEAAAAABG5vbmUAAAAEbm9uZQAAAAAAAAABAAAAMwAAAAtzc2gtZW"
SECRET = "aB3dE6gH9jK2mN5pQ8sT"


def test_secrets_that_hold_a_harmless_string(spark):
    found = [SSH_KEY, SSH_KEY + "QyNTUxOQAAACBq7vX2mZk9Lw" * 20, SECRET + "example", "example" + SECRET, SECRET + "0123456789", "b" * 9 + SECRET, "x" * 30 + SECRET]
    passed = [
        "EXAMPLEkey0123xyzuvw88q", "0123456789abcdefghij", "01234567890" + SECRET[:19], "b" * 9 + SECRET[:19], "placeholder" + SECRET[:19],
        SECRET[:19] + "dummy" + SECRET[:19], "123e4567-e89b-12d3-a456-426614174000",
    ]
    texts = [f"see {value} end" for value in found + passed]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.n_entropy for r in secrets.secret_report(docs).collect()}
    assert [spans[i] for i in range(len(texts))] == [1] * len(found) + [0] * len(passed)
    clean = secrets.without_secrets(docs).orderBy("doc_id").collect()
    assert [r.text for r in clean[:len(found)]] == ["see [SECRET] end"] * len(found)


def test_long_values_with_harmless_strings(spark):
    for value in ("a" * 200_000 + "1", ("abcdefghij" + "Q7" * 5) * 10_000, "dummy1" * 30_000):
        (row,) = secrets.secret_report(spark.createDataFrame([(1, value)], "doc_id long, text string")).collect()
        assert row.n_entropy == 0


def test_odd_rows(spark):
    rows = secrets.secret_report(clashing(documents(spark))).collect()
    assert len(rows) == 11 and all(r.spans == "" for r in rows)
    assert secrets.secret_report(empty(spark)).count() == 0
    long_text = "token=" + "a1B2" * 50_000 + " end"
    (row,) = secrets.secret_report(spark.createDataFrame([(1, long_text)], "doc_id long, text string")).collect()
    assert row.n_assign == 1 and row.spans.startswith("assign:0:200006")


@pytest.mark.parametrize("name", ["n_chars", "other"])
def test_removal(spark, name):
    docs = spark.createDataFrame(
        [(1, "my token = abcdef12 is deadbeef" + "0" * 20, 7), (2, "clean", 5), (3, None, None)], f"doc_id long, text string, {name} long")
    one, two, three = secrets.without_secrets(docs).orderBy("doc_id").collect()
    assert one.text == "my [SECRET] is [SECRET]" and one[name] == (len(one.text) if name == "n_chars" else 7)
    assert tuple(two) == (2, "clean", 5) and tuple(three) == (3, None, None)
