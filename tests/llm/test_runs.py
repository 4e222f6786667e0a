import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from cases import clashing, documents, empty

from codesift.llm import runs


def plain_runs(words):
    """All maximal stretches with a smallest period, by every lag."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            # The smallest period wins where two describe the same stretch.
            if j - i + q >= max(6, 4 * q) and (i, j + q) not in found:
                found[i, j + q] = q
            i = j
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_report(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = [w for i, w in enumerate(words) if i not in gone]
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in ("".join(f"{s},{length},{q}\n" for s, length, q in found), " ".join(kept))]
    return (doc_id, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], *sha)


def texts_with_runs(seed, n, longest):
    random_ = random.Random(seed)
    texts = []
    for _ in range(n):
        pool = [f"w{k}" for k in range(random_.choice([1, 2, 3, 8, 300]))]
        words = []
        while len(words) < random_.randint(0, longest):
            unit = [random_.choice(pool) for _ in range(random_.choice([1, 2, 3, 5, 9, 16, 17, 31, 32, 33, 40, 64, 65, 100]))]
            words += (unit * random_.choice([1, 1, 3, 4, 5, 6]))[:random_.randint(1, 500)]
            words += [random_.choice(pool) for _ in range(random_.randint(0, 4))]
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("seed", range(4))
def test_find_runs(seed):
    for text in texts_with_runs(seed, 40, 900):
        words = text.split()
        numbers = np.array([-1, *[int(w[1:]) for w in words], -2])
        got = [(s - 1, length, q) for s, length, q in runs.find_runs(numbers, len(words))]
        assert got == plain_runs(words), text


def test_report_equals_plain_search(spark):
    texts = [*texts_with_runs(9, 120, 600), None, "", " \t\n", "a " * 50, "É\xa0x \x0b y" * 9]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 2
    got = runs.run_report(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.columns[0] == "doc_id" and dict(got.dtypes)["exponent_milli"] == "bigint"
    want = sorted((plain_report(*r) for r in rows), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert any(r[1] for r in want)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 12_000]
    got = runs.run_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted((plain_report(*r) for r in rows))


def test_odd_rows(spark):
    docs = clashing(documents(spark))
    assert sorted(map(tuple, runs.run_report(docs).collect()), key=repr) == sorted(
        (plain_report(r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert runs.run_report(empty(spark)).count() == 0


def test_long_hostile_texts():
    """Nested and broken repeats of many sizes stay near linear."""
    fib = ["a", "b"]
    while len(fib) < 100_000:
        fib = fib + fib[:len(fib) * 5 // 8]
    numbers = np.array([-1, *[ord(w) for w in fib], -2])
    assert all(length >= 4 * q for _, length, q in runs.find_runs(numbers, len(fib)))
    line = list(range(40)) + [99]
    broken = sum(([*line, 1000 + k] for k in range(3000)), [])
    assert runs.find_runs(np.array([-1, *broken, -2]), len(broken)) == []
