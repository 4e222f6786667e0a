import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from cases import clashing, documents, empty

from codesift.llm import substrings


def plain(rows):
    """By every window of every document; equal rows are one document."""
    split = {}
    for doc_id, text in rows:
        split[doc_id is None, doc_id if doc_id is not None else text or "", text or ""] = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    first = {}
    for key in sorted(split):
        for i in range(len(split[key]) - 19):
            first.setdefault(tuple(split[key][i:i + 20]), (key, i))
    out = []
    for doc_id, text in rows:
        key = (doc_id is None, doc_id if doc_id is not None else text or "", text or "")
        words, gone = split[key], set()
        for i in range(len(words) - 19):
            if first[tuple(words[i:i + 20])] != (key, i):
                gone.update(range(i, i + 20))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def shuffled_passages(seed, n):
    """Texts of passages cut from a common pool, with own words between and small changes."""
    random_ = random.Random(seed)
    pool = [f"{k}" for k in range(6)] + ["é\xa0x", "Z"]
    passages = [[random_.choice(pool) for _ in range(random_.choice([10, 19, 20, 21, 22, 30, 45, 120]))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(random_.randint(0, 6)):
            part = list(random_.choice(passages))
            if random_.random() < 0.3 and len(part) > 3:
                part[random_.randrange(len(part))] = "changed"
            words += part[random_.choice([0, 0, 1, 5]):] + [f"own{random_.randrange(10**6)}" for _ in range(random_.choice([0, 0, 1, 7]))]
        rows.append((i * 3 % 101 * 1000 + i, random_.choice([" ", "\n", " \t"]).join(words)))
    return rows


@pytest.mark.parametrize("portion", [1 << 10, 6 << 20])
def test_equals_every_window(spark, monkeypatch, portion):
    rows = shuffled_passages(portion, 150) + [(10**6, None), (10**6 + 1, " \n"), (-5, "a " * 90), (-6, "a " * 21)]
    # Portions of few rows leave most of the work to the groups.
    size = 4 if portion < 1 << 20 else 10_000
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    got = substrings.substring_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_large_group_of_copies_and_a_common_passage(spark):
    random_ = random.Random(4)
    passage = " ".join(f"p{k}" for k in range(25))
    rows = [(i, " ".join(f"c{k}" for k in range(300))) for i in range(400)]
    rows += [(1000 + i, f"a{i} b{i} {passage} c{i} {' '.join(str(random_.random()) for _ in range(30))}") for i in range(400)]
    got = substrings.substring_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_spans(spark):
    words = [f"w{k}" for k in range(40)]
    rows = [(1, " ".join(words)), (2, " ".join(["x", *words[5:30], "y", *words[:19]])), (3, " ".join(words + words))]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # Document 3 holds the first one twice; windows across its middle are new, but all their words are covered.
    assert got == {1: [], 2: [(1, 26)], 3: [(0, 80)]}


def test_hash_of_a_passage_does_not_depend_on_its_place():
    random_ = np.random.default_rng(1)
    words = [str(x).encode() for x in random_.integers(0, 1000, 300)]
    one = substrings.Passage([words], substrings.WordHashes())
    other = substrings.Passage([words[:7], [b"z"] * 50 + words], substrings.WordHashes())
    assert (one.stretches()[2:] == other.stretches()[-len(one.anchors) + 2:]).all()
    assert (one.windows(np.array([5]))[0] == other.windows(np.array([5 + 57]))[0]).all()


def test_sql_and_plain_agree_with_the_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(map(tuple, substrings.substring_report(docs).collect()), key=repr)
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()])
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    assert sorted(con.sql(substrings.ORACLE_SQL).fetchall(), key=repr) == got


def test_odd_rows(spark):
    docs = clashing(documents(spark))
    got = sorted(map(tuple, substrings.substring_report(docs).collect()), key=repr)
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()])
    assert substrings.substring_report(empty(spark)).count() == 0
    # Rows without an id, and rows with one id and different texts.
    text = " ".join(f"t{k}" for k in range(30))
    rows = [(None, text), (None, text), (5, text + " end"), (5, "start " + text), (5, text + " end")]
    got = substrings.substring_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and sorted(r.n_removed for r in got) in ([0, 0, 30, 30, 30], [0, 30, 30, 30, 30])
    assert all(r.n_removed == 30 for r in got if r.doc_id is None)
