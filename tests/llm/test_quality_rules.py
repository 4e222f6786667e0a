import math
import random
import re
from collections import Counter

import duckdb
import pytest
from cases import clashing, documents, empty
from pyspark.sql import functions as F

from codesift.llm import quality_rules as rules
from codesift.llm.queries import QUERIES


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


def test_counts_equal_plain_counts(spark):
    random_ = random.Random(5)
    pool = ["a", "b", "the", "É", "x#", "*", "ß$", "\n", "\n", "\t", "\x0b", "long-word", "🙂|"]
    texts = ["".join(random_.choice(pool) + random_.choice([" ", "", "  "]) for _ in range(random_.randint(0, 60))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for r in rules.quality_rules(docs).collect():
        want = plain(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_distance(spark):
    def distance(p, q):
        m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
        part = lambda x: sum(a * math.log2(a / c) for a, c in zip(x, m, strict=True) if a)
        return math.sqrt((part(p) + part(q)) / 2)

    cases = [([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5]), ([0.7, 0.2, 0.1], [0.1, 0.1, 0.8])]
    rows = spark.createDataFrame(cases, "p array<double>, q array<double>")
    got = [r[0] for r in rows.select(rules.jensen_shannon(F.col("p"), F.col("q"))).collect()]
    assert all(abs(a - distance(*c)) < 1e-9 for a, c in zip(got, cases, strict=True)) and got[0] == 1.0


def test_unusual_make_up_is_refused(spark):
    common = ["the", "of", "and", "to", "in"]
    letters = lambda n: "".join(chr(97 + n // 26 ** k % 26) for k in range(4))
    clean = [(i, " ".join(f"{common[j % 5]} word{letters(i * 61 + j)}" for j in range(60)), "en") for i in range(40)]
    odd = [(100, " ".join(f"<{i}|#{i * 7}>=*{i * 3}&" for i in range(120)), "en"), (101, clean[0][1].upper(), None)]
    docs = spark.createDataFrame(clean + odd, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in rules.quality_rules(docs).collect()}
    assert all(kept[i] for i in range(40)) and not kept[100] and not kept[101]


def test_both_histograms_decide(spark):
    """A long list of rare words is refused by its words, prose and a short list are kept."""
    letters = lambda n: "".join(chr(97 + n // 26 ** k % 26) for k in range(5))
    common = "the of and to in a is that it for was on".split()
    prose = [(i, " ".join(w for j in range(60) for w in (common[(i + j) % 12], letters(i * 997 + j * 31), letters(i + j * 7))), "en") for i in range(30)]
    menu = lambda i, n: " | ".join(letters(i * 7919 + j * 13) for j in range(n))
    lists = [(100 + i, menu(i, 300), ["en", None][i % 2]) for i in range(4)] + [(200, menu(9, 40), "en")]
    got = {r.doc_id: r for r in rules.quality_rules(spark.createDataFrame(prose + lists, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i in range(30)) and got[200].kept and got[200].word_distance is None
    for i in range(100, 104):
        assert not got[i].kept and not got[i].base_failed
        assert got[i].class_distance <= rules.Divergence().max_class < 1 and got[i].word_distance > rules.Divergence().max_word


def test_given_documents_are_judged_by_their_words(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op6_quality_rules"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    far = [r for r in rows.join(labels, "doc_id", "left").where("word_distance > 0.30 AND NOT base_failed").collect()]
    assert far and not any(r.quality == 1 or r.kept for r in far)


@pytest.mark.parametrize("odd", [False, True])
def test_query_equals_sql(spark, tmp_path, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    if odd:
        docs = docs.unionByName(documents(spark))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES["op6_quality_rules"](spark, str(tmp_path))
    cursor = connection.execute(f"SELECT {', '.join(got.columns)} FROM ({rules.oracle_sql()})")
    close = lambda row: tuple(round(v, 5) if isinstance(v, float) else v for v in row)
    assert sorted(map(close, got.collect()), key=repr) == sorted(map(close, cursor.fetchall()), key=repr)


def test_odd_rows(spark):
    rows = rules.quality_rules(clashing(documents(spark))).collect()
    assert len(rows) == 11 and all(r.kept is not None for r in rows)
    assert [r.n_words for r in rows if r.doc_id in (3, 4, 5)] == [0, 0, 0]
    assert next(r for r in rows if r.doc_id == 9).n_words == 30_000
    assert next(r for r in rows if r.doc_id == 11).n_dup_lines == 2
    assert rules.quality_rules(empty(spark)).count() == 0
