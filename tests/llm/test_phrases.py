import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from cases import clashing, documents, empty

from codesift.llm import phrases


def counted(rows):
    """Counts of all phrases of up to five words by language, and the number of words."""
    found, total = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 6):
                found.setdefault(lang, Counter()).update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    return found, total


def plain(rows, least, top):
    out = []
    found, total = counted(rows)
    for lang, f in found.items():
        chosen = []
        often = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        hidden = set()
        for p, a in often.items():
            for z in range(2, len(p)):
                for s in range(len(p) - z + 1):
                    if 100 * a >= 100 * f[p[s:s + z]]:
                        hidden.add(p[s:s + z])
        for p, a in often.items():
            if p not in hidden:
                cuts = [(1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                chosen.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(chosen)[:top], 1):  # noqa: E741
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def texts(seed, n):
    random_ = random.Random(seed)
    common = ["New York City", "as a matter of fact,", "in order to", "É\xa0b", "of the", "the", "of", "a", "to\tto", "x.", "y\n"]
    rows = []
    for _ in range(n):
        words = [random_.choice(common) if random_.random() < 0.6 else f"w{int(random_.paretovariate(0.8))}" for _ in range(random_.randint(0, 80))]
        rows.append((random_.choice(["en", "en", "fr", None]), " ".join(words)))
    return rows


@pytest.mark.parametrize(("sample", "bits", "least"), [(3, 27, 8), (40, 8, 5), (10_000, 27, 12)])
def test_equals_plain_counts(spark, sample, bits, least):
    """Also with a sample that proposes nearly nothing, and a bitmap with many shared places."""
    rows = texts(sample, 300)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = phrases.collocations(docs, least, top=40, sample=sample, bits=bits)
    want = plain(rows, least, 40)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 40
    named = {(r.lang, r.phrase): r.n for r in phrases.frequent_phrases(docs, least, sample=sample, bits=bits).collect()}
    found, total = counted(rows)
    assert named == {(lang, " ".join(p)): a for lang, f in found.items() for p, a in f.items() if a >= least} | {
        (lang, ""): total[lang] for lang in found}


def test_scores_beyond_64_bits(spark):
    a = 4_000_000_000_000
    score = spark.range(1).selectExpr(
        f"{a}L AS a", f"{a}L AS total", "2L AS l", "3L AS r").selectExpr(
        "(CAST(1000 AS DECIMAL(38,0)) * a * total) DIV (CAST(l AS DECIMAL(38,0)) * r * 1000000000000) AS s").first().s
    assert score == 1000 * a * a // (6 * 10**12)


def test_bitmap_holds_what_was_added(spark):
    hashes = np.random.default_rng(2).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    frame = spark.createDataFrame([(int(h),) for h in hashes.view(np.int64)], "hash long")
    assert not phrases.PhraseSet.of(None, 27).holds(hashes).any()
    for most in (12, 27):
        found = phrases.PhraseSet.of(frame, most)
        assert found.holds(hashes).all() and found.bits == min(most, 19)
    assert found.holds(hashes * np.uint64(0x9E3779B97F4A7C15)).mean() < 0.03


def test_given_documents_sql_and_plain(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(path)
    got = sorted(map(tuple, phrases.collocations(docs).collect()))
    assert got == plain([(r.lang, r.text) for r in docs.collect()], 100, 2000)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    assert sorted(con.sql(phrases.ORACLE_SQL).fetchall()) == got


def test_odd_rows(spark):
    docs = clashing(documents(spark))
    got = phrases.collocations(docs, min_count=3, sample=2)
    assert sorted(map(tuple, got.collect())) == plain([(r.lang, r.text) for r in docs.collect()], 3, 2000)
    assert phrases.collocations(empty(spark)).count() == 0
