import random
from collections import Counter

import pytest
from cases import clashing, documents, empty

from codesift.llm import mixing


def shared(sizes, weights=(5, 2, 1)):
    """Shares by weight, the excess of full sources reshared until none is above."""
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {n: weights[i % 3] for i, n in enumerate(names)}
    mass, fixed, rest = 1.5 * sum(sizes.values()), {}, set(names)
    while True:
        total = sum(weight[n] for n in rest)
        level = (mass - sum(fixed.values())) / total if rest else 0
        over = [n for n in rest if level * weight[n] > 2 * sizes[n] + 1e-9]
        if not over:
            return fixed | {n: level * weight[n] for n in rest}
        for n in over:
            fixed[n] = 2.0 * sizes[n]
            rest.discard(n)


def corpus(spark, seed, n):
    random_ = random.Random(seed)
    rows = [(i, " ".join(["w"] * int(random_.lognormvariate(3, 1))), random_.choice(["a", "b", "Z", "é", None, "a", "a"])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("block", [8, 256])
def test_targets_and_takes(spark, block):
    rows, docs = corpus(spark, 1, 3000)
    out = mixing.mix(docs, block=block).collect()
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in out:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken in (0, r.size, 2 * r.size) and r.size == len(rows[r.doc_id][1].split())
    want = shared(sizes)
    assert len(out) == 3000
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * want[r.source] + 1e-9
    for source in sizes:
        # Small blocks leave few small documents for the last level.
        near = max(2, 0.003 * want[source], (block < 256) * 0.5 * largest[source])
        assert abs(taken[source] - want[source]) <= near, (source, taken[source], want[source])
    again = mixing.mix(docs.repartition(13), block=block).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in out)


def test_chance_follows_probability(spark):
    """Over many draws a unit is taken about as often as its probability says."""
    units = [(f"s{g}", 10 + g % 3, g * 10 + k, 0, 0.3) for g in range(600) for k in range(10)]
    frame = spark.createDataFrame(units, "source string, size long, uid long, copy long, p double")
    got = mixing.pivotal_rounding(frame).collect()
    assert len(got) == 6000
    by_place = Counter(r.uid % 10 for r in got if r.extra)
    assert all(130 < by_place[k] < 230 for k in range(10)), by_place


def test_rows_without_an_id_and_repeated_ids(spark):
    """As many rows come out as went in, each with its own size."""
    random_ = random.Random(6)
    rows = [(random_.choice([None, -1, -1, 0, 5, -(2**62), 2**62]), " ".join("w" * random_.randint(0, 9)), random_.choice(["a", None])) for _ in range(900)]
    rows += [(None, "same words here", "a")] * 300 + [(-1, "same words here", "a")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs).collect()
    size = lambda t: len((t or "").split())
    assert Counter((r.doc_id, r.source, r.size) for r in out) == Counter((d, s, size(t)) for d, t, s in rows)
    want = shared({s: sum(size(t) for _, t, x in rows if x == s) for s in ("a", None)})
    for source in ("a", None):
        assert abs(sum(r.taken for r in out if r.source == source) - want[source]) <= 3
    assert all(r.taken in (0, r.size, 2 * r.size) for r in out)
    again = mixing.mix(docs.repartition(3)).collect()
    assert Counter((r.doc_id, r.source, r.size, r.taken) for r in again) == Counter((r.doc_id, r.source, r.size, r.taken) for r in out)
    sizes = docs.selectExpr("doc_id", "source", "CAST(length(text) AS long) AS size")
    for split in (1, 7, 100_000):
        numbered = mixing._numbered(sizes, split)
        assert numbered.count() == len(rows) == numbered.select("uid", "copy").distinct().count()


def test_odd_rows(spark):
    rows = mixing.mix_report(clashing(documents(spark))).collect()
    assert len(rows) == 11 and all(r.taken <= 2 * r["size"] for r in rows)
    assert all(r.taken == 0 for r in rows if r.doc_id in (3, 4, 5))
    assert mixing.mix_report(empty(spark)).count() == 0


def test_mixed_rows(spark):
    _, docs = corpus(spark, 2, 200)
    want = Counter({r.doc_id: r.copies for r in mixing.mix(docs, doc_id="doc_id").collect()})
    got = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert sum(got.values()) > 0 and mixing.mixed(docs).columns == docs.columns
    assert max(got.values()) <= 2 and abs(sum(got.values()) - sum(want.values())) < 40
