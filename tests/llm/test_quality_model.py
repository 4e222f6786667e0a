import random
import zlib

import numpy as np
from cases import clashing, documents, empty

from codesift.llm import quality_model as model

SMALL = model.Kernel(features=64)


def corpus(spark, n=400):
    random_ = random.Random(1)
    rows = []
    for i in range(n):
        good = random_.random() < 0.7
        words = ["".join(random_.choice("abcdeilmnorst") for _ in range(random_.randint(2, 9))) for _ in range(80)]
        rows.append((i, " ".join(words if good else [w.upper() + "!!" for w in words]), int(good)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(0, None), (9999, 1)], "doc_id long, quality int")
    return {r[0]: r[2] for r in rows}, docs, labels


def test_held_out_accuracy_and_folds(spark):
    truth, docs, labels = corpus(spark)
    rows = model.quality_scores(docs, labels, SMALL).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    # Labels of held-out rows change nothing.
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(string(doc_id) AS binary)) % 5 = 0, 1 - quality, quality) AS quality")
    again = {r.doc_id: r.score for r in model.quality_scores(docs, flipped, SMALL).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in rows)


def test_normal_equations_equal_plain_sums(spark):
    _, docs, labels = corpus(spark, 60)
    stats = model.text_statistics(docs).join(labels.dropna(), "doc_id")
    table = stats.toPandas()
    x = np.stack(table["stats"])
    fitted = model.QualityModel(SMALL, x.mean(axis=0), np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0))
    z = fitted.features(x)
    want = np.hstack([z.T @ z, (z.T @ table["quality"].to_numpy())[:, None]])
    got = model._normal_equations(stats.select("stats", "quality").repartition(7), fitted)
    assert np.allclose(got, want)


def test_isotonic():
    random_ = np.random.default_rng(0)
    y, w = random_.normal(size=30) + np.arange(30) / 10, random_.uniform(0.5, 2, 30)
    fit = model.isotonic(y, w)
    assert (np.diff(fit) >= -1e-12).all() and abs((fit * w).sum() - (y * w).sum()) < 1e-9
    # The least squares of all monotone fits: max-min formula.
    mean = lambda a, b: (y[a:b + 1] * w[a:b + 1]).sum() / w[a:b + 1].sum()
    want = [max(min(mean(a, b) for b in range(i, 30)) for a in range(i + 1)) for i in range(30)]
    assert np.allclose(fit, want)


def test_odd_rows(spark):
    _, _, labels = corpus(spark, 40)
    rows = model.quality_scores(clashing(documents(spark)), labels, SMALL).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows) and not next(r for r in rows if r.doc_id is None).held_out
    assert len({r.score for r in rows if r.doc_id in (3, 4)}) == 1
    assert model.quality_scores(empty(spark), labels, SMALL).count() == 0
    unlabelled = model.quality_scores(documents(spark), labels.where("false"), SMALL).collect()
    assert {r.score for r in unlabelled} == {0.5}
    docs = documents(spark)
    assert model.accepted(docs, labels.where("false"), SMALL).columns == docs.columns
