import numpy as np
import pytest
import sentencepiece
from cases import documents
from test_mixing import shared
from test_secrets import base, entropy
from test_simhash import plain_components, plain_fingerprint

import corpus_pipeline
from codesift.llm import pieces, quality_model
from codesift.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def redacted(text):
    out, at = "", 0
    for start, _, end in sorted(base(text) + entropy(text)):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The input and what each stage made of it, as rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        target = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, SF).write.parquet(target)
        docs = spark.read.parquet(target)
        found.append(docs.collect())
        assert i == 4 or docs.columns == list(found[0][0].__fields__)
    return found


def test_quality(spark, steps):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    good = {r.doc_id for r in quality_model.quality_scores(docs, labels).where("predicted = 1").collect()}
    assert {tuple(r) for r in steps[1]} == {tuple(r) for r in steps[0] if r.doc_id in good}
    assert 0 < len(steps[1]) < len(steps[0])


def test_near_duplicates(steps):
    rows = sorted(steps[1], key=lambda r: r.doc_id)
    roots = plain_components(np.array([plain_fingerprint(r.text) for r in rows], np.uint64))
    first = {}
    for row, root in zip(rows, roots, strict=True):
        first.setdefault(root, row)
    assert sorted(map(tuple, steps[2])) == sorted(map(tuple, first.values()))


def test_secrets(steps):
    before, after = ({r.doc_id: r for r in rows} for rows in steps[2:4])
    assert before.keys() == after.keys()
    for i, row in after.items():
        assert row.text == redacted(before[i].text)
        assert row.n_chars == (len(row.text) if row.text != before[i].text else before[i].n_chars)


def test_mix(steps):
    sizes, taken, largest = {}, {}, {}
    for r in steps[3]:
        n = len(r.text.split(" "))
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
        largest[r.source] = max(largest.get(r.source, 0), n)
    for r in steps[4]:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    for source, target in shared(sizes).items():
        assert abs(taken.get(source, 0) - target) <= largest[source]
    times = [sum(r.doc_id == d for r in steps[4]) for d in {r.doc_id for r in steps[3]}]
    assert max(times) == 2 and {tuple(r) for r in steps[4]} <= {tuple(r) for r in steps[3]}


def test_encoding(steps):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert len(steps[5]) == len(steps[4])
    want = {r.doc_id: r.text for r in steps[4]}
    for r in steps[5]:
        assert r.decoded == want[r.doc_id] and r.ids == library.encode(r.decoded) and r.n_tokens == len(r.ids)


def test_run_and_registration(spark, steps):
    rows = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens").collect()
    assert sorted(map(tuple, rows)) == sorted((r.doc_id, r.n_tokens) for r in steps[5])
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_odd_rows_in_every_stage(spark):
    from pyspark.sql import functions as F

    docs = documents(spark).withColumns({n: F.lit("clash") for n in ("row", "uid", "fp", "stats", "ids", "copies", "clean", "size")})
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.where("false")):
            out = stage(spark, rows, SF)
            assert out.columns == docs.columns or name.startswith("SentencePiece")
            assert (out.count() > 0) == (rows is docs)
