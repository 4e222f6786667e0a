import random
import struct

import pytest
import sentencepiece
from cases import clashing, documents, empty

from codesift.llm import pieces

ALPHABET = "abcdeAB  ▁ééßñ中文の, .\n\t<0x41>🙂0123_=the ing"


def texts(n, seed=1):
    random_ = random.Random(seed)
    return ["".join(random_.choice(ALPHABET) for _ in range(random_.randint(0, 40))) for _ in range(n)]


def field(number, kind, value):
    def varint(v):
        out = b""
        while v > 127:
            out, v = out + bytes([v & 127 | 128]), v >> 7
        return out + bytes([v])

    body = varint(len(value)) + value if kind == 2 else struct.pack("<f", value) if kind == 5 else varint(value)
    return varint(number << 3 | kind) + body


def unigram_model():
    """A small unigram model written by hand."""
    random_ = random.Random(5)
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    rows += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    found = {"▁", *"abcdehtin,."} | {"".join(random_.choice("▁abcdethin") for _ in range(random_.randint(2, 4))) for _ in range(150)}
    rows += [(p, -1.0 - 5 * random_.random(), 1) for p in sorted(found)]
    model = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, s) + field(3, 0, k)) for p, s, k in rows)
    trainer = field(3, 0, 1) + field(35, 0, 1)
    return model + field(2, 2, trainer) + field(3, 2, field(1, 2, b"identity") + field(3, 0, 1) + field(4, 0, 0))


@pytest.mark.parametrize("model", [pieces.model_bytes(), unigram_model()], ids=["merges", "unigram"])
def test_equal_to_the_library(model):
    mine, library = pieces.PieceTransducer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for text in texts(4000):
        assert mine.encode(text) == library.encode(text), text
        assert mine.decode(mine.encode(text)) == library.decode(library.encode(text)), text


def test_round_trip_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = pieces.encoding_report(docs).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    whole = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(whole) and all(r.round_trip for r in rows)
    for r in rows:
        assert r.ids == library.encode(whole[r.doc_id] or "") and r.n_tokens == len(r.ids)


def test_refused_models():
    broken = field(1, 2, field(1, 2, b"<unk>") + field(3, 0, 2)) + field(1, 2, field(1, 2, b"x") + field(3, 0, 4))
    with pytest.raises(ValueError, match="user-defined"):
        pieces.PieceTransducer(broken)


def test_words_are_dropped_and_found_again():
    asked = []
    words = pieces.KnownWords(lambda w: asked.append(w) or (len(w),), most=8)
    for w in ["a", "b", "a", "c", "d", "e", "f", "a", "x" * 100, "x" * 100]:
        assert words[w] == (len(w),)
    assert asked.count("a") == 1 and asked.count("x" * 100) == 2 and len(words) + len(words.older) <= 8


def test_column_of_pieces(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("ein Text",), ("",), (" zwei  ",)], "text string")
    model = pieces.model_bytes()
    coded = pieces.encoded(rows).select("text", pieces.decode_column(model)(F.col("ids")).alias("again"))
    assert all(r.text == r.again for r in coded.collect())


def test_odd_rows(spark):
    rows = pieces.encoding_report(clashing(documents(spark))).collect()
    assert len(rows) == 11 and all(r.round_trip for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4)} == {0}
    assert pieces.encoding_report(empty(spark)).count() == 0
    (kept,) = pieces.encoding_report(spark.createDataFrame([(1, "a▁b")], "doc_id long, text string")).collect()
    assert not kept.round_trip
