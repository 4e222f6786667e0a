import math
import random
import zlib

import numpy as np
from cases import clashing, documents, empty

from codesift.llm import language

SMALL = language.Training(documents=60, excerpts=3, window=32, hidden=6, epochs=20, batch=64)
SYLLABLES = {"aa": "tha wer ing the oud", "bb": "schü ung ein der öst", "cc": "que ción los ñar dez"}


def corpus(spark, n=240):
    random_ = random.Random(2)
    rows = []
    for i in range(n):
        lang = random_.choice(list(SYLLABLES))
        words = ["".join(random_.choices(SYLLABLES[lang].split(), k=random_.randint(1, 3))) for _ in range(30)]
        rows.append((i, " ".join(words), lang))
    return {r[0]: r[2] for r in rows}, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_gradients_equal_differences():
    random_ = np.random.default_rng(0)
    network = language.Network(["a", "b", "c"], 4, 1)
    for name in network.weights:
        network.weights[name] = network.weights[name].astype(np.float64)
    data, labels = random_.integers(97, 123, (5, 7)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    grads = network.gradients(data, labels)

    def loss():
        found = network.positions(network.run(data, "f"), network.run(data, "b"))
        return -np.log(found[:, np.arange(5), labels]).mean()

    for name, grad in grads.items():
        for flat in np.argsort(-np.abs(grad), axis=None)[:5]:
            place, weights = np.unravel_index(flat, grad.shape), network.weights[name]
            old = weights[place]
            weights[place] = old + 1e-2
            more = loss()
            weights[place] = old - 1e-2
            less = loss()
            weights[place] = old
            assert abs((more - less) / 2e-2 - grad[place]) < 1e-3 * max(0.01, abs(grad[place])) + 1e-5, name


def test_held_out_accuracy(spark):
    truth, docs = corpus(spark)
    rows = language.identify(docs, SMALL).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 30 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_rows_are_not_learned_from(spark):
    _, docs = corpus(spark, 120)
    rows = language.training_rows(docs, SMALL)
    changed = docs.selectExpr("doc_id", "text", "if(crc32(cast(string(doc_id) AS binary)) % 4 = 2, 'zz', lang) AS lang")
    assert "zz" not in {r.lang for r in language.training_rows(changed, SMALL).collect()} and rows.count() > 0


def test_windows_hold_every_byte():
    texts = [b"", b"abc", bytes(range(1, 65)) + b"x" * 300, "ÀÉß".encode()]
    table, owner = language.windows_of(texts, 16)
    for i, text in enumerate(texts):
        assert table[owner == i].tobytes().rstrip(b"\0") == text.decode("latin-1").encode("latin-1").lower().replace(
            b"\xc3\x80", b"\xc3\xa0").replace(b"\xc3\x89", b"\xc3\xa9")


def plain_pooled(network, text, width):
    """The pooled probabilities byte by byte, one number at a time for each unit."""
    data = bytearray(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    for i in range(1, len(data)):
        if data[i - 1] == 0xC3 and 0x80 <= data[i] <= 0x9E:
            data[i] += 32
    w, h = {k: v.astype(float) for k, v in network.weights.items()}, network.hidden
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    total, letters = [0.0] * len(network.languages), 0
    for start in range(0, len(data), width):
        part = bytes(data[start:start + width]).ljust(width, b"\0")
        states = {}
        for side, order in (("f", range(width)), ("b", range(width - 1, -1, -1))):
            state = [0.0] * h
            for t in order:
                x = w[f"in_{side}"][part[t]]
                g = [sum(state[i] * w[f"rec_{side}"][i, j] for i in range(h)) for j in range(3 * h)]
                update = [sigmoid(x[j] + g[j]) for j in range(h)]
                reset = [sigmoid(x[h + j] + g[h + j]) for j in range(h)]
                new = [math.tanh(x[2 * h + j] + reset[j] * g[2 * h + j]) for j in range(h)]
                state = [update[j] * state[j] + (1 - update[j]) * new[j] for j in range(h)]
                states[side, t] = state
        for t, byte in enumerate(part):
            if 97 <= byte <= 122 or byte >= 128:
                scores = [
                    sum(states[side, t][j] * w[f"out_{side}"][j, c] for side in "fb" for j in range(h)) + w["bias"][c]
                    for c in range(len(network.languages))]
                powers = [math.exp(s - max(scores)) for s in scores]
                total = [a + p / sum(powers) for a, p in zip(total, powers, strict=True)]
                letters += 1
    return [a / letters for a in total]


def test_prediction_equals_a_plain_network(spark):
    """The query's column against the network byte by byte, over several windows and odd bytes."""
    network = language.Network(["aa", "bb", "cc"], 3, 5)
    texts = ["The OUD", "schÜ ung É" * 4, "x", "12 345 a", "ßÀÞ " * 9, "long text without end " * 5]
    column = language.predict_column(network, 16)
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", column("text").alias("p"))
    for r in frame.collect():
        want = plain_pooled(network, texts[r.id], 16)
        assert r.p.lang_pred == network.languages[int(np.argmax(want))] and abs(r.p.score - max(want)) < 1e-5


def test_odd_rows(spark):
    rows = {r.doc_id: r for r in language.identify(clashing(documents(spark)), SMALL).collect()}
    assert len(rows) == 10  # id 1 twice
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (3, 4, 5))
    assert rows[7].lang_pred in ("en", "de", "fr") and not rows[None].held_out
    assert language.identify(empty(spark), SMALL).count() == 0
    nameless = documents(spark).selectExpr("doc_id", "text", "cast(null AS string) AS lang")
    assert {r.lang_pred for r in language.identify(nameless, SMALL).collect()} == {"und"}
