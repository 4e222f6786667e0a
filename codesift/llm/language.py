"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes, upper case folded, in windows. Two gated recurrent layers
run over a window, one from each side; at every byte their states give
probabilities of the languages. A document's probabilities are the mean over its letter
bytes in all windows, so the whole text counts. The network is trained in numpy by
backpropagation through the whole window.

Training sample (documented bound): for each language the ``documents`` labelled rows with
the smallest hash of their id, among rows whose fold is not ``HELD_OUT``, and
``excerpts`` windows from places spread over each text. Prediction runs in Arrow batches
inside Spark tasks and sees the text only.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without
any labelled row everything is ``und``; a null id is in no fold, so it is neither held out nor
learned from; repeated rows are predicted alike; of equal probabilities the first
language by name wins. Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesift.llm.common import remainder

FOLDS, HELD_OUT = 4, 2
UNDETERMINED = "und"
LETTER = r"\p{L}"


@dataclass(frozen=True)
class Training:
    """Bounds of the training sample and settings of the network.

    ``documents`` texts for each language and ``excerpts`` windows of ``window`` characters from each.
    """

    documents: int = 400
    excerpts: int = 6
    window: int = 64
    hidden: int = 8
    epochs: int = 12
    batch: int = 256
    rate: float = 0.01
    seed: int = 4
    languages: int = 200


def _fold_case(data: np.ndarray) -> np.ndarray:
    """Lower-case ASCII and the two-byte Latin letters; the number of bytes stays."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    second = np.zeros(len(data), bool)
    second[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    out[second] += 32
    return out


LETTER_BYTE = np.zeros(256, np.float32)
LETTER_BYTE[97:123] = 1.0
LETTER_BYTE[128:] = 1.0


def windows_of(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts as rows of ``width`` (0 fills up), and the text each row is from."""
    rows = [-(-len(t) // width) for t in texts]
    owner = np.repeat(np.arange(len(texts)), rows)
    table = np.zeros((len(owner), width), np.uint8)
    at = 0
    for text, n in zip(texts, rows, strict=True):
        table[at:at + n].reshape(-1)[:len(text)] = _fold_case(np.frombuffer(text, np.uint8))
        at += n
    return table, owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * 0.5) * 0.5 + 0.5


@dataclass
class Network:
    """Parameters: an input table and a recurrent matrix for each side, and the output layer."""

    languages: list[str]
    hidden: int
    seed: int
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.weights:
            return
        random, h, c = np.random.default_rng(self.seed), self.hidden, len(self.languages)
        for side in "fb":
            self.weights[f"in_{side}"] = random.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            self.weights[f"rec_{side}"] = random.normal(0, h ** -0.5, (h, 3 * h)).astype(np.float32)
            self.weights[f"out_{side}"] = random.normal(0, h ** -0.5, (h, c)).astype(np.float32)
        self.weights["bias"] = np.zeros(c, np.float32)

    def run(self, data: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """States after each byte, ``(width, rows, hidden)``; ``keep`` takes what backpropagation needs."""
        h, table, rec = self.hidden, self.weights[f"in_{side}"], self.weights[f"rec_{side}"]
        rows, width = data.shape
        states = np.empty((width, rows, h), np.float32)
        state = np.zeros((rows, h), np.float32)
        for t in range(width) if side == "f" else range(width - 1, -1, -1):
            x, g = table[data[:, t]], state @ rec
            gates = _sigmoid(x[:, :2 * h] + g[:, :2 * h])
            update, reset = gates[:, :h], gates[:, h:]
            new = np.tanh(x[:, 2 * h:] + reset * g[:, 2 * h:])
            if keep is not None:
                keep.append((t, state, update, reset, new, g[:, 2 * h:]))
            state = new + update * (state - new)
            states[t] = state
        return states

    def positions(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        """Probabilities of the languages at every byte, ``(width, rows, languages)``."""
        w = self.weights
        scores = forward @ w["out_f"] + backward @ w["out_b"] + w["bias"]
        scores -= scores.max(axis=2, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=2, keepdims=True)
        return scores

    def gradients(self, data: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over letter bytes."""
        h, w = self.hidden, self.weights
        kept: dict[str, list] = {"f": [], "b": []}
        states = {side: self.run(data, side, kept[side]) for side in "fb"}
        error = self.positions(states["f"], states["b"])
        error[:, np.arange(len(labels)), labels] -= 1.0
        counts = LETTER_BYTE[data].T[:, :, None]
        error *= counts / max(1.0, float(counts.sum()))
        flat = error.reshape(-1, error.shape[2])
        grads = {"bias": flat.sum(axis=0)}
        for side in "fb":
            grads[f"out_{side}"] = states[side].reshape(-1, h).T @ flat
            into = error @ w[f"out_{side}"].T
            rec = w[f"rec_{side}"]
            d_rec, d_in = np.zeros_like(rec), np.zeros_like(w[f"in_{side}"])
            d_state = np.zeros((len(data), h), np.float32)
            for t, before, update, reset, new, g_new in reversed(kept[side]):
                d_state = d_state + into[t]
                d_new = d_state * (1 - update) * (1 - new * new)
                d_update = d_state * (before - new) * update * (1 - update)
                d_reset = d_new * g_new * reset * (1 - reset)
                d_x = np.hstack([d_update, d_reset, d_new])
                d_g = np.hstack([d_update, d_reset, d_new * reset])
                d_rec += before.T @ d_g
                one_hot = np.zeros((len(data), 256), np.float32)
                one_hot[np.arange(len(data)), data[:, t]] = 1.0
                d_in += one_hot.T @ d_x
                d_state = d_state * update + d_g @ rec.T
            grads[f"rec_{side}"], grads[f"in_{side}"] = d_rec, d_in
        return grads

    def train(self, data: np.ndarray, labels: np.ndarray, setting: Training) -> None:
        """Adam with a rate that falls to zero."""
        random = np.random.default_rng(setting.seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        batches = -(-len(data) // setting.batch)
        step, steps = 0, setting.epochs * batches
        for _ in range(setting.epochs):
            order = random.permutation(len(data))
            for part in np.array_split(order, batches):
                step += 1
                rate = setting.rate * (1 - (step - 1) / steps)
                for k, g in self.gradients(data[part], labels[part]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    ahead = first[k] / (1 - 0.9 ** step)
                    self.weights[k] -= (rate * ahead / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)

    def pooled(self, texts: list[bytes], width: int, rows: int = 2048) -> np.ndarray:
        """Mean probabilities over the letter bytes of each text, ``(texts, languages)``."""
        table, owner = windows_of(texts, width)
        sums = np.zeros((len(texts), len(self.languages)))
        letters = np.zeros(len(texts))
        for at in range(0, len(table), rows):
            part = table[at:at + rows]
            counts = LETTER_BYTE[part]
            found = self.positions(self.run(part, "f"), self.run(part, "b"))
            np.add.at(sums, owner[at:at + rows], np.einsum("tnc,nt->nc", found, counts))
            np.add.at(letters, owner[at:at + rows], counts.sum(axis=1))
        return sums / np.maximum(letters, 1.0)[:, None]


def training_rows(docs: DataFrame, setting: Training) -> DataFrame:
    """``lang, excerpt`` of the bounded sample, with ``rank`` and ``k`` to put them in order.

    Languages with many rows are thinned by a hash to a few times the sample before the
    rows are ranked, and excerpts are cut before anything is shuffled, so what one
    task gathers does not grow with the input.
    """
    labelled = docs.where(
        (remainder(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.rlike("text", F.lit(LETTER)))
    sizes = docs.where(F.col("lang").isNotNull()).groupBy("lang").count()
    draw = F.xxhash64("doc_id")
    share = draw.bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
    place = lambda k: F.pmod(F.xxhash64("doc_id", k), F.greatest(F.length("text") - setting.window, F.lit(0)) + 1).cast("int") + 1
    excerpts = F.transform(
        F.sequence(F.lit(1), F.lit(setting.excerpts)),
        lambda k: F.struct(k.alias("k"), F.substring(F.col("text"), place(k), F.lit(setting.window)).alias("excerpt")))
    thinned = labelled.join(F.broadcast(sizes), "lang").where(share * F.col("count") < 8.0 * setting.documents)
    smallest = Window.partitionBy("lang").orderBy("draw", "doc_id")
    sample = thinned.select("doc_id", "lang", share.alias("draw"), excerpts.alias("excerpts")).withColumn(
        "rank", F.row_number().over(smallest)).where(F.col("rank") <= setting.documents)
    return sample.select("lang", "rank", F.inline("excerpts"))


def train(docs: DataFrame, setting: Training = Training()) -> Network | None:
    """A network for the languages of ``docs`` (``doc_id, text, lang``), or None without labelled rows."""
    if docs.select("lang").distinct().limit(setting.languages + 2).count() > setting.languages + 1:
        raise ValueError(f"more than {setting.languages} languages; raise Training.languages")
    # At most documents x excerpts x window characters for each language.
    table = training_rows(docs, setting).toPandas()
    if not len(table):
        return None
    table = table.sort_values(["lang", "rank", "k"], kind="stable")
    languages = sorted(set(table["lang"]))
    width = 2 * setting.window
    texts = [t.encode()[:width] for t in table["excerpt"]]
    data, owner = windows_of(texts, width)
    labels = np.array([languages.index(name) for name in table["lang"]])[owner]
    # Excerpts of few bytes end early; the columns none of them reaches are left out.
    data = data[:, :max(map(len, texts), default=1) or 1]
    network = Network(languages, setting.hidden, setting.seed)
    network.train(data, labels, setting)
    return network


def predict_column(network: Network, width: int) -> Callable[[str], Column]:
    """``struct<lang_pred, score>`` of a column of texts with at least one letter."""
    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        pooled = network.pooled([(t or "").encode() for t in texts], width)
        best = pooled.argmax(axis=1)
        return pd.DataFrame({
            "lang_pred": [network.languages[i] for i in best], "score": pooled[np.arange(len(best)), best],
        })

    return predict


def identify(
    docs: DataFrame, setting: Training = Training(), network: Network | None = None, width: int = 128,
    doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    network = network or train(named, setting)
    held_out = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    if network is None:
        return named.select("doc_id", held_out, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    found = predict_column(network, width)("text")
    known = F.coalesce(F.rlike("text", F.lit(LETTER)), F.lit(False))
    return named.select("doc_id", held_out, known.alias("known"), found.alias("found")).select(
        "doc_id", "held_out", F.when(F.col("known"), F.col("found.lang_pred")).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(F.col("known"), F.least(F.lit(1.0), F.col("found.score"))).otherwise(0.0).alias("score"),
    )
