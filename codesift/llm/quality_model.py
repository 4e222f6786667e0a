"""Quality classifier: ridge regression on random Fourier features, calibrated.

Statistics of a text (shares of characters, lengths, repetition) are column expressions,
computed once and written to the shared folder as one narrow row for each document. The
rest runs on these rows. Random Fourier features approximate a Gaussian kernel over
the standardised statistics; every partition of labelled rows sums its own normal
equations, the sums are added in two steps in Spark, and one matrix of fixed size
reaches the driver to be solved. Ridge scores of labelled rows kept from the fit are
summed in ``BINS`` bins, and isotonic regression over the bins turns scores into
probabilities.

Labels are used where ``crc32(doc_id) mod 5`` is 1 to 4: 1, 2 and 3 to fit the ridge,
4 to calibrate. Remainder 0 is held out.

Defined cases: null and empty texts have statistics of zeros and get the score
of such a text; a null id is in no fold, so it is scored and not held out; labels
that are null, or whose document is missing, are not used, and repeated ones count
again; without any label the score is 0.5. Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.functions.text import let
from codesift.llm.common import remainder, stored, words_of

FOLDS = 5
CALIBRATION_FOLD = 4
BINS = 1000
THRESHOLD = 0.3


@dataclass(frozen=True)
class Kernel:
    """Number of features, width of the Gaussian in standard deviations, ridge penalty, seed."""

    features: int = 192
    width: float = 4.0
    penalty: float = 1e-3
    seed: int = 20

    def projection(self, inputs: int) -> tuple[np.ndarray, np.ndarray]:
        random = np.random.default_rng(self.seed)
        return random.normal(size=(inputs, self.features)) / self.width, random.uniform(0, 2 * np.pi, self.features)


STATISTICS = (
    "log_chars", "log_words", "word_length", "distinct_words", "line_words", "distinct_lines", "lower", "upper", "digit",
    "blank", "comma_period", "exclamation", "bar", "symbol", "quote_bracket", "other", "shouted_words",
)


# Classes of characters counted in what is left without lower-case letters.
COUNTED = {
    "upper": r"\p{Lu}", "digit": r"\p{Nd}", "blank": r"[\x20\x09-\x0D]", "comma_period": "[.,;:?]", "exclamation": "!",
    "bar": r"[|]", "symbol": r"[#*$%&<>@^~=+/\\_]", "quote_bracket": r"""["'()\[\]{}-]""",
}


def statistics(text: Column) -> Column:
    """The statistics of a text as an array, in the order of ``STATISTICS``.

    Values used more than once are bound by ``let``: as columns of their own the
    optimizer may copy them into every use, and each copy walks the text again.
    """
    size = lambda array: F.size(array).cast("double")

    def of_parts(p: Column) -> Column:
        without = lambda pattern: F.length(F.regexp_replace(p["rest"], F.lit(f"(?:{pattern})++"), F.lit("")))
        return let(F.struct(
            F.greatest(F.length(p["text"]), F.lit(1)).cast("double").alias("chars"), F.length(p["text"]).alias("length"),
            F.length(p["rest"]).alias("rest"), size(p["words"]).alias("words"), size(p["lines"]).alias("lines"),
            F.greatest(size(p["words"]), F.lit(1.0)).alias("some_words"),
            size(F.array_distinct(p["words"])).alias("distinct_words"), size(F.array_distinct(p["lines"])).alias("distinct_lines"),
            F.array(*[F.length(p["rest"]) - without(c) for c in COUNTED.values()]).alias("counts"),
            F.regexp_count(p["rest"], F.lit(r"\p{Lu}{3,}+")).alias("shouted"),
        ), of_numbers)

    def of_numbers(n: Column) -> Column:
        counted = {name: F.get(n["counts"], F.lit(i)) for i, name in enumerate(COUNTED)}
        values = {
            "log_chars": F.log1p(n["length"]), "log_words": F.log1p(n["words"]),
            "word_length": (n["chars"] - counted["blank"]) / n["some_words"],
            "distinct_words": n["distinct_words"] / F.sqrt(n["some_words"]), "line_words": F.log1p(n["some_words"] / n["lines"]),
            "distinct_lines": n["distinct_lines"] / n["lines"], "lower": (n["chars"] - n["rest"]) / n["chars"],
            **{name: count / n["chars"] for name, count in counted.items()},
            "other": (n["rest"] - F.aggregate(n["counts"], F.lit(0), lambda a, b: a + b)) / n["chars"],
            "shouted_words": n["shouted"] / n["some_words"],
        }
        ordered = F.array(*[values[name].cast("double") for name in STATISTICS])
        return F.when(n["length"] > 0, ordered).otherwise(F.array_repeat(F.lit(0.0), len(STATISTICS)))

    return let(F.coalesce(text, F.lit("")), lambda t: let(F.struct(
        t.alias("text"), words_of(t).alias("words"), F.split(t, "\n", -1).alias("lines"),
        # Lower-case letters, most of a text, are taken out once; the rest is short.
        F.regexp_replace(t, F.lit(r"\p{Ll}++"), F.lit("")).alias("rest"),
    ), of_parts))


def text_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, stats`` for every row of ``docs`` (``doc_id, text``), written once."""
    return stored(docs.select("doc_id", statistics(F.col("text")).alias("stats")), "quality-stats")


@dataclass(frozen=True)
class QualityModel:
    """Everything needed to score statistics; a few hundred numbers."""

    kernel: Kernel
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    knots: np.ndarray = field(default_factory=lambda: np.zeros(0))
    levels: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def features(self, stats: np.ndarray) -> np.ndarray:
        directions, phases = self.kernel.projection(len(STATISTICS))
        # Far outliers keep their side but not their distance; the cosine is periodic.
        standard = np.clip((stats - self.mean) / self.scale, -8, 8)
        waves = np.sqrt(2.0 / self.kernel.features) * np.cos(standard @ directions + phases)
        return np.hstack([waves, np.ones((len(stats), 1))])

    def ridge(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(stats), 0.5)
        raw = self.ridge(stats)
        if not len(self.knots):
            return np.clip(raw, 0.0, 1.0)
        return np.interp(raw, self.knots, self.levels)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, len(STATISTICS)))


def _moments(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    total = [F.count("*").alias("n")]
    for i in range(len(STATISTICS)):
        value = F.get("stats", F.lit(i))
        total += [F.avg(value).alias(f"m{i}"), F.stddev_pop(value).alias(f"d{i}")]
    row = labelled.agg(*total).first()
    mean = np.array([row[f"m{i}"] or 0.0 for i in range(len(STATISTICS))])
    scale = np.array([row[f"d{i}"] or 0.0 for i in range(len(STATISTICS))])
    return mean, np.where(scale > 1e-9, scale, 1.0), row["n"]


def _normal_equations(labelled: DataFrame, model: QualityModel, groups: int = 32) -> np.ndarray:
    """``[Z'Z | Z'y]``, summed by partition, then by group of partitions, then on the driver."""
    width = model.kernel.features + 1

    def of_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, key = np.zeros((width, width + 1)), 0
        for rows in batches:
            z = model.features(_matrix(rows["stats"]))
            total[:, :width] += z.T @ z
            total[:, width] += z.T @ rows["quality"].to_numpy(float)
            key = int(rows["part"].iloc[0]) if len(rows) else key
        yield pd.DataFrame({"part": [key % groups], "sums": [total.tobytes()]})

    def of_group(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(sums).reshape(width, width + 1) for sums in rows["sums"])
        return pd.DataFrame({"part": rows["part"].iloc[:1], "sums": [np.asarray(total).tobytes()]})

    schema = "part int, sums binary"
    sums = labelled.withColumn("part", F.spark_partition_id()).mapInPandas(of_partition, schema)
    rows = sums.groupBy("part").applyInPandas(of_group, schema).collect()
    return sum((np.frombuffer(r.sums).reshape(width, width + 1) for r in rows), np.zeros((width, width + 1)))


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``values`` in weighted squares."""
    blocks: list[list[float]] = []
    for value, weight in zip(values, weights, strict=True):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w, n = blocks.pop()
            u, x, m = blocks[-1]
            blocks[-1] = [(u * x + v * w) / (x + w), x + w, m + n]
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def fit(stats: DataFrame, labels: DataFrame, kernel: Kernel = Kernel()) -> QualityModel:
    """Fit on ``stats`` (``doc_id, stats``) and ``labels`` (``doc_id, quality``); all labelled rows are used."""
    known = labels.select("doc_id", F.col("quality").cast("double").alias("quality")).where(F.col("quality").isNotNull())
    fold = remainder(F.col("doc_id"), FOLDS)
    labelled = stored(stats.join(known, "doc_id").withColumn("fold", fold).where(fold != 0), "quality-labelled")
    fitting = labelled.where(F.col("fold") != CALIBRATION_FOLD)
    mean, scale, n = _moments(fitting)
    model = QualityModel(kernel, mean, scale)
    if not n:
        return model
    sums = _normal_equations(fitting.select("stats", "quality"), model)
    penalty = kernel.penalty * n * np.eye(len(sums)) / len(sums)
    penalty[-1, -1] = 0.0
    weights = np.linalg.lstsq(sums[:, :-1] + penalty, sums[:, -1], rcond=1e-12)[0]
    model = QualityModel(kernel, mean, scale, weights)

    def ridge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"raw": model.ridge(_matrix(rows["stats"])), "quality": rows["quality"]})

    raw = labelled.where(F.col("fold") == CALIBRATION_FOLD).select("stats", "quality").mapInPandas(ridge, "raw double, quality double")
    place = F.floor(F.greatest(F.lit(-0.5), F.least(F.lit(1.5), "raw")) * (BINS / 2)).cast("int")
    bins = raw.groupBy(place.alias("bin")).agg(F.avg("raw").alias("raw"), F.avg("quality").alias("y"), F.count("*").alias("n"))
    table = bins.orderBy("bin").toPandas()
    if not len(table):
        return model
    levels = isotonic(table["y"].to_numpy(), table["n"].to_numpy(float))
    return QualityModel(kernel, mean, scale, weights, table["raw"].to_numpy(), np.clip(levels, 0.0, 1.0))


def score_column(model: QualityModel) -> Callable[[Column | str], Column]:
    """The score of a column of statistics, computed by Arrow batches."""
    @F.pandas_udf("double")
    def score(stats: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(stats)))

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, kernel: Kernel = Kernel(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    stats = text_statistics(named)
    scored = stats.select("doc_id", score_column(fit(stats, labels, kernel))("stats").alias("score"))
    return scored.select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, kernel: Kernel = Kernel()) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, all columns as they are.

    Statistics are computed again for the choice: that costs less than moving texts to scores.
    """
    model = fit(text_statistics(docs.select("doc_id", "text")), labels, kernel)
    return docs.where(score_column(model)(statistics(F.col("text"))) >= THRESHOLD)
