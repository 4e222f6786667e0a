"""Approximate nearest neighbours by several shifted Hilbert orderings.

Each ordering projects vectors to a few random directions, shifts the projected cube by a
random offset and numbers its cells along a Hilbert curve, on which cells that follow each
other touch. The directions of all orderings are cut from as few random rotations as possible,
so orderings that follow each other share none and their windows overlap little. Spark sorts all
keys of an ordering by range and numbers them. The window of a query are the places around its own,
the share ``window`` of all and ``least`` at the least; it meets the blocks of ``BLOCK`` places that its
window touches, in each only the rows of the window, and takes the nearest by exact cosine. Blocks and
orderings are then merged and ranked again by that cosine.

A block is copied only if more than ``QUERIES`` queries look into it, and queries go to the blocks of their
windows, so in an ordering nothing but queries is sent more than once as long as they are few.

Equal vectors: a result holds the smallest ids of equal vectors, so only as many rows
of one vector as could be returned are compared. They are chosen by a ranked limit
before the shuffle; a vector that a third of all rows have costs a few rows. What
is left out of a comparison by this can never be in a result.

How wide the windows must be depends on the data, not on its size. In vectors without
structure neighbours are hardly nearer than others and keys say little; the default is
set for those: many orderings with narrow windows find more than few with wide ones at the same
number of comparisons, 0.88 times as many as there are rows. For clustered vectors a small share will do.

Defined cases: a vector that is null, empty, zero, or has a null or non-finite
component takes no part, nor does a row without id; vectors of different lengths never
meet; repeated rows and ids count once, with the best score; fewer candidates than ``k``
are all returned. Only the two columns named are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType

from codesift.llm.common import stored

BLOCK = 2048
QUERIES = 4096
BATCH = 64


@dataclass(frozen=True)
class Orderings:
    """Number of orderings, directions of each, bits of a coordinate, share of the keys to look at, least number of keys, seed."""

    count: int = 16
    directions: int = 8
    bits: int = 4
    window: float = 0.055
    least: int = 2048
    seed: int = 2

    def __post_init__(self):
        if self.directions * self.bits > 63:
            raise ValueError("a key has at most 63 bits")


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell (rows of coordinates below ``2 ** bits``) on the Hilbert curve.

    The transposed form of the key is built plane by plane: where a coordinate has the
    bit of the plane, the lower bits of the first one are inverted, else exchanged with its own.
    """
    x = cells.astype(np.uint64).copy()
    size = x.shape[1]
    for plane in range(bits - 1, 0, -1):
        low = np.uint64((1 << plane) - 1)
        for i in range(size):
            has = (x[:, i] >> np.uint64(plane)) & np.uint64(1) == 1
            swap = np.where(has, np.uint64(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(has, low, swap)
            x[:, i] ^= swap
    for i in range(1, size):
        x[:, i] ^= x[:, i - 1]
    turned = np.zeros(len(x), np.uint64)
    for plane in range(bits - 1, 0, -1):
        set_ = (x[:, size - 1] >> np.uint64(plane)) & np.uint64(1) == 1
        turned ^= np.where(set_, np.uint64((1 << plane) - 1), np.uint64(0))
    x ^= turned[:, None]
    keys = np.zeros(len(x), np.uint64)
    for plane in range(bits - 1, -1, -1):
        for i in range(size):
            keys = (keys << np.uint64(1)) | ((x[:, i] >> np.uint64(plane)) & np.uint64(1))
    return keys


def _directions(random: np.random.Generator, length: int, setting: Orderings) -> np.ndarray:
    """The directions of every ordering, as columns: rows of random rotations, as long as those of a normal variate."""
    needed = setting.count * setting.directions
    rotations = [np.linalg.qr(random.normal(size=(length, length)))[0] for _ in range(-(-needed // length))]
    return np.concatenate(rotations).T[:, :needed] * np.sqrt(length)


def _key_column(setting: Orderings) -> Callable[[str], Column]:
    """All keys of a vector. Projections of unit vectors are spread over the cube by a
    logistic curve of their usual width."""
    @F.pandas_udf(ArrayType(LongType()))
    def keys(vectors: pd.Series) -> pd.Series:
        out: list = [None] * len(vectors)
        by_length = pd.Series(range(len(vectors))).groupby(vectors.map(len).to_numpy())
        for length, places in by_length:
            unit = np.stack(vectors.iloc[places].to_numpy()).astype(float)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            random = np.random.default_rng([setting.seed, int(length)])
            directions = _directions(random, int(length), setting)
            rows = np.empty((len(unit), setting.count), np.int64)
            for o in range(setting.count):
                own = directions[:, o * setting.directions:(o + 1) * setting.directions]
                # Half of the cube is left free for the shift.
                spread = 0.5 / (1.0 + np.exp(-1.7 * (unit @ own)))
                shifted = spread + random.uniform(0.0, 0.5, setting.directions)
                cells = np.minimum((shifted * (1 << setting.bits)).astype(np.int64), (1 << setting.bits) - 1)
                rows[:, o] = hilbert_keys(cells, setting.bits).astype(np.int64)
            for place, row in zip(places, rows, strict=True):
                out[place] = row
        return pd.Series(out)

    return keys


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id, v`` of the rows that take part."""
    single = vectors.select(embedding).schema[0].dataType == ArrayType(FloatType())
    # Single precision is kept as it is, as it takes half the room; scores are of doubles.
    v = F.col(embedding) if single else F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(
        (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0), F.lit(False)))


def _smallest_ids(rows: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the rows with the ``k + 1`` smallest ids: one may be the query itself."""
    same = Window.partitionBy(F.xxhash64("v"), F.xxhash64(F.reverse("v"))).orderBy("vec_id")
    return rows.withColumn("place", F.dense_rank().over(same)).where(F.col("place") <= k + 1).drop("place")


def _nearest(k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The nearest of one block for the queries that look into it, each among the rows of its window."""
    columns = ["query_id", "vec_id", "score"]

    def nearest(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "vec_id"], kind="stable")
        block, queries = rows[~rows["asks"]], rows[rows["asks"]]
        found = [pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})]
        if not len(block) or not len(queries):
            return found[0]
        places, all_ids, all_vectors = block["place"].to_numpy(), block["vec_id"].to_numpy(), np.stack(block["v"].to_numpy()).astype(float)
        all_lengths = np.sqrt((all_vectors * all_vectors).sum(axis=1))
        asked, wanted = queries["vec_id"].to_numpy(), np.stack(queries["v"].to_numpy()).astype(float)
        low, high = queries["low"].to_numpy(), queries["high"].to_numpy()
        for at in range(0, len(asked), BATCH):
            own, q = asked[at:at + BATCH], wanted[at:at + BATCH]
            seen = slice(np.searchsorted(places, low[at:at + BATCH].min()), np.searchsorted(places, high[at:at + BATCH].max(), "right"))
            ids, vectors, lengths = all_ids[seen], all_vectors[seen], all_lengths[seen]
            if not len(ids):
                continue
            scores = (q @ vectors.T) / (np.sqrt((q * q).sum(axis=1))[:, None] * lengths[None, :])
            # What a batch sees of other windows is left out, so results do not depend on the batches.
            first, last = low[at:at + BATCH, None], high[at:at + BATCH, None]
            scores[(own[:, None] == ids[None, :]) | (places[seen] < first) | (places[seen] > last)] = -np.inf
            few = min(k, len(ids))
            limit = -np.partition(-scores, few - 1, axis=1)[:, few - 1]
            # Everything down to the last place, and what ties with it but for rounding.
            row, column = np.nonzero(scores >= np.maximum(limit[:, None] - 1e-9, -2.0))
            # The product sums in an order of its own; equal vectors must have equal scores.
            exact = (q[row] * vectors[column]).sum(axis=1) / (np.sqrt((q * q).sum(axis=1))[row] * lengths[column])
            taken = scores[row, column] > -np.inf
            found.append(pd.DataFrame({"query_id": own[row], "vec_id": ids[column], "score": exact})[taken])
        rows = pd.concat(found).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
        return rows.groupby("query_id", sort=False).head(k)[columns]

    return nearest


def _places(keyed: DataFrame) -> DataFrame:
    """``uid, asks, ordering, place``: the place of each key in its ordering, from 0.

    Spark sorts the narrow keys by range; the place in the partition plus the rows of earlier
    partitions is the place in the ordering. The table of partitions has a row for each.
    """
    # Equal keys are told apart by the id, so a common key fills as many ranges as it needs.
    order = ["ordering", "key", "vec_id", "uid"]
    keys = keyed.select("vec_id", "uid", "asks", F.posexplode("keys").alias("ordering", "key"))
    ordered = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(ordered.select("uid", "asks", "ordering", F.monotonically_increasing_id().alias("at")), "neighbour-order").select(
        "uid", "asks", "ordering", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    earlier = Window.partitionBy("ordering").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("ordering", "part").agg(F.count("*").alias("n"), F.min("at").alias("first")).select(
        "ordering", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("offset"))
    return rows.join(F.broadcast(parts), ["ordering", "part"]).select("uid", "asks", "ordering", (F.col("at") + F.col("offset")).alias("place"))


def _windows(places: DataFrame, total: int, setting: Orderings) -> DataFrame:
    """``places`` with the first and the last place that a row looks at."""
    half = int(np.ceil(max(setting.window * total, setting.least) / 2 - 1e-9))
    place, end = F.col("place"), max(total - 1, 0)
    # At an end of the curve the window reaches as far to the other side.
    low = F.greatest(F.lit(0).cast("long"), F.least(place - half, F.lit(end - 2 * half).cast("long")))
    high = F.least(F.lit(end).cast("long"), F.greatest(place + half, F.lit(2 * half).cast("long")))
    return places.withColumn("low", low).withColumn("high", high)


def nearest_neighbours(
    vectors: DataFrame, every: int = 50, k: int = 5, setting: Orderings = Orderings(),
    vec_id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK, queries: int = QUERIES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row whose id is divisible by ``every``.

    ``block`` rows meet at most about ``queries`` queries at a time.
    """
    rows = usable(vectors, vec_id, embedding).distinct()
    indexed = _smallest_ids(rows, k).select(F.lit(False).alias("asks"), "vec_id", "v")
    asking = rows.where(F.col("vec_id") % every == 0).select(F.lit(True).alias("asks"), "vec_id", "v")
    keyed = indexed.unionByName(asking).withColumn("keys", _key_column(setting)("v"))
    keyed = stored(keyed.withColumn("uid", F.monotonically_increasing_id()), "neighbour-keys")
    placed = _windows(stored(_places(keyed), "neighbour-places"), keyed.count(), setting)
    looks = F.sequence(F.floor(F.col("low") / block), F.floor(F.col("high") / block))
    asked = placed.where("asks").withColumn("block", F.explode(looks))
    held = placed.where("NOT asks").withColumn("block", F.floor(F.col("place") / block))
    # Blocks that many queries look into are copied, each copy for some of them. These rows are still without vectors.
    chunks = asked.groupBy("ordering", "block").agg(F.ceil(F.count("*") / queries).alias("chunks"))
    asked, held = (side.join(chunks, ["ordering", "block"]) for side in (asked, held))
    held = held.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("uid"), F.col("chunks")))
    met = held.select("uid", "ordering", "block", "chunk", "place", "low", "high").unionByName(
        asked.select("uid", "ordering", "block", "chunk", "place", "low", "high"))
    spread = met.join(keyed.select("uid", "asks", "vec_id", "v"), "uid").withColumn("length", F.size("v"))
    # Vectors of different lengths do not meet.
    groups = spread.groupBy("ordering", "block", "chunk", "length")
    found = groups.applyInPandas(_nearest(k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
