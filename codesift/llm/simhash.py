"""SimHash near-duplicates with a hierarchical index in Gray order.

Fingerprints that differ in few bits are found on the distinct fingerprints only, so
copies cost one row. Of two fingerprints with at most four differing bits, one half has at
most two of them, so the search runs once for each half in the lead:

1. Fingerprints get the rank that they have in Gray order, in which neighbours share
   leading bits. Upper nodes are ranges of this order, as many as the count of
   fingerprints asks for; a node with too many is parted further by a hash.
2. A node knows which bits all its members share (mask) and their values (pattern).
   Nodes meet only if their leading bits differ in at most two places; then the differing
   bits that both share are counted, and the pair goes on only if there are few enough.
3. Members of two nodes are compared in a task. Runs of ``RUN`` neighbours in Gray order
   form lower nodes with masks and patterns of their own; pairs of runs are
   pruned by the same count before single fingerprints are compared.

A task reports not its pairs but a spanning forest of them, so groups of thousands of
near copies give no more rows than members. Components are joined by alternating star steps
on the edges until nothing changes, each step written to the shared folder.

Defined cases: null and blank texts have fingerprint zero and link like any other; a
null id is never the smallest of a component, and a component of such rows only has a
null id; repeated rows are in one component; an empty table gives no rows. Only
the columns named are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from codesift.llm.common import stored

SHINGLE = 4
SEED = 42
BITS = 64
DISTANCE = 4
HALF_DISTANCE = DISTANCE // 2
NODE = 4096
RUN = 32
LEAD = np.uint64(0xFFFFFFFF00000000)


def fingerprint(text: str | None) -> int:
    """The fingerprint of a whole text, as an unsigned number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    last = max(1, len(words) - SHINGLE + 1)
    spans = zip(starts[:last].tolist(), ends[min(SHINGLE, len(words)) - 1:].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], ">u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8)).reshape(len(part), BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


@F.pandas_udf(LongType())
def fingerprint_column(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).astype(np.int64))


def hex_text(fingerprints: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprints), 16, "0"))


def _gray_rank(key: Column) -> Column:
    for shift in (1, 2, 4, 8, 16, 32):
        key = key.bitwiseXOR(F.shiftrightunsigned(key, shift))
    return key


def _rotated(fp: Column, turn: Column) -> Column:
    """The other half in the lead where ``turn`` is 1."""
    return F.when(turn == 1, F.shiftleft(fp, 32).bitwiseOR(F.shiftrightunsigned(fp, 32))).otherwise(fp)


def _nodes(fps: DataFrame, node: int) -> tuple[DataFrame, int]:
    """``turn, prefix, part, members, mask, pattern`` and the number of leading bits of a node."""
    n = fps.count()
    depth = max(0, min(31, (n // node).bit_length()))
    turned = fps.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("turn"), "fp").withColumn(
        "key", _rotated(F.col("fp"), F.col("turn")))
    prefix = F.shiftrightunsigned("key", BITS - depth) if depth else F.lit(0).cast("long")
    turned = turned.withColumn("prefix", prefix)
    sizes = turned.groupBy("turn", "prefix").agg(F.ceil(F.count("*") / node).cast("int").alias("parts"))
    parted = turned.join(sizes, ["turn", "prefix"]).withColumn("part", F.pmod(F.hash("fp"), F.col("parts")))
    members = F.transform(
        F.sort_array(F.collect_list(F.struct(_unsigned_order(_gray_rank(F.col("key"))).alias("rank"), "key"))), lambda m: m["key"])
    both, any_ = F.expr("bit_and(key)"), F.expr("bit_or(key)")
    nodes = parted.groupBy("turn", "prefix", "part").agg(members.alias("members"), both.alias("ones"), any_.alias("some"))
    mask = F.bitwise_not(F.col("ones").bitwiseXOR(F.col("some")))
    nodes = nodes.select("turn", "prefix", "part", "members", mask.alias("mask"), F.col("ones").alias("pattern"))
    return stored(nodes, "simhash-nodes"), depth


def _unsigned_order(value: Column) -> Column:
    return value.bitwiseXOR(F.lit(-(1 << 63)))


def _differences(one: str, other: str, among: Column) -> Column:
    """Differing bits that both nodes share, among the given ones: a lower bound for all their members."""
    differing = F.col(f"{one}.pattern").bitwiseXOR(F.col(f"{other}.pattern"))
    return F.bit_count(differing.bitwiseAND(F.col(f"{one}.mask")).bitwiseAND(F.col(f"{other}.mask")).bitwiseAND(among))


def _node_pairs(nodes: DataFrame, depth: int) -> DataFrame:
    """Pairs of nodes that may hold linked fingerprints, each pair once, a node with itself included."""
    flips = [0] + [sum(1 << b for b in bits) for k in range(1, HALF_DISTANCE + 1) for bits in combinations(range(depth), k)]
    plain = nodes.drop("members")
    probes = plain.withColumn("flip", F.explode(F.array(*[F.lit(f).cast("long") for f in flips])))
    probes = probes.withColumn("near", F.col("prefix").bitwiseXOR(F.col("flip"))).where(F.col("near") >= F.col("prefix"))
    a, b = probes.alias("a"), plain.alias("b")
    pairs = a.join(b, (F.col("a.turn") == F.col("b.turn")) & (F.col("a.near") == F.col("b.prefix")))
    once = (F.col("a.prefix") < F.col("b.prefix")) | (F.col("a.part") <= F.col("b.part"))
    lead, all_bits = F.lit(-(1 << 32)), F.lit(-1).cast("long")
    few = (_differences("a", "b", lead) <= HALF_DISTANCE) & (_differences("a", "b", all_bits) <= DISTANCE)
    return pairs.where(once & few).select(
        F.col("a.turn").alias("turn"), F.col("a.prefix").alias("prefix"), F.col("a.part").alias("part"),
        F.col("b.prefix").alias("prefix2"), F.col("b.part").alias("part2"),
    )


def _runs(members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members in rows of ``RUN``, the last one repeated to fill up, with mask and pattern of each row."""
    fill = -len(members) % RUN
    rows = np.concatenate([members, np.repeat(members[-1:], fill)]).reshape(-1, RUN)
    ones, some = np.bitwise_and.reduce(rows, axis=1), np.bitwise_or.reduce(rows, axis=1)
    return rows, ~(ones ^ some), ones


def _join_labels(labels: np.ndarray, one: np.ndarray, other: np.ndarray) -> None:
    """Give linked places the smallest label of their component."""
    while len(one):
        least = np.minimum(labels[one], labels[other])
        changed = (labels[one] != least) | (labels[other] != least)
        if not changed.any():
            return
        one, other, least = one[changed], other[changed], least[changed]
        for side in (one, other):
            np.minimum.at(labels, labels[side], least)
            np.minimum.at(labels, side, least)
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def forest(members: np.ndarray, others: np.ndarray, step: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all linked members of two nodes, at most one for each member."""
    places = np.concatenate([members, others])
    labels = np.arange(len(places))
    rows, mask, pattern = _runs(members)
    rows2, mask2, pattern2 = _runs(others)
    index = np.minimum(np.arange(rows.size), len(members) - 1).reshape(rows.shape)
    index2 = np.minimum(np.arange(rows2.size), len(others) - 1).reshape(rows2.shape) + len(members)
    shared = (pattern[:, None] ^ pattern2[None, :]) & mask[:, None] & mask2[None, :]
    few = (np.bitwise_count(shared & LEAD) <= HALF_DISTANCE) & (np.bitwise_count(shared) <= DISTANCE)
    first, second = np.nonzero(few)
    for at in range(0, len(first), step):
        i, j = first[at:at + step], second[at:at + step]
        near = np.bitwise_count(rows[i][:, :, None] ^ rows2[j][:, None, :]) <= DISTANCE
        pair, x, y = np.nonzero(near)
        _join_labels(labels, index[i[pair], x], index2[j[pair], y])
    moved = labels != np.arange(len(labels))
    return places[moved], places[labels[moved]]


def links(fps: DataFrame, node: int = NODE) -> DataFrame:
    """``a, b``: edges whose components are those of all links between the distinct ``fp``."""
    nodes, depth = _nodes(fps, node)
    pairs = _node_pairs(nodes, depth)
    left = nodes.select("turn", "prefix", "part", "members")
    right = nodes.select("turn", F.col("prefix").alias("prefix2"), F.col("part").alias("part2"), F.col("members").alias("members2"))
    filled = pairs.join(left, ["turn", "prefix", "part"]).join(right, ["turn", "prefix2", "part2"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for turn, one, other in zip(rows["turn"], rows["members"], rows["members2"], strict=True):
                a, b = forest(np.asarray(one).astype(np.uint64), np.asarray(other).astype(np.uint64))
                if turn:
                    half = np.uint64(32)
                    a, b = (a << half) | (a >> half), (b << half) | (b >> half)
                yield pd.DataFrame({"a": a.astype(np.int64), "b": b.astype(np.int64)})

    # Pairs are dealt out by hash, so the costly ones of a large group do not meet in one task.
    spread = filled.select("turn", "members", "members2").repartition(F.xxhash64("prefix", "prefix2", "part", "part2"))
    return spread.mapInPandas(compare, "a long, b long").where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of an edge ``a, b``: the smallest node of its component.

    A large star links the larger neighbours of a node to its smallest one, a small star
    the smaller ones and itself. Every node ends next to the root.
    """
    def stars(pairs: DataFrame, larger: bool) -> DataFrame:
        if larger:
            pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        centre = pairs.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        met = pairs.join(centre, "a")
        out = met.where(F.col("b") > F.col("a")) if larger else met.where(F.col("b") != F.col("m"))
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not larger:
            out = out.unionByName(centre.select("a", F.col("m").alias("b")))
        return out.where(F.col("a") != F.col("b")).distinct()

    def state(pairs: DataFrame) -> tuple:
        mark = F.xxhash64("a", "b").cast("decimal(20,0)")
        return tuple(pairs.agg(F.count("*"), F.sum(mark)).first())

    edges = stored(edges, "simhash-edges")
    before, now = None, state(edges)
    while now != before:
        edges = stored(stars(stored(stars(edges, larger=True), "simhash-star"), larger=False), "simhash-star")
        before, now = now, state(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp, component_id, root`` for every row of ``docs``."""
    named = docs.select(F.col(doc_id).alias("doc_id"), fingerprint_column(F.col(text)).alias("fp"))
    return with_components(stored(named, "simhash-fingerprints"))


def with_components(rows: DataFrame) -> DataFrame:
    """``rows`` (``doc_id, fp`` and more) with ``root``, a key of the component, and its smallest id."""
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    found = components(links(classes.select("fp")))
    rooted = classes.join(found, classes["fp"] == found["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = rooted.join(named, "root").select("fp", "component_id", "root")
    return rows.join(by_class, "fp")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of every component, the one with the smallest id, all columns as they are."""
    rows = stored(docs.select(
        F.struct("*").alias("row"), "doc_id", fingerprint_column("text").alias("fp"), F.monotonically_increasing_id().alias("uid"),
    ), "simhash-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "uid"))["uid"]
    staying = with_components(rows.select("doc_id", "fp", "uid")).groupBy("root").agg(first.alias("uid"))
    return rows.join(staying, "uid").select("row.*")


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", hex_text(F.col("fp")).alias("fingerprint"), "component_id")
