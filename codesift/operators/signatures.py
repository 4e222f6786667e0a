"""A stored corpus whose parts are skipped by signature.

Texts are stored in parts, each with a signature: a bitmap of the n-grams of its comment-free texts. A rule can match in a part
only if some literal of each of its required sets has all its n-grams there. A search reads the signatures first, then the texts of
those parts that can hold a match, each part with the rules that are possible in it; of all other parts only the paths are read.

- Signatures err on one side: a bit may be set by another n-gram, so a part may be read in vain, never skipped in error.
- A signature takes at most ``BITS / 8`` bytes, whatever its part holds. Each task reads its texts once and sends the bitmaps of its
  parts, not the bits of its texts; an n-gram is marked at its place in a table and hashed once for a task, however often it occurs.
- Parts are directories of one table; which to read is a join on their number, so Spark prunes them before it opens a file.
- How much is skipped depends on what stands together. Texts are stored in order of their path (``cluster_by``), because files of one
  project share their words; a rule without a literal of ``GRAM`` characters is possible everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.functions.comments import strip_comments
from codesift.functions.text import let
from codesift.operators.literals import grams_of
from codesift.operators.scan import matching_rules, rule_array
from codesift.rules import RulePack
from codesift.session import written

GRAM = 3
BITS = 1 << 20
PARTS = 64
# Bits of one bitmap, as Spark's bitmap functions have them.
BUCKET = 8 * 4096
BITMAPS = "part int, bucket bigint, bitmap binary"
# What is possible in which part is broadcast up to so many numbers, beyond that joined by a shuffle.
MAX_SENT = 4_000_000


def _folders(store: str) -> tuple[str, str]:
    # A signature of other settings is of no use, so it has another name.
    return f"{store}/texts", f"{store}/signatures-{GRAM}-{BITS}"


def _bits_of(text: Column) -> Column:
    """The numbers of the bits that stand for the n-grams of a text."""
    return F.array_distinct(F.transform(grams_of(text, GRAM), lambda g: F.pmod(F.xxhash64(g), F.lit(BITS).cast("long"))))


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def _hashed(strings: np.ndarray) -> np.ndarray:
    """``xxhash64`` of strings of one length below 32 bytes, given as rows of bytes; sums wrap around."""
    count, length = strings.shape
    words = strings.astype(np.uint64)
    little = lambda at, size: sum(words[:, at + k] << np.uint64(8 * k) for k in range(size))
    h, at = np.full(count, np.uint64(42) + _P5 + np.uint64(length)), 0
    for at in range(0, length - 7, 8):
        h = _turned(h ^ _turned(little(at, 8) * _P2, 31) * _P1, 27) * _P1 + _P4
    at = length // 8 * 8
    if length - at >= 4:
        h = _turned(h ^ little(at, 4) * _P1, 23) * _P2 + _P3
        at += 4
    for k in range(at, length):
        h = _turned(h ^ words[:, k] * _P5, 11) * _P1
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def _bits_of_grams(grams: np.ndarray) -> np.ndarray:
    """The bits of n-grams given as rows of code points, the same as those of ``_bits_of``."""
    encoded = [row.tobytes().decode("utf-32-le").encode() for row in grams.astype("<u4")]
    lengths = np.array([len(e) for e in encoded])
    out = []
    for length in np.unique(lengths):
        rows = np.frombuffer(b"".join(e for e in encoded if len(e) == length), np.uint8).reshape(-1, length)
        out.append(_hashed(rows).view(np.int64) % BITS)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


@cache
def _ascii_bits() -> np.ndarray:
    """The bit of every n-gram of ASCII characters, by its characters in 7 bits each."""
    numbers = np.arange(1 << 7 * GRAM)
    rows = np.stack([numbers >> 7 * (GRAM - 1 - k) & 127 for k in range(GRAM)], axis=1).astype(np.uint8)
    return _hashed(rows).view(np.int64) % BITS


class _PartBits:
    """The bits of the texts of one part."""

    def __init__(self) -> None:
        self.ascii, self.other = np.zeros(1 << 7 * GRAM, bool), np.zeros(BITS, bool)

    def add(self, texts: list[bytes]) -> None:
        """Texts are read as one, and n-grams that go over an end are left out."""
        joined = b"".join(texts)
        if joined.isascii():
            chars, lengths = np.frombuffer(joined, np.uint8), list(map(len, texts))
        else:
            plain = [t.decode(errors="replace") for t in texts]
            chars, lengths = np.frombuffer("".join(plain).encode("utf-32-le"), "<u4"), list(map(len, plain))
        if len(chars) < GRAM:
            return
        places = len(chars) - GRAM + 1
        inside = np.ones(len(chars), bool)
        ends = np.cumsum(lengths)
        for k in range(1, GRAM):
            inside[ends[ends >= k] - k] = False
        inside = inside[:places]
        windows = [chars[k:places + k] for k in range(GRAM)]
        if chars.dtype != np.uint8:
            plain = np.maximum.reduce(windows) < 128
            foreign = np.stack([w[inside & ~plain] for w in windows], axis=1).astype(np.uint64)
            if len(foreign):
                # A code point has 21 bits.
                keys = np.unique(foreign @ np.array([1 << 21 * (GRAM - 1 - k) for k in range(GRAM)], np.uint64))
                grams = np.stack([keys >> np.uint64(21 * (GRAM - 1 - k)) & np.uint64((1 << 21) - 1) for k in range(GRAM)], axis=1)
                self.other[_bits_of_grams(grams)] = True
            inside = inside & plain
        numbers = windows[0].astype(np.int32)
        for window in windows[1:]:
            numbers = numbers << 7 | window
        self.ascii[numbers[inside]] = True

    def bitmaps(self) -> list[tuple[int, bytes]]:
        """By bucket, as ``bitmap_bucket_number`` and ``bitmap_bit_position`` count: bit 0 alone, then buckets from bit 1 on."""
        found = self.other.copy()
        found[_ascii_bits()[self.ascii]] = True
        out = []
        for bucket, first in enumerate([0, *range(1, BITS, BUCKET)]):
            some = found[first:first + (BUCKET if bucket else 1)]
            if some.any():
                out.append((bucket, np.packbits(some, bitorder="little").tobytes().ljust(BUCKET // 8, b"\0")))
        return out


def _bitmaps_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``part, clean`` to BITMAPS; a part without n-grams gives a row, too. Rows of a part stand together."""
    def ended(part: int, bits: _PartBits) -> pa.RecordBatch:
        rows = bits.bitmaps() or [(None, bytes(BUCKET // 8))]
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * len(rows), pa.int32()), pa.array([b for b, _ in rows], pa.int64()), pa.array([m for _, m in rows], pa.binary())],
            names=["part", "bucket", "bitmap"])

    part, bits = None, None
    for batch in batches:
        parts = batch.column("part").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1), len(parts)]
        for start, end in zip(cuts, cuts[1:]):
            if start == end:
                continue
            if bits is None or parts[start] != part:
                if bits is not None:
                    yield ended(part, bits)
                part, bits = int(parts[start]), _PartBits()
            texts = batch.column("clean").slice(start, end - start)
            bits.add([t for t in texts.drop_null().to_pylist() if t])
    if bits is not None:
        yield ended(part, bits)


def store_corpus(sources: DataFrame, store: str, parts: int = PARTS, cluster_by: str | Column = "path") -> None:
    """Write ``path, content`` in at most ``parts`` parts, and their signatures; a part should fill some splits.

    Rows of one ``cluster_by`` may fill several parts. Rows without content are kept, without a text to search.
    ``store`` must not hold a corpus.
    """
    spark = sources.sparkSession
    texts, signatures = _folders(store)
    near = F.col(cluster_by) if isinstance(cluster_by, str) else cluster_by
    rows = sources.select("path", strip_comments(F.col("content")).alias("clean"), near.alias("near"))
    dealt = rows.repartitionByRange(parts, "near", F.xxhash64("clean"), F.monotonically_increasing_id())
    dealt.select("path", "clean", F.spark_partition_id().alias("part")).write.partitionBy("part").parquet(texts)
    # A part of texts without n-grams has a row, too, so the signatures name all parts.
    bitmaps = stored_texts(spark, store).select("part", F.col("clean").cast("binary").alias("clean")).mapInArrow(_bitmaps_of, BITMAPS)
    bitmaps.groupBy("part", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap")).write.parquet(signatures)


def stored_texts(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema("path string, clean string, part int").parquet(_folders(store)[0])


def _is_set(bitmaps: Column, bit: Column) -> Column:
    def in_bucket(position: Column) -> Column:
        byte = F.substring(bitmaps[F.bitmap_bucket_number(bit)], F.floor(position / 8).cast("int") + 1, F.lit(1))
        power = F.element_at(F.array(*[F.lit(1 << n) for n in range(8)]), (position % 8 + 1).cast("int"))
        return F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(power) != 0

    return F.coalesce(let(F.bitmap_bit_position(bit), in_bucket), F.lit(False))


def possible_rules(spark: SparkSession, store: str, pack: RulePack) -> DataFrame:
    """``part, orders``: each part with the orders of the rules that can match there."""
    rules = rule_array(pack)
    signatures = spark.read.schema(BITMAPS).parquet(_folders(store)[1])
    whole = signatures.groupBy("part").agg(F.map_from_entries(F.collect_list(
        F.when(F.col("bucket").isNotNull(), F.struct("bucket", "bitmap")))).alias("bitmaps"))

    def possible(rule: Column) -> Column:
        # A literal shorter than an n-gram has no bits and excludes nothing.
        return F.forall(rule["required"], lambda s: F.exists(
            s, lambda literal: F.forall(_bits_of(literal), lambda bit: _is_set(F.col("bitmaps"), bit))))

    return whole.select("part", F.transform(F.filter(rules, possible), lambda r: r["rule_order"]).alias("orders"))


def _searched(spark: SparkSession, store: str, possible: DataFrame, max_sent: int) -> DataFrame:
    needed = possible.where(F.size("orders") > 0)
    numbers = needed.agg(F.coalesce(F.sum(F.size("orders") + 1), F.lit(0)).alias("n")).first().n
    return stored_texts(spark, store).join(F.broadcast(needed) if numbers <= max_sent else needed, "part")


def _possible(pack: RulePack) -> Column:
    return F.filter(rule_array(pack), lambda r: F.array_contains("orders", r["rule_order"]))


def texts_to_search(spark: SparkSession, store: str, pack: RulePack, max_sent: int = MAX_SENT) -> DataFrame:
    """``path, clean, part, rules``: the texts of the parts in which some rule is possible, and these rules as an array of RULE."""
    searched = _searched(spark, store, possible_rules(spark, store, pack), max_sent)
    return searched.select("path", "clean", "part", _possible(pack).alias("rules"))


def rule_hit_flags_indexed(spark: SparkSession, store: str, pack: RulePack, max_sent: int = MAX_SENT) -> DataFrame:
    """The rows of ``rule_hit_flags`` for a stored corpus; a row without content has no rule."""
    if not len(pack):
        return stored_texts(spark, store).select("path", F.array().cast("array<string>").alias("rule_ids"))
    possible = written(possible_rules(spark, store, pack), "possible-rules")
    ids = let(_possible(pack), lambda rules: F.transform(matching_rules(F.col("clean"), rules), lambda r: r["rule_id"]))
    searched = _searched(spark, store, possible, max_sent).select("path", ids.alias("rule_ids"))
    skipped = possible.where(F.size("orders") == 0).select("part")
    rest = stored_texts(spark, store).join(skipped, "part").select("path", F.array().cast("array<string>").alias("rule_ids"))
    return searched.unionByName(rest)
