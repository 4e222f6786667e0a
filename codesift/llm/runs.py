"""Periodic runs of words by multi-scale minimizers.

A run is a stretch of words with a smallest period q, at least ``MIN_LENGTH`` and
``MIN_PERIODS * q`` words long, that no neighbouring word extends. Periods are searched in
scales, each twice as long as the one before:

1. Periods up to ``SHORT`` are too short for sampling. For each of them the words are compared with those
   one period on; stretches of equal words are the runs.
2. At scale P, for periods over P/2 and up to P, the hashes of P words from each place on come
   from those of the scale before. A place is a minimizer if its hash is the least of a window of P/2
   places. In a run of period q the windows repeat at distance q, so a minimizer comes back there, and not
   nearer, as P words that come back earlier would make the period shorter. A run of four periods holds
   such a pair; neighbouring minimizers with equal hashes at a distance of the scale are the seeds.
3. A seed is extended to both sides by comparing words, so a wrong hash cannot make a run. Stretches whose
   period is a multiple of a shorter one are left to that one.

Documents are taken by portions: the words of many are joined with a separator each that equals nothing, and the scales
run over all of them at once. A document is the unit of work; extensions read each part of it
a few times for every scale, so work grows as words times the logarithm of the longest document.

Defined cases: a null or blank text has no words, no runs and an empty collapsed text; a null id is a value like
any other; repeated rows are judged each on its own; an empty table gives no rows; only the columns
named are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from codesift.functions.text import let
from codesift.llm.common import portions, words_of

MIN_LENGTH = 6
MIN_PERIODS = 4
SHORT = 16
PORTION = 4 << 20
RUN = StructType().add("start", LongType()).add("length", LongType()).add("period", LongType())
SPREAD, FOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * SPREAD
    return values ^ (values >> np.uint64(29))


def _sliding(values: np.ndarray, width: int, best: np.ufunc, worst: int) -> np.ndarray:
    """The best of every ``width`` neighbours, from the bests of the beginnings and ends of blocks."""
    fill = np.full(-len(values) % width, worst, values.dtype)
    blocks = np.concatenate([values, fill]).reshape(-1, width)
    ends = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    beginnings = best.accumulate(blocks, axis=1).ravel()
    return best(ends[:len(values) - width + 1], beginnings[width - 1:len(values)])


def _seeds(hashes: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """``period, place`` of neighbouring equal minimizers at a distance of the scale, sorted."""
    width = scale // 2
    if len(hashes) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = _sliding(hashes, width, np.minimum, np.iinfo(np.uint64).max)
    edge = np.zeros(width - 1, np.uint64)
    chosen = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), width, np.maximum, 0) == hashes)
    keys = hashes[chosen]
    order = np.argsort(keys, kind="stable")
    keys, places = keys[order], chosen[order]
    distance = np.diff(places)
    good = (keys[1:] == keys[:-1]) & (distance > width) & (distance <= scale)
    period, place = distance[good], places[:-1][good]
    order = np.lexsort((place, period))
    return period[order], place[order]


def _last_equal(words: np.ndarray, place: int, period: int) -> int:
    """The first place from ``place`` on whose word differs from the one a period on."""
    width = 64
    while True:
        one, other = words[place:place + width], words[place + period:place + period + width]
        differ = np.flatnonzero(one[:len(other)] != other)
        if len(differ):
            return place + int(differ[0])
        place += len(other)
        if len(other) < width:
            return place
        width *= 2


def _first_equal(words: np.ndarray, place: int, period: int) -> int:
    """The start of the equal stretch that reaches up to ``place``."""
    width = 64
    while place:
        low = max(0, place - width)
        differ = np.flatnonzero(words[low:place] != words[low + period:place + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        place = low
        width *= 2
    return 0


def _has_shorter(words: np.ndarray, start: int, period: int) -> bool:
    """Is the first period of a run a repeated shorter one?"""
    rest, factor = period, 2
    while rest > 1:
        if rest % factor == 0 or factor * factor > rest:
            factor = factor if rest % factor == 0 else rest
            step = period // factor
            if (words[start:start + period] == words[start + step:start + step + period]).all():
                return True
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return False


def find_runs(words: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """``start, length, period`` of all runs in an array of word numbers, sorted by start and period.

    ``longest`` is the length of the longest document in it; separators must differ from all else.
    """
    found = []

    def keep(start: int, end: int, period: int) -> None:
        length = end - start + period
        if length >= max(MIN_LENGTH, MIN_PERIODS * period) and not _has_shorter(words, start, period):
            found.append((start, length, period))

    for period in range(1, min(SHORT, longest // MIN_PERIODS) + 1):
        equal = np.flatnonzero(words[:-period] == words[period:])
        cuts = np.flatnonzero(np.diff(equal) > 1)
        starts, ends = np.concatenate([equal[:1], equal[cuts + 1]]), np.concatenate([equal[cuts], equal[-1:]]) + 1
        long = ends - starts >= max(MIN_LENGTH, MIN_PERIODS * period) - period
        for start, end in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            keep(start, end, period)

    hashes, scale = _mixed(words.astype(np.uint64) * SPREAD), 1
    while MIN_PERIODS * (scale + 1) <= longest:
        # From hashes of ``scale`` words to those of twice as many.
        hashes, scale = _mixed(hashes[:-scale] * FOLD + hashes[scale:]), 2 * scale
        if scale <= SHORT:
            continue
        done = (0, 0)
        for period, place in zip(*map(np.ndarray.tolist, _seeds(hashes, scale)), strict=True):
            if done[0] == period and place < done[1]:
                continue
            end = _last_equal(words, place, period)
            done = (period, end)
            if end > place:
                keep(_first_equal(words, place, period), end, period)
    return sorted(found, key=lambda r: (r[0], r[2]))


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in portions(batches, "text", PORTION):
        texts = [(t or b"").split() for t in rows.column(1).to_pylist()]
        known: defaultdict[bytes, int] = defaultdict(count().__next__)
        numbers, firsts = [], []
        for i, words in enumerate(texts):
            numbers.append(-1 - i)
            firsts.append(len(numbers))
            numbers.extend(map(known.__getitem__, words))
        numbers.append(-1 - len(texts))
        array, first = np.array(numbers, np.int64), np.array(firsts, np.int64)
        del numbers
        runs = find_runs(array, max(map(len, texts), default=0))
        dropped = np.zeros(len(array) + 1, np.int64)
        for start, length, period in runs:
            dropped[start + period] += 1
            dropped[start + length] -= 1
        stays = np.cumsum(dropped) == 0
        table = np.array(runs, np.int64).reshape(-1, 3)
        owner = np.searchsorted(first, table[:, 0], "right") - 1
        table[:, 0] -= first[owner]
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
        changed = set(owner.tolist())
        collapsed = []
        for i, words in enumerate(texts):
            if i in changed:
                words = [w for w, stay in zip(words, stays[firsts[i]:firsts[i] + len(words)].tolist(), strict=True) if stay]
            collapsed.append(b" ".join(words))
        structs = pa.StructArray.from_arrays([pa.array(table[:, c]) for c in range(3)], ["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), lists, pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """``doc_id, runs, collapsed`` for every row: the runs with word numbers from 0, and the words that
    are in no run behind its first period, joined by one blank."""
    text = F.col(text) if isinstance(text, str) else text
    named = docs.select(F.col(doc_id).alias("doc_id"), text.cast("binary").alias("text"))
    schema = StructType().add(named.schema["doc_id"]).add("runs", ArrayType(RUN)).add("collapsed", StringType())
    return named.mapInArrow(_judged, schema)


def with_planted_runs(doc_id: Column, text: Column) -> Column:
    """The text of the query's contract: of every tenth id, the words from some place on repeat a short stretch."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))

        def place(i: Column) -> Column:
            return F.get(words, F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int"))

        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), place), " ")

    words = words_of(text)
    return F.when((h % 10 == 0) & F.rlike(text, F.lit(r"[^\x20\x09-\x0D]")), let(words, planted)).otherwise(text)


def run_report(docs: DataFrame) -> DataFrame:
    """Per document the number of runs, the longest one, and digests of all runs and of the collapsed text."""
    found = periodic_runs(docs, text=with_planted_runs(F.col("doc_id"), F.col("text")))
    # Greatest length first, then the smallest start and period.
    order = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    longest = F.col("longest")
    return found.withColumn("longest", F.array_max(order)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-longest["start"]).alias("start"),
        longest["length"].alias("length"), (-longest["period"]).alias("period"),
        F.floor(1000 * longest["length"] / (-longest["period"])).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
