"""Repeated passages: seeds from winnowed anchors, extended both ways, maximal repeats removed.

A window is ``WINDOW`` neighbouring words of a document. Words covered by a window that also starts
earlier, in a smaller document or before in the same one, are removed.

1. The anchor of a window is the least hash of ``SEED`` words in it, the leftmost of equal ones. Equal
   windows have equal anchors at equal places, so only documents that share an anchor need to meet. The
   windows of one anchor are neighbours; extended over all of them the anchor stands for a stretch of words.
2. Occurrences of an anchor whose whole stretches are equal form a class. All windows of all but
   the first occurrence of a class start earlier, so copies of any number are settled without pairs: the
   portion of documents at hand settles its own, and one row for each anchor of a portion goes on.
3. Anchors of one class only are done. Where an anchor has several, as at the ends of a repeat, the
   windows of the first occurrences of its classes are grouped by their own hashes, and the first of each stays.
4. A document meets its own marks, and neighbouring removed windows merge into maximal spans.

An anchor that is in most documents, in stretches that all differ, sends one row for each portion too: the
portion knows that its classes are several, and tells so with one row. Hashes of
stretches and windows have 128 bits. A document is the unit of work; texts are shuffled twice, to their marks.

Defined cases: a null or blank text has no words. Documents are ordered by id, those without an id
last by a hash of the text. Rows with one id and the same text are one document and get the same result; rows
with one id and different texts are ordered by a hash of the text. Ids must be integers. An empty table
gives no rows; only the columns named are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codesift.llm.common import portions, stored

WINDOW = 20
SEED = 5
PLACES = WINDOW - SEED + 1
PORTION = 6 << 20
KNOWN = 1 << 20
DOCUMENT = ["unnamed", "id", "version"]
# Kinds of rows: an anchor's class, a settled repeat, a class among several, a sign that an anchor has several, a first window.
CLASS, REPEAT, SEVERAL, SIGN, FIRST = range(5)
OCCURRENCE = "anchor long, stretch long, unnamed boolean, id long, version int, place int, kind int"
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class WordHashes(dict):
    """Hashes of words, kept as long as there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(32))


class Passage:
    """The words of some documents in one row, with the stretches of their anchors.

    ``first`` holds the place of each document's first word; ``anchors``, ``low`` and ``high`` the places of
    the anchors and of the first and last window of each, in order of place.
    """

    def __init__(self, documents: list[list[bytes]], hashes: WordHashes):
        lengths = np.array([len(words) for words in documents], np.int64)
        n = int(lengths.sum())
        self.first = np.cumsum(lengths) - lengths
        self.words = np.fromiter((hashes[w] for words in documents for w in words), np.uint64, n)
        self.sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        ends = np.repeat(self.first + lengths, lengths)
        starts = np.flatnonzero(ends - np.arange(n) >= WINDOW)
        if not len(starts):
            self.anchors = self.low = self.high = np.zeros(0, np.int64)
            self.keys = np.zeros(0, np.uint64)
            return
        grams = np.zeros(n - SEED + 1, np.uint64)
        for k in range(SEED):
            grams = grams * np.uint64(BASES[0]) + self.words[k:k + len(grams)]
        grams = _mixed(grams)
        least = np.lib.stride_tricks.sliding_window_view(grams, PLACES)
        chosen = np.concatenate([
            part + least[part].argmin(axis=1) for part in np.array_split(starts, 1 + len(starts) // (1 << 16))])
        new = np.flatnonzero(np.diff(chosen, prepend=-1))
        self.anchors, self.low = chosen[new], starts[new]
        self.high = starts[np.append(new[1:], len(starts)) - 1]
        self.keys = grams[self.anchors]

    def _between(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        """Hashes of the words from ``start`` to before ``end``, whatever place they stand at."""
        if which not in self.sums:
            base, n = BASES[which], len(self.words)
            up = np.cumprod(np.full(n + 1, base, np.uint64)) * np.uint64(pow(base, -1, 1 << 64))
            down = np.cumprod(np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)) * np.uint64(base)
            words = self.words if not which else _mixed(self.words)
            self.sums[which] = np.concatenate([[np.uint64(0)], np.cumsum(words * up[:n])]), down
        sums, down = self.sums[which]
        return _mixed((sums[end] - sums[start]) * down[start])

    def stretches(self) -> np.ndarray:
        """A hash for each anchor of all its windows and its place among them."""
        place = (self.anchors - self.low).astype(np.uint64) << np.uint64(8)
        width = (self.high - self.low).astype(np.uint64)
        return _mixed(self._between(self.low, self.high + WINDOW, 1) + place + width)

    def windows(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._between(starts, starts + WINDOW, 0), self._between(starts, starts + WINDOW, 1)

    def owner(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, "right") - 1

    def spread(self, which: np.ndarray) -> np.ndarray:
        """The starts of all windows of the anchors numbered ``which``."""
        sizes = self.high[which] - self.low[which] + 1
        return np.repeat(self.low[which] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _split(rows: pa.RecordBatch) -> list[list[bytes]]:
    return [(t or b"").split() for t in rows.column(rows.schema.get_field_index("text")).to_pylist()]


def _documents(rows: pa.RecordBatch) -> list[np.ndarray]:
    return [rows.column(rows.schema.get_field_index(name)).to_numpy(zero_copy_only=False) for name in DOCUMENT]


def _batch(schema: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of a portion: what it can settle itself is settled, and the rest goes to the anchor's group."""
    names = [part.split()[0] for part in OCCURRENCE.split(", ")]
    hashes = WordHashes()
    for rows in portions(batches, "text", PORTION):
        passage = Passage(_split(rows), hashes)
        document = _documents(rows)
        order = np.lexsort(document[::-1])
        differ = np.zeros(len(order), bool)
        for column in document:
            differ[1:] |= column[order][1:] != column[order][:-1]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(differ)
        owner = passage.owner(passage.anchors)
        place = passage.anchors - passage.first[owner]
        key, stretch = passage.keys, passage.stretches() if len(passage.keys) else passage.keys
        # Anchors that come once in the portion need no ordering by document.
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        often = np.append(same, False) | np.append(False, same) if len(order) else np.zeros(0, bool)
        once, order = order[~often], order[often]
        at = rank[owner] << 32 | place
        order = order[np.lexsort((at[order], stretch[order], key[order]))]
        new_key = np.append(True, key[order][1:] != key[order][:-1])[:len(order)]
        new_class = new_key | np.append(True, stretch[order][1:] != stretch[order][:-1])[:len(order)]
        group = np.cumsum(new_key) - 1
        several = np.bincount(group[new_class], minlength=1)[group] > 1 if len(order) else new_key
        first = order[new_class][np.cumsum(new_class) - 1] if len(order) else order
        repeat = at[order] != at[first]
        kinds = np.concatenate([
            np.full(len(once), CLASS), np.where(repeat, REPEAT, np.where(several, SEVERAL, CLASS)), np.full((new_key & several).sum(), SIGN)])
        which = np.concatenate([once, order, order[new_key & several]])
        # Equal rows are one document.
        stays = np.concatenate([np.ones(len(once), bool), new_class | repeat, np.ones(len(kinds) - len(once) - len(order), bool)])
        kinds, which = kinds[stays], which[stays]
        settled = (kinds == REPEAT) | (kinds == SEVERAL)
        # Settled rows only pass by; they are dealt out evenly.
        anchor = np.where(settled, _mixed(at[which].astype(np.uint64) + key[which]), key[which]).view(np.int64)
        yield _batch(
            names, anchor, pa.array(stretch[which].view(np.int64), mask=kinds != CLASS),
            *[column[owner[which]] for column in document], place[which].astype(np.int32), kinds.astype(np.int32))


def _marked(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the row, kind and place of all marks of a portion."""
    marks = rows.column(rows.schema.get_field_index("marks"))
    counts = np.diff(marks.offsets.to_numpy())
    values = marks.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(counts)), counts), values & 7, values >> 3


def _several_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the marked anchors of each document."""
    hashes = WordHashes()
    for rows in portions(batches, "text", PORTION):
        passage = Passage(_split(rows), hashes)
        row, _, place = _marked(rows)
        starts = passage.spread(np.searchsorted(passage.anchors, np.sort(passage.first[row] + place)))
        if not len(starts):
            continue
        owner = passage.owner(starts)
        one, other = passage.windows(starts)
        yield _batch(
            ["one", "other", *DOCUMENT, "place"], one.view(np.int64), other.view(np.int64),
            *[column[owner] for column in _documents(rows)], (starts - passage.first[owner]).astype(np.int32))


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans and kept words of each document."""
    hashes = WordHashes()
    for rows in portions(batches, "text", PORTION):
        documents = _split(rows)
        row, kind, place = _marked(rows)
        spans: list[list[dict[str, int]]] = [[] for _ in documents]
        removed = np.zeros(len(documents), np.int64)
        marked = np.unique(row)
        if len(marked):
            passage = Passage([documents[i] for i in marked], hashes)
            at = passage.first[np.searchsorted(marked, row)] + place
            anchor = np.searchsorted(passage.anchors, at)
            covered = np.zeros(len(passage.words) + WINDOW, bool)
            covered[passage.spread(anchor[(kind == REPEAT) | (kind == SEVERAL)])] = True
            covered[at[kind == FIRST]] = False
            starts = np.flatnonzero(covered)
            depth = np.zeros(len(passage.words) + 1, np.int64)
            np.add.at(depth, starts, 1)
            np.add.at(depth, starts + WINDOW, -1)
            gone = np.cumsum(depth)[:-1] > 0
            # Spans end where a document does.
            begins = gone.copy()
            begins[1:] &= ~gone[:-1] | np.isin(np.arange(1, len(gone)), passage.first)
            low = np.flatnonzero(begins)
            owner = passage.owner(low)
            size = np.diff(np.append(np.cumsum(gone)[low] - 1, gone.sum()))
            for i, start, length in zip(owner.tolist(), (low - passage.first[owner]).tolist(), size.tolist(), strict=True):
                spans[marked[i]].append({"start": start, "end": start + length})
                removed[marked[i]] += length
        kept = []
        for words, cut in zip(documents, spans, strict=True):
            if cut:
                bounds = [0, *[x for s in cut for x in (s["start"], s["end"])], len(words)]
                words = [w for a, b in zip(bounds[::2], bounds[1::2], strict=True) for w in words[a:b]]
            kept.append(b" ".join(words))
        total = np.array([len(words) for words in documents], np.int64)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield _batch(
            ["unnamed", "id", "n_words", "n_removed", "spans", "kept"], *_documents(rows)[:2], total, removed,
            pa.array(spans, span), pa.array(kept, pa.binary()).cast(pa.string()))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, spans, kept`` for every row of ``docs``: the removed words as maximal
    spans of word numbers from 0, and the others joined by one blank."""
    document = docs.select(
        F.col(doc_id).isNull().alias("unnamed"),
        F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(text)).alias("id"), F.hash(text).alias("version"),
        F.col(text).cast("binary").alias("text"),
    )
    met = document.mapInArrow(_occurrences, OCCURRENCE).repartition("anchor")
    whole, by_class = Window.partitionBy("anchor"), Window.partitionBy("anchor", "stretch")
    here = F.struct(*DOCUMENT, "place")
    met = met.withColumn("first", F.min(F.when(F.col("kind") == CLASS, here)).over(by_class))
    different = (F.min("stretch").over(whole) != F.max("stretch").over(whole)) | (F.max((F.col("kind") == SIGN).cast("int")).over(whole) == 1)
    met = met.withColumn("several", different)
    settled = F.when(F.col("kind").isin(REPEAT, SEVERAL), F.col("kind")).when(
        F.col("kind") == CLASS, F.when(here != F.col("first"), REPEAT).when(F.col("several"), SEVERAL))
    marks = stored(met.select(*DOCUMENT, "place", settled.alias("kind")).where("kind IS NOT NULL"), "substring-marks")

    def with_marks(rows: DataFrame, how: str) -> DataFrame:
        packed = rows.groupBy(*DOCUMENT).agg(F.collect_list(F.shiftleft(F.col("place").cast("long"), 3).bitwiseOR(F.col("kind"))).alias("marks"))
        joined = document.join(packed, DOCUMENT, how)
        return joined.select(*DOCUMENT, "text", F.coalesce("marks", F.array().cast("array<long>")).alias("marks"))

    several = with_marks(marks.where(F.col("kind") == SEVERAL), "inner")
    windows = several.mapInArrow(_several_windows, "one long, other long, unnamed boolean, id long, version int, place int")
    firsts = windows.groupBy("one", "other").agg(F.min(here).alias("first")).select("first.*", F.lit(FIRST).alias("kind"))
    cleaned = with_marks(marks.unionByName(firsts), "left").mapInArrow(
        _cleaned, "unnamed boolean, id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string")
    return cleaned.select(
        F.when(~F.col("unnamed"), F.col("id")).alias("doc_id"), "n_words", "n_removed", "spans", "kept")


def substring_report(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH split AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), windows AS (
  SELECT doc_id, i, list_slice(words, i, i + 19) AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM split WHERE len(words) >= 20)
), repeats AS (
  SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1
), word AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM split
), judged AS (
  SELECT word.doc_id, word.word, word.i,
    coalesce(word.i - max(repeats.i) OVER (PARTITION BY word.doc_id ORDER BY word.i ROWS UNBOUNDED PRECEDING) < 20, false) AS gone
  FROM word LEFT JOIN repeats ON word.doc_id = repeats.doc_id AND word.i = repeats.i
), kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS words
  FROM judged GROUP BY doc_id
)
SELECT split.doc_id, len(split.words)::BIGINT AS n_words, coalesce(kept.n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(kept.words, '')) AS kept_sha256
FROM split LEFT JOIN kept ON split.doc_id = kept.doc_id
"""
