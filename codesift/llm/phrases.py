"""Phrase collocations by Toivonen's sampling method, with exact counts.

A sample of the documents proposes a set of phrases. A full pass counts the set and its negative border, the
phrases outside it whose parts are all inside. If a phrase of the border is frequent, the sample missed
it: it joins the set, and a further pass counts what the border gained. This pass looks ahead: it also counts
phrases whose parts are new to the border themselves, so that it meets all that can still be frequent, however long,
and the border is closed behind it.

The set may be large, so tasks get it as a bitmap of hashes with ``SPARSE`` places for each phrase, up to
``2 ** BITS``, which are 16 MB. A place that two phrases share makes a task count a phrase too many, never too few. Phrases of
the set are counted by their words. Phrases of the border are counted by a hash of 64 bits: such a count can
only be too high, and a phrase that seems frequent by it is counted by its words in the next pass. The
driver sees the places of a bitmap only. The sample is mined by the same passes from an empty set, with a
threshold lowered in proportion, and halved once more so that few phrases are missed.

Counts are summed for portions of some megabytes in the task, then by Spark before and after the shuffle, so common phrases
are no hot keys. Scores and the choice of phrases are joins and groupings of frequent phrases only.

Defined cases: a null text is empty, a null language is ``und``; repeated rows count as often as
they come; an empty table gives no rows; only the columns named are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codesift.llm.common import portions, stored

MIN_COUNT = 100
LONGEST = 5
TOP = 2000
SAMPLE = 10
BITS = 27
FEWEST_BITS = 16
SPARSE = 64
PORTION = 4 << 20
HELD = 2 << 20
GROUPS = 64
# Letters fall to lower case, stops and line ends part pieces, tabs are blanks.
_LETTERS = bytes.maketrans(bytes(range(65, 91)) + b"\t", bytes(range(97, 123)) + b" ")
_CLEANED = _LETTERS.translate(bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(32))


class PhraseSet:
    """A set of phrases as a bitmap of their hashes; it may hold more than was put in."""

    def __init__(self, bits: int, places: np.ndarray):
        self.bits = bits
        self.places = places

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> np.uint64(64 - self.bits)
        return (self.places[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)

    @staticmethod
    def of(phrases: DataFrame | None, most_bits: int) -> PhraseSet:
        """The phrases of a column ``hash``; at most one row for each 64 places comes to the driver."""
        bits = min(most_bits, max(FEWEST_BITS, (SPARSE * (phrases.count() if phrases else 0)).bit_length()))
        places = np.zeros(1 << bits - 6, np.uint64)
        if phrases:
            place = F.shiftrightunsigned("hash", 64 - bits)
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
            found = phrases.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(bit).alias("bit")).toArrow()
            places[found.column("at").to_numpy()] = found.column("bit").to_numpy().view(np.uint64)
        return PhraseSet(bits, places)


class _Words:
    """The words of some texts of one language, with the ends of pieces between."""

    def __init__(self, lang: str, texts: list[bytes]):
        cleaned = b"\n".join(texts).translate(_CLEANED).replace(b"\n", b" \n ")
        numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        numbers[b"\n"]  # noqa: B018  the end of a piece is number 0
        known = numbers.__getitem__
        self.at = np.array([known(w) for w in cleaned.split(b" ") if w], np.int64)
        self.names = list(numbers)
        seed = xxhash.xxh64_intdigest(lang.encode())
        self.hashes = _mixed(np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.names), np.uint64, len(self.names)))

    def phrase(self, place: int, length: int) -> bytes:
        return b" ".join([self.names[i] for i in self.at[place:place + length].tolist()])


class _Pass:
    """What a pass over the documents counts.

    ``known``: the set so far; ``fresh``: the phrases of it to count by words; ``old``: the set under which
    phrases were counted before. With ``ahead`` a phrase whose parts are in the set, or never counted
    themselves, is counted as well: that is all the border may still come to hold, so one pass closes it.
    """

    def __init__(self, known: PhraseSet, fresh: PhraseSet | None = None, old: PhraseSet | None = None, border: bool = True, ahead: bool = False):
        self.known, self.fresh, self.old, self.border, self.ahead = known, fresh, old, border, ahead

    def phrases(self, words: _Words, longest: int) -> Iterator[tuple[bool, np.ndarray, list[bytes], np.ndarray]]:
        """Whether by words, hashes, phrases and counts, length by length."""
        known, fresh, old = self.known, self.fresh, self.old
        counts = np.bincount(words.at, minlength=1)
        held = known.holds(words.hashes)
        held_before = old.holds(words.hashes) if old else np.zeros(len(held), bool)
        held[0] = held_before[0] = False
        if fresh:
            which = np.flatnonzero(held & fresh.holds(words.hashes))
            yield True, words.hashes[which], [words.names[i] for i in which], counts[which]
        if self.border and old is None:
            # Single words have no parts: the first pass counts all.
            which = np.flatnonzero(~held[1:]) + 1
            yield False, words.hashes[which], [], counts[which]
        # From here on by place: the hash of the phrase that starts there, and where longer ones may start.
        single = words.hashes[words.at]
        hashes, inside, inside_before = single, held[words.at], held_before[words.at]
        for length in range(2, longest + 1):
            places = np.flatnonzero(inside[:-1] & inside[1:])
            if not len(places):
                return
            own = _mixed(hashes[places] * np.uint64(0x9E3779B97F4A7C15) + single[places + length - 1])
            before = inside_before[places] & inside_before[places + 1]
            holds = known.holds(own)
            named = holds & fresh.holds(own) if fresh else np.zeros(len(own), bool)
            if fresh:
                keys, at, n = np.unique(own[named], return_index=True, return_counts=True)
                yield True, keys, [words.phrase(p, length) for p in places[named][at].tolist()], n
            if self.border:
                keys, n = np.unique(own[~(named | before)], return_counts=True)
                yield False, keys, [], n
            size = len(inside) - 1
            hashes, inside, inside_before = np.zeros(size, np.uint64), np.zeros(size, bool), np.zeros(size, bool)
            hashes[places] = own
            inside[places] = holds | ~before if self.ahead else holds
            if old:
                inside_before[places] = before & old.holds(own)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])
    return keys[first], np.add.reduceat(n[order], first) if len(first) else n


def _counting(sent, longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``sent`` is the broadcast of a pass."""
    def rows(hashes: np.ndarray, names: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), names, pa.array(n.astype(np.int64))], ["hash", "name", "n"])

    def count_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, border = sent.value, []
        for part in portions(batches, "text", PORTION):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                words, prefix = _Words(lang, texts), lang.encode() + b"\n"
                for by_words, hashes, phrases, n in work.phrases(words, longest):
                    if by_words:
                        yield rows(hashes, pa.array([prefix + p for p in phrases], pa.binary()).cast(pa.string()), n)
                    else:
                        border.append((hashes, n))
                if work.fresh and work.old is None and work.border:
                    # A row without a phrase holds the number of all words.
                    yield rows(np.zeros(1, np.uint64), pa.array([lang + "\n"]), np.array([np.count_nonzero(words.at)]))
            if sum(len(n) for _, n in border) > HELD:
                border = [_summed(border)]
                if len(border[0][1]) > HELD // 2:
                    yield rows(border[0][0], pa.nulls(len(border[0][1]), pa.string()), border[0][1])
                    border = []
        if border:
            hashes, n = _summed(border)
            yield rows(hashes, pa.nulls(len(n), pa.string()), n)

    return count_phrases


def _counted(texts: DataFrame, work: _Pass, least: float, longest: int) -> DataFrame:
    """``hash, name, n`` of what comes ``least`` times; ``name`` is null for the border, and the language
    and a line end for the number of words."""
    sent = texts.sparkSession.sparkContext.broadcast(work)
    found = texts.mapInArrow(_counting(sent, longest), "hash long, name string, n long").groupBy("hash", "name").agg(F.sum("n").alias("n"))
    found = stored(found.where((F.col("n") >= least) | F.col("name").endswith("\n")), "phrase-counts")
    sent.destroy()
    return found


def _proposed(texts: DataFrame, least: float, longest: int, bits: int) -> DataFrame:
    """Hashes of the phrases that come ``least`` times in a sample, length by length from an empty set."""
    known, old, new = [], None, PhraseSet.of(None, bits)
    while True:
        known.append(_counted(texts, _Pass(new, old=old), least, longest).select("hash"))
        if known[-1].isEmpty():
            return reduce(DataFrame.unionByName, known)
        old, new = new, PhraseSet.of(reduce(DataFrame.unionByName, known), bits)


def frequent_phrases(
    docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, sample: int = SAMPLE, bits: int = BITS,
    text: str = "text", lang: str = "lang",
) -> DataFrame:
    """``lang, phrase, n``: all phrases of up to ``longest`` words that come ``min_count`` times in their
    language, with exact counts, and for each language a row with an empty phrase, the number of its words.

    One document in ``sample`` proposes phrases; that changes the work of the passes, not the result.
    """
    texts = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    # Copies are told apart by where they stand, so a large group of them is sampled like other documents.
    place = F.xxhash64("text", F.monotonically_increasing_id())
    proposing = stored(texts.where(F.pmod(place, F.lit(sample)) == 0), "phrase-sample")
    known = _proposed(proposing, max(2, min_count / sample / 2), longest, bits)
    first = old = PhraseSet.of(known, bits)
    found = _counted(texts, _Pass(first, fresh=first), min_count, longest)
    tables, ahead = [found], True
    while not (missed := found.where("name IS NULL").select("hash")).isEmpty():
        # What the border failed on joins the set and is counted by words. The second pass counts the border
        # to its end, so the third, which names what the second found, has no border left.
        known = known.unionByName(found.where("hash <> 0 OR name IS NULL").select("hash"))
        work = _Pass(PhraseSet.of(known, bits), PhraseSet.of(missed, bits), old if ahead else None, border=ahead, ahead=ahead)
        found = _counted(texts, work, min_count, longest)
        tables.append(found)
        ahead = False
    named = reduce(DataFrame.unionByName, tables).where("name IS NOT NULL").select("name", "n").distinct()
    phrase = F.substring_index("name", "\n", -1)
    return named.select(F.left("name", F.length("name") - F.length(phrase) - 1).alias("lang"), phrase.alias("phrase"), "n")


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, sample: int = SAMPLE,
    bits: int = BITS, text: str = "text", lang: str = "lang",
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of each language by their weakest cut."""
    found = frequent_phrases(docs, min_count, longest, sample, bits, text, lang)
    totals = found.where("phrase = ''").select("lang", F.col("n").alias("total"))
    known = found.where("phrase <> ''").withColumn("words", F.split("phrase", " "))
    candidates = known.where(F.size("words") > 1)
    # A longer phrase that holds this one as often does so through those of one word more.
    size = F.size("words")
    parts = F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))
    inside = candidates.where(size > 2).select("lang", F.explode(parts).alias("part"), "n").select(
        "lang", F.array_join("part", " ").alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = candidates.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("n"))).drop("longer")

    cuts = F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.struct(
        k.alias("k"), F.array_join(F.slice("words", F.lit(1), k), " ").alias("head"),
        F.array_join(F.slice("words", k + 1, F.size("words") - k), " ").alias("tail")))
    cut = kept.select("lang", "phrase", F.col("n").alias("a"), F.explode(cuts).alias("cut")).select("lang", "phrase", "a", "cut.*")
    left = known.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    right = known.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    scored = cut.join(left, ["lang", "head"]).join(right, ["lang", "tail"]).join(totals, "lang").withColumn(
        "score", F.expr("(CAST(1000 AS DECIMAL(38,0)) * a * total) DIV (CAST(l AS DECIMAL(38,0)) * r)"))
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", F.col("total").alias("n"))).alias("best"))
    rows = weakest.select("lang", "phrase", "best.*")

    # The best of a language are among the best of its parts.
    best = (F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    part = F.pmod(F.xxhash64("phrase"), F.lit(GROUPS))
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*best))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM piece
), place AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words
), phrases AS (
  SELECT lang, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, k, count(*) AS f
  FROM place CROSS JOIN (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL
), total AS (
  SELECT lang, count(*) AS n FROM place GROUP BY lang
), frequent AS (
  SELECT lang, phrase, k, f, string_split(phrase, ' ') AS w FROM phrases WHERE f >= 100
), longer AS (
  SELECT lang, array_to_string(list_slice(w, s, s + z - 1), ' ') AS phrase, max(f) AS f
  FROM (SELECT lang, w, f, k, z, unnest(range(1, k - z + 2)) AS s FROM frequent CROSS JOIN (SELECT unnest(range(2, 5)) AS z) WHERE z < k)
  GROUP BY ALL
), cut AS (
  SELECT c.lang, c.phrase, c.f AS a, c.cut, h.f AS l, t.f AS r, total.n,
    (1000::HUGEINT * c.f * total.n) // (h.f::HUGEINT * t.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM frequent WHERE k > 1) c
  JOIN phrases h ON h.lang = c.lang AND h.phrase = array_to_string(list_slice(c.w, 1, c.cut), ' ')
  JOIN phrases t ON t.lang = c.lang AND t.phrase = array_to_string(list_slice(c.w, c.cut + 1, c.k), ' ')
  JOIN total ON total.lang = c.lang
), weakest AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY w.score DESC, w.a DESC, w.phrase) AS rank, w.phrase,
    w.a, w.l, w.r, w.n, w.score::BIGINT AS score
  FROM weakest w LEFT JOIN longer ON longer.lang = w.lang AND longer.phrase = w.phrase
  WHERE longer.f IS NULL OR 100 * longer.f < 100 * w.a
) WHERE rank <= 2000
"""
