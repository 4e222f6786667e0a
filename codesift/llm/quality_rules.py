"""Quality rules: counts of a text, and how far its make-up lies from that of its language.

Base rules count words, symbols, repeated lines and repeated three-word windows. The
method compares two histograms of a text with references: how its characters fall into
classes, and how often it uses the common words of a language. The references are sums
over all documents of a language that pass the base rules; the distance is the
Jensen-Shannon distance (root of the divergence in bits, 0 to 1) to the nearest
language. A histogram from too little text says nothing, so short texts are not judged
by it; how long a text must be goes by all its characters or words, not by those that are found.

Counts are made in the row of the text without a shuffle, and written once to the
shared folder (a few numbers for each document); the references are one row for each
listed language.

Defined cases: a null or blank text has no words and fails; a null language adds to no
reference, and such a text is compared with all of them; repeated rows are judged each
on their own; an empty table gives no rows. Where no language has a reference, the
distances are null and decide nothing. Only the three columns named are read, so other
columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.functions.text import let
from codesift.llm.common import stored, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOL = r"[#*$%&|<>]"
LINE_WITH_WORD = r"[^\x20\x09-\x0D]"

# Common words of each language, shorter than ``SHORT`` characters.
COMMON = {
    "en": "the of and to in a is that it for was on are as with",
    "fr": "le la de et les des en un une est que dans pour qui au",
    "de": "der die und in den von zu das mit sich des auf ist im dem",
    "es": "el la de que y en un los se del las por con no una",
}
SHORT = 8
# Classes of characters; what is in none of them is counted last.
CLASSES = {
    "lower": r"\p{Ll}", "upper": r"\p{Lu}", "digit": r"\p{Nd}", "blank": r"[\x20\x09-\x0D]",
    "sentence": r"[.,;:!?'\"()-]", "symbol": r"[#*$%&|<>@^~=+/\\_{}\[\]`]",
}


@dataclass(frozen=True)
class Divergence:
    """Largest distances to the nearest language, and how much text is needed to judge.

    Texts whose language is not listed in ``common`` have no fair reference; they are
    judged against the nearest one, so give word lists for all languages of a corpus.

    Among texts of 100 words and more, prose lies up to 0.25 from the words of its language, a text with none of them
    at 0.36, whatever its length; the limit stands between.
    """

    common: dict[str, str] = field(default_factory=lambda: COMMON)
    max_class: float = 0.30
    max_word: float = 0.30
    min_chars: int = 200
    min_words: int = 100

    @property
    def words(self) -> list[str]:
        return sorted({w for listed in self.common.values() for w in listed.split()})


def repeated_window_words(words: Column, width: int = 3) -> Column:
    """Words that lie in a window of ``width`` words found twice or more in the text.

    Windows are compared by their 64-bit hashes, sorted with their places; equal
    neighbours are the repeated ones. Places covered by several
    such windows count once.
    """
    def of_places(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("covered"))
        step = lambda s, p: F.struct(
            (p + width).alias("end"), (s["covered"] + p + width - F.greatest(p, s["end"])).alias("covered")
        )
        return F.aggregate(F.sort_array(places), start, step, lambda s: s["covered"])

    def repeated(s: Column) -> Column:
        same = lambda x, i: F.get(s, i)["h"] == x["h"]
        hit = F.filter(s, lambda x, i: F.coalesce(same(x, i - 1), F.lit(False)) | F.coalesce(same(x, i + 1), F.lit(False)))
        return of_places(F.transform(hit, lambda x: x["at"]))

    def windows(w: Column) -> Column:
        key = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])
        places = F.sequence(F.lit(0), F.size(w) - width)
        return F.sort_array(F.transform(places, lambda i: F.struct(key(i).alias("h"), i.alias("at"))))

    return let(words, lambda w: F.when(
        F.size(w) > width, let(windows(w), repeated)
    ).otherwise(F.lit(0).cast("long")))


def _common_counts(words: list[str]) -> Column:
    """How often each listed word stands among the words of the text, without regard
    to case and to what is not a letter around it. Long words are passed over first."""
    pattern = r"(?<!\p{L})(?:" + "|".join(sorted(words, key=len, reverse=True)) + r")(?!\p{L})"
    short = F.lower(F.array_join(F.filter("words", lambda w: F.length(w) < SHORT + 2), " "))
    found = F.regexp_extract_all(short, F.lit(pattern), F.lit(0))
    # Each word found stands between blanks of its own, so taking one word out leaves the others whole.
    framed = F.concat(F.lit(" "), F.array_join(found, "  "), F.lit(" "))

    def times(all_found: Column, word: str) -> Column:
        without = F.length(F.replace(all_found, F.lit(f" {word} "), F.lit("")))
        return ((F.length(all_found) - without) / (len(word) + 2)).cast("long")

    return let(framed, lambda f: F.array(*[times(f, w) for w in words]))


def text_counts(docs: DataFrame, rule: Divergence) -> DataFrame:
    """One narrow row for each document: base counts and the two histograms.

    Lower-case letters, most of a text, are taken out once; the other classes are
    counted in what is left.
    """
    lines = F.filter(F.split("text", "\n", -1), lambda s: F.rlike(s, F.lit(LINE_WITH_WORD)))
    lower, *others = CLASSES
    in_rest = F.array(*[F.regexp_count("rest", F.lit(CLASSES[name])).cast("long") for name in others])
    blank = others.index("blank")
    add = lambda a, b: a + b
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumns({
        "words": words_of(F.col("text")),
        "rest": F.regexp_replace("text", F.lit(CLASSES[lower] + "++"), F.lit("")),
    }).withColumns({
        "n_words": F.size("words").cast("long"),
        "n_symbols": F.regexp_count("rest", F.lit(SYMBOL)).cast("long"),
        "n_dup_lines": let(lines, lambda found: F.size(found) - F.size(F.array_distinct(found))).cast("long"),
        "n_repeat_words": repeated_window_words(F.col("words")),
        "chars": F.length("text").cast("long"), "others": in_rest, "n_rest": F.length("rest").cast("long"),
        "common": _common_counts(rule.words),
    }).select(
        "doc_id", "lang", "n_words", (F.col("chars") - F.get("others", F.lit(blank))).alias("word_chars"), "n_symbols",
        "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "chars",
        F.concat(
            F.array(F.col("chars") - F.col("n_rest")), "others",
            F.array(F.col("n_rest") - F.aggregate("others", F.lit(0).cast("long"), add)),
        ).alias("classes"),
        "common",
    )


def language_references(counts: DataFrame, rule: Divergence) -> DataFrame:
    """Summed histograms of each listed language, one row each."""
    total = lambda name, size: F.array(*[F.sum(F.get(name, F.lit(i))) for i in range(size)])
    return counts.where(~F.col("base_failed") & F.col("lang").isin(list(rule.common))).groupBy("lang").agg(
        total("classes", len(CLASSES) + 1).alias("classes"), total("common", len(rule.words)).alias("common"),
        F.sum("n_words").alias("n_words"),
    )


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b)
    return let(total, lambda t: F.transform(counts, lambda c: c / F.greatest(t, F.lit(1))))


def jensen_shannon(one: Column, other: Column) -> Column:
    """The distance of two arrays of shares: 0 for equal ones, 1 for ones without overlap."""
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(one, other, lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2))
    summed = F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2
    return F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), summed)))


def _with_rest(counts: Column, n_words: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b)
    return F.concat(counts, F.array(F.greatest(n_words - total, F.lit(0).cast("long"))))


def quality_rules(
    docs: DataFrame, rule: Divergence = Divergence(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """Counts, distances and verdict for every row of ``docs``."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = stored(text_counts(named, rule), "quality-counts")
    words = rule.words
    # One value, whose size is set by the word lists.
    references = language_references(counts, rule).agg(
        F.collect_list(F.struct("lang", "classes", "common", "n_words")).alias("references")
    )

    def distance(ref: Column, own: Column) -> Column:
        return jensen_shannon(_shares(own), _shares(ref["classes"]))

    def word_distance(listed: str, ref: Column) -> Column:
        at = [words.index(w) for w in listed.split()]
        pick = lambda array: F.array(*[F.get(array, F.lit(i)) for i in at])
        return jensen_shannon(
            _shares(_with_rest(pick(F.col("common")), F.col("n_words"))),
            _shares(_with_rest(pick(ref["common"]), ref["n_words"])),
        )

    def by_language(ref: Column) -> Column:
        chosen = F.lit(None).cast("double")
        for lang_name, listed in rule.common.items():
            chosen = F.when(ref["lang"] == lang_name, word_distance(listed, ref)).otherwise(chosen)
        return chosen

    judged = counts.withColumn("references", references.scalar()).withColumns({
        "class_distance": F.when(
            F.col("chars") >= rule.min_chars,
            F.array_min(F.transform("references", lambda r: distance(r, F.col("classes")))),
        ),
        "word_distance": F.when(
            F.col("n_words") >= rule.min_words, F.array_min(F.transform("references", by_language))
        ),
    })
    near = (F.coalesce("class_distance", F.lit(0.0)) <= rule.max_class) & (
        F.coalesce("word_distance", F.lit(0.0)) <= rule.max_word)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & near).alias("kept"), "class_distance", "word_distance",
    )


def quality_report(docs: DataFrame) -> DataFrame:
    """The same with distances to six places, for comparisons across engines."""
    rounded = {c: F.round(c, 6) for c in ("class_distance", "word_distance")}
    return quality_rules(docs).withColumns(rounded)


def oracle_sql(rule: Divergence = Divergence()) -> str:
    """``quality_report`` over a table ``documents`` as DuckDB SQL."""
    lower, *others = CLASSES
    gone = lambda pattern: f"length(rest) - length(regexp_replace(rest, '{pattern}', '', 'g'))"
    quoted = {name: pattern.replace("'", "''") for name, pattern in CLASSES.items()}
    names = ["lower", *others]
    listed = " UNION ALL ".join(
        f"SELECT '{lang}' AS ref, '{word}' AS bin" for lang, text in rule.common.items() for word in text.split())
    term = lambda p, q: f"CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END"
    distance = f"sqrt(greatest(0, least(1, sum({term('p', 'q')} + {term('q', 'p')}) / 2)))"
    refs = ", ".join(f"'{lang}'" for lang in rule.common)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[ 	-
]+'), lambda x: x <> '') AS words,
    regexp_replace(text, '{CLASSES[lower]}+', '', 'g') AS rest,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{LINE_WITH_WORD}')) AS lines FROM d),
windows AS (SELECT uid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS v
    FROM (SELECT uid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
covered AS (SELECT uid, count(DISTINCT place) AS n_repeat_words FROM (SELECT uid, unnest([i, i + 1, i + 2]) AS place
    FROM (SELECT uid, i, count(*) OVER (PARTITION BY uid, v) AS n FROM windows) WHERE n > 1) GROUP BY uid),
counted AS (SELECT w.uid, doc_id, lang, words, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    {gone(SYMBOL)} AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, length(text) AS chars, length(text) - length(rest) AS "lower",
    {", ".join(f'{gone(quoted[name])} AS "{name}"' for name in others)}, length(rest) AS n_rest
    FROM w LEFT JOIN covered USING (uid)),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    n_rest - ({" + ".join(f'"{name}"' for name in others)}) AS other FROM counted),
classes AS (SELECT uid, lang, base_failed, unnest({names + ["other"]}) AS bin, unnest([{", ".join(f'"{n}"' for n in names)}, other]) AS n FROM judged),
class_refs AS (SELECT lang AS ref, bin, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM classes
    WHERE NOT base_failed AND lang IN ({refs}) GROUP BY lang, bin),
class_found AS (SELECT uid, min(far) AS class_distance FROM (SELECT uid, ref, {distance} AS far
    FROM (SELECT uid, bin, n / greatest(1, sum(n) OVER (PARTITION BY uid)) AS p FROM classes) JOIN class_refs USING (bin) GROUP BY uid, ref) GROUP BY uid),
listed AS ({listed}),
tokens AS (SELECT uid, bin, count(*) AS n FROM (SELECT uid, unnest(regexp_split_to_array(lower(array_to_string(
    list_filter(words, lambda x: length(x) < {SHORT + 2}), ' ')), '\P{{L}}+')) AS bin FROM judged) WHERE bin IN (SELECT bin FROM listed) GROUP BY uid, bin),
own AS (SELECT j.uid, j.lang, j.base_failed, j.n_words, l.ref, l.bin, coalesce(t.n, 0) AS n
    FROM judged j, listed l LEFT JOIN tokens t ON t.uid = j.uid AND t.bin = l.bin),
own_all AS (SELECT uid, lang, base_failed, ref, bin, n FROM own UNION ALL
    SELECT uid, lang, base_failed, ref, '', greatest(0, max(n_words) - sum(n)) FROM own GROUP BY uid, lang, base_failed, ref),
word_sums AS (SELECT ref, bin, sum(n) AS n FROM own WHERE lang = ref AND NOT base_failed GROUP BY ref, bin),
word_totals AS (SELECT lang AS ref, sum(n_words) AS n FROM judged WHERE NOT base_failed AND lang IN ({refs}) GROUP BY lang),
word_counts AS (SELECT * FROM word_sums UNION ALL SELECT ref, '', greatest(0, max(t.n) - sum(s.n)) FROM word_sums s JOIN word_totals t USING (ref) GROUP BY ref),
word_refs AS (SELECT ref, bin, n / greatest(1, sum(n) OVER (PARTITION BY ref)) AS q FROM word_counts),
word_found AS (SELECT uid, min(far) AS word_distance FROM (SELECT uid, ref, {distance} AS far
    FROM (SELECT uid, ref, bin, n / greatest(1, sum(n) OVER (PARTITION BY uid, ref)) AS p FROM own_all) JOIN word_refs USING (ref, bin) GROUP BY uid, ref) GROUP BY uid),
distances AS (SELECT j.*, CASE WHEN chars >= {rule.min_chars} THEN class_distance END AS class_far,
    CASE WHEN n_words >= {rule.min_words} THEN word_distance END AS word_far
    FROM judged j LEFT JOIN class_found USING (uid) LEFT JOIN word_found USING (uid))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
    n_repeat_words::BIGINT AS n_repeat_words, base_failed,
    NOT base_failed AND coalesce(class_far, 0) <= {rule.max_class} AND coalesce(word_far, 0) <= {rule.max_word} AS kept,
    round(class_far, 6) AS class_distance, round(word_far, 6) AS word_distance FROM distances
"""
