"""Secret scan: three fixed patterns and sliding-window entropy, in column expressions.

A text is scanned whole and in its own row, so nothing is shuffled. Positions come
from cutting the text at its matches: the lengths of the pieces and of the matches
add up to the starts.

Entropy. A candidate is a maximal run of token characters that holds a digit and a
letter. Its class is the smallest of ``CLASSES`` that holds all its characters, and
says how wide the window is and how many bits per character make it suspicious. The
window moves one character at a time; the counts of its characters and the sum of
``c * log2(c)`` over them are kept up to date by the character that enters and the one
that leaves. A candidate that is a UUID, or of which every window overlaps a harmless string, adds
no span; a longer one that only holds such a string is judged. The spans of the three patterns
are never suppressed.

Defined cases: a null or empty text has no span; repeated rows are scanned each on
their own; rows with equal ids stay apart; columns of the input other than the id and the text
are not read, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.functions.text import let

# The kinds in the order that breaks ties, and their patterns.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
# A run of one class reaches its end whatever its start, so the length may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"

CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}+"
SPAN = "struct<start:int,kind:int,end:int>"


@dataclass(frozen=True)
class CharClass:
    """A class of characters, the width of its window and the bits that are too many."""

    name: str
    pattern: str
    window: int
    bits: float


CLASSES = (
    CharClass("hex", "^[0-9A-Fa-f]+$", 20, 2.9),
    CharClass("alphanumeric", "^[0-9A-Za-z]+$", 20, 3.7),
    CharClass("base64", "^[0-9A-Za-z+/_=-]+$", 20, 3.8),
)
# Known harmless strings: marked examples, alphabets and counting, runs of one character.
HARMLESS = r"(?:(?i:example|placeholder|changeme|dummy|abcdefghij|01234567890?+|1234567890)|(.)\%d{7}%s)"


def _covered(harmless: str, window: int) -> str:
    """A value in which every window overlaps a harmless string: no stretch as long as a window
    follows the beginning or such a string without another one in it."""
    # Of a run of one character only its last eight are followed: matching it whole from each place is quadratic.
    one, two, three = (harmless % (group, r"(?!\1)" if group == 1 else "") for group in (1, 2, 3))
    return f"^(?!.*?(?:^|{one})(?:(?!{two}).){{{window}}}).*{three}"


# Candidates that are a UUID, or that harmless strings leave no window of.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    _covered(HARMLESS, min(c.window for c in CLASSES)),
)


def _pieces(text: Column, pattern: str, kind: str) -> Column:
    """All matches of a pattern as ``(start, kind, end)``; ends are exclusive."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda s: F.length(s))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + pair["gap"]
        end = begin + pair["len"]
        span = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with(
        F.slice(gaps, 1, F.size(matches)), F.transform(matches, lambda m: F.length(m)),
        lambda g, m: F.struct(g.alias("gap"), m.alias("len")),
    )
    return F.aggregate(pairs, start, step, lambda s: s["spans"])


def _when_found(text: Column, pattern: str, spans: Column) -> Column:
    """The pattern is looked for once before positions are worked out; most texts have none."""
    return F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def _cut(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def _assign_spans(text: Column) -> Column:
    """Matches whose value is long enough. The value is what follows the opening."""
    opening = ASSIGN[: ASSIGN.rindex("(")]
    long_enough = lambda s: F.length(F.regexp_replace(_cut(text, s), F.lit("^" + opening), F.lit(""))) >= ASSIGN_VALUE
    return F.filter(_pieces(text, ASSIGN, "assign"), long_enough)


def _term(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(F.greatest(count, F.lit(1)))).otherwise(F.lit(0.0))


def peak_entropy(value: Column, window: Column) -> Column:
    """The highest entropy, in bits per character, of any window of ``value``.

    ``value`` has at least ``window`` characters, all of them token characters.
    """
    def step(codes: Column, state: Column, at: Column) -> Column:
        enters = F.get(codes, at - 1)
        leaves = F.when(at > window, F.get(codes, at - window - 1)).otherwise(F.lit(0))

        def move(change: Column) -> Column:
            old, new = F.get(state["counts"], change["enters"]), F.get(state["counts"], change["leaves"])
            same = change["enters"] == change["leaves"]
            shift = F.when(same, F.lit(0.0)).otherwise(
                _term(old + 1) - _term(old)
                + F.when(change["leaves"] > 0, _term(new - 1) - _term(new)).otherwise(F.lit(0.0))
            )
            total = state["total"] + shift
            counts = F.when(same, state["counts"]).otherwise(F.transform(
                state["counts"],
                lambda c, i: c + (i == change["enters"]).cast("int")
                - ((i == change["leaves"]) & (change["leaves"] > 0)).cast("int"),
            ))
            return F.struct(
                counts.alias("counts"), total.alias("total"),
                F.when(at >= window, F.least(state["least"], total)).otherwise(state["least"]).alias("least"),
            )

        return let(F.struct(enters.alias("enters"), leaves.alias("leaves")), move)

    start = F.struct(
        F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("total"), F.lit(float("inf")).alias("least"),
    )
    # Characters are taken from an array: a substring walks the string from its start.
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c))
    # H = log2(w) - sum(c * log2(c)) / w, so the least sum gives the highest entropy.
    return let(codes, lambda c: F.aggregate(
        F.sequence(F.lit(1), F.length(value)), start, lambda state, at: step(c, state, at),
        lambda s: F.log2(window) - s["least"] / window,
    ))


def _suspicious(value: Column, classes: tuple[CharClass, ...], allowed: tuple[str, ...]) -> Column:
    verdict = F.lit(False)
    for c in reversed(classes):
        high = (F.length(value) >= c.window) & (peak_entropy(value, F.lit(c.window)) >= c.bits)
        verdict = F.when(F.rlike(value, F.lit(c.pattern)), high).otherwise(verdict)
    for pattern in allowed:
        verdict = ~F.rlike(value, F.lit(pattern)) & verdict
    return verdict


def base_spans(text: Column) -> Column:
    """Spans of the three fixed patterns, ordered by start and kind; ``text`` is not null."""
    return F.sort_array(F.concat(
        _when_found(text, ASSIGN, _assign_spans(text)),
        _when_found(text, ACCESS, _pieces(text, ACCESS, "access")),
        _when_found(text, HEX, _pieces(text, HEX, "hex")),
    ))


def entropy_spans(
    text: Column, classes: tuple[CharClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED
) -> Column:
    """Candidates with a window of too many bits; ``text`` is not null."""
    found = F.filter(
        _pieces(text, CANDIDATE, "entropy"), lambda s: let(_cut(text, s), lambda v: _suspicious(v, classes, allowed))
    )
    return _when_found(text, CANDIDATE, found)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` for each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ","
    )


def secret_spans(docs: DataFrame, text: str = "text", **entropy) -> DataFrame:
    """``docs`` with the arrays ``base_spans`` and ``entropy_spans``; columns of these names are replaced."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"base_spans": base_spans(whole), "entropy_spans": entropy_spans(whole, **entropy)})


def all_spans() -> Column:
    return F.sort_array(F.concat(F.col("base_spans"), F.col("entropy_spans")))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by ``mark``; spans that overlap are replaced as one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        fresh = (s["start"] >= state["at"])
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"]).alias("out"),
        )

    done = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def secret_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts by kind, the digest of the base spans, and all spans as text."""
    found = secret_spans(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == KINDS.index(k))).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(span_text(F.col("base_spans")), 256).alias("base_sha256"), span_text(all_spans()).alias("spans"),
        F.size("entropy_spans").cast("long").alias("n_entropy"),
    )


def without_secrets(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with every span of a secret replaced; the column ``length``, if present, follows the text."""
    whole = F.col(text)
    spans = F.sort_array(F.concat(base_spans(whole), entropy_spans(whole)))
    clean = let(spans, lambda found: redacted(whole, found))
    rows = docs.select(F.struct("*").alias("row"), F.when(whole.isNotNull(), clean).alias("clean"))
    kept = [
        F.col("clean").alias(c) if c == text
        else F.when(F.col("clean").eqNullSafe(F.col(f"row.{text}")), F.col(f"row.`{c}`")).otherwise(F.length("clean").cast("long")).alias(c)
        if c == length else F.col(f"row.`{c}`")
        for c in docs.columns
    ]
    return rows.select(*kept)
