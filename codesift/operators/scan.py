"""Rule matching: one narrow pass over the source table, no shuffle.

All findings of a file come from one row, so they are matched, ordered, numbered
and given their snippet inside that row. The text columns are dropped before
anything downstream can shuffle them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.functions.comments import strip_comments
from codesift.functions.text import (
    base_name, let, lines_of_code, literal_rows, snippet, solidity_version, split_lines,
)
from codesift.rules import CompiledRule, RulePack

HIT = "struct<neg_rank:int,line:int,rule_order:int,occ:int>"
FINDING = "struct<position:int,rule_order:int,rank:int,line:int,occ:int,code_snippet:string>"
RULE = (
    "struct<rule_order:int,rule_id:string,neg_rank:int,pattern:string,before:string,after:string,"
    "required:array<array<string>>>"
)
MARK = "\x01"
# From so many matches of a rule in a text on, its lines are counted one by one.
MANY_MATCHES = 100


def _mark_for(clean: Column) -> Column:
    """A string that does not occur in the text: one control character, or that
    character and a digest of the text where the text holds it already."""
    return F.when(
        F.contains(clean, F.lit(MARK)), F.concat(F.lit(MARK), F.sha2(clean, 256))
    ).otherwise(F.lit(MARK))


def _line_hits(marked: Column, mark: Column, neg_rank: Column, rule_order: Column) -> Column:
    """One struct for each match, with its line and its number on that line.

    Line feeds are counted between the marks; a text with very many matches is cut into lines instead.
    """
    def on_line(text: Column, index: Column) -> Column:
        removed = F.length(text) - F.length(F.replace(text, mark, F.lit("")))
        return F.when(
            F.contains(text, mark),
            F.struct(
                neg_rank.alias("neg_rank"), (index + 1).alias("line"), rule_order.alias("rule_order"),
                F.call_function("div", removed, F.length(mark)).cast("int").alias("occ"),
            ),
        )

    def next_hit(done: Column, piece: Column) -> Column:
        feeds = F.octet_length(piece) - F.octet_length(F.replace(piece, F.lit("\n"), F.lit("")))
        before = F.try_element_at(done, F.lit(-1))

        def hit(n: Column) -> Column:
            return F.struct(
                neg_rank.alias("neg_rank"), (F.coalesce(before["line"], F.lit(1)) + n).alias("line"), rule_order.alias("rule_order"),
                F.when(n == 0, F.coalesce(before["occ"], F.lit(0)) + 1).otherwise(1).alias("occ"))

        return F.concat(done, F.array(let(feeds, hit)))

    def by_piece(pieces: Column) -> Column:
        return F.when(
            F.size(pieces) <= MANY_MATCHES,
            F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.array().cast(f"array<{HIT}>"), next_hit),
        ).otherwise(_each_occurrence(F.filter(F.transform(split_lines(marked), on_line), lambda h: h.isNotNull())))

    return let(F.split(marked, mark, -1), by_piece)


def _each_occurrence(hits: Column) -> Column:
    """Hits with one entry per match from hits with one entry per line; most lines hold one match of a rule."""
    def repeated(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), h["occ"]),
            lambda occ: F.struct(
                h["neg_rank"].alias("neg_rank"), h["line"].alias("line"),
                h["rule_order"].alias("rule_order"), occ.alias("occ"),
            ),
        )

    return let(hits, lambda lines: F.when(
        F.exists(lines, lambda h: h["occ"] > 1), F.flatten(F.transform(lines, repeated))
    ).otherwise(lines))


def _rule_matches(clean: Column, rule: CompiledRule) -> Column:
    """Does the rule match anywhere? Literals that a match must hold are tested first."""
    test = F.rlike(clean, F.lit(rule.pattern))
    for choices in reversed(rule.jvm.required):
        found = F.contains(clean, F.lit(choices[0]))
        for literal in choices[1:]:
            found = found | F.contains(clean, F.lit(literal))
        test = found & test
    return test


def _unrolled_hits(clean: Column, mark: Column, pack: RulePack) -> Column:
    parts = []
    for rule in pack.rules:
        replacement = F.concat(F.lit(rule.before_mark), mark, F.lit(rule.after_mark))
        marked = F.regexp_replace(clean, F.lit(rule.pattern), replacement)
        parts.append(
            F.when(
                _rule_matches(clean, rule),
                _line_hits(marked, mark, F.lit(-rule.rule.rank), F.lit(rule.order)),
            ).otherwise(F.array().cast(f"array<{HIT}>"))
        )
    return F.concat(*parts)


def rule_row(rule: CompiledRule) -> dict:
    """What the scan takes from a rule, by the fields of RULE."""
    return {
        "rule_order": rule.order, "rule_id": rule.rule.rule_id, "neg_rank": -rule.rule.rank, "pattern": rule.pattern,
        "before": rule.before_mark, "after": rule.after_mark, "required": rule.jvm.required,
    }


def rule_array(pack: RulePack) -> Column:
    return literal_rows([rule_row(r) for r in pack.rules], RULE)


def _has_literals(clean: Column, rule: Column) -> Column:
    """Does the text hold what every match of the rule must hold?"""
    return F.forall(rule["required"], lambda s: F.exists(s, lambda v: F.contains(clean, v)))


def matching_rules(clean: Column, rules: Column) -> Column:
    """The rules that match anywhere, literals first."""
    def matches(rule: Column) -> Column:
        return F.when(_has_literals(clean, rule), F.rlike(clean, rule["pattern"])).otherwise(F.lit(False))

    return F.filter(rules, matches)


def _array_hits(clean: Column, mark: Column, rules: Column) -> Column:
    """The matches of the rules whose literals occur. A pattern from a column is compiled for each use, so
    its matches are marked at once, and a text without a mark has none."""
    def hits(rule: Column) -> Column:
        marked = F.regexp_replace(clean, rule["pattern"], F.concat(rule["before"], mark, rule["after"]))
        return let(marked, lambda m: F.when(
            F.contains(m, mark), _line_hits(m, mark, rule["neg_rank"], rule["rule_order"])
        ).otherwise(F.array().cast(f"array<{HIT}>")))

    return F.flatten(F.transform(F.filter(rules, lambda rule: _has_literals(clean, rule)), hits))


def findings_array(content: Column, clean: Column, pack: RulePack, unroll: bool = False) -> Column:
    """The findings of one file, ordered by severity, line, rule and occurrence.

    The pack is one literal array in the plan, walked for each text. ``unroll``
    writes every rule out as an expression of its own instead: the result is the
    same, patterns stay compiled for the task, and the plan grows with the pack.
    """
    if not len(pack):
        return F.array().cast(f"array<{FINDING}>")
    if unroll:
        return _findings(content, clean, lambda c, m: _unrolled_hits(c, m, pack))
    return findings_of_rules(content, clean, rule_array(pack))


def findings_of_rules(content: Column, clean: Column, rules: Column) -> Column:
    """The same for a column of rules (an array of RULE), which may differ from row to row."""
    return _findings(content, clean, lambda c, m: _array_hits(c, m, rules))


def _findings(content: Column, clean: Column, find: Callable[[Column, Column], Column]) -> Column:
    def numbered(hits: Column) -> Column:
        def with_snippets(lines: Column) -> Column:
            return F.transform(
                F.sort_array(hits),
                lambda h, i: F.struct(
                    (i + 1).alias("position"), h["rule_order"].alias("rule_order"),
                    (-h["neg_rank"]).alias("rank"), h["line"].alias("line"), h["occ"].alias("occ"),
                    snippet(lines, h["line"]).alias("code_snippet"),
                ),
            )

        return F.when(F.size(hits) > 0, let(split_lines(content), with_snippets)).otherwise(
            F.array().cast(f"array<{FINDING}>")
        )

    return let(clean, lambda c: let(_mark_for(c), lambda m: let(find(c, m), numbered)))


def scan_sources(
    sources: DataFrame,
    pack: RulePack,
    min_severity: str | None = None,
    keep: tuple[str, ...] = (),
    unroll: bool = False,
) -> DataFrame:
    """``path, content`` to one row per file with its findings. Works on streams too.

    A row without content was not readable and gives no result; the text is only
    tested behind the scan. ``keep`` names extra columns to carry along, such as an
    arrival order.
    """
    content, clean = F.col("content"), F.col("clean")
    kept = [F.col(name) for name in keep]
    cleaned = sources.select("path", "content", *kept, strip_comments(content).alias("clean"))
    return scanned_rows(cleaned, findings_array(content, clean, pack.at_least(min_severity), unroll), keep)


def scanned_rows(cleaned: DataFrame, found: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """``path, content, clean`` and an expression of the findings to one row per file.

    One generated row per file: the generator keeps the optimizer from copying the
    scan into filters on its result, which would match every rule again. The lines
    are counted inside it, too: a filter on them moves no test of the text to where
    its keys are read, in a few large splits.
    """
    content, clean = F.col("content"), F.col("clean")
    kept = [F.col(name) for name in keep]
    made = F.struct(found.alias("findings"), lines_of_code(content).alias("lines_of_code"))
    return cleaned.select("*", F.explode_outer(F.array(made)).alias("made")).select(
        "path",
        *kept,
        base_name(F.col("path")).alias("file_name"),
        F.col("made.lines_of_code").alias("lines_of_code"),
        solidity_version(clean).alias("solidity_version"),
        F.col("made.findings").alias("findings"),
    ).where(F.col("lines_of_code").isNotNull())


def rule_hit_flags(sources: DataFrame, pack: RulePack) -> DataFrame:
    """``path`` and the ids of the rules that match anywhere, in rule order."""
    cleaned = sources.select("path", strip_comments(F.col("content")).alias("clean"))
    ids = let(F.col("clean"), lambda c: F.transform(matching_rules(c, rule_array(pack)), lambda r: r["rule_id"]))
    return cleaned.select("path", ids.alias("rule_ids"))
