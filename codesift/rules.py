"""Detection rules and rule packs."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.functions.dialect import JvmRegex, UnsupportedPattern, can_match_nothing, to_jvm
from codesift.functions.segments import linear_form
from codesift.functions.severity import rank_of, RANK

RULE_SCHEMA = (
    "rule_order int, rule_id string, title string, description string, severity string, "
    "swc string, cwe string, recommendation string, references array<string>, regex string"
)
# A pack travels inside the plan and is broadcast, so its size is checked.
MAX_PACK_BYTES = 16 << 20


@dataclass(frozen=True)
class Rule:
    rule_id: str
    title: str
    description: str
    severity: str
    swc: str
    cwe: str
    recommendation: str
    references: tuple[str, ...]
    regex: str
    # Optional java.util.regex form with the same match starts: group 1 is skipped
    # text before the match, group 2 starts where the match starts.
    jvm_form: str | None = field(default=None, compare=False)

    @property
    def rank(self) -> int:
        return RANK.get((self.severity or "").upper(), 0)


@dataclass(frozen=True)
class CompiledRule:
    order: int
    rule: Rule
    jvm: JvmRegex
    # A form with the groups of ``Rule.jvm_form`` that reads a text once, where the pattern has one.
    linear: str | None = None

    @property
    def pattern(self) -> str:
        return self.grouped or self.jvm.pattern

    @property
    def grouped(self) -> str | None:
        return self.rule.jvm_form or self.linear

    @property
    def before_mark(self) -> str:
        """Replacement text ahead of the match mark."""
        return "$1" if self.grouped else ""

    @property
    def after_mark(self) -> str:
        return "$2" if self.grouped else "$0"


class RulePack:
    """An ordered, checked list of rules; the order breaks ties between findings."""

    def __init__(self, rules: Iterable[Rule | CompiledRule]):
        self.rules: list[CompiledRule] = []
        seen: set[str] = set()
        size = 0
        for order, item in enumerate(rules):
            rule = item.rule if isinstance(item, CompiledRule) else item
            if rule.rule_id in seen:
                raise ValueError(f"rule id {rule.rule_id} is used twice")
            seen.add(rule.rule_id)
            size += sum(len(str(v).encode()) for v in vars(rule).values())
            if isinstance(item, CompiledRule):
                self.rules.append(item)
                continue
            if can_match_nothing(rule.regex):
                raise UnsupportedPattern(f"{rule.rule_id}: pattern matches the empty string")
            try:
                self.rules.append(CompiledRule(order, rule, to_jvm(rule.regex), linear_form(rule.regex)))
            except UnsupportedPattern as error:
                raise UnsupportedPattern(f"{rule.rule_id}: {error}") from error
        if size > MAX_PACK_BYTES:
            raise ValueError(f"rule pack too large: {size} bytes")

    def __len__(self) -> int:
        return len(self.rules)

    def at_least(self, min_severity: str | None) -> RulePack:
        """Rules at or above a severity; unknown or empty names keep all. Orders stay."""
        floor = rank_of(min_severity)
        return RulePack(r for r in self.rules if r.rule.rank >= floor)

    def only(self, *rule_ids: str) -> RulePack:
        return RulePack(r for r in self.rules if r.rule.rule_id in rule_ids)

    def plus(self, *rules: Rule) -> RulePack:
        """This pack with user rules appended."""
        return RulePack([r.rule for r in self.rules] + list(rules))

    def with_texts(self, change: Callable[[str], str], reference: Callable[[str], str] | None = None) -> RulePack:
        """The same rules with all their texts but the severity changed, references by a function of their own."""
        def changed(rule: Rule) -> Rule:
            texts = {n: change(getattr(rule, n)) for n in
                     ("rule_id", "title", "description", "swc", "cwe", "recommendation")}
            return replace(rule, **texts, references=tuple(map(reference or change, rule.references)))

        return RulePack(replace(r, rule=changed(r.rule)) for r in self.rules)

    @classmethod
    def from_rows(cls, rows: Iterable) -> RulePack:
        """Rows or dicts with the columns of RULE_SCHEMA, in rule order."""
        dicts = [r if isinstance(r, dict) else r.asDict() for r in rows]
        dicts.sort(key=lambda d: d.get("rule_order") or 0)
        text = ("rule_id", "title", "description", "severity", "swc", "cwe", "recommendation")
        return cls(
            Rule(*[d.get(name) or "" for name in text], tuple(d.get("references") or ()), d["regex"])
            for d in dicts
        )

    @classmethod
    def from_df(cls, rules: DataFrame) -> RulePack:
        """A rule table. Its bytes are summed before it is read to the driver."""
        texts = F.to_json(F.struct(*[F.col(c) for c in rules.columns]))
        size = rules.agg(F.coalesce(F.sum(F.octet_length(texts)), F.lit(0)).alias("size")).first().size
        # Names and quotes of the fields come on top of the texts.
        if size > 2 * MAX_PACK_BYTES:
            raise ValueError(f"rule pack too large: {size} bytes")
        return cls.from_rows(rules.collect())

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [
            (r.order, r.rule.rule_id, r.rule.title, r.rule.description, r.rule.severity, r.rule.swc,
             r.rule.cwe, r.rule.recommendation, list(r.rule.references), r.rule.regex)
            for r in self.rules
        ]
        return spark.createDataFrame(rows, RULE_SCHEMA)

    def broadcast(self, spark: SparkSession) -> DataFrame:
        """The rule table for equi joins; MAX_PACK_BYTES bounds what is broadcast."""
        return F.broadcast(self.to_df(spark))
