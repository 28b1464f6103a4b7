"""Rule scoring: literal and pattern hits, context tier, points and score as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight import fixed_values as V
from wardlight.functions.text import WILDCARD, any_of, constant, fragments, line_regex

HIGH, PLAIN, DOWN, PATTERN = "high", "plain", "down", "pattern"
TELLING = 4  # letters from which a word is rare enough to look for


@dataclass(frozen=True)
class RuleSet:
    """Vocabulary of the scorer.  The default is the fixed vocabulary; any list may be replaced."""

    literals: list[str] = field(default_factory=lambda: V.LITERALS)
    high_risk: list[str] = field(default_factory=lambda: V.HIGH_RISK)
    down_weighted: list[str] = field(default_factory=lambda: V.DOWN_WEIGHTED)
    patterns: list[str] = field(default_factory=lambda: V.PATTERNS)
    safe_context: list[str] = field(default_factory=lambda: V.SAFE_CONTEXT)
    medical_context: list[str] = field(default_factory=lambda: V.MEDICAL_CONTEXT)
    disposal_context: list[str] = field(default_factory=lambda: V.DISPOSAL_CONTEXT)
    disposal_words: list[str] = field(default_factory=lambda: V.DISPOSAL_WORDS)
    range_context: list[str] = field(default_factory=lambda: V.RANGE_CONTEXT)
    range_words: list[str] = field(default_factory=lambda: V.RANGE_WORDS)

    def entries(self) -> list[tuple[str, str, list[str]]]:
        """(kind, rule text, literal parts that must occur) for every rule."""
        out = []
        for word in self.literals:
            kind = DOWN if word in self.down_weighted else HIGH if word in self.high_risk else PLAIN
            out.append((kind, word, [word]))
        return out + [(PATTERN, line_regex(p), fragments(p)) for p in self.patterns]


def grouped_by_anchor(rules: RuleSet) -> list[tuple[str, list[tuple[str, str, list[str]]]]]:
    """Put rules that share a word under that word (the most shared word first).

    A text without the word cannot hit any rule of the group, so one substring test replaces many.  Patterns with regex
    syntax of their own name no word that must occur; they form a group that every text is tested for.  Only words of
    four or more letters serve as a shared word, because shorter ones occur in most texts; a shorter rule is its
    own word.
    """
    every = rules.entries()
    left = [rule for rule in every if rule[2]]
    groups = [("", [rule for rule in every if not rule[2]])]  # every text contains the empty word
    if not groups[0][1]:
        groups = []
    while left:
        sharing: dict[str, list] = {}
        for rule in left:
            own = set(rule[2])
            shared = {w for part in rule[2] for w in part.replace(WILDCARD, " ").split() if len(w) >= TELLING or w in own}
            for word in shared | (own if rule[0] != PATTERN else set()):
                sharing.setdefault(word, []).append(rule)
        anchor = max(sharing, key=lambda w: (len(sharing[w]), len(w), w))
        groups.append((anchor, sharing[anchor]))
        taken = {id(rule) for rule in sharing[anchor]}
        left = [rule for rule in left if id(rule) not in taken]
    return groups


def rule_hits(lowered: Column, rules: RuleSet | None = None) -> Column:
    """Array of the rule structs that hit a lower-cased text column: shared words, then parts, then the rule itself."""
    kind = "array<struct<kind string, rule string, parts array<string>>>"
    groups = [
        {"anchor": anchor, "members": [{"kind": k, "rule": rule, "parts": p} for k, rule, p in members]}
        for anchor, members in grouped_by_anchor(rules or RuleSet())
    ]
    table = constant(groups, f"array<struct<anchor string, members {kind}>>")
    near = F.flatten(F.transform(F.filter(table, lambda g: F.contains(lowered, g["anchor"])), lambda g: g["members"]))
    present = F.filter(near, lambda m: F.forall(m["parts"], lambda p: F.contains(lowered, p)))
    return F.filter(present, lambda m: (m["kind"] != PATTERN) | F.rlike(lowered, m["rule"]))


def hit_count(hits: Column, kind: str) -> Column:
    return F.size(F.filter(hits, lambda r: r["kind"] == kind)).cast("bigint")


def context_tier(lowered: Column, rules: RuleSet | None = None) -> Column:
    """Tenths of a point per pattern hit; the first context that applies decides."""
    r = rules or RuleSet()
    return (
        F.when(any_of(lowered, r.medical_context), V.TENTHS_MEDICAL)
        .when(any_of(lowered, r.disposal_words) & any_of(lowered, r.disposal_context), V.TENTHS_DISPOSAL)
        .when(any_of(lowered, r.range_words) & any_of(lowered, r.range_context), V.TENTHS_RANGE)
        .when(any_of(lowered, r.safe_context), V.TENTHS_SAFE)
        .otherwise(V.TENTHS_NONE)
    )


def milli_score(tenths: Column) -> Column:
    """Points to thousandths of a score.  Whole numbers, so every engine gets the same value.

    The steps are not monotone: 10 tenths give 400 and 15 tenths give 375.
    """
    return (
        F.when(tenths == 0, 0)
        .when(tenths <= 10, tenths * 40)
        .when(tenths <= 20, tenths * 25)
        .when(tenths <= 30, 500 + (tenths - 20) * 15)
        .otherwise(F.least(650 + (tenths - 30) * 10, F.lit(1000)))
    ).cast("bigint")


def with_keyword_score(prompts: DataFrame, text: str = "prompt", rules: RuleSet | None = None) -> DataFrame:
    """Add hit counts, ``points10`` (tenths) and ``keyword_score``.

    Contexts are looked up only for prompts whose score they can change: those with a pattern or a down-weighted
    literal.  The steps are separate projections because each value is used more than once.
    """
    r = rules or RuleSet()
    lowered = F.col("_lowered")
    counted = (
        prompts.withColumn("_lowered", F.coalesce(F.lower(F.col(text)), F.lit("")))
        .withColumn("_hits", rule_hits(lowered, r))
        .withColumns({
            "n_pattern": hit_count(F.col("_hits"), PATTERN),
            "n_high": hit_count(F.col("_hits"), HIGH),
            "n_plain": hit_count(F.col("_hits"), PLAIN),
            "n_down": hit_count(F.col("_hits"), DOWN),
        })
        .withColumns({
            "tier10": F.when(F.col("n_pattern") > 0, context_tier(lowered, r)).otherwise(0),
            "_down10": F.when(F.col("n_down") == 0, 0)
            .when(any_of(lowered, r.safe_context), V.TENTHS_DOWN)
            .otherwise(V.TENTHS_HIGH),
        })
    )
    tenths = (
        F.col("n_pattern") * F.col("tier10")
        + F.col("n_high") * V.TENTHS_HIGH
        + F.col("n_plain") * V.TENTHS_PLAIN
        + F.col("n_down") * F.col("_down10")
    )
    return (
        counted.withColumn("points10", tenths.cast("bigint"))
        .withColumn("keyword_score", milli_score(F.col("points10")) / F.lit(1000.0))
        .drop("_hits", "_down10", "tier10")
    )
