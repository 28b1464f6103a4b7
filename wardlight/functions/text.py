"""Small text predicates on a string column, all native Spark expressions.

Word lists become one literal array that a higher-order function walks.  On long texts this measured twice as
fast as the same list spelled out as one generated-code sum of ``contains`` calls (see README, "Measured").
"""

from __future__ import annotations

import json
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

WILDCARD = ".*"
WORD = r"[\p{L}\p{N}_]{2,}"


def constant(value: list, ddl: str) -> Column:
    """A nested constant; the optimizer folds it to one literal, and building it is one call, not thousands."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), ddl)


def strings(words: list[str]) -> Column:
    return constant(words, "array<string>")


def shortest(words: list[str]) -> list[str]:
    """Drop entries that contain another entry: an any-of test cannot change by them."""
    return [w for w in dict.fromkeys(words) if not any(o != w and o in w for o in words)]


def any_of(text: Column, words: list[str]) -> Column:
    """True when at least one of ``words`` is a substring of ``text``."""
    return F.exists(strings(shortest(words)), lambda w: F.contains(text, w))


def is_plain(pattern: str) -> bool:
    """Whether the pattern is plain text around ``.*`` wildcards, so that its parts mean themselves."""
    return all(re.fullmatch(r"[\w ]*", part) for part in pattern.split(WILDCARD))


def fragments(pattern: str) -> list[str]:
    """The literal parts of an ``a.*b.*c`` pattern, longest first; each must occur for it to match.  Patterns with other
    regex syntax have none that a plain search could ask for."""
    if not is_plain(pattern):
        return []
    return sorted((part for part in pattern.split(WILDCARD) if part), key=len, reverse=True)


def line_regex(pattern: str) -> str:
    """Java form of an ``a.*b.*c`` search in which ``.`` stops at ``\\n`` only.

    Java's ``.`` also stops at ``\\r``, U+0085, U+2028 and U+2029 unless UNIX_LINES ``(?d)`` is set.  The form with
    one attempt per line start and possessive steps finds the same lines (taking each part at its first place leaves
    the most room for the next) but never backtracks, so a long line costs linear time.
    """
    parts = pattern.split(WILDCARD)
    if is_plain(pattern) and all(parts):
        return "(?dm)^" + "".join(f"(?>.*?{part})" for part in parts)
    return "(?d)" + pattern


def has_parts(text: Column, pattern: str) -> Column:
    parts = fragments(pattern)
    return F.forall(strings(parts), lambda f: F.contains(text, f)) if parts else F.lit(True)


def matches(text: Column, pattern: str) -> Column:
    """Regex search.  The literal parts are asked for first: ``And`` short-circuits, so the regex engine runs only on
    the few texts with all of them."""
    return has_parts(text, pattern) & text.rlike(line_regex(pattern))


def any_match(text: Column, patterns: list[str]) -> Column:
    """Any pattern matches; entries without a wildcard are plain substrings."""
    plain = [p for p in patterns if WILDCARD not in p]
    wild = [p for p in patterns if WILDCARD in p]
    tests = ([any_of(text, plain)] if plain else []) + [matches(text, p) for p in wild]
    return reduce(or_, tests)


def words(text: Column) -> Column:
    """Lower-cased tokens of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def preview(text: Column, width: int) -> Column:
    """First ``width`` characters, with an ellipsis when something was cut."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def digest(text: Column, buckets: int) -> Column:
    """Stable hash bucket of a text (the same in every process and engine)."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % buckets
