"""Chat formatting with linked tool calls.

Calls and results are hash-joined by conversation and call identifier.  Calls are ordered topologically: a call comes
after the calls whose results it refers to.  Arguments are validated against the tools' schemas, and every conversation
is serialised as canonical JSON (sorted keys, no blanks, no escapes beyond those that JSON needs).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import written

CHECKED = "valid boolean, problem string, canonical string"


# --- arguments against schemas ------------------------------------------------------------------------------------

def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _is(value, kind: str) -> bool:
    tests = {
        "string": lambda v: isinstance(v, str),
        "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
        "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
        "boolean": lambda v: isinstance(v, bool),
        "null": lambda v: v is None,
        "array": lambda v: isinstance(v, list),
        "object": lambda v: isinstance(v, dict),
    }
    return tests[kind](value)


def problem_of(value, schema: dict, at: str = "$") -> str | None:
    """The first way in which ``value`` breaks ``schema`` (type, enum, minimum, maximum, minLength, maxLength, required,
    properties, additionalProperties, items), with its place; None if it holds."""
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return f"{at}: not {kinds}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not in enum"
    if _is(value, "number"):
        if value < schema.get("minimum", value):
            return f"{at}: below minimum"
        if value > schema.get("maximum", value):
            return f"{at}: above maximum"
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            return f"{at}: too short"
        if len(value) > schema.get("maxLength", len(value)):
            return f"{at}: too long"
    if isinstance(value, dict):
        missing = [k for k in schema.get("required", []) if k not in value]
        if missing:
            return f"{at}: {missing[0]} is missing"
        known = schema.get("properties", {})
        for k in sorted(value):
            if k in known:
                found = problem_of(value[k], known[k], f"{at}.{k}")
            else:
                found = f"{at}: {k} is unknown" if schema.get("additionalProperties", True) is False else None
            if found:
                return found
    if isinstance(value, list) and "items" in schema:
        return next((p for i, v in enumerate(value) if (p := problem_of(v, schema["items"], f"{at}[{i}]"))), None)
    return None


def check_arguments(tool: str | None, arguments: str | None, schemas: dict[str, dict]) -> tuple[bool, str | None, str | None]:
    """(valid, problem, canonical arguments); arguments that are not JSON have no canonical form."""
    try:
        value = json.loads(arguments, parse_constant=lambda name: (_ for _ in ()).throw(ValueError(name)))
        text = canonical(value)
    except (TypeError, ValueError, RecursionError):
        return False, "$: not JSON", None
    if tool not in schemas:
        return False, "unknown tool", text
    found = problem_of(value, schemas[tool])
    return found is None, found, text


def validated(calls: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """``calls`` with valid, problem and the canonical form of their arguments."""

    @F.pandas_udf(CHECKED)
    def check(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for tools, arguments in batches:
            yield pd.DataFrame([check_arguments(t, a, schemas) for t, a in zip(tools, arguments)], columns=["valid", "problem", "canonical"])

    return calls.withColumn("_checked", check("tool", "arguments")).select(
        *calls.columns, "_checked.valid", "_checked.problem", "_checked.canonical")


# Control characters whose escapes hold a hexadecimal letter and have no short form.
LETTERED = [0x0B, 0x0E, 0x0F, 0x1A, 0x1B, 0x1C, 0x1D, 0x1E, 0x1F]


def line(fields: Column) -> Column:
    """A struct, its fields in the order of their names, as canonical JSON: Spark writes the escapes of control
    characters with capital letters, ``canonical`` with small ones."""
    plain = F.to_json(fields)
    small = plain
    for code in LETTERED:  # an escape starts at a backslash that is not escaped itself
        small = F.regexp_replace(small, rf"(?<!\\)((?:\\\\)*+)\\u{code:04X}", rf"$1\\u{code:04x}")
    return F.when(plain.contains("\\u00"), small).otherwise(plain)


# --- linking and order --------------------------------------------------------------------------------------------

IDS = ["conv_id", "call_id"]


def _first_calls(calls: DataFrame) -> DataFrame:
    """The first call of every identifier: the others of this identifier repeat it."""
    return calls.groupBy(*IDS).agg(F.min(F.struct("turn", "tool", "arguments", "position")).alias("_first"))


def linked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Every call once, with ``content`` and ``result_turn`` of its result, ``n_results`` and ``status``.

    status is linked, or unanswered without a result, or repeated for a call whose identifier an earlier call of the
    conversation already has; a repeated call gets no result.  The result of a call is the first one of its identifier
    in a later turn.
    """
    first = _first_calls(calls)
    answers = results.join(first, IDS).where(F.col("turn") > F.col("_first.turn"))
    answers = answers.groupBy(*IDS).agg(
        F.min(F.struct("turn", "content")).alias("_answer"), F.count(F.lit(1)).alias("n_results"))
    one = written(first.join(answers, IDS, "left"), "answers")
    both = calls.join(one, IDS, "left")
    own = F.coalesce(F.col("position") == F.col("_first.position"), F.lit(True))
    answered = own & F.col("n_results").isNotNull()
    return both.select(
        *calls.columns, F.when(answered, F.col("_answer.content")).alias("content"),
        F.when(answered, F.col("_answer.turn")).alias("result_turn"),
        F.when(answered, F.col("n_results")).otherwise(0).cast("bigint").alias("n_results"),
        F.when(~own, "repeated").when(answered, "linked").otherwise("unanswered").alias("status"))


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results that come before or without a call of their identifier."""
    first = calls.groupBy(*IDS).agg(F.min("turn").alias("_at"))
    joined = results.join(first, IDS, "left")
    return joined.where(F.coalesce(F.col("_at") >= F.col("turn"), F.lit(True))).drop("_at")


def ordered(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level, unmet: the place of a call among the calls of its turn, and what it cannot have.

    (turn, level) is a topological order: needs of earlier turns are met by the turns, and level is one more than the
    highest level of the calls of the same turn that a call needs.  ``unmet`` counts needs of later turns and of calls
    that are not there.  Calls in or behind a circle within their turn have no level.  Each round takes the calls off
    whose needs are all placed, so there are as many rounds as the longest chain within one turn.
    """
    known = calls.where(F.col("call_id").isNotNull() & F.col("conv_id").isNotNull())
    nodes = written(known.groupBy(*IDS).agg(F.min("turn").alias("turn")), "calls")
    wants = known.select("conv_id", F.col("call_id").alias("by"), F.explode("needs").alias("call_id")).where(
        F.col("call_id").isNotNull()).distinct()
    mine = nodes.select("conv_id", F.col("call_id").alias("by"), F.col("turn").alias("by_turn"))
    met = written(wants.join(mine, ["conv_id", "by"]).join(nodes, IDS, "left"), "needs")
    later = F.coalesce(F.col("turn") > F.col("by_turn"), F.lit(True))
    unmet = met.where(later).groupBy("conv_id", F.col("by").alias("call_id")).agg(F.count(F.lit(1)).alias("unmet"))
    edges = met.where("turn = by_turn").select("conv_id", "by", "call_id")
    waiting = edges.select("conv_id", F.col("by").alias("call_id")).distinct()
    done = nodes.select(*IDS).join(waiting, IDS, "left_anti").withColumn("level", F.lit(0))
    found, level = [done], 0
    edges, waiting, done = written(edges, "open"), written(waiting, "waiting"), written(done, "level")
    while edges.head(1):
        edges = written(edges.join(done.select(*IDS), IDS, "left_anti"), "open")
        left = written(edges.select("conv_id", F.col("by").alias("call_id")).distinct(), "waiting")
        level += 1
        done = written(waiting.join(left, IDS, "left_anti").withColumn("level", F.lit(level)), "level")
        if not done.head(1):
            break
        found.append(done)
        waiting = left
    levels = found[0]
    for more in found[1:]:
        levels = levels.unionByName(more)
    return nodes.select(*IDS).join(levels, IDS, "left").join(unmet, IDS, "left").select(
        *IDS, "level", F.coalesce("unmet", F.lit(0).cast("bigint")).alias("unmet"))


# --- conversations ------------------------------------------------------------------------------------------------

def format_chats(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """conv_id, turn, kind (message, call, orphan), level, call_id, status, valid, problem, unmet, json: one row per
    message, call and result without a call, each as one line of canonical JSON.

    ``messages`` has conv_id, turn, role, text; ``calls`` conv_id, turn, call_id, tool, arguments, needs; ``results``
    conv_id, turn, call_id, content.  Read in the order of turn, kind from messages to orphans, level (null last) and
    call_id, a conversation has every call after the calls that it needs, and each call carries its result.  Null texts
    and contents count as empty; arguments that are not JSON are invalid and serialised as null.  Calls without an
    identifier are unanswered and stand at level 0.  Rows without a conversation are kept under null.  Repeated rows
    are kept as often as they occur.  Empty tables give an empty result.
    """
    numbered = calls.select(
        "conv_id", "turn", "call_id", "tool", "arguments", "needs", F.monotonically_increasing_id().alias("position"))
    placed = written(validated(numbered, schemas), "checked_calls")
    joined = linked(placed, results).join(ordered(placed), IDS, "left")
    shown = ["conv_id", "turn", "kind", "level", "call_id", "status", "valid", "problem", "unmet", "json"]

    def text(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(""))

    none = {"level": "int", "status": "string", "valid": "boolean", "problem": "string", "unmet": "bigint"}
    blank = {k: F.lit(None).cast(v) for k, v in none.items()}
    says = messages.withColumns({
        **blank, "kind": F.lit("message"), "call_id": F.lit(None).cast("string"),
        "json": line(F.struct(text("text").alias("content"), text("role").alias("role")))})
    lost = orphans(placed, results).withColumns({
        **blank, "kind": F.lit("orphan"), "status": F.lit("orphan"),
        "json": line(F.struct(text("call_id").alias("call_id"), text("content").alias("content"), F.lit("tool").alias("role")))})
    rest = line(F.struct(
        text("call_id").alias("call_id"), text("content").alias("result"), F.lit("call").alias("role"), "status",
        text("tool").alias("tool"), "valid"))
    does = joined.withColumns({
        "kind": F.lit("call"), "level": F.when(F.col("call_id").isNull() | F.col("conv_id").isNull(), 0).otherwise(F.col("level")),
        "json": F.concat(F.lit('{"arguments":'), F.coalesce("canonical", F.lit("null")), F.lit(","), F.substring(rest, 2, 2 ** 31 - 1))})
    return says.select(shown).unionByName(does.select(shown)).unionByName(lost.select(shown))
