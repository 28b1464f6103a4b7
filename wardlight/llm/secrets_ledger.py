"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of every path is addressed by the sha256 of its text.  The ledger is a table of (blob, rules) pairs that
have been scanned and of the spans found.  A scan reads only the texts whose pair is not in the ledger, once per blob,
appends to the ledger, and joins the spans of all blobs back to all paths.
"""

from __future__ import annotations

import json
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import text_of
from wardlight.session import scratch_path

# Fixed values: (kind, pattern, group whose length counts, its least length), in the order that breaks ties.
KEYWORDS = r"(?i:(password|passwd|secret|token|api_?key))"
RULES = [
    ("assign", KEYWORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]{16,}", 0, 20),  # the same spans as AKIA[A-Z0-9]+ of 20 or more characters
    ("hex", "[0-9a-f]{24,}", 0, 24),  # the same spans as [0-9a-f]+ of 24 or more characters
]
VERSION = "1"
SPAN = "struct<start: bigint, kind_no: int, end: bigint>"
LEDGER = f"blob string, rules string, spans array<{SPAN}>"


def _spans_of(text: Column, number: int, pattern: str, group: int, least: int) -> Column:
    """Spans of one rule in code points.  Matches and the pieces between them have the positions as running sums."""
    ends = F.aggregate(
        F.zip_with(
            F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
            lambda gap, hit: F.struct(F.length(gap).cast("bigint").alias("gap"), F.length(hit).cast("bigint").alias("hit")),
        ),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start: bigint, end: bigint>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.coalesce(x["hit"], F.lit(0))).alias("at"),
            F.when(x["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["hit"]).alias("end")
            )))).alias("out"),
        ),
    )["out"]
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    long_enough = F.filter(F.arrays_zip(ends.alias("span"), counted.alias("part")), lambda x: F.length(x["part"]) >= least)
    spans = F.transform(long_enough, lambda x: F.struct(
        x["span"]["start"].alias("start"), F.lit(number).alias("kind_no"), x["span"]["end"].alias("end")
    ))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def spans_of(text: Column, rules=RULES) -> Column:
    """All spans of a text, by start and then by the order of the rules."""
    found = [_spans_of(text, i, *rule[1:]) for i, rule in enumerate(rules)]
    return F.array_sort(F.concat(*found))


def address(df: DataFrame, text: str) -> Column:
    """The address of the text of each row."""
    return F.sha2(text_of(df, text).cast("binary"), 256)


def stamp(rules, version: str) -> str:
    """What the ledger knows rules by: all of their parts, and the caller's version of them."""
    return sha256(json.dumps([version, [list(rule) for rule in rules]]).encode()).hexdigest()


def scan(
    df: DataFrame, text: str = "text", ledger: str | None = None, rules=RULES, version: str = VERSION,
    blob: str = "_blob", spans: str = "_spans",
) -> DataFrame:
    """``df`` with the columns ``blob`` and ``spans``; every version of every path gets the spans of its text.

    Null texts count as empty and have no spans; an empty table gives an empty result.  Columns of ``df`` that have the
    name ``blob`` or ``spans`` are replaced, all others are kept, whatever their names.  ``ledger`` is a folder in shared
    storage.  With an existing one, only blobs that it lacks for these ``rules`` and this ``version`` are scanned and
    appended, so spans of other rules are never taken for theirs.  Scans that append the same blobs at the same time, and
    repeated appends, change nothing in the result.  Without a ledger, a new one is begun in the scratch folder.
    """
    spark = df.sparkSession
    path = ledger or scratch_path(spark, "ledger")
    own = stamp(rules, version)
    addressed = df.select(address(df, text).alias("address"), F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"))
    blobs = df.select(address(df, text).alias("blob"), text_of(df, text).alias("text")).groupBy("blob").agg(
        F.any_value("text").alias("text"))
    known = known_blobs(spark, ledger, own)
    if known is not None:
        blobs = blobs.join(known, "blob", "left_anti")
    blobs.select("blob", F.lit(own).alias("rules"), spans_of(F.col("text"), rules).alias("spans")).write.mode("append").parquet(path)
    entries = spark.read.schema(LEDGER).parquet(path).where((F.col("rules") == own) & (F.size("spans") > 0))
    found = entries.groupBy(F.col("blob").alias("address")).agg(F.any_value("spans").alias("found"))
    none = F.array().cast(f"array<{SPAN}>")
    kept = [F.col("row")[c].alias(c) for c in df.columns if c.lower() not in (blob.lower(), spans.lower())]
    return addressed.join(found, "address", "left").select(
        *kept, F.col("address").alias(blob), F.coalesce("found", none).alias(spans))


def known_blobs(spark, ledger: str | None, own: str) -> DataFrame | None:
    """The ledger's scanned blobs of these rules; None before the first scan has written it."""
    from pyspark.errors import AnalysisException

    if ledger is None:
        return None
    try:
        entries = spark.read.parquet(ledger)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return entries.where(F.col("rules") == own).select("blob")


def spans_text(spans: Column, rules=RULES) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(r[0]) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string")
    )), ",")


def redacted(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with every stretch covered by spans replaced by ``mask`` once."""
    merged = F.aggregate(
        spans, F.array().cast("array<struct<start: bigint, end: bigint>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["start"] < F.element_at(acc, -1)["end"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                F.element_at(acc, -1)["start"].alias("start"),
                F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"),
            ))),
        ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    begins = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(merged, lambda m: m["end"]))
    stops = F.concat(F.transform(merged, lambda m: m["start"]), F.array(F.length(text).cast("bigint")))
    kept = F.zip_with(begins, stops, lambda b, e: F.substring(text, (b + 1).cast("int"), (e - b).cast("int")))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(kept, mask))
