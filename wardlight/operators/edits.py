"""Character-level leakage check over whole sets: test prompts within a few edits of a train prompt.

Exact join by segment signatures.  A text is cut into twice as many equal segments as edits are allowed, plus two.  One
edit spoils one segment at most, so at least half of the segments and one more occur unchanged in a partner, each moved
by no more places than there are edits.  Any choice of edits + 1 segments therefore holds one that a partner has: each
train prompt is found by its rarest ones, and wording that many prompts begin with finds nobody.  Test prompts are asked
for all places where a segment can lie; what is found is verified with a banded edit distance.

Segments lie on a grid that depends on the length class of a text alone, so a test prompt has one or two grids to ask for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.session import stored

EDITS = 6
SHARE = 0.1  # of the longer text: a similarity of 0.9
FINE = 64  # texts shorter than this have a length class of their own for every length


def allowed(longer: Column, edits: int, share: float) -> Column:
    """Edits that a pair may differ by, given the length of its longer text."""
    return F.least(F.lit(edits), F.floor(longer * F.lit(share) + F.lit(1e-9)).cast("int"))


def length_class(n: Column) -> Column:
    """The least length of the class that holds ``n``: eight classes to an octave, single lengths below FINE."""
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(n.cast("double")) + 1e-12) - 3, F.lit(0))).cast("int")
    return F.when(n < FINE, n).otherwise(n - n % step).cast("int")


def _grid(low: Column, edits: int, share: float) -> tuple[Column, Column]:
    """Edits that any pair with a text of the class may differ by, and the number of segments of its texts."""
    width = F.when(low < FINE, F.lit(1)).otherwise(F.floor(low / 8) + 1)
    most = allowed(low + width + edits, edits, share)
    return most, F.least(2 * most + 2, F.greatest(low, most + 1))


def _segment(text: Column, low: Column, i: Column, start: Column, size: Column) -> Column:
    """Hash of segment ``i`` of the grid of ``low``, read from place ``start`` (from 0) of ``text``."""
    return F.xxhash64(low, i, F.substring(text, start + 1, size))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """The array ``use`` makes of ``value``, which is computed once: lambdas compute what they name anew every time."""
    return F.flatten(F.transform(F.array(value), use))


def own_segments(text: Column, n: Column, edits: int, share: float) -> Column:
    """Hashes of all segments of a text."""
    low = length_class(n)
    _, count = _grid(low, edits, share)
    size = F.floor(low / count).cast("int")
    return _bound(text, lambda t: F.transform(F.sequence(F.lit(0), count - 1), lambda i: _segment(t, low, i, i * size, size)))


def asked_segments(text: Column, n: Column, edits: int, share: float) -> Column:
    """Hashes of everything that may be a segment of a partner: all classes, segments and places in reach.

    All places of a segment are read from one stretch of the text, as Spark walks a string from its start to cut it.
    """
    reach = allowed(n + edits, edits, share)
    lengths = F.sequence(F.greatest(n - reach, F.lit(1)), n + reach)
    classes = F.array_distinct(F.transform(lengths, length_class))

    def of_class(text: Column, low: Column) -> Column:
        most, count = _grid(low, edits, share)
        size = F.floor(low / count).cast("int")
        far = F.least(most, reach)

        def of_segment(i: Column) -> Column:
            first, last = F.greatest(i * size - far, F.lit(0)), F.least(i * size + far, n - size)
            stretch = F.struct(F.substring(text, first + 1, last - first + size).alias("text"), first.alias("first"), size.alias("size"))
            return _bound(stretch, lambda cut: F.when(first <= last, F.transform(
                F.sequence(first, F.greatest(first, last)), lambda at: _segment(cut["text"], low, i, at - cut["first"], cut["size"]))
            ).otherwise(F.array().cast("array<bigint>")))

        return F.flatten(F.transform(F.sequence(F.lit(0), count - 1), of_segment))

    return F.array_distinct(_bound(text, lambda t: F.flatten(F.transform(classes, lambda low: of_class(t, low)))))


def as_units(text: Column, unit: str) -> Column:
    """What is counted: characters, or bytes of the UTF-8 form (each byte read as one character)."""
    return F.decode(text.cast("binary"), "ISO-8859-1") if unit == "byte" else text


class Sides:
    """Both sets stored once; equal texts stand for each other."""

    def __init__(self, test: DataFrame, train: DataFrame, key: str, text: str, edits: int, share: float, unit: str):
        self.edits, self.share, self.unit = edits, share, unit
        both = [df.select(df[key].alias("key"), as_units(df[text].cast("string"), unit).alias("text"), F.lit(side).alias("side"))
                for side, df in enumerate((test, train))]
        self.rows = stored(both[0].unionByName(both[1]).withColumn("n", F.coalesce(F.length("text"), F.lit(0))).withColumn(
            "digest", F.when(F.col("n") > 0, F.sha2(F.col("text").cast("binary"), 256))).withColumn("no", F.monotonically_increasing_id()), "prompts")
        known = self.rows.where("digest is not null").groupBy("digest").agg(
            F.min(F.when(F.col("side") == 0, F.col("no"))).alias("a"), F.min(F.when(F.col("side") == 1, F.col("no"))).alias("b"))
        self.classes = stored(known, "classes")  # digest, a test row and a train row of each text

    def representatives(self, side: str) -> DataFrame:
        """no, text, n: one row for each different text; of test texts those that train lacks."""
        one = self.classes.where("a is not null and b is null" if side == "a" else "b is not null").select(F.col(side).alias("no"))
        return self.rows.select("no", "text", "n").join(one, "no", "left_semi")

    def units(self) -> Column:
        """The text for cutting: bytes, whose places need no walk, or characters."""
        return F.encode("text", "ISO-8859-1") if self.unit == "byte" else F.col("text")

    def links(self) -> tuple[DataFrame, DataFrame]:
        """(no, h) of what each test text asks for, and of the rarest segments of each train text; only h of both."""
        own = stored(self.representatives("b").select("no", "n", own_segments(self.units(), F.col("n"), self.edits, self.share).alias("own")), "segments")
        held = own.select("no", F.explode("own").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
        most, _ = _grid(length_class(F.col("n")), self.edits, self.share)
        ranked = own.select("no", most.alias("most"), F.explode("own").alias("h")).join(stored(held, "frequent"), "h", "left").groupBy("no", "most").agg(
            F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "h"))).alias("own"))
        right = ranked.select("no", F.explode(F.slice("own", F.lit(1), F.col("most") + 1)["h"]).alias("h"))
        left = self.representatives("a").select("no", F.explode(asked_segments(self.units(), F.col("n"), self.edits, self.share)).alias("h"))
        wanted = stored(right.select(F.col("no").alias("b"), "h"), "indexed")
        met = stored(left.join(wanted.select("h").distinct(), "h", "left_semi").select(F.col("no").alias("a"), "h"), "asked")
        return met, wanted

    def verified(self, pairs: DataFrame) -> DataFrame:
        """a, b, distance of the pairs that are near enough."""
        texts = self.rows.select("no", "text", "n")
        first, second = texts.toDF("a", "text_a", "n_a"), texts.toDF("b", "text_b", "n_b")
        near = pairs.join(first, "a").join(second, "b")
        most = allowed(F.greatest("n_a", "n_b"), self.edits, self.share)
        near = near.where(F.abs(F.col("n_a") - F.col("n_b")) <= most)
        measured = near.withColumn("distance", F.levenshtein("text_a", "text_b", self.edits))
        return measured.where((F.col("distance") >= 0) & (F.col("distance") <= most)).select("a", "b", "distance")


def edit_overlap(
    test: DataFrame, train: DataFrame, key: str = "row_id", text: str = "prompt", edits: int = EDITS, share: float = SHARE,
    unit: str = "character",
) -> DataFrame:
    """key, n_chars, leaked: whether some train prompt can be turned into the test prompt by few enough edits.

    Allowed are ``share`` of the longer text, and never more than ``edits``.  ``unit`` is what an edit changes: a
    character or a byte.  Null and empty prompts never leak.  Each test prompt is first held against one train prompt
    for every segment found, which settles large groups of near copies in time linear in their size, and only if none
    is near against all of them.
    """
    sides = Sides(test, train, key, text, edits, share, unit)
    asked, indexed = sides.links()
    leaders = indexed.groupBy("h").agg(F.min("b").alias("b"))
    quick = stored(sides.verified(asked.join(leaders, "h").select("a", "b").distinct()).select("a").distinct(), "quick")
    others = asked.join(quick, "a", "left_anti").join(indexed, "h").select("a", "b").distinct()
    slow = sides.verified(others).select("a").distinct()
    near = sides.classes.join(quick.unionByName(slow), "a", "left_semi").select("digest")
    equal = sides.classes.where("a is not null and b is not null").select("digest")
    leaked = equal.unionByName(near).withColumn("leaked", F.lit(True))
    return sides.rows.where("side = 0").select("key", "n", "digest").join(leaked, "digest", "left").select(
        F.col("key").alias(key), F.col("n").cast("bigint").alias("n_chars"), F.coalesce("leaked", F.lit(False)).alias("leaked"))


def edit_matches(
    test: DataFrame, train: DataFrame, key: str = "row_id", text: str = "prompt", edits: int = EDITS, share: float = SHARE,
    unit: str = "character",
) -> DataFrame:
    """key, n_chars, match, distance: the nearest train prompt of every test prompt, of equally near ones the least key.

    Both are null where no train prompt is near enough.  The nearest is only known after all candidates were looked at,
    so a group of near copies costs the product of its different test and train texts.
    """
    sides = Sides(test, train, key, text, edits, share, unit)
    asked, indexed = sides.links()
    near = sides.verified(asked.join(indexed, "h").select("a", "b").distinct())
    named = stored(sides.rows.where("side = 1 and digest is not null").groupBy("digest").agg(F.min("key").alias("match")).join(
        sides.classes.select("digest", "a", "b"), "digest"), "named")
    order = F.struct("distance", F.col("match").isNull().alias("no_key"), "match")
    best = near.join(named.select("b", "match"), "b").groupBy("a").agg(F.min(order).alias("best"))
    found = best.join(sides.classes.select("a", "digest"), "a").select("digest", "best.match", "best.distance").unionByName(
        named.where("a is not null").select("digest", "match", F.lit(0).alias("distance")))
    return sides.rows.where("side = 0").select("key", "n", "digest").join(found, "digest", "left").select(
        F.col("key").alias(key), F.col("n").cast("bigint").alias("n_chars"), "match", "distance")
