"""Sets of word shingles, and which of them can have a linked one at all.

Hashes are in ascending order.  Of two linked sets each has several common shingles early in this order (see ``early``),
so a set is left out unless so many of its early shingles occur early in other sets.  Only the early ones are moved, as
32-bit remainders within buckets; sets that stay are read again in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.session import small_side, stored

WORDS = 5
PERCENT = 75
FILTER_BITS = (1 << 22, 1 << 28)  # least and largest size of the filter that spares most classes a second reading
BITS_A_CLASS = 64
EARLY_SHARE = 5  # a fifth of a set more than the least prefix is compared early
WINDOW_SHINGLES = 1_500_000  # early shingles that a Python worker combines before it sends them on
WINDOW_CLASSES = 30_000
BUCKET_ROWS = 12_000  # documents to a bucket of early shingles: some 2 million entries, of which several are of one class
REMEMBERED = 200_000  # word hashes that one Python worker keeps
CREDIT_CLASSES = 1_000_000  # classes whose credits one task adds up before it sends them on
CREDITS_A_PART = 20_000  # classes whose credits meet in one group
PREFIX_SHINGLES = 1_000_000  # shingles of whole sets that a worker combines before it asks how common they are; about as many meet in one bucket
MOST_COMMON = (1 << 15) - 1  # shingles held by more classes count as held by so many


def text_of(df: DataFrame, column: str) -> Column:
    """The text column, with null read as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def needed(n: Column) -> Column:
    """Least overlap with any partner: the smallest whole number of at least PERCENT of n."""
    return F.floor((n * PERCENT + 99) / 100).cast("int")


class Shingler:
    """Distinct 64-bit hashes of the word shingles of a text, ascending as signed numbers."""

    def __init__(self, size: int = WORDS):
        self.size = size
        self.memory: dict[bytes, int] = {}

    def words(self, text: str) -> list[bytes]:
        """Maximal stretches without ASCII white space, A-Z lower-cased."""
        return text.encode("utf-8", "surrogatepass").lower().split()

    def sets(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0, "int64")
        known = self.memory
        try:
            codes = np.array([known[w] for w in words], "uint64")
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            codes = np.array([known[w] for w in words], "uint64")
        size = min(self.size, len(words))
        n = len(words) - size + 1
        mixed = np.full(n, size, "uint64")
        for i in range(size):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
            mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        return np.unique(mixed.view("int64"))


def _need(n: int) -> int:
    return -(-n * PERCENT // 100)


def early(n: int) -> int:
    """How many of the least hashes of a set of n are compared: n - need + g, where g = ``common(n)``.

    At most n - need of them are outside the overlap with a linked set, so g of them lie inside it, and the first
    common(m) of the overlap are early in a linked set of m as well.
    """
    return n - _need(n) + common(n) if n else 0


def common(n: int) -> int:
    return max(1, n // EARLY_SHARE)


def least_common(n: Column) -> Column:
    """Early shingles that a class of n must share to have a link: ``common`` of the smallest possible partner."""
    return F.greatest(F.lit(1), F.floor(needed(n) / EARLY_SHARE)).cast("int")


READ = "key {kind}, class binary, x bigint, n int, bucket int, h binary, owner binary, xs binary"


class Window:
    """Early shingles of some documents, combined before they are moved."""

    def __init__(self, bits: int):
        self.bits, self.seen = bits, {}
        self.hashes: list[np.ndarray] = []
        self.size = 0

    def add(self, x: int, hashes: np.ndarray) -> None:
        if x not in self.seen:
            self.seen[x] = len(self.seen)
            self.hashes.append(hashes.copy())  # a part of a set would keep the whole of it
            self.size += len(hashes)

    def full(self) -> bool:
        return self.size >= WINDOW_SHINGLES or len(self.seen) >= WINDOW_CLASSES

    def rows(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """(bucket, h, owner, xs).  A shingle of several classes here is credited to them at once, as bucket -1 with
        counts for h, and only one of its classes is sent on, marked, so that a frequent shingle has one entry for each
        window."""
        if not self.seen:
            return
        xs = np.array(list(self.seen), "int64")
        owner = np.repeat(np.arange(len(xs), dtype="u2"), [len(h) for h in self.hashes])
        h = np.concatenate(self.hashes).view("uint64")
        self.hashes = []
        order = np.argsort(h, kind="stable")
        h, owner = h[order], owner[order]
        del order
        first = np.append(True, h[1:] != h[:-1])
        several = ~(first & np.append(first[1:], True))
        credit = np.bincount(owner[several], minlength=len(xs))
        got = np.flatnonzero(credit)
        yield -1, credit[got].astype("<u4").tobytes(), b"", xs[got].tobytes()
        h, owner, several = h[first], owner[first], several[first]
        bucket = (h >> np.uint64(64 - self.bits)).astype("i4")
        edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
        for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
            classes, at = np.unique(owner[start:end], return_inverse=True)
            marked = at | several[start:end].astype("int64") << 15
            yield (int(bucket[start]), (h[start:end] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(),
                   marked.astype("<u2").tobytes(), xs[classes].tobytes())


def read_documents(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per document (key, class, x, n; class null for empty texts), and rows of early shingles (bucket, h,
    owner, xs), from one pass over the texts."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(df[key].alias("key"), text_of(df, text).alias("text"))
    bits = max(6, (df.count() // BUCKET_ROWS).bit_length())
    names = ["key", "class", "x", "n", "bucket", "h", "owner", "xs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, window, kept = Shingler(), Window(bits), None

        def posted() -> pa.RecordBatch:
            found = list(window.rows())
            none = [pa.nulls(len(found), t) for t in (kept.schema.field(0).type, pa.binary(), pa.int64(), pa.int32())]
            parts = [pa.array(list(v), t) for v, t in zip(zip(*found), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))]
            return pa.RecordBatch.from_arrays([*none, *parts], names)

        for whole in batches:
            kept = whole
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                classes, numbers, sizes = [], [], []
                for value in batch.column(1):
                    words = shingler.words(value.as_py())
                    found = shingler.sets(words)
                    n = len(found)
                    digest = blake2b(b" ".join(words), digest_size=16).digest() if n else None
                    x = int.from_bytes(digest[:8], "little", signed=True) if n else None
                    classes.append(digest)
                    numbers.append(x)
                    sizes.append(n)
                    if n:
                        window.add(x, found[: early(n)])
                    if window.full():
                        yield posted()
                        window = Window(bits)
                blank = [pa.nulls(len(sizes), t) for t in (pa.int32(), pa.binary(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(classes, "binary"), pa.array(numbers, "int64"), pa.array(sizes, "int32"), *blank], names)
        if window.seen:
            yield posted()

    return rows.mapInArrow(run, READ.format(kind=kind))


def bucket_credits(parts: list[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(x, credit) from all entries (h, owner, xs) of one bucket."""
    h, x, marked = [], [], []
    for a, b, c in parts:
        owner = np.frombuffer(b, "<u2")
        h.append(np.frombuffer(a, "<u4"))
        x.append(np.frombuffer(c, "<i8")[owner & 0x7FFF])
        marked.append(owner >> 15)
    h, x, marked = np.concatenate(h), np.concatenate(x), np.concatenate(marked).astype(bool)
    order = np.lexsort((~marked, x, h))  # of a class's entries for one shingle the marked one comes first
    h, x, marked = h[order], x[order], marked[order]
    once = np.append(True, (h[1:] != h[:-1]) | (x[1:] != x[:-1]))
    h, x, marked = h[once], x[once], marked[once]
    group = np.cumsum(np.append(True, h[1:] != h[:-1])) - 1
    shared = (np.bincount(group) > 1)[group] & ~marked
    return np.unique(x[shared], return_counts=True)


class Sums:
    """Credits of classes, added up before they leave a task; ``take`` gives them by part and starts anew."""

    def __init__(self, parts: int):
        self.parts, self.x, self.n = parts, np.zeros(0, "int64"), np.zeros(0, "int64")

    def add(self, x: np.ndarray, n: np.ndarray) -> None:
        self.x, at = np.unique(np.concatenate([self.x, x]), return_inverse=True)
        self.n = np.bincount(at, np.concatenate([self.n, n]), minlength=len(self.x)).astype("int64")

    def take(self) -> pa.RecordBatch:
        part = self.x % self.parts
        order = np.argsort(part, kind="stable")
        x, n, part = self.x[order], self.n[order], part[order]
        edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else np.zeros(1, int)
        rows = [(int(part[i]), x[i:j].tobytes(), n[i:j].astype("<u4").tobytes()) for i, j in zip(edges[:-1].tolist(), edges[1:].tolist())]
        self.__init__(self.parts)
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()))], ["part", "xs", "ns"])


def credits(read: DataFrame, parts: int) -> DataFrame:
    """x, credit: how many early shingles of a class occur early in other classes (or more, for classes with copies)."""
    posted = read.where("bucket is not null").select("bucket", "h", "owner", "xs")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, bucket, entries = Sums(parts), None, []
        for batch in batches:
            for number, *entry in zip(*(c.to_pylist() for c in batch.columns)):
                if number != bucket and entries:
                    sums.add(*bucket_credits(entries))
                    entries = []
                    if len(sums.x) >= CREDIT_CLASSES:
                        yield sums.take()
                bucket = number
                entries.append(entry)
        if entries:
            sums.add(*bucket_credits(entries))
        yield sums.take()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, xs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums = Sums(parts)
                sums.add(np.frombuffer(xs, "<i8"), np.frombuffer(n, "<u4").astype("int64"))
                yield sums.take()

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        sums = Sums(1)
        sums.add(np.frombuffer(b"".join(rows["xs"]), "<i8"), np.frombuffer(b"".join(rows["ns"]), "<u4").astype("int64"))
        return pd.DataFrame({"x": sums.x, "credit": sums.n})

    packed = "part int, xs binary, ns binary"
    across = posted.where("bucket >= 0").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, packed)
    within = posted.where("bucket < 0").select("h", "xs").mapInArrow(local, packed)
    return across.unionByName(within).groupBy("part").applyInPandas(total, "x bigint, credit bigint")


def _bits_of(hashes: DataFrame, size: int) -> np.ndarray:
    """A bitmap of ``size`` bits over the only column of ``hashes``: at most 8,192 rows of 4 KB, whatever the table."""
    # Spark's bitmap functions number bits from 1
    at = F.pmod(F.col(hashes.columns[0]), F.lit(size)) + 1
    rows = hashes.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros(size // 8, "u1")
    for r in rows:
        bits = np.frombuffer(bytes(r["bits"]), "u1")
        out[(r["bucket"] - 1) * len(bits) : r["bucket"] * len(bits)] = bits
    return out


def _marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the unsigned hashes have their bit set."""
    at = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype("u1") & 1).astype(bool)


def whole_sets(df: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """key, class, n, hashes, v (a number) of the classes in ``wanted`` (class, key of one of its rows), each once; stored.

    Two bitmaps, over keys and over keys with their class, find the rows in the task that reads them, so sets are stored
    where they are made.  The few rows that only the bitmaps take for wanted are named by a join without sets.
    """
    spark = df.sparkSession
    size = min(FILTER_BITS[1], max(FILTER_BITS[0], 1 << (wanted.count() * BITS_A_CLASS).bit_length()))
    bits = spark.sparkContext.broadcast((
        _bits_of(wanted.select(F.xxhash64("key")), size), _bits_of(wanted.select(F.xxhash64("key", "class")), size)))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, (keys, pairs) = Shingler(), bits.value
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                hashes = batch.column(2).to_numpy().view("uint64")
                rows, classes, sets = [], [], []
                for row in np.flatnonzero(_marked(keys, hashes)).tolist():
                    words = shingler.words(batch.column(1)[row].as_py())
                    digest = blake2b(b" ".join(words), digest_size=16).digest()
                    # Spark's xxhash64 of (key, class): that of the key is the seed for the class
                    if _marked(pairs, np.array([xxhash.xxh64_intdigest(digest, int(hashes[row]))], "uint64"))[0]:
                        rows.append(row)
                        classes.append(digest)
                        sets.append(shingler.sets(words))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, "int64")), pa.array(classes, "binary"),
                     pa.array([len(s) for s in sets], "int32"), pa.array(sets, pa.list_(pa.int64()))],
                    ["key", "class", "n", "hashes"],
                )

    rows = df.select(df[key].alias("key"), text_of(df, text).alias("text")).withColumn("at", F.xxhash64("key"))
    read = rows.mapInArrow(run, f"key {kind}, class binary, n int, hashes array<bigint>")
    found = stored(read.withColumn("v", F.monotonically_increasing_id()), "members", compression="none")
    right = wanted.select(F.col("class").alias("c"), F.col("key").alias("k"))
    named = found.select("key", "class", "v")
    wrong = stored(named.join(right, (named["class"] == right["c"]) & named["key"].eqNullSafe(right["k"]), "left_anti").select("v"), "unwanted")
    if wrong.head(1):
        found = found.join(small_side(wrong), "v", "left_anti").select(found.columns)
    # only a repeated row with the same key gives a class twice; sets are moved for these alone
    twice = found.groupBy("class").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("class")
    if not twice.head(1):
        return found
    return found.join(twice, "class", "left_anti").unionByName(found.join(twice, "class", "left_semi").dropDuplicates(["class"]))


# --- the rarest shingles of whole sets -----------------------------------------------------------------------------

def _questions(number: int, bits: int, vs: np.ndarray, ns: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    """Rows (window, bucket, h, df, owner) of one window of classes.  Bucket -1 names the classes (v for h, n for owner)
    and stays in the window; the others hold the least 32 bits of the shingles of a bucket, each once, and the places of the
    classes that hold them, the first of each shingle marked."""
    owner = np.repeat(np.arange(len(vs), dtype="u2"), ns)
    h = hashes.view("uint64")
    code = h >> np.uint64(64 - bits) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    del order
    first = np.append(True, code[1:] != code[:-1])[: len(code)]
    marked = (owner | first.astype("u2") << 15).astype("<u2")
    bucket = (code >> np.uint64(32)).astype("i4")
    edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)]), len(bucket)).tolist()
    rows = [(number, -1, vs.astype("<i8").tobytes(), b"", ns.astype("<i4").tobytes())]
    for start, end in zip(edges[:-1], edges[1:]):
        least = (code[start:end][first[start:end]] & np.uint64(0xFFFFFFFF)).astype("<u4")
        rows.append((number, int(bucket[start]), least.tobytes(), b"", marked[start:end].tobytes()))
    return _asked(rows)


ASKED = "window bigint, bucket int, h binary, df binary, owner binary"


def _asked(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["window", "bucket", "h", "df", "owner"])


def _answers(bucket: int, rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    """The rows of one bucket with how many entries each shingle has in all windows, less the shingles that have one."""
    hashes = [np.frombuffer(h, "<u4") for _, h, _ in rows]
    owners = [np.frombuffer(o, "<u2") for _, _, o in rows]
    held = [np.diff(np.append(np.flatnonzero(o >> 15), len(o))) for o in owners]
    known, at = np.unique(np.concatenate(hashes), return_inverse=True)
    df = np.bincount(at, np.concatenate(held), minlength=len(known)).astype("int64")[at]
    out, start = [], 0
    for (window, _, _), h, o, n in zip(rows, hashes, owners, held):
        own, start = df[start : start + len(h)], start + len(h)
        shared = own > 1
        if shared.any():
            out.append((window, bucket, h[shared].tobytes(), np.minimum(own[shared], MOST_COMMON).astype("<u2").tobytes(),
                        o[np.repeat(shared, n)].tobytes()))
    return _asked(out)


def _prefixes(rows: list[tuple[int, bytes, bytes, bytes]]) -> pa.RecordBatch:
    """(v, n, prefix) of the classes of one window from all its rows (bucket, h, df, owner)."""
    vs, ns, codes, owners = np.zeros(0, "<i8"), np.zeros(0, "<i4"), [np.zeros(0, "int64")], [np.zeros(0, "int64")]
    for bucket, h, df, owner in rows:
        if bucket < 0:
            vs, ns = np.frombuffer(h, "<i8"), np.frombuffer(owner, "<i4")
            continue
        marked = np.frombuffer(owner, "<u2")
        code = np.frombuffer(df, "<u2").astype("int64") << 48 | bucket << 32 | np.frombuffer(h, "<u4").astype("int64")
        codes.append(code[np.cumsum(marked >> 15, dtype="int64") - 1])
        owners.append((marked & 0x7FFF).astype("int64"))
    code, owner = np.concatenate(codes), np.concatenate(owners)
    order = np.lexsort((code, owner))
    code, own = code[order], np.bincount(owner, minlength=len(vs))
    spare = own - (ns.astype("int64") * PERCENT + 99) // 100 + 1  # shared shingles within the prefix; the unshared come before them
    rank = np.arange(len(code)) - np.repeat(np.cumsum(own) - own, own)
    values = code[rank < np.repeat(spare, own)]
    got = spare > 0
    offsets = np.append(0, np.cumsum(spare[got]))
    return pa.RecordBatch.from_arrays(
        [pa.array(vs[got], "int64"), pa.array(ns[got], "int32"),
         pa.ListArray.from_arrays(pa.array(offsets, "int32"), pa.array(values, "int64"))], ["v", "n", "prefix"])


def shared_prefixes(members: DataFrame) -> DataFrame:
    """v, n, prefix: the shingles, rarest first, that a linked partner of ``members`` (v, n, hashes) must be found by.

    A shingle is one number: how many classes hold it, up to MOST_COMMON, before the first bits (those of its bucket) and
    the last 32 of its hash.  Numbers that several shingles share are counted and found together, in one order for all
    sets, which verification sorts out.  Windows of classes send each of their shingles once to the shingle's bucket and
    get the shared ones back with their counts; sets stay where they are.
    """
    total = members.agg(F.sum(F.col("n").cast("bigint"))).first()[0] or 0
    bits = min(16, max(6, (total // PREFIX_SHINGLES).bit_length()))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, size = [], 0
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                hashes = batch.column(2)
                window.append((batch.column(0).to_numpy(), np.diff(hashes.offsets.to_numpy()), hashes.flatten().to_numpy()))
                size += len(window[-1][2])
                if size >= PREFIX_SHINGLES or len(window) * 500 >= WINDOW_CLASSES:
                    yield _questions(int(window[0][0][0]), bits, *(np.concatenate(c) for c in zip(*window)))
                    window, size = [], 0
        if window:
            yield _questions(int(window[0][0][0]), bits, *(np.concatenate(c) for c in zip(*window)))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _runs(batches, 1):
            yield _answers(bucket, [(window, h, owner) for window, _, h, _, owner in rows])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches, 0):
            yield _prefixes([row[1:] for row in rows])

    asked = stored(members.select("v", "n", "hashes").mapInArrow(ask, ASKED), "asked", compression="zstd")
    answered = asked.where("bucket >= 0").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(answer, ASKED)
    whole = asked.where("bucket < 0").unionByName(answered)
    return whole.repartition("window").sortWithinPartitions("window").mapInArrow(cut, "v bigint, n int, prefix array<bigint>")


def _runs(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of sorted batches, those with the same value in column ``by`` together."""
    value, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and row[by] != value:
                yield value, rows
                rows = []
            value = row[by]
            rows.append(row)
    if rows:
        yield value, rows
