"""Best-fit packing by exact-complement hashing.

How many pieces there are of each length (at most ``capacity`` numbers, whatever the table) is all that a plan needs.
The plan takes the longest piece left, looks up its gap in the index of single, pair and triple sums of the lengths
still available, and uses the combination that fills the gap exactly, as often as the counts allow.  Only where none
does, the longest piece that fits is put in and the rest of the gap is looked up again.  Pieces get ranks within their
length, and the plan's intervals of ranks say which sequence and offset each one has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wardlight.llm.common import word_encoder, text_of, written

CAPACITY = 4096
ROWS_PER_SALT = 20_000  # rows that one rank window holds at most, on average
LEAST_SALTS = 32


class SumIndex:
    """Available counts by length, with the number of available pairs for every sum.

    A triple is found by asking the pair sums for what each single leaves, so that the three indexes stay consistent
    when a length runs out.
    """

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype("int64")
        self.size = len(counts) - 1
        self.pairs = np.zeros(2 * self.size + 1, "int64")
        self.present = self.left > 0
        for length in np.flatnonzero(self.present):
            if length:
                self._count_pairs(int(length), 1, upto=int(length) - 1)
                self.pairs[2 * length] += self.left[length] > 1

    def _count_pairs(self, length: int, by: int, upto: int | None = None) -> None:
        """Pairs of ``length`` with every other present length (only smaller ones with ``upto``)."""
        others = np.flatnonzero(self.present[: (self.size if upto is None else upto) + 1])
        others = others[(others > 0) & (others != length)]
        self.pairs[others + length] += by

    def take(self, length: int, n: int) -> None:
        before = self.left[length]
        self.left[length] = before - n
        if before > 1 >= self.left[length]:
            self.pairs[2 * length] -= 1
        if self.left[length] == 0:
            self.present[length] = False
            self._count_pairs(length, -1)

    def single(self, gap: int) -> list[int] | None:
        return [gap] if 0 < gap <= self.size and self.present[gap] else None

    def pair(self, gap: int) -> list[int] | None:
        """The pair with the longest part first."""
        if gap < 2 or self.pairs[gap] <= 0:
            return None
        top = min(gap - 1, self.size)
        longer = np.arange(top, (gap + 1) // 2 - 1, -1)
        good = self.present[longer] & self.present[gap - longer]
        if gap % 2 == 0 and good[-1] and self.left[gap // 2] < 2:
            good[-1] = False
        at = int(np.argmax(good))
        return [int(longer[at]), int(gap - longer[at])] if good[at] else None

    def triple(self, gap: int) -> list[int] | None:
        if gap < 3:
            return None
        first = np.arange(min(gap - 2, self.size), 0, -1)
        for a in first[self.present[first] & (self.pairs[gap - first] > 0)]:
            rest = self.pair(int(gap - a))
            if rest and self._enough([int(a), *rest]):
                return [int(a), *rest]
        return None

    def _enough(self, lengths: list[int]) -> bool:
        return all(self.left[x] >= lengths.count(x) for x in set(lengths))

    def exact(self, gap: int) -> list[int] | None:
        return self.single(gap) or self.pair(gap) or self.triple(gap)

    def longest(self, limit: int) -> int:
        found = np.flatnonzero(self.present[1 : limit + 1])
        return int(found[-1]) + 1 if len(found) else 0


def plan(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """[(lengths of one sequence, how many such sequences)] for the number of pieces of each length 0..capacity."""
    index, capacity, out = SumIndex(counts), len(counts) - 1, []
    while longest := index.longest(capacity):
        pattern, gap = [longest], capacity - longest
        held = [longest]
        index.take(longest, 1)
        while gap:
            more = index.exact(gap) or ([x] if (x := index.longest(gap)) else [])
            if not more:
                break
            for x in more:
                index.take(x, 1)
                held.append(x)
            pattern += more
            gap -= sum(more)
        again = min(int(index.left[x]) // pattern.count(x) for x in set(pattern))
        if again:
            for x in set(pattern):
                index.take(x, again * pattern.count(x))
        out.append((pattern, 1 + again))
    return out


def intervals(patterns: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first rank, first sequence and offset of each interval of ranks, by first rank."""
    used: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        for length in lengths:
            rank = used.get(length, 0)
            rows.setdefault(length, []).append((rank, sequence, offset))
            used[length] = rank + times
            offset += length
        sequence += times
    return {k: tuple(np.array(x, "int64") for x in zip(*v)) for k, v in rows.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``length`` is 1 to ``capacity``.

    Rows of null, zero or negative length get nulls: they take no room.  Longer ones raise an error, since only the
    caller can cut them.  Which of two pieces of one length goes where is left open; repeated rows are packed as often
    as they occur.  An empty table gives an empty result.  The rows are written once to the scratch folder.
    """
    spark, names = pieces.sparkSession, pieces.columns
    room = F.when(pieces[length] > 0, pieces[length].cast("int"))
    rows = written(pieces.select(
        F.struct(*[pieces[c] for c in names]).alias("row"), room.alias("n"), F.monotonically_increasing_id().alias("no")
    ), "to_pack")
    per_length = rows.groupBy("n").count().where("n is not null").collect()  # one row per length
    if any(r["n"] > capacity for r in per_length):
        raise ValueError(f"a piece is longer than {capacity}")
    counts = np.zeros(capacity + 1, "int64")
    for r in per_length:
        counts[r["n"]] = r["count"]
    where = spark.sparkContext.broadcast(intervals(plan(counts)))  # at most a few patterns per length

    salted = rows.withColumn("salt", F.pmod(F.xxhash64("no"), F.lit(max(LEAST_SALTS, int(counts.sum()) // ROWS_PER_SALT))))
    sizes = written(salted.where("n is not null").groupBy("n", "salt").count(), "rank_sizes")
    before = Window.partitionBy("n").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("n", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("n", "salt").orderBy("no")
    ranked = salted.withColumn("rank", F.row_number().over(own) - 1).join(starts, ["n", "salt"], "left")
    ranked = ranked.select("row", "n", (F.col("rank") + F.col("start")).alias("rank"))

    schema = StructType([
        StructField("row", rows.schema["row"].dataType), StructField("sequence_id", LongType()), StructField("offset", LongType())
    ])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pc.fill_null(batch.column(1), 0).to_numpy(zero_copy_only=False)
            rank = pc.fill_null(batch.column(2), 0).to_numpy(zero_copy_only=False)
            sequence, offset = np.full(len(n), -1, "int64"), np.full(len(n), -1, "int64")
            for one in np.unique(n[n > 0]):
                first, begin, at = where.value[int(one)]
                mine = np.flatnonzero(n == one)
                hit = np.searchsorted(first, rank[mine], side="right") - 1
                sequence[mine], offset[mine] = begin[hit] + rank[mine] - first[hit], at[hit]
            none = sequence < 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sequence, mask=none), pa.array(offset, mask=none)], ["row", "sequence_id", "offset"]
            )

    return ranked.mapInArrow(place, schema).select("row.*", "sequence_id", "offset")


def token_pieces(
    df: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """key, piece, start, length, ids (little-endian unsigned 32-bit) of every document's tokens and its end id.

    Null texts count as empty and give the end id alone.  Only documents of more than ``capacity`` ids are cut, into
    pieces of ``capacity`` of which the last may be shorter.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(df[key].alias("key"), text_of(df, text).alias("text"))
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                origin, piece, start, length, ids = [], [], [], [], []
                for row, own in enumerate(encoder.many(batch.column(1).to_pylist())):
                    data = own + end
                    for i, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        origin.append(row)
                        piece.append(i)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        ids.append(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(origin, "int64")), pa.array(piece, "int32"), pa.array(start, "int64"),
                     pa.array(length, "int64"), pa.array(ids, "binary")],
                    ["key", "piece", "start", "length", "ids"],
                )

    return rows.mapInArrow(cut, f"key {kind}, piece int, start bigint, length bigint, ids binary")


def packed_documents(
    df: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """Where every piece of every document goes: doc key, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = token_pieces(df, tokenizer, end_id, key, text, capacity).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces, capacity).withColumnRenamed("key", key)


def sequences(pieces: DataFrame, placed: DataFrame, keys: list[str]) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves, from pieces with ids and from ``pack``."""
    both = placed.select(*keys, "sequence_id", "offset").join(pieces.select(*keys, "ids"), keys)
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # one sequence: at most ``capacity`` parts
    joined = F.aggregate(parts, F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return both.groupBy("sequence_id").agg(joined.alias("ids"))
