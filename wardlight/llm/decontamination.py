"""Benchmark decontamination: one Aho-Corasick automaton over normalised test texts, run once over every document.

1. A text is normalised byte by byte: A-Z lower-cased, ASCII that is neither letter nor digit read as a space.  This
   keeps every offset, so a place in the normalised text is the same place in the original.
2. Every ten consecutive words of a test text are a pattern, with a space on either side; a shorter text is one pattern.
   All patterns of a block of test texts form one automaton, which names the texts that hold each pattern.
3. A document's words, one space apart, go through the automaton once.  Matches are turned into intervals of words,
   these are joined where they touch or overlap, and mapped to code points of the original.

Test texts are read in blocks of a bounded number of characters, so that an automaton fits a worker.  One block is the
rule; with several, documents are written once with a row number and the hits of all blocks meet by it.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import arrow_rows, text_of, written

WORDS = 10
BLOCK_CHARS = 500_000  # of test texts in one automaton: some 4 million nodes, 200 MB
SPACE = 0x20
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else SPACE for b in range(256))
HIT = "n_words bigint, starts array<bigint>, ends array<bigint>, first array<bigint>, last array<bigint>, items array<string>"


def windows(words: list[bytes], size: int) -> list[bytes]:
    """Every run of ``size`` words, or all words where there are fewer."""
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


class Scanner:
    """The automaton of some test texts (item, text)."""

    def __init__(self, texts: list[tuple[str | None, bytes]], size: int = WORDS):
        import ahocorasick

        holders: dict[bytes, set[str | None]] = defaultdict(set)
        for item, text in texts:
            for window in windows(text.translate(NORMAL).split(), size):
                holders[window].add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for window, items in holders.items():
            # Latin-1 maps bytes one to one; only equality of bytes matters here
            self.automaton.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, tuple(items)))
        self.empty = not holders
        if not self.empty:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words, hit intervals (first word, word after the last) that do not touch, and the items found."""
        words = text.translate(NORMAL).split()
        if self.empty or not words:
            return len(words), [], []
        line = b" " + b" ".join(words) + b" "
        found = list(self.automaton.iter(line.decode("latin-1")))
        if not found:
            return len(words), [], []
        spaces = np.flatnonzero(np.frombuffer(line, "u1") == SPACE)
        after = np.searchsorted(spaces, [end for end, _ in found])  # the space that ends a match comes after this word
        length = np.array([n for _, (n, _) in found])
        items = {i for _, (_, own) in found for i in own if i is not None}
        return len(words), joined(after - length, after), sorted(items)


def joined(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """The union of intervals [first, last), as few as possible, ascending."""
    if not len(first):
        return []
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.append(True, first[1:] > last[:-1])
    ends = np.append(np.flatnonzero(new)[1:] - 1, len(first) - 1)
    return list(zip(first[new].tolist(), last[ends].tolist()))


def code_points(text: bytes, intervals: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends, in code points of the original text, of intervals of its words."""
    normal = np.frombuffer(text.translate(NORMAL), "u1") != SPACE
    edges = np.diff(normal.astype("i1"), prepend=0, append=0)
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    before = np.append(0, np.cumsum((np.frombuffer(text, "u1") & 0xC0) != 0x80))
    return ([int(before[begins[a]]) for a, _ in intervals], [int(before[ends[b - 1]]) for _, b in intervals])


BUILT: dict[str, Scanner] = {}  # the automaton a worker holds, by its name


def scanner_of(name: str, texts, size: int) -> Scanner:
    if name not in BUILT:
        BUILT.clear()
        BUILT[name] = Scanner(texts, size)
    return BUILT[name]


def scanned(rows: DataFrame, texts: list[tuple[str | None, bytes]], size: int, only_hits: bool = False) -> DataFrame:
    """``rows`` (key, text as bytes) with the columns HIT in place of the text; with ``only_hits`` rows with hits only."""
    shared, name = rows.sparkSession.sparkContext.broadcast(texts), uuid.uuid4().hex
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of(name, shared.value, size)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                out, rows_kept = [], []
                for row, text in enumerate(batch.column(1)):
                    data = text.as_py()
                    n, intervals, items = scanner.scan(data)
                    if only_hits and not intervals:
                        continue
                    starts, ends = code_points(data, intervals) if intervals else ([], [])
                    rows_kept.append(row)
                    out.append((n, starts, ends, [a for a, _ in intervals], [b for _, b in intervals], items))
                columns = list(zip(*out)) if out else [[]] * 6
                longs = pa.list_(pa.int64())
                kinds = [pa.int64(), longs, longs, longs, longs, pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows_kept, pa.int64())), *[pa.array(list(c), t) for c, t in zip(columns, kinds)]],
                    ["key", "n_words", "starts", "ends", "first", "last", "items"])

    return rows.mapInArrow(run, f"key {kind}, {HIT}")


def item_texts(benchmark: DataFrame, item: str, texts: list[str], block_chars: int) -> tuple[DataFrame, int]:
    """(item, text) of all test texts, each once, and into how many blocks of about ``block_chars`` characters they go."""
    one = F.explode(F.array(*[text_of(benchmark, t) for t in texts])).alias("text")
    rows = benchmark.select(benchmark[item].cast("string").alias("item"), one).where("text <> ''")
    rows = written(rows.distinct(), "item_texts")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    return rows, max(1, -(-chars // block_chars))


def block_of(rows: DataFrame, blocks: int, number: int) -> list[tuple[str | None, bytes]]:
    """One block of ``item_texts``, for the driver to hand to all tasks."""
    block = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == number)
    return [(r["item"], r["text"].encode("utf-8", "replace")) for r in block.collect()]


def merged(gathered: DataFrame) -> DataFrame:
    """Hits of several automata on the same documents (key and arrays) as if one had found them."""
    kind = gathered.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in arrow_rows(batches):
            out = []
            for r in rows:
                words = joined(np.array(r["first"]), np.array(r["last"]))
                begin, end = dict(zip(r["first"], r["starts"])), dict(zip(r["last"], r["ends"]))
                out.append({
                    "key": r["key"], "starts": [begin[a] for a, _ in words], "ends": [end[b] for _, b in words],
                    "first": [a for a, _ in words], "last": [b for _, b in words], "items": sorted(set(r["items"]))})
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("key", pa.int64()), ("starts", longs), ("ends", longs), ("first", longs), ("last", longs), ("items", pa.list_(pa.string()))]))

    return gathered.mapInArrow(
        run, f"key {kind}, starts array<bigint>, ends array<bigint>, first array<bigint>, last array<bigint>, items array<string>")


def contamination(
    documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    texts: tuple[str, ...] = ("text",), size: int = WORDS, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """key, n_words, n_hit, items (texts, ascending), spans (array of start, end) and contaminated of every document.

    ``texts`` are the columns of ``benchmark`` that hold questions or answers.  Spans are code points of the original
    text, end exclusive, from the first to the last word of a stretch of hit words.  Null and empty texts, on either
    side, have no words and no hits; a test text without ten words counts as a whole.  Rows of ``benchmark`` with a null
    item hit words but name no item; repeated rows count once.  Repeated documents are kept.  An empty table of test
    texts leaves all documents clean, an empty table of documents gives an empty result.  Other columns are not read.
    """
    rows = documents.select(documents[key].alias("key"), text_of(documents, text).cast("binary").alias("text"))
    asked, blocks = item_texts(benchmark, item, list(texts), block_chars)
    if blocks == 1:
        return with_counts(scanned(rows, block_of(asked, 1, 0), size)).withColumnRenamed("key", key)
    numbered = written(rows.withColumn("no", F.monotonically_increasing_id()), "numbered")
    counted = written(scanned(numbered.select(F.col("no").alias("key"), "text"), [], size).select(
        F.col("key").alias("no"), "n_words"), "counted")
    hits = None
    for number in range(blocks):
        block = block_of(asked, blocks, number)
        part = written(scanned(numbered.select(F.col("no").alias("key"), "text"), block, size, only_hits=True), "hits")
        hits = part if hits is None else hits.unionByName(part)
    gathered = hits.groupBy("key").agg(
        *[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "first", "last", "items")])
    whole_hits = merged(gathered).withColumnRenamed("key", "no")
    none = F.array().cast("array<bigint>")
    whole = numbered.select("no", "key").join(counted, "no").join(whole_hits, "no", "left").select(
        "key", "n_words", *[F.coalesce(c, none).alias(c) for c in ("starts", "ends", "first", "last")],
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return with_counts(whole).withColumnRenamed("key", key)


def with_counts(found: DataFrame) -> DataFrame:
    pairs = F.zip_with("first", "last", lambda a, b: b - a)
    n_hit = F.aggregate(pairs, F.lit(0).cast("bigint"), lambda total, n: total + n)
    spans = F.zip_with("starts", "ends", lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    return found.select("key", "n_words", n_hit.alias("n_hit"), "items", spans.alias("spans"), (F.size("first") > 0).alias("contaminated"))
