"""Ranked lexical search by NRA: postings sorted by impact are read from the front only.

1. One pass over the documents writes an index: every shard holds some thousand documents in the order of their keys,
   the number of terms of each, and the postings (document, occurrences) of the terms that the queries ask for.
2. Sums over all shards give the number of documents, of terms, and of documents that hold a term.  They fix weights.
3. In a shard every posting becomes its impact on a score, and every list is sorted by falling impact.  A query reads
   its lists from the front, a growing number of postings at a time.  What was read of a document is its lower bound;
   with the next unread impact of every list in which it was not met yet it is the upper bound.  Reading ends when no
   unseen document can reach the k-th lower bound and all documents that still can have equal bounds: membership, ties
   and scores are then settled.  The best of one shard are the bar for the next one of the same task.
4. The best of all tasks are merged per query.

Queries are taken in blocks of a bounded number of characters.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlight.llm.common import text_of, written

SHARD_DOCUMENTS = 8_192
SHARD_POSTINGS = 1_500_000  # a shard ends with the document that reaches this number
BLOCK_CHARS = 4_000_000  # of query texts at a time
FIRST_READ = 256  # postings of every list read in the first round; twice as many in each further one
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and other characters beyond ASCII, A-Z lower-cased."""
    return text.translate(NORMAL).split()


def weight(documents: int, holders: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holders + 1)))


class ShardWriter:
    """Documents of one shard and their postings for some terms."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.vocabulary = vocabulary
        self.keys, self.sizes = [], []
        self.postings: list[tuple[list[int], list[int]]] = []
        self.n_postings = 0

    def add(self, key, text: bytes) -> None:
        words = terms(text)
        ids, counts, known = [], [], self.vocabulary
        for word, n in Counter(words).items():
            if word in known:
                ids.append(known[word])
                counts.append(n)
        self.keys.append(key)
        self.sizes.append(len(words))
        self.postings.append((ids, counts))
        self.n_postings += len(ids)

    def full(self) -> bool:
        return len(self.keys) >= SHARD_DOCUMENTS or self.n_postings >= SHARD_POSTINGS

    def row(self) -> dict:
        """Documents in the order of their keys, nulls last; postings by term."""
        order = sorted(range(len(self.keys)), key=lambda i: (self.keys[i] is None, self.keys[i] if self.keys[i] is not None else 0))
        ids = np.array([t for i in order for t in self.postings[i][0]], "<i4")
        tf = np.array([c for i in order for c in self.postings[i][1]], "<i4")
        doc = np.repeat(np.arange(len(order)), [len(self.postings[i][0]) for i in order]).astype("<i4")
        by = np.argsort(ids, kind="stable")
        held, sizes = np.unique(ids, return_counts=True)
        return {
            "keys": [self.keys[i] for i in order], "sizes": np.array([self.sizes[i] for i in order], "<i8").tobytes(),
            "documents": sum(s > 0 for s in self.sizes), "n_terms": sum(self.sizes), "held": held.tolist(),
            "holders": sizes.tolist(), "doc": doc[by].tobytes(), "tf": tf[by].tobytes(),
        }


INDEX = "keys array<{kind}>, sizes binary, documents bigint, n_terms bigint, held array<int>, holders array<int>, doc binary, tf binary"


def index(rows: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """One row for each shard of ``rows`` (key, text as bytes)."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    key_type = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, kind = ShardWriter(shared.value), None

        def shard() -> pa.RecordBatch:
            schema = pa.schema([
                ("keys", pa.list_(kind)), ("sizes", pa.binary()), ("documents", pa.int64()), ("n_terms", pa.int64()),
                ("held", pa.list_(pa.int32())), ("holders", pa.list_(pa.int32())), ("doc", pa.binary()), ("tf", pa.binary())])
            return pa.RecordBatch.from_pylist([writer.row()], schema=schema)

        for whole in batches:
            kind = whole.schema.field(0).type
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    writer.add(key, text.as_py())
                    if writer.full():
                        yield shard()
                        writer = ShardWriter(shared.value)
        if writer.keys:
            yield shard()

    return rows.mapInArrow(run, INDEX.format(kind=key_type))


class Shard:
    """Impact-sorted lists of one shard: term -> (documents, impacts falling)."""

    def __init__(self, row: dict, weights: np.ndarray, documents: int, n_terms: int):
        self.keys = row["keys"]
        sizes = np.frombuffer(row["sizes"], "<i8")
        length = 25 + (75 * sizes * documents) // max(n_terms, 1)
        doc, tf = np.frombuffer(row["doc"], "<i4").astype("int64"), np.frombuffer(row["tf"], "<i4").astype("int64")
        holders = np.array(row["holders"], "int64")
        list_no = np.repeat(np.arange(len(holders)), holders)
        impact = weights[np.repeat(np.array(row["held"], "int64"), holders)] * ((10**9 * tf) // (1000 * tf + 8 * length[doc]))
        order = np.lexsort((-impact, list_no))
        doc, impact = doc[order], impact[order]
        ends = np.cumsum(holders)
        self.lists = {t: (doc[e - n : e], impact[e - n : e]) for t, e, n in zip(row["held"], ends.tolist(), row["holders"])}

    def search(self, query: dict[int, int], k: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents, by falling score and rising key, of the k best that score at least ``bar`` and above 0."""
        lists = [(doc, impact * n) for t, n in query.items() if t in self.lists for doc, impact in [self.lists[t]]]
        lower = np.zeros(len(self.keys), "int64")
        met = np.zeros((len(lists), len(self.keys)), bool)
        next_impact = np.array([impact[0] for _, impact in lists], "int64")
        at, step = 0, FIRST_READ
        bar = max(bar, 1)
        while True:
            for i, (doc, impact) in enumerate(lists):
                if at < len(doc):
                    read = doc[at : at + step]
                    lower[read] += impact[at : at + step]
                    met[i, read] = True
                    next_impact[i] = impact[at + step] if at + step < len(doc) else 0
            at, step = at + step, 2 * step
            unseen = int(next_impact.sum())
            if len(lower) > k:
                bar = max(bar, int(np.partition(lower, len(lower) - k)[len(lower) - k]))
            if unseen >= bar:
                continue  # a document not met yet may still be among the best
            alive = np.flatnonzero(lower + unseen >= bar)
            upper = lower[alive] + unseen - next_impact @ met[:, alive]
            alive, upper = alive[upper >= bar], upper[upper >= bar]
            if (upper == lower[alive]).all():
                best = alive[np.argsort(-lower[alive], kind="stable")][:k]
                return best, lower[best]


FOUND = "query int, key {kind}, score bigint"


def search(shards: DataFrame, queries: list[dict[int, int]], weights: np.ndarray, documents: int, n_terms: int, k: int) -> DataFrame:
    """query, key, score: the k best of every task for each query."""
    spark = shards.sparkSession
    shared = spark.sparkContext.broadcast((queries, weights))
    key_type = shards.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight_of = shared.value
        best: list[list[tuple]] = [[] for _ in asked]  # (-score, key is null, key)
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type.value_type
            for i in range(batch.num_rows):
                shard = Shard(batch.slice(i, 1).to_pylist()[0], weight_of, documents, n_terms)
                for number, query in enumerate(asked):
                    own = best[number]
                    found, scores = shard.search(query, k, -own[-1][0] if len(own) == k else 0)
                    if len(found):
                        keys = [shard.keys[d] for d in found.tolist()]
                        new = [(-s, key is None, 0 if key is None else key) for s, key in zip(scores.tolist(), keys)]
                        best[number] = sorted(own + new)[:k]
        rows = [(q, None if null else key, -s) for q, own in enumerate(best) for s, null, key in own]
        if rows:
            numbers, keys, scores = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int32()), pa.array(keys, kind), pa.array(scores, pa.int64())], ["query", "key", "score"])

    return shards.mapInArrow(run, FOUND.format(kind=key_type))


def query_blocks(items: DataFrame, item: str, text: str, block_chars: int) -> Iterator[list[tuple]]:
    """(item, text as bytes) of all items with a text, in blocks of about ``block_chars`` characters."""
    rows = items.select(items[item].alias("item"), text_of(items, text).alias("text")).where("text <> ''")
    rows = written(rows.withColumn("no", F.monotonically_increasing_id()), "query_texts")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars)
    for number in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("no"), F.lit(blocks)) == number)
        yield [(r["item"], r["text"].encode("utf-8", "replace")) for r in block.collect()]


def top_documents(
    documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", k: int = 10, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """item, rank (from 1), key, score: the k best documents of every item with a score above 0, ties by rising key.

    Null and empty texts have no terms: such documents count in no statistic and are never found, such items have no
    rows.  Repeated documents are ranked as rows of their own, null keys last among equal scores.  An item that occurs
    in several rows is ranked once for each, with ranks from 1 in each.  Empty tables give an empty result.  Scores are
    whole numbers (see ``Shard``) and the same however rows are spread.  Other columns are not read.
    """
    spark = documents.sparkSession
    rows = documents.select(documents[key].alias("key"), text_of(documents, text).cast("binary").alias("text"))
    item_type = items.schema[item].dataType
    out = None
    for block in query_blocks(items, item, item_text, block_chars):
        vocabulary: dict[bytes, int] = {}
        queries, ids = [], []
        for own, data in block:
            counts = Counter(vocabulary.setdefault(t, len(vocabulary)) for t in terms(data))
            if counts:
                queries.append(dict(counts))
                ids.append(own)
        if not queries:
            continue
        shards = written(index(rows, vocabulary), "shards")
        n_documents, n_terms = shards.agg(F.sum("documents"), F.sum("n_terms")).first()
        if not n_documents:
            continue
        pair = F.explode(F.arrays_zip("held", "holders")).alias("pair")
        held = shards.select(pair).groupBy("pair.held").agg(F.sum("pair.holders").alias("holders")).collect()  # a row a term
        weights = np.zeros(len(vocabulary), "int64")
        for r in held:
            weights[r["held"]] = weight(n_documents, r["holders"])
        found = search(shards, queries, weights, n_documents, n_terms, k)
        ranked = found.withColumn("rank", F.row_number().over(
            Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("key")))).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(ids)), f"query int, item {item_type.simpleString()}")
        part = ranked.join(F.broadcast(names), "query").select("item", "rank", "key", "score")
        out = part if out is None else out.unionByName(part)
    if out is None:
        kind = rows.schema["key"].dataType.simpleString()
        out = spark.createDataFrame([], f"item {item_type.simpleString()}, rank int, key {kind}, score bigint")
    return out.withColumnRenamed("item", item).withColumnRenamed("key", key)
