"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

The classifier is fitted on a bounded sample of labelled rows: PER_CLASS rows of either label are examples and as many
calibrate.  Its features are the words and word beginnings that point to toxic texts most in the sample.  Document
frequencies are counted over all documents.  The examples lie in a block-max inverted index: the lists of the few features
are rows of a matrix, cut into blocks of neighbouring examples with the largest weight in each; the sum of its products with
a query bounds all cosines within a block, and blocks are visited by falling bound until none can hold a nearer example.  The nearest examples vote with
the square of their cosine, and the vote is mapped to a probability by the calibration rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import forget_words, text_of, written

PER_CLASS = 3_000
FEATURES = 2_048
LEAST_GAIN = 15.0  # log-likelihood ratio from which a feature is more than chance
LEAST_LIFT = 4.0  # how many times more often toxic texts must have a feature
NEIGHBOURS = 15
EVIDENCE = 3
BLOCK = 64
THRESHOLD = 0.3
BEGINNINGS = (4, 5, 6, 7, 8)
LEVELS = (1, 2, 3)
WORD = re.compile(r"[^\W\d_]+")
REMEMBERED = 150_000


def held_out(key: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


def stems_of(word: str) -> list[str]:
    """A word as a whole, and its beginnings, marked by their length."""
    return [f"w {word}"] + [f"{n} {word[:n]}" for n in BEGINNINGS if len(word) > n]


def levels(distinct: int) -> list[int]:
    """A stem gives one feature for each level up to the number of different words that have it."""
    return [n for n in LEVELS if n <= distinct]


def sample(labels: DataFrame, key: str, label: str, per_class: int) -> DataFrame:
    """key, toxic, example (else calibration), weight: rows of the sample and how many training rows each stands for."""
    known = labels.where(labels[key].isNotNull() & labels[label].isin(0, 1) & ~held_out(labels[key])).select(
        labels[key].cast("bigint").alias("key"), labels[label].cast("int").alias("toxic"))
    known = known.groupBy("key").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = F.xxhash64("key")
    rows = []
    for value in (0, 1):
        found = known.where(F.col("toxic") == value).orderBy(order, "key").limit(2 * per_class).collect()  # bounded
        weight = totals.get(value, 0) / max(1, len(found))
        rows += [(r["key"], value, i % 2 == 0, weight) for i, r in enumerate(found)]
    return labels.sparkSession.createDataFrame(rows, "key bigint, toxic int, example boolean, weight double")


def _rows(df: DataFrame, key: str, text: str, row: str | None) -> DataFrame:
    carried = [df[row].alias("row")] if row else []
    return df.select(df[key].cast("bigint").alias("key"), *carried, text_of(df, text).alias("text"))


def select_features(texts: DataFrame, size: int) -> list[str]:
    """The features of toxic texts with the largest log-likelihood ratio between the labels of (text, toxic) rows."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                stems = Counter(f for w in set(WORD.findall(value.as_py().lower())) for f in stems_of(w))
                found = [f"{n} {f}" for f, distinct in stems.items() for n in levels(distinct)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, "string"), pa.array([toxic] * len(found), "int32")], ["feature", "toxic"])

    totals = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    n1, n0 = float(totals.get(1, 0)), float(totals.get(0, 0))
    if not n1 or not n0:
        return []
    counted = texts.select("text", "toxic").mapInArrow(names, "feature string, toxic int").groupBy("feature").agg(
        F.sum("toxic").cast("double").alias("a"), F.count(F.lit(1)).cast("double").alias("df"))

    def part(observed: Column, expected: Column) -> Column:
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

    a, b, df = F.col("a"), F.col("df") - F.col("a"), F.col("df")
    n = n1 + n0
    gain = 2 * (
        part(a, df * n1 / n) + part(b, df * n0 / n) + part(n1 - a, (n - df) * n1 / n) + part(n0 - b, (n - df) * n0 / n))
    lift = ((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1))
    best = counted.withColumn("gain", gain).where((F.col("gain") >= LEAST_GAIN) & (lift >= LEAST_LIFT)).orderBy(F.desc("gain"), "feature").limit(size)
    return [r["feature"] for r in best.collect()]


def feature_counts(rows: DataFrame, features: list[str]) -> DataFrame:
    """All columns but text, ids, counts: how often each selected feature occurs in each whole text, ids ascending."""
    numbers: dict[str, dict[int, int]] = {}  # stem -> level -> feature
    for i, name in enumerate(features):
        level, stem = name.split(" ", 1)
        numbers.setdefault(stem, {})[int(level)] = i
    shared = rows.sparkSession.sparkContext.broadcast(numbers)
    carried = rows.columns[:-1]
    kinds = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes[:-1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        number, memory = shared.value, {}
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                ids, counts = [], []
                for value in batch.column(len(carried)):
                    words: Counter = Counter()  # different words of a stem
                    total: Counter = Counter()  # their occurrences
                    for word, n in Counter(WORD.findall(value.as_py().lower())).items():
                        own = memory.get(word)
                        if own is None:
                            if len(memory) > REMEMBERED:
                                memory.clear()
                            own = memory[word] = tuple(stem for stem in stems_of(word) if stem in number)
                        for stem in own:
                            words[stem] += 1
                            total[stem] += n
                    found = sorted(
                        (number[stem][level], total[stem]) for stem, distinct in words.items()
                        for level in levels(distinct) if level in number[stem])
                    ids.append([i for i, _ in found])
                    counts.append([n for _, n in found])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                    [*carried, "ids", "counts"])

    return rows.mapInArrow(count, f"{kinds}, ids array<int>, counts array<int>")


class BlockMaxIndex:
    """Unit vectors in blocks of neighbours, with the largest weight of every feature in each block."""

    def __init__(self, keys: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((keys, vectors.argmax(axis=1))) if len(keys) else np.zeros(0, int)
        self.keys, self.columns = keys[order], np.ascontiguousarray(vectors[order].T)
        self.starts = range(0, len(keys), BLOCK)
        self.order = order
        self.most = np.array([self.columns[:, s : s + BLOCK].max(axis=1) for s in self.starts]).reshape(len(self.starts), vectors.shape[1])

    def nearest(self, ids: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the k nearest examples with a cosine above 0; ties go to the smaller key."""
        bounds = self.most[:, ids] @ weights
        places, found = np.zeros(0, int), np.zeros(0)
        for block in np.argsort(-bounds, kind="stable"):
            if bounds[block] <= 0 or (len(found) == k and bounds[block] < found[-1] - 1e-9):
                break
            start = self.starts[block]
            cosine = np.round(weights @ self.columns[ids, start : start + BLOCK], 12)
            hit = np.flatnonzero(cosine > 0)
            places, found = np.concatenate([places, hit + start]), np.concatenate([found, cosine[hit]])
            best = np.lexsort((self.keys[places], -found))[:k]
            places, found = places[best], found[best]
        return places, found


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted isotonic regression by pooling neighbours: steps (from x, value)."""
    pools: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        pools.append([x[i], y[i] * w[i], w[i]])
        while len(pools) > 1 and (
            pools[-2][0] == pools[-1][0] or pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]
        ):
            last = pools.pop()
            pools[-1][1] += last[1]
            pools[-1][2] += last[2]
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


class Model:
    """Index, labels and calibration; small enough to go to every worker."""

    def __init__(self, idf: np.ndarray, rows: list, neighbours: int = NEIGHBOURS):
        self.idf, self.k = idf, neighbours
        rows = sorted(rows, key=lambda r: r["key"])
        weighed = [self.vector(r["ids"], r["counts"]) for r in rows]
        known = [i for i, r in enumerate(rows) if r["example"] and len(weighed[i][0])]
        dense = np.zeros((len(known), len(idf)))
        for row, i in enumerate(known):
            dense[row, weighed[i][0]] = weighed[i][1]
        self.index = BlockMaxIndex(np.array([rows[i]["key"] for i in known], "int64"), dense)
        self.toxic = np.array([rows[i]["toxic"] for i in known], float)[self.index.order]
        self.stands = np.array([rows[i]["weight"] for i in known], float)[self.index.order]
        total = sum(r["weight"] for r in rows)
        self.base = sum(r["weight"] for r in rows if r["toxic"]) / total if total else 0.0
        votes, labels, weights = [], [], []
        none = [1.0, self.base]  # of texts with no feature, with one row's worth of the base rate
        for r, (ids, v) in zip(rows, weighed):
            vote = self.vote(ids, v)[0] if not r["example"] else None
            if not len(ids):
                none = [none[0] + r["weight"], none[1] + r["weight"] * r["toxic"]]
            elif vote is not None:
                votes.append(vote)
                labels.append(r["toxic"])
                weights.append(r["weight"])
        self.unknown = none[1] / none[0]
        self.steps = monotone(np.array(votes), np.array(labels, float), np.array(weights)) if votes else None

    def vector(self, ids: list[int], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        at = np.array(ids, int)
        weight = (1 + np.log(np.array(counts, float))) * self.idf[at] if len(at) else np.zeros(0)
        length = np.sqrt((weight * weight).sum())
        return at, weight / length if length else weight

    def vote(self, ids: np.ndarray, weights: np.ndarray) -> tuple[float | None, np.ndarray, np.ndarray]:
        """Toxic share of the neighbours' votes, the neighbours' places and cosines; None without neighbours."""
        if not len(ids) or not len(self.index.keys):
            return None, np.zeros(0, int), np.zeros(0)
        places, cosines = self.index.nearest(ids, weights, self.k)
        power = cosines * cosines * self.stands[places]
        total = power.sum()
        return (float((power * self.toxic[places]).sum() / total) if total else None), places, cosines

    def score(self, ids: list[int], counts: list[int]) -> tuple[float, np.ndarray, np.ndarray]:
        vote, places, cosines = self.vote(*self.vector(ids, counts))
        if vote is None:
            return self.unknown, places, cosines
        if self.steps is None:
            return vote, places, cosines
        at = max(0, int(np.searchsorted(self.steps[0], vote, side="right")) - 1)
        # the step itself, and a little of the vote so that votes within a step stay ordered
        return 0.98 * float(self.steps[1][at]) + 0.02 * vote, places, cosines


def toxicity(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    per_class: int = PER_CLASS, features: int = FEATURES, row: str | None = None, evidence: int = EVIDENCE,
) -> DataFrame:
    """key, held_out, score (0 to 1), predicted (score >= THRESHOLD), nearest (array of example key, cosine, toxic, the
    ``evidence`` nearest ones of those that vote).

    Null and empty texts, and texts without any feature, get the toxic rate of such texts in the sample.  Without labels
    of both kinds every score is that of the base rate.  A repeated key in ``labels`` counts once, as toxic if any of
    its rows is; labels other than 0 and 1 and null keys are not learnt from.  Rows with a null key are scored; repeated
    rows too; ``row`` names a column that tells them apart and is returned beside the key.  An empty table gives an empty result.  Only ``text`` decides a score.
    """
    spark, rows = df.sparkSession, _rows(df, key, text, row)
    picked = F.broadcast(sample(labels, key, label, per_class))  # at most 4 * per_class rows
    examples = picked.where("example").select("key", "toxic")
    names = select_features(rows.join(F.broadcast(examples), "key").select("text", "toxic"), features)
    counted = written(feature_counts(rows, names), "features")
    total = counted.count()
    frequency = np.zeros(len(names))
    for r in counted.select(F.explode("ids").alias("id")).groupBy("id").count().collect():  # one row per feature
        frequency[r["id"]] = r["count"]
    fitted = counted.drop("row").join(picked, "key").dropDuplicates(["key"]).collect()  # at most 4 * per_class rows
    model = spark.sparkContext.broadcast(Model(np.log((1 + total) / (1 + frequency)) + 1, fitted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memory = model.value, {}
        nearest = pa.list_(pa.struct([("key", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
        for batch in batches:
            scores, shown = [], []
            for ids, counts in zip(batch.column("ids").to_pylist(), batch.column("counts").to_pylist()):
                query = (tuple(ids), tuple(counts))
                if query not in memory:
                    if len(memory) > 20_000:
                        memory.clear()
                    score, places, cosines = own.score(ids, counts)
                    memory[query] = score, [
                        {"key": int(own.index.keys[p]), "cosine": float(c), "toxic": int(own.toxic[p])}
                        for p, c in list(zip(places, cosines))[:evidence]]
                score, near = memory[query]
                scores.append(score)
                shown.append(near)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(scores, "float64"), pa.array(shown, nearest)], [*carried, "score", "nearest"])

    carried = counted.columns[:-2]
    kinds = ", ".join(f"{name} {kind}" for name, kind in counted.dtypes[:-2])
    scored = counted.mapInArrow(run, f"{kinds}, score double, nearest array<struct<key bigint, cosine double, toxic int>>")
    return scored.select(
        F.col("key").alias(key), *([F.col("row").alias(row)] if row else []), F.coalesce(held_out(F.col("key")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "nearest",
    )
