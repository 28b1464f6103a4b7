"""Exact top-k search by inner product with MaxScore over shards.

The terms of a query are its non-zero components.  In a block of vectors every term has a bound on what it can add
above its least possible contribution.  Terms are taken by falling bound; those whose bounds together cannot lift a
vector over the query's k-th best score so far are non-essential.  The essential postings of a block are traversed for
all its vectors, the others are probed term group by term group only while the vector stays competitive.  Every pair of
a shard and a block of queries gives its k best, and these are merged per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlight.llm.common import written

SHARD_ROWS = 4_096
QUERY_ROWS = 4_096
BLOCK_ROWS = 2_048
PROBE = 8  # terms probed at a time
EXACT_FLOAT = 2.0 ** 53
LONG = 2 ** 63 - 1


def quantised(df: DataFrame, key: str, vector: str, scale: int = 256) -> DataFrame:
    """key, x: floor(scale * component) of the vectors that are not null and hold finite numbers only."""
    x = F.transform(df[vector], lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    # floor(double) is a long in Spark and would saturate: take the fraction off instead
    whole = F.transform(x, lambda c: F.when(F.abs(c) * scale < 2.0 ** 52, F.floor(c * scale).cast("double")).otherwise(c * scale))
    return df.where(df[vector].isNotNull() & finite).select(df[key].cast("bigint").alias("key"), whole.alias("x"))


def _matrix(vectors, width: int) -> np.ndarray:
    """Rows of equal width; shorter vectors are filled up with zeros, which add nothing to a product."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class Block:
    """Vectors of a shard with the bounds of every term."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.keys, self.postings = keys, np.ascontiguousarray(rows.T)
        self.low, self.high = rows.min(axis=0), rows.max(axis=0)


class Best:
    """The k best of one query: highest score first, ties to the smaller key."""

    def __init__(self, k: int):
        self.k, self.keys, self.scores = k, np.zeros(0, "int64"), np.zeros(0)

    @property
    def bar(self) -> float:
        return self.scores[-1] if len(self.scores) == self.k else -np.inf

    def add(self, keys: np.ndarray, scores: np.ndarray) -> None:
        keys, scores = np.concatenate([self.keys, keys]), np.concatenate([self.scores, scores])
        order = np.lexsort((keys, -scores))[: self.k]
        self.keys, self.scores = keys[order], scores[order]


def search_block(query: np.ndarray, own: int, block: Block, best: Best) -> None:
    """MaxScore of one query over one block."""
    terms = np.flatnonzero(query)
    up, down = query[terms] * block.high[terms], query[terms] * block.low[terms]
    most, least = np.maximum(up, down), np.minimum(up, down)
    order = np.argsort(-(most - least), kind="stable")
    terms, most, least = terms[order], most[order], least[order]
    rest = np.append(np.cumsum(most[::-1])[::-1], 0.0)  # what terms i.. can add at most
    if rest[0] < best.bar:
        return
    # essential terms: the fewest at the front such that a vector with none of them above its least stays below the bar
    without = np.append(0.0, np.cumsum(least)) + rest
    essential = int(np.searchsorted(-without, -best.bar, side="right"))
    essential = min(max(essential, PROBE), len(terms))
    score = query[terms[:essential]] @ block.postings[terms[:essential]]
    alive = np.flatnonzero((score + rest[essential] >= best.bar) & (block.keys != own))
    score, at = score[alive], essential
    while at < len(terms) and len(alive):
        more = terms[at : at + PROBE]
        score = score + query[more] @ block.postings[np.ix_(more, alive)]
        at += len(more)
        still = score + rest[at] >= best.bar
        alive, score = alive[still], score[still]
    if len(alive) > 4 * best.k:
        cut = np.partition(score, len(score) - best.k)[len(score) - best.k]
        alive, score = alive[score >= cut], score[score >= cut]
    best.add(block.keys[alive], score)


def search_shard(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """query_id, vec_id, score: the k best of the shard for each query."""
    width = max([0, *map(len, queries["x"]), *map(len, vectors["x"])])
    asked, rows = _matrix(queries["x"], width), _matrix(vectors["x"], width)
    largest = np.abs(asked).max(initial=0) * np.abs(rows).max(initial=0) * max(1, width)
    if largest >= EXACT_FLOAT:  # whole numbers of any size
        asked, rows = _integers(asked), _integers(rows)
    keys = vectors["key"].to_numpy("int64")
    blocks = [Block(keys[i : i + BLOCK_ROWS], rows[i : i + BLOCK_ROWS]) for i in range(0, len(keys), BLOCK_ROWS)]
    out: list[tuple[int, int, int]] = []
    for own, query in zip(queries["key"], asked):
        if largest >= EXACT_FLOAT:
            scores = rows @ query
            order = sorted((-s, v) for s, v in zip(scores, keys.tolist()) if v != own)[:k]
            out += [(own, v, max(-LONG, min(LONG, -s))) for s, v in order]
            continue
        best = Best(k)
        for block in blocks:
            search_block(query, own, block, best)
        out += [(own, int(v), int(s)) for v, s in zip(best.keys, best.scores)]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def _integers(rows: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in r] for r in rows], dtype=object).reshape(rows.shape)


def top_k(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose key is divisible by ``every`` its k best others.

    Vectors that are null or hold null or non-finite components take no part, nor do rows with a null key.  Shorter
    vectors count as filled up with zeros.  Ties go to the smaller key.  Rows that repeat a key are searched as often
    as they occur but never found for their own key.  Scores beyond a long are set to its limits.  An empty table
    gives an empty result.
    """
    clean = quantised(df, key, vector).where("key is not null")
    vectors = written(clean.withColumn("no", F.monotonically_increasing_id()), "vectors")
    total = vectors.count()
    shards = max(1, -(-total // SHARD_ROWS))
    query_blocks = max(1, -(-total // every // QUERY_ROWS))
    spread = F.xxhash64("no")
    # every shard meets every block of queries in a group of its own, of at most about SHARD_ROWS + QUERY_ROWS vectors
    data = vectors.withColumn("shard", F.pmod(spread, F.lit(shards))).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = vectors.where(F.col("key") % every == 0).withColumn("part", F.pmod(spread, F.lit(query_blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))))

    def search(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        return search_shard(queries, rows, k)

    found = asked.groupBy("shard", "part").cogroup(data.groupBy("shard", "part")).applyInPandas(
        search, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
