"""Clustering of integer vectors around centroids, with a LAESA table of distances to fixed pivots.

1. Vectors become whole numbers.  The first centroids are the vectors with the least hashes of their keys; some of
   them serve as pivots, which never change.
2. The distance of every vector to every pivot is stored once.
3. In a round the distances of the centroids to the pivots are known.  For each pivot the difference of the two
   distances is a lower bound on the distance of a vector to a centroid.  A vector is first held against the centroid
   with the least bound; centroids whose bound is above that distance fall away, the others get exact integer distances.
4. Every task adds up the vectors of its clusters; sums are split into parts of 32 bits, which Spark adds without
   overflow, and centroids move to the exact floor of the mean.

What a round brings to the driver is a few numbers for each centroid and component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import written

PIVOTS = 8
ROWS = 4_096  # vectors compared at a time
NARROW = 2 ** 26  # below it, products of two components and their sums over 2 ** 9 components fit 64 bits
SLACK = 1e-6  # relative, more than square roots and differences of them lose
PART_BITS = 32
LONG = 2 ** 63 - 1


def whole_vectors(df: DataFrame, key: str, vector: str, scale: int, width: int) -> DataFrame:
    """key, x: floor(scale * component) as doubles that are whole numbers, of vectors of ``width`` finite components."""
    x = F.transform(df[vector], lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) != float("inf")))
    # beyond 2 ** 52 a double is whole already, and floor() would give a long
    floor = F.transform(x, lambda c: F.when(F.abs(c * scale) < 2.0 ** 52, F.floor(c * scale).cast("double")).otherwise(c * scale))
    return df.where(df[vector].isNotNull() & (F.size(df[vector]) == width) & finite).select(df[key].alias("key"), floor.alias("x"))


def matrix(x: np.ndarray) -> np.ndarray:
    """Whole doubles as integers: 64 bits where all arithmetic fits, Python's where it does not."""
    if np.abs(x).max(initial=0) < NARROW:
        return x.astype("int64")
    return np.array([[int(c) for c in row] for row in x], dtype=object).reshape(x.shape)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``a`` to the same rows of ``b``."""
    if a.dtype != object and b.dtype == object:
        a = a.astype(object)
    d = a - b
    return (d * d).sum(axis=-1)


def roots(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype("float64"))


def nearest(x: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, centroid_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and exact squared distance of every row of ``x``, ties to the smaller number; and the number of exact
    distances taken.  ``to_pivots`` and ``centroid_pivots`` are distances to the pivots."""
    bound = np.zeros((len(x), len(centroids)))
    for p in range(to_pivots.shape[1]):
        own, other = to_pivots[:, p, None], centroid_pivots[None, :, p]
        np.maximum(bound, np.abs(own - other) - SLACK * (own + other), out=bound)
    best = bound.argmin(axis=1)
    distance = squared(x, centroids[best])
    limit = roots(distance) * (1 + SLACK)
    open_ = bound <= limit[:, None]
    open_[np.arange(len(x)), best] = False
    taken = len(x)
    for c in range(len(centroids)):
        rows = np.flatnonzero(open_[:, c] & (bound[:, c] <= limit))
        if not len(rows):
            continue
        d = squared(x[rows], centroids[c][None, :])
        taken += len(rows)
        closer = (d < distance[rows]) | ((d == distance[rows]) & (c < best[rows]))
        rows, d = rows[closer], d[closer]
        best[rows], distance[rows] = c, d
        limit[rows] = roots(d) * (1 + SLACK)
    return best, distance, taken


def vectors_of(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(keys, x, distances to pivots) of a batch (key, x, pivots), some rows at a time."""
    for start in range(0, batch.num_rows, ROWS):
        part = batch.slice(start, ROWS)
        x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        pivots = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
        yield part.column(0), matrix(x), pivots


def with_pivots(rows: DataFrame, pivots: list[list[int]], width: int) -> DataFrame:
    """key, x and the distances to all pivots."""
    kind = rows.schema["key"].dataType.simpleString()
    fixed = matrix(np.array(pivots, "float64").reshape(-1, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                x = matrix(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
                table = np.stack([roots(squared(x, p[None, :])) for p in fixed], axis=1)
                offsets = pa.array(np.arange(0, table.size + 1, table.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(table.ravel()))], ["key", "x", "pivots"])

    return rows.mapInArrow(run, f"key {kind}, x array<double>, pivots array<double>")


def parts(value: int) -> Iterator[tuple[int, int]]:
    """(place, part): the parts of 32 bits of a whole number, with its sign on each."""
    sign, rest, place = (-1 if value < 0 else 1), abs(int(value)), 0
    while rest:
        yield place, sign * (rest & (2 ** PART_BITS - 1))
        rest >>= PART_BITS
        place += 1


def cluster_sums(table: DataFrame, centroids: list[list[int]], to_pivots: list[list[float]], width: int, move: bool) -> dict[tuple[int, int], int]:
    """(cluster, what) -> exact sum: what is a component, -1 the number of vectors, -2 their squared distances."""
    shared = table.sparkSession.sparkContext.broadcast((centroids, to_pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, distances = shared.value
        centres, distances = _integers(centres, width), np.array(distances)
        sums: dict[tuple[int, int], int] = {}
        for batch in batches:
            for _, x, pivots in vectors_of(batch, width):
                best, distance, _ = nearest(x, pivots, centres, distances)
                for c in np.unique(best).tolist():
                    mine = best == c
                    sums[c, -1] = sums.get((c, -1), 0) + int(mine.sum())
                    if not move:
                        sums[c, -2] = sums.get((c, -2), 0) + sum(int(d) for d in distance[mine])
                        continue
                    for i, s in enumerate(x[mine].sum(axis=0)):
                        sums[c, i] = sums.get((c, i), 0) + int(s)
        rows = [(c, what, place, part) for (c, what), s in sums.items() for place, part in parts(s)]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(col), t) for col, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                ["cluster", "what", "place", "part"])

    added = table.select("key", "x", "pivots").mapInArrow(run, "cluster int, what int, place int, part bigint").groupBy(
        "cluster", "what", "place").agg(F.sum("part").alias("part"))
    out: dict[tuple[int, int], int] = {}
    for r in added.collect():  # a few rows for each centroid and component
        out[r["cluster"], r["what"]] = out.get((r["cluster"], r["what"]), 0) + (r["part"] << (PART_BITS * r["place"]))
    return out


def _integers(rows: list[list[int]], width: int) -> np.ndarray:
    narrow = all(abs(c) < NARROW for row in rows for c in row)
    return np.array(rows, dtype="int64" if narrow else object).reshape(-1, width)


def pivot_distances(centroids: list[list[int]], pivots: list[list[int]]) -> list[list[float]]:
    return [[float(np.sqrt(float(sum((a - b) ** 2 for a, b in zip(c, p))))) for p in pivots] for c in centroids]


def clusters(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 64, width: int = 64, k: int = 16,
    rounds: int = 3, salt: str = "1:", n_pivots: int = PIVOTS,
) -> DataFrame:
    """key, cluster, distance (squared), cluster_inertia, inertia and centroid (components) of every kept vector.

    Kept are vectors of exactly ``width`` components that are neither null nor non-finite, also after scaling; the others
    have no row.  The first centroids are the ``k`` kept rows with the least SHA-256 of ``salt`` and key, rows that
    repeat a key in the order of their components, null keys last; with fewer rows there are fewer clusters.  Ties go to
    the smaller cluster; an empty cluster keeps its centroid.  Repeated rows are kept.  All arithmetic is exact;
    distances and sums beyond a long are set to its limit.  An empty table gives an empty result.  Other columns are not
    read.
    """
    spark = df.sparkSession
    rows = whole_vectors(df, key, vector, scale, width)
    digest = F.sha2(F.concat(F.lit(salt), F.col("key").cast("string")).cast("binary"), 256)
    first = rows.orderBy(F.asc_nulls_last(digest), "x").limit(k).collect()  # k vectors
    kind = rows.schema["key"].dataType.simpleString()
    if not first:
        empty = "cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid array<string>"
        return spark.createDataFrame([], f"key {kind}, {empty}").withColumnRenamed("key", key)
    centroids = [[int(c) for c in r["x"]] for r in first]
    pivots = centroids[:n_pivots]
    table = written(with_pivots(rows, pivots, width), "pivot_table")
    for _ in range(rounds):
        sums = cluster_sums(table, centroids, pivot_distances(centroids, pivots), width, move=True)
        for c in range(len(centroids)):
            if n := sums.get((c, -1), 0):
                centroids[c] = [sums.get((c, i), 0) // n for i in range(width)]
    distances = pivot_distances(centroids, pivots)
    sums = cluster_sums(table, centroids, distances, width, move=False)
    own = [min(LONG, sums.get((c, -2), 0)) for c in range(len(centroids))]
    total = min(LONG, sum(sums.get((c, -2), 0) for c in range(len(centroids))))
    shared = spark.sparkContext.broadcast((centroids, distances))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, to_pivots = shared.value
        centres, to_pivots = _integers(centres, width), np.array(to_pivots)
        for batch in batches:
            for keys, x, near in vectors_of(batch, width):
                best, distance, _ = nearest(x, near, centres, to_pivots)
                clipped = [min(LONG, int(d)) for d in distance]
                yield pa.RecordBatch.from_arrays([keys, pa.array(best, pa.int32()), pa.array(clipped, pa.int64())], ["key", "cluster", "distance"])

    names = spark.createDataFrame(
        [(c, own[c], total, [str(x) for x in centroids[c]]) for c in range(len(centroids))],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid array<string>")
    assigned = table.select("key", "x", "pivots").mapInArrow(run, f"key {kind}, cluster int, distance bigint")
    return assigned.join(F.broadcast(names), "cluster").select(
        "key", "cluster", "distance", "cluster_inertia", "inertia", "centroid").withColumnRenamed("key", key)
