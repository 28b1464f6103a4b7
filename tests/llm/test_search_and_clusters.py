"""Ranked search, clusters and decontamination against plain versions, also on odd rows."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlight.llm import decontamination, nra, pivot_clusters, queries

ITEMS = [
    (1, "w1 w2 W3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), (2, "one two"), (3, None), (4, "  ..."), (5, "İstanbul ß é"), (5, "w50, w51"),
    (None, "tail x"), (7, "w1 w1 w1 w399"), (8, "a"), (8, "a"),
]
ITEM_SCHEMA = "item_id bigint, text string, `key` string, no string, score string"


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(*i, None, None, None) for i in ITEMS], ITEM_SCHEMA)


def ranked(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("shard, first_read, block_chars", [(8192, 256, 10**6), (3, 1, 10**6), (5, 2, 20)])
def test_search_equals_plain_version(spark, odd, odd_texts, items, monkeypatch, shard, first_read, block_chars):
    extra = odd.where("doc_id < 3").withColumn("doc_id", F.lit(None).cast("bigint"))
    rows = [*odd_texts, *[(None, t) for k, t in odd_texts if k < 3]]
    both = odd.unionByName(extra).unionByName(odd.where("doc_id = 8"))
    rows.append(next((k, t) for k, t in odd_texts if k == 8))
    monkeypatch.setattr(nra, "SHARD_DOCUMENTS", shard)
    monkeypatch.setattr(nra, "FIRST_READ", first_read)
    got = ranked(nra.top_documents(both, items, k=4, block_chars=block_chars))
    assert got == sorted(brute.op11(rows, ITEMS, k=4), key=repr)


def test_shards_stop_reading_early_and_stay_exact():
    rng = np.random.default_rng(3)
    n, lists = 5000, {}
    for t in range(6):
        docs = np.sort(rng.choice(n, 3000, replace=False))
        lists[t] = (docs, rng.zipf(1.5, len(docs)).clip(max=1000).astype("int64"))
    shard = object.__new__(nra.Shard)
    shard.keys = list(range(n))
    shard.lists = {t: (d[np.argsort(-i, kind="stable")], np.sort(i)[::-1]) for t, (d, i) in lists.items()}
    scores = np.zeros(n, "int64")
    for t, (d, i) in lists.items():
        scores[d] += i * (t + 1)
    order = np.lexsort((np.arange(n), -scores))[:10]
    found, got = shard.search({t: t + 1 for t in lists}, 10, 0)
    assert found.tolist() == order.tolist() and got.tolist() == scores[order].tolist()
    assert len(shard.search({0: 1}, 10, 10**9)[0]) == 0


def test_search_of_empty_tables(spark, odd, none, items):
    assert nra.top_documents(none, items).count() == 0
    assert nra.top_documents(odd, items.limit(0)).count() == 0
    assert nra.top_documents(odd, items.where("item_id in (3, 4)")).count() == 0


@pytest.mark.parametrize("block_chars", [10**6, 10])
def test_decontamination_equals_plain_version(spark, odd, odd_texts, items, block_chars):
    found = decontamination.contamination(odd, items, block_chars=block_chars)
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], [tuple(s) for s in r.spans]) for r in found.collect()}
    want = brute.op13(odd_texts, ITEMS)
    assert got == want and any(v[3] for v in want.values())
    assert {r.doc_id for r in found.where("contaminated").select("doc_id").collect()} == {k for k, v in want.items() if v[1]}


def test_decontamination_reads_questions_and_answers_and_keeps_repeats(spark, odd, none, items):
    both = spark.createDataFrame([(1, "nothing here at all", "one two three"), (2, None, None)], "item_id string, question string, answer string")
    found = decontamination.contamination(odd.unionByName(odd), both, texts=("question", "answer"))
    assert found.count() == 2 * odd.count() and found.where("contaminated").count() == 4
    assert decontamination.contamination(none, items).count() == 0
    assert decontamination.contamination(odd, items.limit(0)).where("contaminated").count() == 0


VECTORS = "vec_id bigint, embedding array<double>, x string, pivots string, cluster string, `key` string"


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, None, None, None, None) for k, v in rows], VECTORS).repartition(3)


def within_longs(rows):
    longest = 2**63 - 1
    return sorted([(k, c, min(d, longest), min(a, longest), min(b, longest), x) for k, c, d, a, b, x in rows], key=repr)


def clustered(df, **options):
    found = pivot_clusters.clusters(df, **options).withColumn("centroid", F.concat_ws(",", "centroid"))
    return sorted(map(tuple, found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid").collect()), key=repr)


@pytest.mark.parametrize("spread", [0.1, 1.0, 1e7])
def test_clusters_equal_plain_version(spark, spread):
    rng = np.random.default_rng(int(spread))
    rows = [(i, (rng.normal(size=4) * spread).tolist()) for i in range(300)]
    rows += [(5, rows[5][1]), (None, [0.0] * 4), (700, None), (701, [1.0] * 3), (702, [float("nan")] * 4), (703, [None, 1.0, 1.0, 1.0]), (704, [float("inf")] * 4)]
    options = {"width": 4, "k": 7, "scale": 64}
    assert clustered(vectors(spark, rows), n_pivots=3, **options) == within_longs(brute.op12(rows, **options))


def test_clusters_of_huge_ties_and_few_vectors(spark):
    rows = [(i, [float((-2) ** (i % 40)) * 1e9, 1e12]) for i in range(60)]
    options = {"width": 2, "k": 5, "scale": 64}
    assert clustered(vectors(spark, rows), **options) == within_longs(brute.op12(rows, **options))
    few = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-1.0, 0.5])]
    assert clustered(vectors(spark, few), **options) == brute.op12(few, **options)
    assert clustered(vectors(spark, few[:0]), **options) == []


def test_pivot_bounds_spare_exact_distances():
    rng = np.random.default_rng(0)
    centres = rng.integers(-1000, 1000, (16, 8))
    x = centres[rng.integers(0, 16, 2000)] + rng.integers(-20, 20, (2000, 8))
    pivots = centres[:6]

    def table(rows):
        return np.stack([pivot_clusters.roots(pivot_clusters.squared(rows, p[None, :])) for p in pivots], axis=1)

    best, distance, taken = pivot_clusters.nearest(x, table(x), centres, table(centres))
    every = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert taken < every.size / 3


@pytest.mark.parametrize("name", ["op11_nra_ranked_search", "op13_benchmark_automaton"])
def test_query_reads_whole_tables(spark, small, name):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    rows = queries.REGISTRY[name](spark, small).collect()
    if name.startswith("op11"):
        assert sorted(map(tuple, rows)) == sorted(brute.op11(docs, items))
    else:
        want = brute.op13(docs, items)
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in rows} == {k: (v[0], v[1], len(v[2])) for k, v in want.items()}
