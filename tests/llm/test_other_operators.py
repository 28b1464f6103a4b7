"""Toxicity, search, tool calls, components, the registered queries and the pipeline."""

import json
import re
import zlib
from collections import Counter

import brute
import numpy as np
import parity
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wardlight.llm import maxscore, queries, signature_join, tool_chat, toxicity
from wardlight.llm.components import components
from wardlight.llm.oracle import oracle


@pytest.mark.parametrize("name", sorted(oracle()))
def test_query_equals_sql(spark, small, name):
    assert parity.compare(spark, parity.connect(small), queries.REGISTRY[name], oracle()[name], small) is None


def test_every_operator_has_its_query():
    assert sorted(n.split("_")[0] for n in queries.REGISTRY) == sorted(f"op{i}" for i in range(1, 14))


@pytest.mark.parametrize("name", ["op2", "op3", "op4", "op5", "op10"])
def test_query_equals_plain_version(spark, small, name):
    full = next(n for n in queries.REGISTRY if n.startswith(name + "_"))
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.REGISTRY[full](spark, small).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert got == getattr(brute, name)(rows)


def test_toxicity_holds_out_and_finds_toxic_texts(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.REGISTRY["op1_nearest_toxic_examples"](spark, folder).collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    english = {r[0] for r in spark.read.parquet(f"{folder}/documents.parquet").where("lang = 'en'").select("doc_id").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in labels and r.doc_id in english]
    toxic, clean = [r.score for r in held if labels[r.doc_id]], [r.score for r in held if not labels[r.doc_id]]
    auc = np.mean([(a > b) + (a == b) / 2 for a in toxic for b in clean])
    assert auc > 0.75  # some 25 toxic texts to learn from; see the README for larger tables


def plain_toxicity(texts, picked, names, k):
    """{key: (score, [example keys])} from all cosines: ``texts`` of all rows, ``picked`` (key, toxic, example, weight)."""
    def counts(text):
        words = Counter(re.findall(r"[^\W\d_]+", (text or "").lower()))
        distinct, total = Counter(), Counter()
        for word, n in words.items():
            for stem in {f"w {word}", *(f"{m} {word[:m]}" for m in (4, 5, 6, 7, 8) if len(word) > m)}:
                distinct[stem] += 1
                total[stem] += n
        return {i: total[s] for i, (level, s) in enumerate(n.split(" ", 1) for n in names) if distinct[s] >= int(level)}

    found = {key: counts(t) for key, t in texts}
    df = Counter(i for c in found.values() for i in c)

    def unit(c):
        v = {i: (1 + np.log(n)) * (np.log((1 + len(texts)) / (1 + df[i])) + 1) for i, n in c.items()}
        length = np.sqrt(sum(x * x for x in v.values()))
        return {i: x / length for i, x in v.items()}

    vectors = {key: unit(c) for key, c in found.items()}
    examples = [r for r in picked if r.example and vectors[r.key]]

    def vote(v):
        near = sorted((-round(sum(x * vectors[e.key].get(i, 0.0) for i, x in v.items()), 12), e.key, e) for e in examples)
        near = [n for n in near if n[0] < 0][:k]
        power = sum(n[0] ** 2 * n[2].weight for n in near)
        return (sum(n[0] ** 2 * n[2].weight * n[2].toxic for n in near) / power if near else None), [n[1] for n in near]

    votes = {key: vote(v) for key, v in vectors.items()}
    rows = [r for r in picked if not r.example and votes[r.key][0] is not None]
    x = sorted({votes[r.key][0] for r in rows})
    steps = [[v, sum(r.weight * r.toxic for r in rows if votes[r.key][0] == v), sum(r.weight for r in rows if votes[r.key][0] == v)] for v in x]
    while any(a[1] / a[2] >= b[1] / b[2] for a, b in zip(steps, steps[1:])):
        i = next(i for i, (a, b) in enumerate(zip(steps, steps[1:])) if a[1] / a[2] >= b[1] / b[2])
        steps[i:i + 2] = [[steps[i][0], steps[i][1] + steps[i + 1][1], steps[i][2] + steps[i + 1][2]]]
    base = sum(r.weight * r.toxic for r in picked) / sum(r.weight for r in picked)
    bare = [r for r in picked if not vectors[r.key]]
    unknown = (base + sum(r.weight * r.toxic for r in bare)) / (1 + sum(r.weight for r in bare))

    def score(v):
        if v is None:
            return unknown
        below = [s for s in steps if s[0] <= v] or steps[:1]
        return 0.98 * below[-1][1] / below[-1][2] + 0.02 * v if steps else v

    return {key: (score(v), near) for key, (v, near) in votes.items()}


def test_toxicity_equals_all_cosines(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    picked = toxicity.sample(labels, "doc_id", "toxic", toxicity.PER_CLASS)
    texts = docs.select(F.col("doc_id").alias("key"), "text")
    names = toxicity.select_features(texts.join(picked.where("example"), "key").select("text", "toxic"), toxicity.FEATURES)
    want = plain_toxicity([tuple(r) for r in texts.collect()], picked.collect(), names, toxicity.NEIGHBOURS)
    got = toxicity.toxicity(docs, labels, evidence=toxicity.NEIGHBOURS).collect()
    assert len(names) > 5 and sum(bool(n) for _, n in want.values()) > 20
    for r in got:
        score, near = want[r.doc_id]
        assert r.score == pytest.approx(score, abs=1e-9) and [e.key for e in r.nearest] == near


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(0, 0), (52, 1), (52, 0), (None, 1), (7, None), (8, 5)], "doc_id bigint, toxic int")
    scored = toxicity.toxicity(odd, labels)
    assert scored.count() == odd.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.toxicity(odd, labels.limit(0)).select("score").distinct().count() == 1


def test_search_equals_plain_version(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(150)]
    rows[50] = (50, None)
    rows[3], rows[4] = (3, [float("nan")] * 6), (4, [None, 1.0])
    rows[5], rows[6], rows[100] = (5, [1.0, 2.0]), (6, []), (100, [float("inf")])
    rows[7] = (7, rows[8][1])
    df = spark.createDataFrame([(*r, "extra") for r in rows], "vec_id bigint, embedding array<double>, x string")
    got = sorted(tuple(r) for r in maxscore.top_k(df).collect())
    padded = [(k, v if v is None or any(x is None for x in v) else (list(v) + [0.0] * 6)[:6]) for k, v in rows if v != [float("inf")]]
    assert got == sorted(brute.op9(padded))
    assert maxscore.top_k(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 40), (40, 30), (50, 50), (41, 40)]
    got = {r.v: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 40: 30, 41: 30}


def test_tool_calls(spark):
    schema = {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "array", "items": {"type": "integer"}}}}}
    calls = [
        (1, 0, "b", "f", '{"x": [1, 2.5]}', ["a"]), (1, 0, "a", "f", '{"y": 1, "x": []}', None), (1, 0, "c", "g", "{}", ["b", "zz"]),
        (1, 0, "p", "f", "{", ["q"]), (1, 0, "q", "f", None, ["p"]), (1, 2, "a", "f", '{"x":[1]}', []), (2, 1, None, "f", '{"x":[]}', []),
        (None, 0, "a", None, "NaN", [None]),
    ]
    results = [(1, 1, "a", "first"), (1, 2, "a", "second"), (1, 0, "b", "too early"), (1, 1, "b", None), (9, 1, "a", "lost"), (1, 1, None, "x")]
    messages = [(1, 0, "user", "hi \"é\"\n"), (1, 1, None, None), (None, None, "user", "x")]
    rows = tool_chat.format_chats(
        spark.createDataFrame(messages, "conv_id bigint, turn bigint, role string, text string"),
        spark.createDataFrame(calls, "conv_id bigint, turn bigint, call_id string, tool string, arguments string, needs array<string>"),
        spark.createDataFrame(results, "conv_id bigint, turn bigint, call_id string, content string"), schema).collect()
    assert len(rows) == len(messages) + len(calls) + 3
    for r in rows:
        assert r.json == tool_chat.canonical(json.loads(r.json))
    found = {(r.conv_id, r.turn, r.call_id): r for r in rows if r.kind == "call"}
    assert {k: (r.level, r.status, r.valid, r.unmet) for k, r in found.items()} == {
        (1, 0, "a"): (0, "linked", True, 0), (1, 0, "b"): (1, "linked", False, 0), (1, 0, "c"): (2, "unanswered", False, 1),
        (1, 0, "p"): (None, "unanswered", False, 0), (1, 0, "q"): (None, "unanswered", False, 0),
        (1, 2, "a"): (0, "repeated", True, 0), (2, 1, None): (0, "unanswered", True, None), (None, 0, "a"): (0, "unanswered", False, None),
    }
    assert found[1, 0, "b"].problem == "$.x[1]: not integer" and found[1, 0, "c"].problem == "unknown tool"
    assert found[1, 0, "p"].problem == "$: not JSON" and json.loads(found[1, 0, "p"].json)["arguments"] is None
    assert json.loads(found[1, 0, "a"].json)["result"] == "first"
    assert sorted(r.call_id or "" for r in rows if r.kind == "orphan") == ["", "a", "b"]


def test_pipeline_equals_plain_version(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, small)
    assert kept.columns == docs.columns
    rows = sorted((r.doc_id, r.text) for r in kept.collect())
    scored = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, spark.read.parquet(f"{small}/labels.parquet")).collect()}
    assert [k for k, _ in rows] == sorted(k for k, p in scored.items() if not p)
    copies = brute.op8(rows)
    rows = [r for r in rows if copies[r[0]][2]]
    near = brute.op10(rows)
    rows = [r for r in rows if near[r[0]][1] == r[0]]
    masked = []
    for key, text in rows:
        spans = [tuple(map(int, p.split(":")[1:])) for p in filter(None, brute.op5([(key, text)])[key][4].split(","))]
        merged = []
        for s, e in spans:
            if merged and s < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
            else:
                merged.append((s, e))
        for s, e in reversed(merged):
            text = text[:s] + "[secret]" + text[e:]
        masked.append((key, text))
    got = corpus_pipeline.run(spark, small).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == brute.op6(masked)
    brute.check_packing([(r.length, r.sequence_id, r.offset) for r in got])


def test_pipeline_decides_by_row(spark, small):
    """Null and repeated ids: every stage takes away just the rows it rejects, whatever id they have."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    words = [f"v{i}" for i in range(80)]
    copy, near = " ".join(words), " ".join([*words[:78], "x", "y"])
    scored = toxicity.toxicity(docs, spark.read.parquet(f"{small}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    toxic = next(texts[r.doc_id] for r in scored.collect() if r.predicted)
    added = [(None, toxic), (None, copy), (None, copy), (None, near), (None, "a clean one"), (9_000, toxic), (9_000, "another clean one"),
             (9_000, copy), (9_000, copy), (9_000, near), (9_000, "a third"), (9_001, "a third"), (9_001, "the fourth"),
             (None, "of nobody"), (None, "of nobody")]
    rows = spark.createDataFrame(added, "doc_id bigint, text string")
    others = [F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema if f.name not in rows.columns]
    odd = rows.select("*", *others).select(docs.columns)
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/by_row"
    odd.repartition(2).write.mode("overwrite").parquet(folder)

    def left(kept):
        assert kept.columns == docs.columns
        return sorted((r.doc_id or 0, r.text) for r in kept.collect())

    labels, both = spark.read.parquet(f"{small}/labels.parquet"), docs.unionByName(odd)
    predicted = {r.x: r.predicted for r in toxicity.toxicity(both.withColumn("x", F.col("text")), labels, row="x").collect()}
    assert predicted[toxic] == 1 and predicted["a clean one"] == 0
    assert left(corpus_pipeline.drop_toxic(spark, both, small)) == [x for x in left(both) if not predicted[x[1]]]
    for given in (odd, spark.read.parquet(folder)):  # rows in memory and rows in files
        once = corpus_pipeline.drop_copies(spark, given, small)
        others = [(0, "a clean one"), (0, "of nobody"), (9_000, toxic), (9_000, "a third"), (9_000, "another clean one"), (9_001, "the fourth")]
        assert left(once) == sorted([*others, (9_000, copy), (9_000, near)])
        kept = left(corpus_pipeline.drop_near_copies(spark, given, small))
        assert sorted({*others, (9_000, copy)} ^ set(kept)) in ([], [(9_000, copy), (9_000, near)])
        assert len(kept) == len(others) + 1


def test_pipeline_of_an_empty_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    assert docs.count() == 0


def test_registry_has_the_stages():
    import __spark_entry__

    assert {"pipeline", *queries.REGISTRY} <= set(__spark_entry__.queries())
    assert len(corpus_pipeline.STAGES) == 5


def test_lines_are_canonical_for_all_control_characters(spark):
    text = "".join(map(chr, range(0x80))) + "\u2028\u2029é😀"
    messages = spark.createDataFrame([(1, 0, "user", text), (1, 4, None, None)], "conv_id bigint, turn bigint, role string, text string")
    calls = spark.createDataFrame(
        [(1, 1, "c\x1f", "lookup", json.dumps({"query": text}), []), (1, 2, "d", "x", "{", [])],
        "conv_id bigint, turn bigint, call_id string, tool string, arguments string, needs array<string>")
    results = spark.createDataFrame(
        [(1, 3, "c\x1f", text), (1, 3, "lost\x7f", text), (2, 0, None, None)], "conv_id bigint, turn bigint, call_id string, content string")
    lines = [r["json"] for r in tool_chat.format_chats(messages, calls, results, queries.TOOLS).collect()]
    assert len(lines) == 6 and all(line == tool_chat.canonical(json.loads(line)) for line in lines)


def test_chats_of_empty_tables_with_extra_columns(spark):
    extra = ", level string, json string, kind string, `position` string"
    messages = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string" + extra)
    calls = spark.createDataFrame([], "conv_id bigint, turn bigint, call_id string, tool string, arguments string, needs array<string>" + extra)
    results = spark.createDataFrame([], "conv_id bigint, turn bigint, call_id string, content string" + extra)
    assert tool_chat.format_chats(messages, calls, results, queries.TOOLS).count() == 0
    one = spark.createDataFrame([(1, 0, "user", "x", "a", "b", "c", "d")], messages.schema)
    assert tool_chat.format_chats(one, calls, results, queries.TOOLS).first()["json"] == '{"content":"x","role":"user"}'
