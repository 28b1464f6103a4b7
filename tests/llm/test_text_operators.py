"""Operators over texts against the plain versions, on odd rows, an empty table, repeated rows and null ids."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlight.llm import (
    bpe_fragments, exact_dedup, packing, queries, rans, secrets_ledger, signature_join, token_transducer,
)

WORD, BYTE = queries.tokenizer(queries.WORD_TOKENIZER), queries.tokenizer(queries.BYTE_TOKENIZER)


def by_key(df, *columns, key="doc_id"):
    return {r[key]: tuple(r[c] for c in columns) for r in df.collect()}


def op2(df):
    return rans.round_trip(df, WORD, 2, 49408).withColumn("crc", F.crc32("ids")).withColumn("n", F.length("ids") / 4)


def op3(df):
    return bpe_fragments.encode_decode(df, WORD).select(
        "doc_id", (F.length("ids") / 4).cast("int").alias("n"), F.sha2("ids", 256).alias("i"), F.sha2("decoded", 256).alias("d"))


def test_rans_shards(odd, odd_texts):
    assert by_key(op2(odd), "start", "n", "crc") == brute.op2(odd_texts)


def test_fragments(odd, odd_texts):
    assert by_key(op3(odd), "n", "i", "d") == brute.op3(odd_texts)


def test_transducer(odd, odd_texts):
    counted = token_transducer.token_counts(odd, BYTE).withColumn("over", F.col("n_tokens") > 512)
    assert by_key(counted, "n_bytes", "n_tokens", "over") == brute.op4(odd_texts)


def test_secrets(odd, odd_texts):
    spans = secrets_ledger.spans_text(F.col("_spans"))
    assert by_key(secrets_ledger.scan(odd).withColumn("s", spans), "s") == {k: v[4:] for k, v in brute.op5(odd_texts).items()}


def test_a_repeated_append_changes_nothing(spark, odd, tmp_path):
    path = str(tmp_path / "ledger")
    first = secrets_ledger.scan(odd, ledger=path)
    want = {r.doc_id: r.s for r in first.select("doc_id", secrets_ledger.spans_text(F.col("_spans")).alias("s")).collect()}
    spark.read.parquet(path).write.mode("append").parquet(path + "-copy")
    spark.read.parquet(path + "-copy").write.mode("append").parquet(path)  # what two scans at once would leave
    again = secrets_ledger.scan(odd, ledger=path).select("doc_id", secrets_ledger.spans_text(F.col("_spans")).alias("s")).collect()
    assert len(again) == odd.count() and {r.doc_id: r.s for r in again} == want


def test_columns_of_the_ledgers_names(spark, odd):
    kept = secrets_ledger.scan(odd, blob="own_blob", spans="own_spans")
    assert set(odd.columns) < set(kept.columns) and kept.where("_spans is null").count() == odd.count()
    assert secrets_ledger.scan(odd).schema["_spans"].dataType == kept.schema["own_spans"].dataType


def test_ledger_scans_only_unseen_blobs(spark, odd, odd_texts, tmp_path):
    path = f"file://{tmp_path}/ledger"
    first = odd.where("doc_id < 17")
    secrets_ledger.scan(first, ledger=path).count()
    before = spark.read.parquet(path).count()
    assert before == len({t or "" for k, t in odd_texts if k < 17})
    found = secrets_ledger.scan(odd, ledger=path)
    assert spark.read.parquet(path).count() == len({t or "" for _, t in odd_texts})
    assert by_key(found.withColumn("s", secrets_ledger.spans_text(F.col("_spans"))), "s") == {
        k: v[4:] for k, v in brute.op5(odd_texts).items()}
    secrets_ledger.scan(odd, ledger=path, version="2").count()
    assert spark.read.parquet(path).groupBy("blob", "rules").count().where("count > 1").count() == 0


def test_ledger_knows_rules_by_their_content(spark, odd, tmp_path):
    path = f"file://{tmp_path}/ledger"
    own = [*secrets_ledger.RULES, ("word", "idiot", 0, 5)]
    n = [odd.count(), secrets_ledger.scan(odd, ledger=path).selectExpr("sum(size(_spans))").first()[0]]
    found = [secrets_ledger.scan(odd, ledger=path, rules=rules).selectExpr("count(*)", "sum(size(_spans))").first() for rules in (own, own, secrets_ledger.RULES)]
    assert [list(r) for r in found] == [[n[0], n[1] + 1], [n[0], n[1] + 1], n]
    entries = spark.read.parquet(path)
    assert entries.count() == entries.distinct().count() == 2 * entries.select("blob").distinct().count()


def test_redaction(odd, odd_texts):
    found = secrets_ledger.scan(odd).select("doc_id", secrets_ledger.redacted(F.col("text"), F.col("_spans"), "#").alias("t"))
    got = by_key(found, "t")
    for key, text in odd_texts:
        want = text
        covered = sorted({i for part in filter(None, brute.op5([(key, text)])[key][4].split(","))
                          for i in range(int(part.split(":")[1]), int(part.split(":")[2]))}, reverse=True)
        for i in covered:
            want = want[:i] + ("" if i + 1 in covered else "#") + want[i + 1:]
        # two spans that touch have a mark each
        assert got[key][0] == want or got[key][0].replace("##", "#") == want


def test_packing(odd, odd_texts):
    rows = packing.packed_documents(odd, WORD, 1).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == brute.op6(odd_texts)
    used = brute.check_packing([(r.length, r.sequence_id, r.offset) for r in rows])
    assert used == -(-sum(r.length for r in rows) // 4096)


def test_packing_keeps_rows_that_repeat_or_have_no_length(spark):
    rows = [(1, 3), (1, 3), (1, 3), (2, None), (3, 0), (None, 5), (4, 2)]
    got = packing.pack(spark.createDataFrame(rows, "a int, length int"), capacity=5).collect()
    assert sorted(((r.a, r.length) for r in got), key=str) == sorted(rows, key=str)
    assert {r.sequence_id is None for r in got if not r.length} == {True}
    assert brute.check_packing([(r.length, r.sequence_id, r.offset) for r in got if r.length], 5) == 4
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 9)], "a int, length int"), capacity=5)


def test_sequences(odd):
    pieces = packing.token_pieces(odd, WORD, 1).cache()
    placed = packing.pack(pieces.select("key", "piece", "length"))
    whole = packing.sequences(pieces, placed, ["key", "piece"])
    assert whole.agg(F.sum(F.length("ids"))).first()[0] == 4 * pieces.agg(F.sum("length")).first()[0]
    assert whole.where(F.length("ids") > 4 * 4096).count() == 0


@pytest.mark.parametrize("support", [0.002, 0.2])
def test_dedup(odd, odd_texts, support):
    got = by_key(exact_dedup.exact_dedup(odd, support=support), "keep", "group_size", "kept", "digest")
    assert got == brute.op8(odd_texts)


def test_dedup_of_null_and_repeated_keys(spark):
    rows = [(None, "b"), (None, "b"), (3, "b"), (3, "b"), (None, "only")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r.doc_id), str(r.keep), r.group_size, r.kept) for r in got) == [
        ("3", "3", 4, True), ("3", "3", 4, True), ("None", "3", 4, False), ("None", "3", 4, False), ("None", "None", 1, True)]


def test_signature_join(odd, odd_texts):
    assert by_key(signature_join.near_duplicates(odd), "n_shingles", "component_id") == brute.op10(odd_texts)


def test_signature_join_of_chains_and_shared_passages(spark):
    """Chains longer than one link, a passage in unlike texts, copies, and a bucket of several blocks."""
    rng = np.random.default_rng(5)
    words = [f"a{i}" for i in range(5000)]
    passage = [f"p{i}" for i in range(30)]
    texts = []
    for group in range(6):
        text = rng.choice(words, 60).tolist()
        for step in range(9):
            text = list(text)
            text[(7 * step) % 60] = f"g{group}s{step}"
            texts.append(" ".join(text))
    for i in range(300):
        texts.append(" ".join(passage + [f"u{i}_{j}" for j in range(i % 14)]))
    texts += texts[:20]
    rows = list(enumerate(texts))
    got = by_key(signature_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")), "n_shingles", "component_id")
    assert got == brute.op10(rows)


def test_prefixes_are_found_without_moving_sets(spark, monkeypatch):
    """Against a plain version, with several windows; no shingle of a set is a row of its own."""
    from wardlight.operators import shingle_sets

    monkeypatch.setattr(shingle_sets, "PREFIX_SHINGLES", 300)
    rng = np.random.default_rng(11)
    sets = [np.unique(rng.integers(-2**63, 2**63 - 1, 20))]
    for _ in range(1200):
        kept = sets[rng.integers(len(sets))]
        sets.append(np.unique(np.append(kept[: rng.integers(1, 20)], rng.integers(-2**63, 2**63 - 1, rng.integers(0, 9)))))
    rows = [(v, len(s), s.tolist()) for v, s in enumerate(sets)]
    found = shingle_sets.shared_prefixes(spark.createDataFrame(rows, "v bigint, n int, hashes array<bigint>").repartition(3))
    assert "Generate" not in found._jdf.queryExecution().toString()

    def code(h):  # 64 buckets
        h &= 2**64 - 1
        return (h >> 58) << 32 | h & 0xFFFFFFFF

    held = {}
    for _, _, own in rows:
        for h in own:
            held[code(h)] = held.get(code(h), 0) + 1
    want = {}
    for v, n, own in rows:
        shared = sorted(held[code(h)] << 48 | code(h) for h in own if held[code(h)] > 1)
        spare = len(shared) - -(-75 * n // 100) + 1
        if spare > 0:
            want[v] = (n, shared[:spare])
    assert by_key(found, "n", "prefix", key="v") == want


def test_whole_sets_are_the_wanted_ones(spark, monkeypatch):
    """Each wanted class once and under its own key, also where the bitmaps take many other rows for wanted."""
    from wardlight.operators import shingle_sets

    monkeypatch.setattr(shingle_sets, "FILTER_BITS", (1 << 15, 1 << 15))
    rows = [(i, f"t{i % 9000} a b c d e") for i in range(27_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    read = shingle_sets.read_documents(docs, "doc_id", "text").where("bucket is null").select("key", "class")
    wanted = read.where("key % 2 = 0 and key < 18000 or key = 18001").localCheckpoint()
    got = shingle_sets.whole_sets(docs, "doc_id", "text", wanted)
    keys = sorted(r["key"] for r in got.collect())
    assert len(keys) == len(set(keys)) and got.select("v").distinct().count() == len(keys)
    by_class = {}
    for r in wanted.collect():
        by_class.setdefault(bytes(r["class"]), []).append(r["key"])
    assert {bytes(r["class"]) for r in got.collect()} == set(by_class) and got.count() == len(by_class)
    assert all(r["key"] in by_class[bytes(r["class"])] for r in got.collect())


def test_workers_hold_only_what_the_step_needs(spark):
    """A window holds early shingles, not the sets they were cut from, and the words of an earlier step are given back."""
    from wardlight.llm import common, toxicity
    from wardlight.operators.shingle_sets import Window

    window = Window(6)
    window.add(1, np.arange(1000)[:10])
    assert window.hashes[0].base is None and window.size == 10

    def words_after(batches):
        common.ENCODERS["earlier"] = object()
        yield from (b.slice(0, 0) for b in step(batches))
        import pyarrow as pa
        yield pa.RecordBatch.from_arrays([pa.array([len(common.ENCODERS)], "int64")], ["n"])

    class Rows:  # takes the place of a table, to run its task here
        columns, dtypes, sparkSession = ["key", "text"], [("key", "bigint"), ("text", "string")], spark

        def mapInArrow(self, run, schema):
            return run

    step = toxicity.feature_counts(Rows(), ["1 w a"])
    assert [b.column(0).to_pylist() for b in words_after(iter([]))] == [[0]]


def test_tree_links_are_complete():
    """Dual traversal against all pairs, within one tree and between two, without any pruning by components at first."""
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(12):
        base = np.unique(rng.integers(-2**62, 2**62, rng.integers(20, 90)))
        for _ in range(6):
            keep = rng.random(len(base)) > 0.12
            sets.append(np.unique(np.concatenate([base[keep], rng.integers(-2**62, 2**62, 3)])))

    def parts(links):
        label = list(range(len(sets)))
        for a, b in links:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
        return label

    def linked(a, b):
        common = len(np.intersect1d(sets[a], sets[b]))
        return 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common)

    n = len(sets)
    every = [(a, b) for a in range(n) for b in range(a) if linked(a, b)]
    got = signature_join.tree_links(list(range(n)), sets, list(range(n)), [0] * n)
    assert parts(got) == parts(every) and all(linked(*p) for p in got)
    sides = [i % 2 for i in range(n)]
    across = [(a, b) for a, b in every if sides[a] != sides[b]]
    assert parts(signature_join.tree_links(list(range(n)), sets, list(range(n)), sides)) == parts(across)


OPERATORS = {
    "rans": op2, "fragments": op3, "counts": lambda df: token_transducer.token_counts(df, BYTE),
    "secrets": secrets_ledger.scan, "packing": lambda df: packing.packed_documents(df, WORD, 1),
    "dedup": exact_dedup.exact_dedup, "join": signature_join.near_duplicates,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(none, name):
    assert OPERATORS[name](none).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_null_ids_and_repeated_rows_stay(spark, name):
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (7, "a b c d e f g"), (7, "a b c d e f g"), (None, None)]
    got = OPERATORS[name](spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["7", "7", "None", "None", "None"]
