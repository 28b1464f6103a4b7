"""Deduplication, splits, samples, files and leakage checks."""


import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardlight.operators import dataprep, fuzzy
from wardlight.session import scratch_path
from wardlight.sources import tabular

SCHEMA = "row_id bigint, prompt string, label string"


def labelled(spark, n=3000):
    rows = [(i, f"text {i % 2500}", "big" if i % 10 < 9 else f"rare{i % 2}") for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_split_counts_per_label_are_exact(spark):
    df = labelled(spark)
    split = dataprep.stratified_split(df).toPandas()
    assert len(split) == 3000 and split["row_id"].is_unique
    for label, rows in split.groupby("label"):
        assert (rows["split"] == "test").sum() == round(0.2 * len(rows))
    again = dataprep.stratified_split(df.repartition(5)).toPandas()
    assert set(split[split["split"] == "test"]["row_id"]) == set(again[again["split"] == "test"]["row_id"])


def test_tiny_labels_and_extreme_shares(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "y"), (4, "d", None)], SCHEMA)
    assert dataprep.stratified_split(df, 0.2).where("split = 'test'").count() == 0
    assert dataprep.stratified_split(df, 1.0).where("split = 'test'").count() == 4


def test_dedup_keeps_first_and_is_idempotent(spark):
    df = spark.createDataFrame([(3, "a", "x"), (1, "a", "y"), (2, None, "x"), (5, None, "z"), (4, "b", "x")], SCHEMA)
    once = dataprep.dedup_prompts(df)
    assert sorted(map(tuple, once.collect())) == [(1, "a", "y"), (2, None, "x"), (4, "b", "x")]
    assert sorted(map(tuple, dataprep.dedup_prompts(once).collect())) == sorted(map(tuple, once.collect()))


def test_no_overlap_after_dedup_and_split(spark):
    split = dataprep.stratified_split(dataprep.dedup_prompts(labelled(spark)))
    sides = [split.where(F.col("split") == s) for s in ("train", "test")]
    assert dataprep.exact_overlap(*sides).count() == 0


def test_encode_uses_train_map(spark):
    train = spark.createDataFrame([(1, "a", "z"), (2, "b", "y")], SCHEMA)
    test = spark.createDataFrame([(1, "a", "y"), (2, "b", "z"), (3, "c", "w")], SCHEMA)
    got = {r["label"]: r["label_id"] for r in dataprep.label_encode(test, train).collect()}
    assert got == {"z": 0, "y": 1, "w": None}


def test_missing_columns_raise(spark):
    with pytest.raises(ValueError, match="label"):
        dataprep.export_split(spark.createDataFrame([("a", "test")], "text string, split string"))


def test_folder_without_csv_raises(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        tabular.read_csv_folder(spark, str(tmp_path), SCHEMA)


@pytest.mark.parametrize("sep", [",", "\t"])
def test_csv_keeps_awkward_texts(spark, sep):
    texts = ['say "hi"', "two\nlines", " outer blanks ", "a,b\tc", "back\\slash", 'end"', "#x", "é無"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    path = tabular.write_csv(df, scratch_path(spark, "csv"), sep)
    assert [r["prompt"] for r in tabular.read_csv(spark, path, SCHEMA, sep).orderBy("row_id").collect()] == texts


def test_logs_append_and_prune(spark):
    df = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, "2024-01-02 10:00:00")], "id int, ts string")
    path = scratch_path(spark, "log")
    for _ in range(2):
        tabular.append_log(df.withColumn("ts", F.col("ts").cast("timestamp")), path)
    recent = tabular.read_log(spark, path).where("day >= '2024-01-02'")
    assert recent.count() == 2 and "PartitionFilters: [isnotnull(day" in recent._jdf.queryExecution().toString()


def test_training_state(spark, tmp_path):
    (tmp_path / "state.json").write_text(
        '{"log_history": [{"step": 10, "loss": 0.5},\n {"step": 20, "eval_f1": 0.9, "eval_loss": 0.1}]}')
    rows = tabular.read_training_state(spark, str(tmp_path / "state.json")).collect()
    assert [(r["step"], r["eval_f1"]) for r in rows] == [(20, 0.9)]


def test_older_chat_key(spark, tmp_path):
    (tmp_path / "chat.json").write_text('{"user_message": "old"}\n{"prompt": "new"}\n')
    rows = tabular.read_chat_log(spark, str(tmp_path / "chat.json"), "prompt string, user_message string").collect()
    assert sorted(r["prompt"] for r in rows) == ["new", "old"]


def test_near_overlap_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    licence = " ".join(rng.choice(words) for _ in range(25))

    def texts(n):
        out = []
        for i in range(n):
            text = base[rng.randrange(len(base))].split()
            for _ in range(rng.randint(0, 6)):
                text[rng.randrange(len(text))] = rng.choice(words)
            out.append((i, " ".join(text) + (" " + licence if i % 3 else "")))
        return out + [(n, None), (n + 1, ""), (n + 2, "short text"), (n + 3, "Short  TEXT"), (n + 4, licence)]

    base = [" ".join(rng.choice(words) for _ in range(rng.randint(6, 60))) for _ in range(12)]
    test, train = texts(60), texts(90)

    def shingles(text):
        parts = (text or "").lower().split()
        return {tuple(parts[i:i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()

    def similar(a, b):
        return bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)

    expected = {(i, len(shingles(t)), any(similar(shingles(t), shingles(u)) for _, u in train)) for i, t in test}
    frames = [spark.createDataFrame(rows, "row_id bigint, prompt string") for rows in (test, train)]
    assert {tuple(r) for r in fuzzy.near_overlap(*frames).collect()} == expected
    assert len({leaked for _, _, leaked in expected}) == 2


def test_best_match_is_the_most_similar_train_row(spark):
    words = [f"w{i}" for i in range(60)]

    def text(*changed):
        return " ".join("x" + w if i in changed else w for i, w in enumerate(words))

    train = [(7, text(59)), (3, text(58)), (2, text(58)), (5, text(0, 59)), (9, "Some  other"), (8, "some other"), (None, text(30))]
    test = [(1, text()), (2, text(58).upper()), (3, text(0, 58)), (4, "some OTHER"), (5, "lone words"), (6, ""), (None, text(30, 59))]
    frames = [spark.createDataFrame(rows, "row_id bigint, prompt string") for rows in (test, train)]
    got = {r.row_id: (r.n_shingles, r.match, r.similarity) for r in fuzzy.best_matches(*frames).collect()}
    # of 56 shingles, a change of the last word alters 1, of the one before 2, of the first 1, of one in the middle 5
    assert got == {
        1: (56, 7, 55 / 57), 2: (56, 2, 1.0), 3: (56, 2, 55 / 57), 4: (1, 8, 1.0), 5: (1, None, None), 6: (0, None, None),
        None: (56, None, 55 / 57)}


def test_sets_without_a_similar_one_are_not_moved(spark):
    def text(i):
        return " ".join(["one licence line that every prompt ends with"] + [f"w{i}x{j}" for j in range(80)])

    test, train = [(i, text(i)) for i in range(40)], [(i, text(100 + i)) for i in range(60)]
    test.append((99, text(100).replace("w100x79", "other")))
    frames = [spark.createDataFrame(rows, "row_id bigint, prompt string") for rows in (test, train)]
    sets = fuzzy._sides(*frames, "row_id", "prompt")[-1]
    assert sets.count() == 2
    assert {r.row_id for r in fuzzy.near_overlap(*frames).where("leaked").collect()} == {99}


def test_sides_are_joined_once(spark, small):
    from wardlight.plans import queries

    plain, kept = queries.raw_overlap_sides(spark, small), queries.stored_overlap_sides(spark, small)
    for a, b in zip(plain, kept):
        assert a.columns == b.columns and a.exceptAll(b).count() == b.exceptAll(a).count() == 0
        assert "Join" not in b._jdf.queryExecution().executedPlan().toString()


def test_stop_words_by_list_and_by_language(spark):
    from wardlight.operators.ngrams import ngram_counts

    df = spark.createDataFrame([("The bomb and the gun, a C4",), ("",), (None,)], "prompt string")
    expected = {"bomb", "gun", "c4", "bomb gun", "gun c4", "bomb gun c4"}
    for stop in (["the", "and"], "english"):
        assert {r["gram"] for r in ngram_counts(df, 3, stop).collect()} == expected


def test_most_frequent_grams_by_codes_and_by_texts(spark, monkeypatch):
    """The same grams, ties in text order, where codes tell them, where all tie, and where codes collide."""
    from pyspark.sql import functions as F

    from wardlight.operators import ngrams

    texts = [" ".join(f"w{j:03d}" for j in range(60) if i % (j + 1) == 0) for i in range(1, 400)]
    df = spark.createDataFrame([(t, "a" if i % 2 else "b") for i, t in enumerate(texts)], "prompt string, label string")
    sums = [F.count_if(F.col("label") == "a").alias("a")]
    every = ngrams.ngram_counts(df, 2).orderBy(F.desc("n"), "gram").collect()
    assert len(every) > 100
    plain, counted = F.xxhash64, []
    monkeypatch.setattr(ngrams, "top_ngrams", lambda rows, size, top=ngrams.top_ngrams: counted.append(rows) or top(rows, size))
    for size in (5, 20, 60, len(every), len(every) + 5):
        found = ngrams.most_frequent(df, size, 2, sums=sums, keep=("label",)).collect()
        assert sorted((-r["n"], r["gram"]) for r in found) == [(-r["n"], r["gram"]) for r in every[:size]]
        assert all(r["a"] <= r["n"] for r in found)
    counted.clear()
    ngrams.most_frequent(df, 5, 2).collect()
    assert len(counted) == 1 and "left_semi" not in str(counted) and "LeftSemi" in counted[0]._jdf.queryExecution().toString()
    monkeypatch.setattr(ngrams.F, "xxhash64", lambda *c: plain(*c) % 40)
    got = ngrams.most_frequent(df, 9, 2).collect()
    assert sorted((-r["n"], r["gram"]) for r in got) == [(-r["n"], r["gram"]) for r in every[:9]]
