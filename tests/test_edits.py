"""The edit-distance join against all pairs, on texts that were really edited."""

import random

import pytest
from pyspark.sql import functions as F

from wardlight.operators import edits

SCHEMA = "row_id bigint, prompt string, text string, no string, key string, digest string"


def distance(a, b, most):
    """Edits from a to b, or more than ``most``."""
    far, row = most + 1, {j: j for j in range(min(most, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            new[j] = min(row.get(j, far) + 1, new.get(j - 1, far) + 1, row.get(j - 1, far) + (j == 0 or x != b[j - 1]))
        row = new
    return row.get(len(b), far)


def edited(rng, text, times):
    out = list(text)
    for _ in range(times):
        at, kind = rng.randrange(len(out) + 1), rng.randrange(3)
        if kind == 0:
            out.insert(at, rng.choice("abcdé "))
        elif out:
            at = min(at, len(out) - 1)
            out[at:at + 1] = [] if kind == 1 else [rng.choice("xyzü")]
    return "".join(out)


def texts(seed=4):
    """(test, train): random texts of many lengths, their edited copies, a common beginning, ties, null and empty."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(n)) for n in (1, 2, 5, 9, 10, 11, 19, 20, 33, 59, 60, 63, 64, 65, 70, 130, 200, 400)]
    common = "".join(rng.choice("abcdefgh") for _ in range(300))
    train = [*base, None, "", *[common + "".join(rng.choice("abcdefgh") for _ in range(200)) for _ in range(6)]]
    test = [edited(rng, t, k) for t in train if t for k in (0, 1, 2, 4, 6, 7, 12)] + [None, "", base[7], base[7]]
    return list(enumerate(test)), [(1000 + i, t) for i, t in enumerate([*train, base[7], base[16][:-1]])]


def plain(test, train, most, share, encode):
    out = {}
    for key, a in test:
        near = []
        for other, b in train:
            if a and b:
                limit = min(most, int(max(len(encode(a)), len(encode(b))) * share + 1e-9))
                if abs(len(encode(a)) - len(encode(b))) <= limit and (d := distance(encode(a), encode(b), limit)) <= limit:
                    near.append((d, other))
        out[key] = min(near) if near else None
    return out


@pytest.mark.parametrize("unit, most, share", [("character", 6, 0.1), ("byte", 6, 0.1), ("character", 2, 0.3)])
def test_matches_equal_all_pairs(spark, unit, most, share):
    test, train = texts()
    frames = [spark.createDataFrame([(*r, None, None, None, None) for r in rows], SCHEMA).repartition(3) for rows in (test, train)]
    want = plain(test, train, most, share, (lambda s: s) if unit == "character" else str.encode)
    options = {"edits": most, "share": share, "unit": unit}
    got = {r.row_id: r for r in edits.edit_matches(*frames, **options).collect()}
    assert {k: None if r["match"] is None else (r.distance, r["match"]) for k, r in got.items()} == want
    assert sum(v is not None and v[0] > 0 for v in want.values()) > 20
    leaked = edits.edit_overlap(*frames, **options).collect()
    assert {r.row_id: r.leaked for r in leaked} == {k: v is not None for k, v in want.items()}


def test_empty_tables(spark):
    test, train = (spark.createDataFrame([(*r, None, None, None, None) for r in rows], SCHEMA) for rows in texts())
    assert edits.edit_overlap(test.limit(0), train).count() == 0
    assert edits.edit_matches(test, train.limit(0)).where("match is not null").count() == 0


def test_a_common_beginning_finds_nobody(spark):
    """Each train text is found by its rarest segments, so texts that only begin alike are no candidates."""
    rng = random.Random(1)
    start = "abcdefgh" * 60
    rows = [(i, start + "".join(rng.choice("abcdefgh") for _ in range(600)), None, None, None, None) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    sides = edits.Sides(df.where("row_id < 20"), df.where("row_id >= 20"), "row_id", "prompt", 6, 0.1, "character")
    asked, indexed = sides.links()
    assert indexed.count() == 20 * 7 and asked.join(indexed, "h").count() == 0


def test_length_classes(spark):
    low = {r.id: r.low for r in spark.range(1, 5000).select("id", edits.length_class(F.col("id").cast("int")).alias("low")).collect()}
    assert all(low[n] == n for n in range(1, 64)) and low[64] == 64 and low[71] == 64 and low[72] == 72 and low[127] == 120 and low[129] == 128
    assert all(low[n] <= n < low[n] + low[n] // 8 + 1 and low[n] >= low[max(1, n - 1)] for n in low)


def test_asked_places_hold_every_moved_segment(spark):
    """Of characters and of bytes; a text asks for its own segments, and a moved copy for enough of them."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdé€") for _ in range(n)) for n in (1, 13, 14, 63, 64, 71, 72, 500)]
    rows = spark.createDataFrame([(t, "xy" + t[:-1]) for t in texts], "text string, moved string")
    for unit in ("character", "byte"):
        cut = [F.encode(c, "ISO-8859-1") if unit == "byte" else c for c in (edits.as_units(F.col(n), unit) for n in rows.columns)]
        n = [F.length(edits.as_units(F.col(c), unit)) for c in rows.columns]
        own, asked, moved = (f(*a, 6, 0.1) for f, a in (
            (edits.own_segments, (cut[0], n[0])), (edits.asked_segments, (cut[0], n[0])), (edits.asked_segments, (cut[1], n[1]))))
        found = rows.select(F.size(F.array_except(own, asked)).alias("lost"), F.size(F.array_distinct(own)).alias("all"), F.size(
            F.array_intersect(own, moved)).alias("kept"), n[0].alias("n")).collect()
        assert all(r.lost == 0 for r in found)
        assert all(2 * r.kept >= r["all"] for r in found if r.n >= 40)
