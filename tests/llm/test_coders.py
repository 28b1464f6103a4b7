"""The coders below the operators: rANS frames, merges, the transducer, the sum index, the block-max index."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from wardlight.llm import bpe_fragments, common, maxscore, packing, queries, rans, token_transducer, toxicity

WORD, BYTE = queries.tokenizer(queries.WORD_TOKENIZER), queries.tokenizer(queries.BYTE_TOKENIZER)
LETTERS = "aeiouthnsrvlmd'''!.,?0123 \n\t   　éßñ你😀́\x1f<|>KſİΣ"
MACHINE, CODEC, ENCODER = token_transducer.Transducer(BYTE), bpe_fragments.FragmentCodec(WORD), common.WordEncoder(WORD, limit=60)
WORD_LIBRARY, BYTE_LIBRARY = brute.word_tokenizer(), brute.word_tokenizer(queries.BYTE_TOKENIZER)


@given(st.lists(st.text(alphabet=LETTERS, max_size=60), max_size=8))
@settings(max_examples=150, deadline=None)
def test_tokenizers_agree_with_the_library(texts):
    assert MACHINE.count_all(texts).tolist() == [len(BYTE_LIBRARY.encode(t, add_special_tokens=False).ids) for t in texts]
    for t in texts:
        want = WORD_LIBRARY.encode(t, add_special_tokens=False).ids
        assert CODEC.encode(t) == brute.u32(want) == ENCODER.ids(t)
        assert CODEC.decode(CODEC.encode(t)) == WORD_LIBRARY.decode(want, skip_special_tokens=False)


def test_chunk_maps_of_texts_without_certain_cuts():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcxyz'é你!") for _ in range(4000)) for _ in range(5)] + ["你好" * 1500, "'r" * 1500, " " * 3000]
    assert MACHINE.count_all(texts).tolist() == [len(BYTE_LIBRARY.encode(t, add_special_tokens=False).ids) for t in texts]


def test_the_table_of_states_may_be_emptied(monkeypatch):
    monkeypatch.setattr(token_transducer, "MOST_STATES", 10)
    machine = token_transducer.Transducer(BYTE)
    texts = ["some words", "other words here", "don't stop"]
    for _ in range(3):
        assert machine.count_all(texts).tolist() == [len(BYTE_LIBRARY.encode(t).ids) for t in texts]


def test_long_and_short_merges_agree(monkeypatch):
    rng = random.Random(4)
    pieces = [[*"".join(rng.choice("abcdeinsth") for _ in range(rng.randint(1, 60)))] for _ in range(200)]
    short = [bpe_fragments.merge(p, CODEC.ranks) for p in pieces]
    assert short == [bpe_fragments._merge_long(p, CODEC.ranks) for p in pieces]


def test_cuts_fall_where_no_token_reaches():
    for piece in ("a你b", "hello", "é!é"):
        fragments = CODEC.cut(piece)
        for left, right in zip(fragments, fragments[1:]):
            assert not any(left[-1] + right[0].removesuffix("</w>") in t for t in CODEC.vocabulary)


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 4095, 4096, 4097, 70_000])
def test_frames(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 49407).astype("<u2")
    counts = np.bincount(ids, minlength=49408)
    coder = rans.Coder(rans.scaled(counts))
    data = rans.pack_frame(ids, coder)
    assert (rans.unpack_frame(data, coder) == ids).all()
    if n:
        damaged = bytearray(data)
        damaged[-1] ^= 1
        with pytest.raises(ValueError):
            rans.unpack_frame(bytes(damaged), coder)


def test_scaled_frequencies():
    table = rans.scaled(np.array([0, 1, 10**12, 5]))
    assert table.sum() == 1 << rans.SCALE_BITS and table[0] == 0 and (table[1:] > 0).all()
    assert rans.scaled(np.zeros(4, int)).sum() == 0


@given(st.lists(st.integers(1, 40), max_size=60))
@settings(max_examples=150, deadline=None)
def test_plans(lengths):
    counts = np.bincount(lengths, minlength=41) if lengths else np.zeros(41, int)
    patterns = packing.plan(counts)
    used = np.zeros(41, int)
    for pattern, times in patterns:
        assert sum(pattern) <= 40
        for x in pattern:
            used[x] += times
    assert (used == counts).all()
    best_fit = []  # best-fit decreasing is no better by more than one sequence
    for x in sorted(lengths, reverse=True):
        room = [i for i, left in enumerate(best_fit) if left >= x]
        if room:
            best_fit[min(room, key=lambda i: best_fit[i])] -= x
        else:
            best_fit.append(40 - x)
    assert sum(n for _, n in patterns) <= len(best_fit) + 1


@given(st.lists(st.integers(1, 12), min_size=1, max_size=14), st.integers(1, 30))
@settings(max_examples=200, deadline=None)
def test_sum_index_finds_any_exact_combination(lengths, gap):
    index = packing.SumIndex(np.bincount(lengths, minlength=31))
    from itertools import combinations

    there = any(sum(c) == gap for r in (1, 2, 3) for c in combinations(lengths, r))
    found = index.exact(gap)
    assert (found is not None) == there
    if found:
        assert sum(found) == gap and all(lengths.count(x) >= found.count(x) for x in found)


def test_block_max_index_is_exact():
    rng = np.random.default_rng(1)
    vectors = rng.random((300, 40)) * (rng.random((300, 40)) < 0.1)
    vectors /= np.maximum(1e-9, np.linalg.norm(vectors, axis=1, keepdims=True))
    keys = rng.permutation(300)
    index = toxicity.BlockMaxIndex(keys, vectors)
    for _ in range(50):
        ids = np.sort(rng.choice(40, 5, replace=False))
        weights = rng.random(5)
        cosines = np.round(vectors[:, ids] @ weights, 12)
        want = sorted(((-c, k) for c, k in zip(cosines, keys) if c > 0))[:7]
        places, found = index.nearest(ids, weights, 7)
        assert [index.keys[p] for p in places] == [k for _, k in want]
        assert np.allclose(found, [-c for c, _ in want])


def test_isotonic_steps():
    x, y = toxicity.monotone(np.array([0.1, 0.2, 0.2, 0.5, 0.9]), np.array([0, 1, 0, 0, 1.0]), np.ones(5))
    assert (np.diff(y) >= 0).all() and y[0] == 0 and y[-1] == 1


@pytest.mark.parametrize("spread", [3, 400, 2**40])
def test_maxscore_shard(spread):
    import pandas as pd

    rng = np.random.default_rng(spread % 97)
    rows = [rng.integers(-spread, spread, 12).astype(float).tolist() for _ in range(5000)]
    rows[7] = rows[8]
    vectors = pd.DataFrame({"key": range(5000), "x": rows})
    queries_ = vectors[vectors["key"] % 1000 == 0]
    got = maxscore.search_shard(queries_, vectors, 5)
    for q in queries_["key"]:
        scores = sorted((-sum(int(a) * int(b) for a, b in zip(rows[q], r)), v) for v, r in enumerate(rows) if v != q)[:5]
        mine = got[got["query_id"] == q]
        limit = maxscore.LONG
        assert list(zip(mine["score"], mine["vec_id"])) == [(max(-limit, min(limit, -s)), v) for s, v in scores]


def test_chunks_of_a_long_line_run_together(monkeypatch):
    """No cut of such a text is certain, and yet the number of runs does not grow with the number of chunks."""
    rng = np.random.default_rng(5)
    line = "".join(rng.choice(list("abcdefghij"), 300_000))
    machine = token_transducer.Transducer(BYTE)
    calls = []
    run = machine.run
    monkeypatch.setattr(machine, "run", lambda *a: calls.append(len(a[1])) or run(*a))
    assert machine.count_all([line])[0] == len(brute.word_tokenizer("byte_bpe_50k.json").encode(line).ids)
    assert calls[0] > 500 and len(calls) <= 8
