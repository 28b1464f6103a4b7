"""Byte-pair encoding and decoding by forced-boundary splitting.

A merge can only reach over a place between two bytes if some vocabulary token holds these two bytes side by side.  A
byte pair that no token holds is therefore a certain cut: the fragments on both sides are encoded independently and
their ids concatenated.  Fragments are short and recur, so each distinct one is merged once and remembered.

The library is asked for the normalised text and for nothing else; pieces, cuts, merges and decoding are done here.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from wardlight.llm.common import spaced, text_of

REMEMBERED = 400_000  # words, and half as many other fragments, that one Python worker keeps


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others for the characters from U+0100 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + others.index(b)) for b in range(256)]


ALPHABET = byte_alphabet()


NEVER = 1 << 60
SHORT = 64  # units up to which a list scan beats a heap


def merge(units: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merge the best-ranked neighbours, the leftmost of equals first, until no merge applies."""
    if len(units) > SHORT:
        return _merge_long(units, ranks)
    units = list(units)
    scores = [ranks.get(p, NEVER) for p in zip(units, units[1:])]
    while scores and (best := min(scores)) != NEVER:
        i = scores.index(best)
        units[i:i + 2] = [units[i] + units[i + 1]]
        del scores[i]
        if i:
            scores[i - 1] = ranks.get((units[i - 1], units[i]), NEVER)
        if i < len(scores):
            scores[i] = ranks.get((units[i], units[i + 1]), NEVER)
    return units


def _merge_long(units: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The same with a heap of (rank, place) and links between the units left, in n log n."""
    token: list[str | None] = list(units)
    after, before = list(range(1, len(units) + 1)), list(range(-1, len(units) - 1))
    heap = [(r, i) for i, p in enumerate(zip(units, units[1:])) if (r := ranks.get(p)) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if token[i] is None or j >= len(token) or ranks.get((token[i], token[j])) != rank:
            continue  # one of the two has been merged since
        token[i], token[j], after[i] = token[i] + token[j], None, after[j]
        if after[i] < len(token):
            before[after[i]] = i
        for left in (before[i], i):
            right = after[left] if left >= 0 else len(token)
            if right < len(token) and (r := ranks.get((token[left], token[right]))) is not None:
                heapq.heappush(heap, (r, left))
    return [t for t in token if t is not None]


class FragmentCodec:
    """Encoder and decoder of one ``tokenizers`` file: BPE over bytes with a mark at word ends."""

    def __init__(self, path: str, limit: int = REMEMBERED):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.normalise = Tokenizer.from_file(path).normalizer.normalize_str
        model, splitter = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.suffix: str = model["end_of_word_suffix"]
        self.pieces = regex.compile(splitter["pattern"]["Regex"], regex.V0)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)))
        self.tokens = {i: t for t, i in self.vocabulary.items()} | {i: t for t, i in self.added.items()}
        self.names = [self.tokens.get(i) for i in range(max(self.tokens) + 1)]
        self.packed = {t: i.to_bytes(4, "little") for t, i in self.vocabulary.items()}
        self.inside = self._inner_pairs()
        self.limit = limit
        self.fragments: dict[tuple[str, ...], bytes] = {}
        self.words: dict[bytes, bytes] = {}

    def _inner_pairs(self) -> set[tuple[str, str]]:
        """All pairs of neighbouring byte characters inside any token."""
        pairs: set[tuple[str, str]] = set()
        for token in self.vocabulary:
            body = token.removesuffix(self.suffix)
            pairs.update(zip(body, body[1:]))
        return pairs

    def cut(self, piece: str) -> list[list[str]]:
        """A piece in byte characters, cut where no token can reach over; the last unit carries the word-end mark."""
        units = [ALPHABET[b] for b in piece.encode("utf-8")]
        fragments, start = [], 0
        for i in range(1, len(units)):
            if (units[i - 1], units[i]) not in self.inside:
                fragments.append(units[start:i])
                start = i
        fragments.append(units[start:])
        fragments[-1][-1] += self.suffix
        return fragments

    def _fragment(self, units: list[str]) -> bytes:
        key = tuple(units)
        if key not in self.fragments:
            if len(self.fragments) >= self.limit // 2:
                self.fragments.clear()
            self.fragments[key] = self._merged(units)
        return self.fragments[key]

    def _merged(self, units: list[str]) -> bytes:
        return b"".join([self.packed[t] for t in merge(units, self.ranks)])

    def _word(self, word: bytes) -> bytes:
        text = word.decode() if word.isalpha() else self.normalise(word.decode())  # of bytes: a-z only
        fragments = [f for m in self.pieces.finditer(text) for f in self.cut(m.group())]
        if len(fragments) == 1:  # remembered as a word
            return self._merged(fragments[0])
        return b"".join([self._fragment(f) for f in fragments])

    def _plain(self, text: str) -> bytes:
        """Ids of text without special strings.  Neither normaliser nor pieces reach over ASCII white space, nor from
        an ASCII letter to ASCII punctuation other than an apostrophe."""
        words, known = spaced(text.encode("utf-8", "replace").lower()).split(), self.words
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            fresh = {w for w in words if w not in known}
            if len(known) + len(fresh) > self.limit:
                known.clear()
                fresh = set(words)
            for word in fresh:
                known[word] = self._word(word)
            return b"".join([known[w] for w in words])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; special strings in the text become their ids."""
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [self._plain(text[at:m.start()]), self.added[m.group()].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """The tokens joined by blanks, as the library does for a file that names no decoder."""
        names = self.names
        return " ".join([names[i] for i in np.frombuffer(ids, "<u4").tolist()])


def encode_decode(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (little-endian unsigned 32-bit), decoded: every whole text encoded and decoded again.

    Null texts count as empty, and an empty text has no ids and decodes to the empty text.  Rows are kept one by one,
    so repeated rows and null keys pass through; an empty table gives an empty result.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = FragmentCodec(tokenizer)
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                ids = [codec.encode(v.as_py()) for v in batch.column(1)]
                decoded = [codec.decode(i) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(ids, "binary"), pa.array(decoded, "string")], ["key", "ids", "decoded"]
                )

    rows = df.select(df[key].alias("key"), text_of(df, text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, ids binary, decoded string").withColumnRenamed("key", key)
