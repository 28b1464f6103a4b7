"""Token counts by a finite-state transducer compiled from a byte-level BPE file.

The transducer reads bytes (the first byte of a character carries the character's class) and writes numbers that sum to
the token count.  Its state joins the place within the splitting pattern with what decides future merges: the longest
suffix that some token may still continue, and for every place where such a token could begin, the last token of the
encoding up to there and the count relative to now.  A new byte ends exactly one token that stays next to its
predecessor when both are encoded together; its predecessor's count plus one is the new count.  States and transitions
are made when first met and kept in a table, so the inner loop is one table look-up per byte for thousands of chunks at
a time.

A text is cut into chunks.  The map of a chunk takes an entry state to an exit state and a count.  Chunk maps of a text
are composed by a parallel prefix scan.  Most cuts are made where the splitting pattern always ends a piece, and there
the map is constant; elsewhere a map holds the entry states that occur.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from wardlight.llm.bpe_fragments import ALPHABET, merge
from wardlight.llm.common import text_of

CHUNK = 512  # bytes
BATCH_CHARS = 2_000_000
MOST_STATES = 250_000  # beyond this the table is begun anew
CONTINUED, LETTER, NUMBER, SPACE, OTHER = range(5)
WEIGHT_BITS, WEIGHT_ZERO = 8, 128
FRESH = ("", ((0, "", 0),))  # nothing read of a piece yet
BLANK, APOSTROPHE = ALPHABET[32], "'"
# The contractions that are pieces of their own; the first letter decides or waits for the second.
CONTRACTIONS_SHORT, CONTRACTIONS_LONG = "stmd", {"r": "e", "v": "e", "l": "l"}
ENDED = ("ended", FRESH, "")


class Transducer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.ranks = {tuple(m): i for i, m in enumerate(spec["model"]["merges"])}
        self.vocabulary = set(spec["model"]["vocab"])
        self.starts = {t[:n] for t in self.vocabulary for n in range(1, len(t))}
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.classes = np.zeros(0x110000, "u1")
        self._clear()

    # --- one piece --------------------------------------------------------------------------------------------

    def _fits(self, before: str, token: str) -> bool:
        """Whether the two tokens stay as they are when their bytes are encoded together."""
        key = (before, token)
        if key not in self.pairs:
            self.pairs[key] = merge(list(before + token), self.ranks) == ([before, token] if before else [token])
        return self.pairs[key]

    def read(self, piece: tuple, byte: str) -> tuple[tuple, int]:
        suffix, places = piece
        for length, before, count in places:  # the longest token first
            token = suffix[len(suffix) - length:] + byte
            if token in self.vocabulary and self._fits(before, token):
                break
        else:
            raise ValueError(f"no token ends after {suffix + byte!r}")
        gained = count + 1
        kept = [(n + 1, b, c - gained) for n, b, c in places if suffix[len(suffix) - n:] + byte in self.starts]
        longest = kept[0][0] if kept else 0
        return ((suffix + byte)[len(suffix) + 1 - longest:], (*kept, (0, token, 0))), gained

    def read_all(self, piece: tuple, text: str) -> tuple[tuple, int]:
        total = 0
        for byte in text:
            piece, gained = self.read(piece, byte)
            total += gained
        return piece, total

    # --- the splitting pattern --------------------------------------------------------------------------------

    def _begin(self, kind: int, byte: str) -> tuple[tuple, int]:
        """First character of a new piece."""
        if kind == SPACE:
            return (SPACE, FRESH, byte), 0
        if byte == APOSTROPHE:
            return (APOSTROPHE, FRESH, byte), 0
        piece, gained = self.read(FRESH, byte)
        return (kind, piece, ""), gained

    def advance(self, state: tuple, kind: int, byte: str) -> tuple[tuple, int]:
        """``state`` is (mode, piece, waiting): bytes that wait are not read into the piece yet."""
        mode, piece, waiting = state
        if kind == CONTINUED:
            if mode == SPACE:
                return (mode, piece, waiting + byte), 0
            piece, gained = self.read(piece, byte)
            return (mode, piece, waiting), gained
        if mode == "ended":
            return self._begin(kind, byte)
        if mode == SPACE:
            if kind == SPACE:
                piece, gained = self.read_all(piece, waiting)
                return (mode, piece, byte), gained
            first, gained = self.read_all(FRESH, waiting)
            if waiting == BLANK:  # the last blank of a run belongs to the next piece
                first, more = self.read(first, byte)
                return (kind, first, ""), gained + more
            state, more = self._begin(kind, byte)
            return state, gained + more
        if mode == APOSTROPHE:
            whole = waiting + byte
            if waiting == APOSTROPHE and byte in CONTRACTIONS_SHORT or CONTRACTIONS_LONG.get(waiting[1:]) == byte:
                return ENDED, self.read_all(FRESH, whole)[1]
            if waiting == APOSTROPHE and byte in CONTRACTIONS_LONG:
                return (mode, FRESH, whole), 0
            if waiting == APOSTROPHE and kind == OTHER:
                piece, gained = self.read_all(FRESH, whole)
                return (OTHER, piece, ""), gained
            gained, state = self.read(FRESH, APOSTROPHE)[1], ENDED
            for k, b in [(LETTER, waiting[1:])] * (len(waiting) > 1) + [(kind, byte)]:
                state, more = self.advance(state, k, b)
                gained += more
            return state, gained
        if kind == mode:
            piece, gained = self.read(piece, byte)
            return (mode, piece, ""), gained
        return self._begin(kind, byte)

    def last(self, state: tuple) -> int:
        """What is still to count when the text ends, or a piece certainly ends, in this state."""
        mode, piece, waiting = state
        if mode == SPACE:
            return self.read_all(piece, waiting)[1]
        if mode == APOSTROPHE:
            return self.read(FRESH, APOSTROPHE)[1] + self.read_all(FRESH, waiting[1:])[1]
        return 0

    # --- the table --------------------------------------------------------------------------------------------

    def _clear(self) -> None:
        self.pairs: dict[tuple[str, str], bool] = {}
        self.states, self.numbers, self.lasts = [ENDED], {ENDED: 0}, [0]
        self.codes = np.full(256 * 5, -1, "int32")
        self.symbols: list[int] = []
        self.width = 128
        self.table = np.full(1024 * self.width, -1, "int32")

    def _number(self, state: tuple) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.lasts.append(self.last(state))
            if len(self.states) * self.width > len(self.table):
                self.table = np.concatenate([self.table, np.full(len(self.table), -1, "int32")])
        return self.numbers[state]

    def _fill(self, missing: np.ndarray) -> None:
        for at in np.unique(missing).tolist():
            symbol = self.symbols[at % self.width]
            state, gained = self.advance(self.states[at // self.width], symbol >> 8, ALPHABET[symbol & 255])
            number = self._number(state)
            self.table[at] = number << WEIGHT_BITS | gained + WEIGHT_ZERO

    def _coded(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols as columns of the table."""
        for s in np.flatnonzero((np.bincount(symbols, minlength=len(self.codes)) > 0) & (self.codes < 0)).tolist():
            self.codes[s] = len(self.symbols)
            self.symbols.append(s)
        if len(self.symbols) > self.width:
            rows, old = len(self.table) // self.width, self.width
            self.width *= 2
            wide = np.full((rows, self.width), -1, "int32")
            wide[:, :old] = self.table.reshape(rows, old)
            self.table = wide.reshape(-1)
            return self._coded(symbols)
        return self.codes[symbols]

    def run(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit state and count of every chunk from its entry state; all chunks advance together."""
        order = np.argsort(-sizes, kind="stable")
        position, state = starts[order].copy(), entries[order].astype("int64")
        total = np.zeros(len(order), "int64")
        ascending = -sizes[order]
        for t in range(int(sizes.max(initial=0))):
            k = int(np.searchsorted(ascending, -t, side="left"))  # chunks longer than t
            at = state[:k] * self.width + codes[position[:k] + t]
            found = self.table[at]
            if (found < 0).any():
                self._fill(at[found < 0])
                found = self.table[at]
            state[:k] = found >> WEIGHT_BITS
            total[:k] += (found & (1 << WEIGHT_BITS) - 1) - WEIGHT_ZERO
        exits, counts = np.empty_like(state), np.empty_like(total)
        exits[order], counts[order] = state, total
        return exits, counts

    # --- texts ------------------------------------------------------------------------------------------------

    def _classes_of(self, points: np.ndarray) -> np.ndarray:
        found = self.classes[points]
        if not found.all():
            for p in np.unique(points[found == 0]).tolist():
                alone = [kind for kind, head in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(self.split(head + chr(p))) == 1]
                self.classes[p] = alone[0] if alone else SPACE
            found = self.classes[points]
        return found

    def _chunks(self, kinds: np.ndarray, first: int, end: int, certain: np.ndarray) -> tuple[list[int], list[bool]]:
        """Cuts of one text, and whether a piece certainly ends at each."""
        cuts, sure, at = [first], [True], first
        while end - at > 2 * CHUNK:
            i = int(np.searchsorted(certain, at + CHUNK))
            if i < len(certain) and certain[i] < min(end, at + 2 * CHUNK):
                at, ok = int(certain[i]), True
            else:
                at, ok = at + CHUNK, False
                while kinds[at] == CONTINUED:
                    at += 1
            cuts.append(at)
            sure.append(ok)
        return cuts, sure

    def counts(self, texts: list[str]) -> np.ndarray:
        """Token counts of texts without special strings."""
        if len(self.states) > MOST_STATES:
            self._clear()
        data = "".join(texts)
        raw = np.frombuffer(data.encode("utf-8", "replace"), "u1")
        points = np.frombuffer(data.encode("utf-32-le", "replace"), "<u4")
        size = 1 + (points > 0x7F).astype("int64") + (points > 0x7FF) + (points > 0xFFFF)
        lead = np.cumsum(size) - size
        classes = self._classes_of(points)
        kinds = np.zeros(len(raw), "u1")
        kinds[lead] = classes
        symbols = raw.astype("int64") | kinds.astype("int64") << 8
        codes = self._coded(symbols)
        certain = lead[1:][(classes[1:] == SPACE) & (classes[:-1] != SPACE)]
        ends = np.cumsum([0, *(len(t) for t in texts)])
        bounds = np.append(lead, len(raw))[ends]
        starts, sure, owner = [], [], []
        for i, (first, end) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            cuts, ok = self._chunks(kinds, first, end, certain)
            starts += cuts
            sure += ok
            owner += [i] * len(cuts)
        starts, owner, sure = np.array(starts, "int64"), np.array(owner, "int64"), np.array(sure, bool)
        sizes = np.diff(np.append(starts, len(raw)))
        exits, counts = self.run(codes, starts, sizes, np.zeros(len(starts), "int64"))
        lasts = np.array(self.lasts)[exits]
        out = np.zeros(len(texts), "int64")
        plain = np.ones(len(texts), bool)
        plain[owner[~sure]] = False
        np.add.at(out, owner, np.where(plain[owner], counts + lasts, 0))
        rest = np.flatnonzero(~plain[owner])
        if len(rest):
            begins = np.append(True, owner[rest][1:] != owner[rest][:-1])
            maps = self.chunk_maps(codes, starts[rest], sizes[rest], sure[rest] | begins, exits[rest], counts[rest])
            ends = np.append(np.flatnonzero(begins)[1:], len(rest))
            for first, end in zip(np.flatnonzero(begins).tolist(), ends.tolist()):
                state, total = scan([Mapped(m, self.lasts, k > 0 and bool(sure[rest[first + k]])) for k, m in enumerate(maps[first:end])])(0)
                out[owner[rest[first]]] = total + self.lasts[state]
        return out

    def chunk_maps(self, codes, starts, sizes, fresh, exits, counts) -> list[dict[int, tuple[int, int]]]:
        """For each chunk: entry state -> (exit state, count), for every entry that its predecessor's exits can be.

        ``fresh`` chunks are entered in state 0.  All chunks have run from state 0.  Then all those whose predecessor ends
        elsewhere run together from there, until no exit changes; as a token machine forgets its entry within a few
        tokens, two or three rounds are the rule, however many chunks there are.
        """
        maps = [{0: (x, n)} for x, n in zip(exits.tolist(), counts.tolist())]
        entry, exits = np.zeros(len(starts), "int64"), exits.astype("int64").copy()
        while True:
            wanted = np.where(fresh, 0, np.append(0, exits[:-1]))
            moved = np.flatnonzero(wanted != entry)
            if not len(moved):
                return maps
            new = np.array([k for k in moved.tolist() if int(wanted[k]) not in maps[k]], "int64")
            if len(new):
                found, n = self.run(codes, starts[new], sizes[new], wanted[new])
                for k, x, c in zip(new.tolist(), found.tolist(), n.tolist()):
                    maps[k][int(wanted[k])] = (x, c)
            for k in moved.tolist():
                exits[k] = maps[k][int(wanted[k])][0]
            entry = wanted

    def count_all(self, texts: list[str]) -> np.ndarray:
        """Token counts of any texts; each special string in them is one token."""
        out = np.zeros(len(texts), "int64")
        held: list[str] = []
        owner: list[int] = []
        chars = 0

        def flush() -> None:
            nonlocal chars
            if held:
                np.add.at(out, owner, self.counts(held))
            held.clear()
            owner.clear()
            chars = 0

        for i, text in enumerate(texts):
            parts = self.specials.split(text) if self.specials and self.specials.search(text) else [text]
            out[i] += len(parts) - 1
            held += parts
            owner += [i] * len(parts)
            chars += len(text)
            if chars >= BATCH_CHARS:
                flush()
        flush()
        return out


class Mapped:
    """A chunk map as a function; a ``sure`` chunk is entered anew, after the token before it has been flushed."""

    def __init__(self, known: dict[int, tuple[int, int]], lasts, sure: bool):
        self.known, self.lasts, self.sure = known, lasts, sure

    def __call__(self, entry: int) -> tuple[int, int]:
        exit_, count = self.known[0 if self.sure else entry]
        return exit_, count + (self.lasts[entry] if self.sure else 0)


class Composed:
    """First one map, then the other; remembers what it was asked."""

    def __init__(self, first, then):
        self.first, self.then, self.known = first, then, {}

    def __call__(self, entry: int) -> tuple[int, int]:
        if entry not in self.known:
            middle, before = self.first(entry)
            state, after = self.then(middle)
            self.known[entry] = (state, before + after)
        return self.known[entry]


def scan(maps: list):
    """All maps composed, by pairs of pairs: composition is associative, so any grouping gives the same map."""
    while len(maps) > 1:
        maps = [Composed(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def token_counts(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens of every whole text.

    Null texts count as empty, with 0 bytes and 0 tokens.  Rows are counted one by one, so repeated rows and null keys
    pass through; an empty table gives an empty result.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer(tokenizer)
        for whole in batches:
            for first in range(0, whole.num_rows, 2000):
                batch = whole.slice(first, 2000)
                texts = batch.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(t.encode("utf-8", "replace")) for t in texts], "int64"),
                     pa.array(machine.count_all(texts), "int64")], ["key", "n_bytes", "n_tokens"],
                )

    rows = df.select(df[key].alias("key"), text_of(df, text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("key", key)
