"""Token ids as compressed binary shards: a static range asymmetric numeral system (rANS).

Format.  One frequency table, scaled to 2**SCALE_BITS, is shared by the whole data set.  A frame holds whole documents
in ascending order and is cut into blocks of BLOCK ids that are coded independently.  A block has LANES interleaved
states: lane k codes the ids k, k + LANES, ...  After every SEGMENT ids per lane the coder starts anew and its final
states stand in front of the segment's words, so that a decoder may begin at any of these checkpoints; a decoder runs
all segments of many blocks side by side.  Every block carries the crc32 of its ids.

    frame    = magic, number of blocks, blocks
    block    = ids in it, crc32 of the ids, number of segments, words of each segment, segments
    segment  = LANES final states (64-bit), renormalisation words (32-bit) in the order of reading
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlight.llm.common import word_encoder, text_of, written

MAGIC = b"RANS1\0\0\0"
SCALE_BITS = 20
LANES = 16
SEGMENT = 256  # ids of one lane between two checkpoints
BLOCK = LANES * SEGMENT * 16
FRAME_IDS = 1 << 20  # documents are added to a frame until it has so many ids
LOW = np.uint64(1 << 31)
WORD, ONE = np.uint64(32), np.uint64(1)
HEADER = struct.Struct("<IIII")


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE_BITS, at least 1 for every id that occurs."""
    total = 1 << SCALE_BITS
    used = np.flatnonzero(counts)
    if len(used) > total // 2:
        raise ValueError("too many different ids for the scale")
    out = np.zeros(len(counts), "int64")
    if len(used):
        share = counts[used] / counts.sum()
        out[used] = np.maximum(1, np.floor(share * (total - len(used)))).astype("int64")
        out[used[np.argmax(counts[used])]] += total - out.sum()
    return out.astype("uint32")


class Coder:
    def __init__(self, frequencies: np.ndarray):
        self.freq = frequencies.astype("uint64")
        self.start = np.concatenate([[0], np.cumsum(frequencies.astype("uint64"))[:-1]]).astype("uint64")
        self.bits, self.mask = np.uint64(SCALE_BITS), np.uint64((1 << SCALE_BITS) - 1)
        self.symbol = np.repeat(np.arange(len(frequencies), dtype="uint16" if len(frequencies) <= 65536 else "uint32"), frequencies)

    def _grid(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids as (steps, lanes, segments), and how many ids each segment holds."""
        per = LANES * SEGMENT
        n = -(-len(ids) // per)
        padded = np.zeros(n * per, ids.dtype)
        padded[: len(ids)] = ids
        held = np.full(n, per)
        held[-1] = len(ids) - (n - 1) * per
        return np.ascontiguousarray(padded.reshape(n, SEGMENT, LANES).transpose(1, 2, 0)), held

    @staticmethod
    def _live(t: int, held: np.ndarray) -> np.ndarray | None:
        """Lanes that have an id in step ``t``; None when all do."""
        if (t + 1) * LANES <= held.min():
            return None
        return t * LANES + np.arange(LANES)[:, None] < held

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Final states (lanes, segments) and the words of every segment, in reading order."""
        grid, held = self._grid(ids)
        steps, _, n = grid.shape
        state = np.full((LANES, n), LOW, "uint64")
        words = np.zeros((steps, LANES, n), "uint32")
        wrote = np.zeros((steps, LANES, n), bool)
        shift = np.uint64(63 - SCALE_BITS)
        for t in range(min(steps, -(-int(held.max()) // LANES)) - 1, -1, -1):
            f, c = self.freq[grid[t]], self.start[grid[t]]
            live = self._live(t, held)
            if live is not None:
                f = np.where(live, f, np.uint64(1))
            over = state >= (f << shift)
            if live is not None:
                over &= live
            words[t], wrote[t] = state, over
            small = np.where(over, state >> WORD, state)
            quotient = small // f
            small += quotient * ((ONE << self.bits) - f)  # the remainder, under the quotient
            small += c
            state = small if live is None else np.where(live, small, state)
        words, wrote = np.ascontiguousarray(words.transpose(2, 0, 1)), np.ascontiguousarray(wrote.transpose(2, 0, 1))
        return state, [words[i][wrote[i]] for i in range(n)]

    def decode(self, states: np.ndarray, words: list[np.ndarray], held: np.ndarray) -> list[np.ndarray]:
        """Ids of every segment; all segments advance together.  ``states`` is (lanes, segments)."""
        n = len(words)
        state = states.copy()
        flat = np.concatenate([*words, np.zeros(LANES, "uint32")]).astype("uint64")
        at = np.concatenate([[0], np.cumsum([len(w) for w in words])[:-1]]).astype("int64") - 1
        steps = -(-int(held.max()) // LANES)
        out = np.zeros((steps, LANES, n), self.symbol.dtype)
        for t in range(steps):
            live = self._live(t, held)
            slot = state & self.mask
            ids = self.symbol[slot]
            out[t] = ids
            moved = self.freq[ids] * (state >> self.bits) + slot - self.start[ids]
            state = moved if live is None else np.where(live, moved, state)
            need = state < LOW
            if live is not None:
                need &= live
            order = np.cumsum(need, axis=0, dtype="int64")
            if order[-1].any():
                order += at
                at = order[-1].copy()
                hit = np.flatnonzero(need)
                state.reshape(-1)[hit] = (state.reshape(-1)[hit] << WORD) | flat[order.reshape(-1)[hit]]
        if not (state == LOW).all():
            raise ValueError("damaged segment: the final state is wrong")
        out = np.ascontiguousarray(out.transpose(2, 0, 1))
        return [out[i].reshape(-1)[: held[i]] for i in range(n)]


def pack_frame(ids: np.ndarray, coder: Coder) -> bytes:
    blocks = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    parts = [MAGIC, struct.pack("<I", len(blocks))]
    if not blocks:
        return b"".join(parts)
    states, words = coder.encode(ids)  # BLOCK is a whole number of segments, so segments never reach over blocks
    at = 0
    for block in blocks:
        n = -(-len(block) // (LANES * SEGMENT))
        mine = words[at : at + n]
        parts.append(HEADER.pack(len(block), zlib.crc32(block.astype("<u4").tobytes()), n, 0))
        parts.append(np.array([len(w) for w in mine], "<u4").tobytes())
        for i, w in enumerate(mine):
            parts += [states[:, at + i].astype("<u8").tobytes(), w.astype("<u4").tobytes()]
        at += n
    return b"".join(parts)


def unpack_frame(data: bytes, coder: Coder) -> np.ndarray:
    """All ids of a frame; raises ValueError where a checksum does not hold."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a frame")
    (n_blocks,) = struct.unpack_from("<I", data, len(MAGIC))
    at = len(MAGIC) + 4
    states, words, held, blocks = [], [], [], []
    for _ in range(n_blocks):
        size, crc, n, _ = HEADER.unpack_from(data, at)
        lengths = np.frombuffer(data, "<u4", n, at + HEADER.size)
        at += HEADER.size + 4 * n
        for i, length in enumerate(lengths.tolist()):
            states.append(np.frombuffer(data, "<u8", LANES, at))
            words.append(np.frombuffer(data, "<u4", length, at + 8 * LANES))
            held.append(min(LANES * SEGMENT, size - i * LANES * SEGMENT))
            at += 8 * LANES + 4 * length
        blocks.append((n, crc))
    if not blocks:
        return np.zeros(0, "<u4")
    segments = coder.decode(np.stack(states, axis=1).astype("uint64"), words, np.array(held))
    out, first = [], 0
    for number, (n, crc) in enumerate(blocks):
        ids = np.concatenate(segments[first : first + n]).astype("<u4")
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"damaged block {number}: its checksum is wrong")
        out.append(ids)
        first += n
    return np.concatenate(out)


def kind_of(n_ids: int) -> str:
    """How ids are held between the steps: 16 bits where the vocabulary allows it."""
    return "<u2" if n_ids <= 1 << 16 else "<u4"


def document_ids(
    df: DataFrame, tokenizer: str, end_id: int, n_ids: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """key, ids (see ``kind_of``) with the end id."""
    kind = kind_of(n_ids)
    rows = df.select(df[key].cast("bigint").alias("key"), text_of(df, text).alias("text"))
    end = end_id.to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                wide = [ids + end for ids in encoder.many(batch.column(1).to_pylist())]
                ids = [np.frombuffer(w, "<u4").astype(kind).tobytes() for w in wide]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, "binary")], ["key", "ids"])

    return rows.mapInArrow(encode, "key bigint, ids binary")


def frequencies(documents: DataFrame, n_ids: int) -> np.ndarray:
    """Counts of all ids 0..n_ids-1: one row of counts per task, then one sum per id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_ids, "int64")
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), kind_of(n_ids))
            total += np.bincount(ids, minlength=n_ids)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, "int32"), pa.array(total[used], "int64")], ["id", "n"])

    found = documents.select("ids").mapInArrow(count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    out = np.zeros(n_ids, "int64")
    table = found.toArrow()  # at most one row per id of the vocabulary
    out[table.column("id").to_numpy()] = table.column("n").to_numpy()
    return out


FRAMES = "shard int, frame int, first bigint, n_ids bigint, keys array<bigint>, lengths array<bigint>, data binary"


def write_frames(documents: DataFrame, table: np.ndarray, name: str = "rans") -> DataFrame:
    """The data set in ascending key order: one row per frame, one shard per range of keys.

    ``first`` counts ids from the start of the shard; ``shard_starts`` gives what lies before each shard.
    """
    spark = documents.sparkSession
    shared, kind = spark.sparkContext.broadcast(table), kind_of(len(table))
    width = np.dtype(kind).itemsize
    tie = F.xxhash64("ids")
    ordered = documents.select("key", tie.alias("tie"), "ids").repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")
    ordered = ordered.select(F.spark_partition_id().alias("shard"), "key", "ids")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, first, number, shard = Coder(shared.value), 0, 0, 0
        keys: list = []
        pieces: list[bytes] = []

        def frame() -> pa.RecordBatch:
            nonlocal first, number
            ids = np.frombuffer(b"".join(pieces), kind)
            lengths = [len(p) // width for p in pieces]
            row = [[shard], [number], [first], [len(ids)], [keys], [lengths], [pack_frame(ids, coder)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            first, number = first + len(ids), number + 1
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(row, kinds)], ["shard", "frame", "first", "n_ids", "keys", "lengths", "data"]
            )

        held = 0
        for batch in batches:
            for i in range(batch.num_rows):
                shard = batch.column(0)[i].as_py()
                keys.append(batch.column(1)[i].as_py())
                pieces.append(batch.column(2)[i].as_py())
                held += len(pieces[-1]) // width
                if held >= FRAME_IDS:
                    yield frame()
                    keys, pieces, held = [], [], 0
        if keys:
            yield frame()

    return written(ordered.mapInArrow(encode, FRAMES), name, compression="none")


def shard_starts(frames: DataFrame) -> DataFrame:
    """shard, base: ids in all earlier shards.  One row per shard, of which there are as many as write tasks."""
    sizes = frames.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()
    rows, base = [], 0
    for r in sorted(sizes, key=lambda r: r["shard"]):
        rows.append((r["shard"], base))
        base += r["n"]
    return frames.sparkSession.createDataFrame(rows, "shard int, base bigint")


def read_documents(frames: DataFrame, table: np.ndarray) -> DataFrame:
    """key, start, ids (little-endian unsigned 32-bit) of every document, decoded from the frames."""
    spark = frames.sparkSession
    shared = spark.sparkContext.broadcast(table)
    placed = frames.join(F.broadcast(shard_starts(frames)), "shard")
    placed = placed.select((F.col("base") + F.col("first")).alias("first"), "keys", "lengths", "data")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                first, keys, lengths, data = (batch.column(c)[i].as_py() for c in range(4))
                raw = unpack_frame(data, coder).tobytes()
                ends = np.cumsum(lengths)
                begins = ends - lengths
                ids = [raw[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, "int64"), pa.array(begins + first, "int64"), pa.array(ids, "binary")], ["key", "start", "ids"]
                )

    return placed.mapInArrow(decode, "key bigint, start bigint, ids binary")


def round_trip(
    df: DataFrame, tokenizer: str, end_id: int, n_ids: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode a table, write its shards, read them back: key, start, ids.

    Null texts count as empty and give the end id alone.  Rows are in ascending key order, null keys first, and equal
    keys by a hash of their ids; repeated rows stay repeated.  An empty table gives an empty result.
    """
    documents = written(document_ids(df, tokenizer, end_id, n_ids, key, text), "ids")
    counts = frequencies(documents, n_ids)
    table = scaled(counts)
    return read_documents(write_frames(documents, table), table).withColumnRenamed("key", key)
