"""Helpers shared by the operators of this subpackage: scratch tables, word-cached encoding, Arrow rows."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.session import scratch_path

CACHED_WORDS = 600_000  # words an encoder remembers in one Python worker, about 120 MB
LETTER, PUNCTUATION = 1, 2
BYTE_KINDS = np.zeros(256, "u1")
BYTE_KINDS[[*b"abcdefghijklmnopqrstuvwxyz"]] = LETTER
BYTE_KINDS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = PUNCTUATION


BETWEEN = b"\xff"


def spaced(data: bytes) -> bytes:
    """A space put between every ASCII letter and following ASCII punctuation other than an apostrophe."""
    raw = np.frombuffer(data, "u1")
    kinds = BYTE_KINDS[raw]
    at = np.flatnonzero((kinds[:-1] == LETTER) & (kinds[1:] == PUNCTUATION)) + 1
    return np.insert(raw, at, 32).tobytes() if len(at) else data


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and still there when an executor is lost."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(df: DataFrame, column: str) -> Column:
    """The text column, with null read as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


class WordEncoder:
    """Encodes whole texts with a ``tokenizers`` file that drops white space and case, as ``word_bpe_49k.json`` does.

    A text is cut at ASCII white space and between an ASCII letter and ASCII punctuation (never at an apostrophe,
    which can belong to either side).  Normaliser, special strings and pieces of such a tokenizer lie within one part,
    so the library encodes every distinct part once and the remembered ids are joined.  Texts with the start of a
    special string are cut at white space only and keep their case.
    """

    def __init__(self, path: str, limit: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder()
        self.mark, self.mark_id = next((t.content, i) for i, t in added.items() if t.special)
        self.openings = sorted({t.content[:2].encode() for t in added.values()})
        self.packed = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab().values()) + 1)]
        self.limit = limit
        self.parts: dict[bytes, bytes] = {}

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[bytes]:
        """``ids`` of several texts; new words of all of them are learnt at once."""
        raw = [t.encode("utf-8", "replace") for t in texts]
        special = [any(o in data for o in self.openings) for data in raw]
        # the byte between texts occurs in none of them and is neither letter nor punctuation
        plain = iter(spaced(BETWEEN.join([d for d, s in zip(raw, special) if not s]).lower()).split(BETWEEN))
        docs = [data.split() if s else next(plain).split() for data, s in zip(raw, special)]
        known = self.parts
        found = [list(map(known.get, parts)) for parts in docs]
        missing = [[i for i, ids in enumerate(own) if ids is None] for own in found]
        fresh = {parts[i] for parts, own in zip(docs, missing) for i in own}
        if len(known) + len(fresh) > self.limit:  # start over with the new words
            known.clear()
        self._learn(fresh)
        for parts, own, at in zip(docs, found, missing):
            for i in at:
                own[i] = known[parts[i]]
        return [b"".join(own) for own in found]

    def _learn(self, parts: set[bytes]) -> None:
        """Encode new parts: ASCII words by the merges alone, since neither normaliser nor splitter changes them; the
        others in one call with a special string between them, or one by one if they hold it."""
        mark, tokenize = self.mark.encode(), self.tokenizer.model.tokenize
        odd, plain = [], []
        for part in parts:
            if part.isalpha() and part.islower():  # of bytes: a-z only
                self.parts[part] = b"".join([self.packed[t.id] for t in tokenize(part.decode())])
            else:
                (odd if mark in part else plain).append(part)
        text = self.mark.join([p.decode() for p in plain])
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(ids == self.mark_id)
        if len(ends) != max(0, len(plain) - 1):
            raise ValueError("the special string between two parts was lost")
        data, start = ids.tobytes(), 0
        for part, end in zip(plain, [*ends.tolist(), len(ids)]):
            self.parts[part] = data[4 * start:4 * end]
            start = end + 1
        for part in odd:
            self.parts[part] = np.array(self.tokenizer.encode(part.decode(), add_special_tokens=False).ids, "<u4").tobytes()


ENCODERS: dict[str, WordEncoder] = {}  # the encoder a Python worker keeps from task to task, by its file


def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder: it reads its file once and keeps what it has learnt, within its bound."""
    if path not in ENCODERS:
        ENCODERS.clear()
        ENCODERS[path] = WordEncoder(path)
    return ENCODERS[path]


def forget_words() -> None:
    """Gives back what the encoder of an earlier step holds; steps without one call it in their tasks."""
    ENCODERS.clear()


def arrow_rows(batches: Iterable[pa.RecordBatch], size: int = 2_000) -> Iterator[list[dict]]:
    """Rows of Arrow batches in small lists."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size).to_pylist()
