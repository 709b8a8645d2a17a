"""Encoding texts with a public byte-level BPE vocabulary.

Result on odd input: a null or empty text gives an empty list; a text of any
length and script is encoded whole; nothing is normalised, so decoding returns
the text; repeated rows each get their own result; extra columns are kept away
from the Python side.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts longer than this are cut at safe boundaries before encoding, so that no call holds a very long text at once.
LONG_CHARS = 1 << 16

#: A token of PATTERN never runs from a non-space into a space, so each such place is a token boundary whatever follows.
#: The class also leaves out separators that only one of the two regex engines counts as spaces.
_SAFE = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \n])")


class Tokenizer:
    """A tiktoken encoding built from a local rank file."""

    def __init__(self, folder: str = TOKENIZER_DIR, ranks: str = RANKS):
        import tiktoken

        with open(f"{folder}/{ranks}", "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._core = tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})._core_bpe
        self.bytes_of = [b""] * (max(table.values()) + 1)
        for token, rank in table.items():
            self.bytes_of[rank] = token
        self.length_of = np.fromiter(map(len, self.bytes_of), np.int32, len(self.bytes_of))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        try:
            if len(text) <= LONG_CHARS:
                return self._core.encode_ordinary(text)
            return [i for part in safe_parts(text, LONG_CHARS) for i in self._core.encode_ordinary(part)]
        except UnicodeEncodeError:  # a lone surrogate, which UTF-8 cannot hold
            return self.encode(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace"))

    def decode_bytes(self, ids) -> bytes:
        """The raw bytes of the tokens; one token may hold part of a character."""
        return b"".join(self.bytes_of[i] for i in ids)


def safe_parts(text: str, size: int) -> Iterator[str]:
    """Cut after about ``size`` characters at the next place where PATTERN must break; a stretch without one stays whole."""
    at = 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


@lru_cache(maxsize=4)
def tokenizer(folder: str = TOKENIZER_DIR, ranks: str = RANKS) -> Tokenizer:
    return Tokenizer(folder, ranks)


def encode_column(df: DataFrame, key: str, text: str, folder: str = TOKENIZER_DIR, ranks: str = RANKS) -> DataFrame:
    """(key, ids): one narrow stage, no shuffle; key and text are the only columns that leave the JVM."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(folder, ranks)
        for batch in batches:
            ends, values = [0], []
            for value in batch.column(1).to_pylist():
                values.append(np.array(tok.encode(value), np.int32))
                ends.append(ends[-1] + len(values[-1]))
            flat = pa.array(np.concatenate(values) if values else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=[key, "ids"])

    return df.select(F.col(key), F.col(text).cast("string").alias("__text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
