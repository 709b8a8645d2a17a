"""Vectors of texts through a callable that is given, in batches of bounded size.

The callable takes a list of texts and gives a list of vectors. A batch holds at most so many texts and tokens; a text is cut
to its first tokens only for the callable, whose input is limited; a batch that the callable refuses is halved until single
texts are left. Vectors are brought to length one.

Result on odd input: null and blank texts have no vector; a text that is refused alone has none either; a zero vector stays
zero; repeated rows each get their vector.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embed = Callable[[Sequence[str]], Sequence[Sequence[float]]]
TEXTS, TOKENS, LONGEST = 100, 250_000, 8_000
#: Characters that count as one token where no tokenizer is at hand.
CHARS_PER_TOKEN = 4


def batches_of(texts: Sequence[str], texts_at_once: int = TEXTS, tokens_at_once: int = TOKENS, longest: int = LONGEST) -> Iterator[list[int]]:
    """Places of the texts of each batch, in order."""
    batch, held = [], 0
    for i, text in enumerate(texts):
        tokens = min(len(text) // CHARS_PER_TOKEN + 1, longest)
        if batch and (len(batch) >= texts_at_once or held + tokens > tokens_at_once):
            yield batch
            batch, held = [], 0
        batch.append(i)
        held += tokens
    if batch:
        yield batch


def embedded(texts: Sequence[str], embed: Embed) -> list[np.ndarray | None]:
    """Vectors of the texts; a refused batch is halved, a refused text gets none."""
    try:
        return [v / n if (n := np.linalg.norm(v)) else v for v in (np.asarray(x, np.float32) for x in embed(texts))]
    except Exception:
        if len(texts) == 1:
            return [None]
        half = len(texts) // 2
        return embedded(texts[:half], embed) + embedded(texts[half:], embed)


def embed_column(df: DataFrame, key: str, text: str, embed: Embed, longest: int = LONGEST) -> DataFrame:
    """(key, vector): one narrow stage."""
    kind = df.schema[key].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            values = [(t or "")[: longest * CHARS_PER_TOKEN] for t in part.column(1).to_pylist()]
            there = [i for i, t in enumerate(values) if t.strip()]
            out: list[list[float] | None] = [None] * len(values)
            for places in batches_of([values[i] for i in there], longest=longest):
                for i, v in zip(places, embedded([values[there[i]] for i in places], embed)):
                    out[there[i]] = None if v is None else v.tolist()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.list_(pa.float32()))], names=[key, "vector"])

    return df.select(F.col(key), F.col(text).cast("string").alias("__text")).mapInArrow(run, f"`{key}` {kind}, vector array<float>")


def hashed_ngrams(texts: Sequence[str], size: int = 64) -> list[np.ndarray]:
    """A stand-in that needs no model: counts of character trigrams in hashed buckets."""
    out = []
    for text in texts:
        v = np.zeros(size, np.float32)
        low = f" {text.lower()} "
        for i in range(len(low) - 2):
            h = zlib.crc32(low[i : i + 3].encode("utf-8", "replace"))
            v[h % size] += 1 if h & (1 << 20) else -1
        out.append(v)
    return out
