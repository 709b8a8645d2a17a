"""Cutting oversized texts at natural boundaries.

Tokens are those of the public byte-level vocabulary. Cuts are placed between
a non-space and the white space after it (or after a full-width stop), where
the token pattern must break; a piece is then exactly a range of the whole
text's tokens and needs no second encoding. Where a window has no such place,
the cut falls on a character inside a long run and the piece is encoded again
to prove its size.

The place is chosen by lexical cohesion: token counts of the blocks left and
right of each place are compared by cosine, the depth of a place is how far
its similarity lies below the peaks on both sides, and the deepest valley of
the window wins, with a bonus for stronger boundaries (heading, paragraph,
line, sentence). Words serve only where a window has none of these.

Result on odd input: null and empty texts and texts within the limit give one
piece, the whole text (null stays null); repeated rows are cut alike; ties of
depth go to the later place; white space is never dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenization import RANKS, TOKENIZER_DIR, Tokenizer, tokenizer

LIMIT, OVERLAP = 1024, 64
#: Tokens per cell, cells per block, cells on each side in which a valley's peaks are sought, hashed vocabulary of a cell.
CELL, BLOCK, REACH, BUCKETS = 16, 6, 8, 256
HEADING, PARAGRAPH, LINE, SENTENCE, WORD = 5, 4, 3, 2, 1
BONUS = np.array([0, 0, 0.0, 0.15, 0.35, 0.7])
#: A window starts at this share of the limit after the last cut.
LEAST_SHARE = 0.4

_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\f\v")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;")] = True
_WIDE_STOP = re.compile(rb"(?:\xe3\x80\x82|\xef\xbc[\x81\x9f])(?=\xe3[\x81-\x83]|[\xe4-\xed][\x80-\xbf]|[A-Za-z0-9])")
_ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0  -     　]")


def boundaries(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the places to cut, ascending, and the strength of each."""
    data = np.frombuffer(raw, np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    after = np.flatnonzero(~space[1:] & space[:-1]) + 1
    if len(after) and len(starts) and after[0] <= starts[0]:
        after = after[1:]
    starts = starts[: len(after)]  # white space at the very end is no place to cut
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    breaks = lines[after] - lines[starts]
    level = np.where(breaks >= 2, PARAGRAPH, np.where(breaks == 1, LINE, np.where(_STOP[data[starts - 1]], SENTENCE, WORD)))
    level[(breaks >= 1) & (data[after] == ord("#"))] = HEADING
    wide = np.fromiter((m.end() for m in _WIDE_STOP.finditer(raw)), np.int64)
    if len(wide):
        places = np.concatenate([starts, wide])
        order = np.argsort(places, kind="stable")
        return places[order], np.concatenate([level, np.full(len(wide), SENTENCE)])[order]
    return starts, level


#: Cells whose counts are held at once.
CELLS_AT_ONCE = 4096


def valley_depths(ids: np.ndarray) -> np.ndarray:
    """For each cell edge, how far the similarity of its two blocks lies below the peaks around it."""
    cells = len(ids) // CELL + 1
    like = np.concatenate([_similarity(ids, cells, first, min(first + CELLS_AT_ONCE, cells + 1)) for first in range(0, cells + 1, CELLS_AT_ONCE)])
    padded = np.pad(like, REACH, mode="edge")
    peak_left = np.max([padded[k : k + cells + 1] for k in range(REACH + 1)], axis=0)
    peak_right = np.max([padded[REACH + k : REACH + k + cells + 1] for k in range(REACH + 1)], axis=0)
    return peak_left + peak_right - 2 * like


def _similarity(ids: np.ndarray, cells: int, first: int, last: int) -> np.ndarray:
    """Cosine of the blocks left and right of the cell edges from ``first`` to ``last``; only the cells around them are counted."""
    low, high = max(first - BLOCK, 0), min(last + BLOCK, cells)
    part = ids[low * CELL : high * CELL].astype(np.int64)
    bucket = (part * 2654435761 >> 12) % BUCKETS
    counts = np.bincount((np.arange(len(part)) // CELL) * BUCKETS + bucket, minlength=(high - low) * BUCKETS).reshape(-1, BUCKETS)
    counts = counts[:, counts.any(axis=0)]
    total = np.vstack([np.zeros((1, counts.shape[1])), np.cumsum(counts, axis=0)]).astype(np.float32)
    edge = np.arange(first, last)
    left = np.sqrt(total[edge - low] - total[np.maximum(edge - BLOCK, 0) - low])
    right = np.sqrt(total[np.minimum(edge + BLOCK, cells) - low] - total[edge - low])
    norm = np.sqrt((left * left).sum(1) * (right * right).sum(1))
    return (left * right).sum(1) / np.maximum(norm, 1e-9)


def cut(tok: Tokenizer, text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(start byte, end byte, tokens, bytes repeated from the piece before) of each piece."""
    raw = (text or "").encode("utf-8", "replace")
    ids = np.array(tok.encode(text), np.int64)
    if len(ids) <= limit:
        return [(0, len(raw), len(ids), 0)]
    ends = np.cumsum(tok.length_of[ids])
    exact = not _ODD_SPACE.search(text)
    places, level = boundaries(raw)
    index = np.searchsorted(ends, places)
    sound = (index < len(ends)) & (ends[np.minimum(index, len(ends) - 1)] == places)
    places, level, index = places[sound], level[sound], index[sound] + 1
    depth = valley_depths(ids)
    score = depth[np.minimum((index + CELL // 2) // CELL, len(depth) - 1)] + BONUS[level]

    def measured(start: int, end: int) -> int:
        return len(tok.encode(raw[start:end].decode("utf-8", "replace")))

    out: list[tuple[int, int, int, int]] = []
    begin, begin_byte, done, done_byte = 0, 0, 0, 0  # of the piece with its overlap; of what earlier pieces hold
    while True:
        clean = exact
        if len(ids) - begin <= limit and (clean or measured(begin_byte, len(raw)) <= limit):
            out.append((begin_byte, len(raw), len(ids) - begin if clean else measured(begin_byte, len(raw)), done_byte - begin_byte))
            return out
        most = min(begin + limit, len(ids) - 1)
        least = min(max(done + int(limit * LEAST_SHARE), begin + overlap + 1), most)
        low, high = np.searchsorted(index, least, "left"), np.searchsorted(index, most, "right")
        strong = low + np.flatnonzero(level[low:high] >= SENTENCE)
        if len(strong):
            best = strong[len(strong) - 1 - int(np.argmax(score[strong][::-1]))]
        else:
            best = high - 1 if high > low else -1
        if best >= 0:
            stop, stop_byte = int(index[best]), int(places[best])
        else:
            clean = False
            stop, stop_byte = _inside(raw, ends, most, done_byte)
        if not clean:
            while stop > done + 1 and stop_byte > done_byte and measured(begin_byte, stop_byte) > limit:
                shorter, shorter_byte = _inside(raw, ends, max(done + 1, stop - max(1, (stop - begin) // 16)), done_byte)
                if shorter_byte >= stop_byte:
                    break
                stop, stop_byte = shorter, shorter_byte
        size = stop - begin if clean else measured(begin_byte, stop_byte)
        if size > limit and begin_byte < done_byte:  # the overlap leaves no room: go on without it
            begin, begin_byte = done, done_byte
            continue
        out.append((begin_byte, stop_byte, size, done_byte - begin_byte))
        done, done_byte = stop, stop_byte
        low, high = np.searchsorted(index, stop - overlap * 3 // 2), np.searchsorted(index, stop - overlap // 2, "right")
        if high > low:
            near = low + int(np.argmin(np.abs(index[low:high] - (stop - overlap))))
            begin, begin_byte = int(index[near]), int(places[near])
        else:
            begin, begin_byte = _inside(raw, ends, max(stop - overlap, 1), out[-1][0])
            exact = False  # from here on sizes are measured


def _inside(raw: bytes, ends: np.ndarray, most: int, above: int) -> tuple[int, int]:
    """The last token edge up to ``most`` tokens that is also a character edge; failing that the next character edge above ``above``."""
    while most > 0 and int(ends[most - 1]) > above:
        at = int(ends[most - 1])
        if at >= len(raw) or raw[at] & 0xC0 != 0x80:
            return most, at
        most -= 1
    at = above + 1
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return int(np.searchsorted(ends, at)) + 1, at


def split_oversized(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True, oversized_only: bool = False, folder: str = TOKENIZER_DIR, ranks: str = RANKS) -> DataFrame:
    """(key, piece, pieces, start_byte, end_byte, repeated_bytes, n_tokens[, text]): one row for each piece, in one narrow stage.

    A text has no more tokens than UTF-8 bytes, so with ``oversized_only`` the scan drops short texts before Python sees them.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key), F.col(text).cast("string").alias("__text"))
    if oversized_only:
        rows = rows.filter(F.octet_length("__text") > limit)
    schema = f"`{key}` {kind}, piece int, pieces int, start_byte bigint, end_byte bigint, repeated_bytes bigint, n_tokens int" + ", text string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(folder, ranks)
        for batch in batches:
            taken, numbers, texts = [], [], []
            for row, value in enumerate(batch.column(1).to_pylist()):
                pieces = cut(tok, value, limit, overlap)
                if oversized_only and len(pieces) == 1 and pieces[0][2] <= limit:
                    continue
                raw = (value or "").encode("utf-8", "replace") if with_text else b""
                for k, (start, end, size, repeated) in enumerate(pieces):
                    taken.append(row)
                    numbers.append((k, len(pieces), start, end, repeated, size))
                    if with_text:
                        texts.append(None if value is None else raw[start:end].decode("utf-8", "replace"))
            table = np.array(numbers, np.int64).reshape(-1, 6)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            columns = [batch.column(0).take(pa.array(taken, pa.int64())), *(pa.array(table[:, k]).cast(kind) for k, kind in enumerate(kinds))]
            names = [key, "piece", "pieces", "start_byte", "end_byte", "repeated_bytes", "n_tokens"]
            if with_text:
                columns.append(pa.array(texts, pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, schema)
