"""Files that nobody wrote by hand: generated, minified, vendored, or data saved as code.

Each excerpt of a file is lexed once; identifiers, strings and numbers are masked and five masked tokens make a shingle,
labelled with how often it occurred before (in powers of two). A file is the set of its excerpts' shingles. Files with
equal sets form a class; MinHash bands over the sets of the classes give candidates, which an exact upper bound of their
overlap (the bits in which two parity bitmaps differ) cuts down, and candidates are verified by the exact Jaccard
similarity of the sets (0.8 or more). First each class is verified against its nearest candidates, then every candidate
whose ends these links leave in different clusters, so each candidate is verified or already known to be in one cluster.

The clusters decide first: one of literals only is data, one of dense lines is minified, one that several repositories
share, names included, is vendored (files in one language have most masked shingles in common, copies also keep their
names), one within a single repository is a generated family, and one most of whose files carry evidence lends it to the
rest. What a file says of itself (its place, its name, the comment at its head, the shape of its lines) decides only
where no cluster does; the column ``by`` tells which of the two it was.

Only code and lock files are judged; documents and configuration count as
written by hand. Result on odd input: a file without excerpts is judged by its
path; null paths give nothing; repeated rows change nothing; a null or empty
content has no shingles and belongs to no cluster; extra columns are ignored. Excerpts of one file that stand in the same
batch are merged before they are shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import BROADCAST_BYTES, broadcast_if_small, estimated_bytes, materialise

SHINGLE, SIMILARITY = 5, 0.8
#: Two sets of similarity 0.8 share none of the bands with a probability under 0.001.
BANDS, ROWS = 24, 6
#: 64-bit words of the parity bitmap.
WORDS = 8
#: Files with fewer tokens resemble one another by chance more often; clusters of them are decided by the stricter second values.
SMALL_TOKENS = 200
#: Share of identifiers that copies have in common.
COPIED = (0.5, 0.8)
#: Classes of a band that are paired within one block; two blocks meet in a task of their own.
BLOCK = 2048
#: A family within one repository has at least so many files.
FAMILY = (3, 5)
#: Shingles that are sketched at once.
AT_ONCE = 400_000
#: Characters that are lexed at once.
CHARS_AT_ONCE = 2_000_000

CODE = r"(?i)\.(?:py|pyi|ts|tsx|mts|cts|js|jsx|mjs|cjs|go|rs|java|kt|scala|c|cc|cpp|h|hpp|cs|rb|php|swift|m|lua|pl|sh|css|scss)$"
# Names that tools give to lock files.
LOCK = r"(?i)(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|bun\.lockb?|poetry\.lock|pdm\.lock|uv\.lock|pipfile\.lock|cargo\.lock|go\.sum|composer\.lock|gemfile\.lock|podfile\.lock|mix\.lock|flake\.lock|deno\.lock|gradle\.lockfile|packages\.lock\.json)$"
# Folders in which package managers and people keep third-party code, each followed by a package.
VENDORED_PATH = r"(?i)(?:^|/)(?:_?vendor|node_modules|third[_-]?party|extern|external|externals|pods|carthage|bower_components|jspm_packages|site-packages|dist-packages)/[^/]+/"
GENERATED_PATH = r"(?i)(?:^|/)__generated__/|(?:^|/)zz_generated[_.][^/]*$|\.(?:generated|gen|g|designer|freezed)\.[a-z]{1,5}$|\.pb(?:\.gw|\.validate|\.micro)?\.(?:go|cc|h|dart)$|_pb2?(?:_grpc)?\.pyi?$|_pb\.(?:js|ts|d\.ts)$|_grpc\.pb\.go$|\.pb\.[a-z]+$"
MINIFIED_PATH = r"(?i)[.-]min\.(?:js|css|mjs|cjs)$|\.bundle\.(?:js|css|mjs)$|\.chunk\.(?:js|css|mjs)$|(?:^|/)bundle\.js$"

_GENERATED_HEAD = re.compile(
    r"(?i)code generated (?:by|from|with)\b|@generated\b|<auto-?generated|\bauto-?generated (?:file|by|from|code|using)|automatically (?:produced|generated|created) (?:by|from|with|using)\b|(?:file|code) (?:was|is|has been) (?:auto(?:matically)?[- ]?)?(?:generated|produced) (?:by|from|with|using)\b"
    r"|generated (?:by|from|using) [\w./@`'-]+.{0,40}(?:do not|don't|edit|overwrit|lost)|do not (?:modify|edit)(?: this file)? by hand: (?:output|generated|produced)|do not (?:edit|modify)[^.]{0,30}(?:generated|output of)|output of `"
    r"|자동(?:으로)? ?생성(?:된|되었|한)|도구로 .{0,10}생성|wurde (?:automatisch )?(?:von|mit|durch) .{0,40}(?:erzeugt|generiert|erstellt)|automatisch (?:erzeugt|generiert)|généré(?:e)? (?:automatiquement|par)|ne pas (?:modifier|éditer)|generad[oa] (?:automáticamente|por)|no (?:editar|modificar)\b|自動(?:的に)?生成|によって生成"
)
_VENDORED_HEAD = re.compile(r"(?i)vendored (?:from|copy|in from)|copied (?:verbatim |unchanged |as is )?from (?:upstream|the |https?:)|copied verbatim|third[- ]party (?:library|code|module|package|component)|\bexternal library\b|bundled .{0,20}library|released under its own licen[cs]e|\(c\) the \w+ (?:contributors|authors|project)|send fixes (?:there|upstream)|from upstream \w+ v?\d|upstream copy of|origin(?:al)? project:|fremde? bibliothek|외부 라이브러리|서드파티|bibliothèque tierce|biblioteca (?:externa|de terceros)|外部ライブラリ")
_LINES = re.compile(r"[^\r\n]+")
_HEAD_LINE = re.compile(r"^\s*(?:#+!?|//+[!/]?|/\*+!?|\*+|--|;+|%|<!--|\"\"\"|'''|\"|')\s*(.*)")

_KEEP = frozenset("def return if not for in import from const let var function export async class pub fn func while else new null None true false True False self nil range append public static void final int List String try catch except raise throw switch case break continue use impl struct match mut as with lambda yield await private protected".split())
_TOKEN = re.compile(r"//[^\n]*|#[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|[A-Za-z_$][\w$]*|\d[\w.]*|\S", re.S)
_SEEDS = np.random.default_rng(20).integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_SHIFTS = np.random.default_rng(21).integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


#: Codes of masked tokens; every keyword and sign has its own.
_IDENTIFIER, _STRING, _NUMBER, _COMMENT = 11, 12, 13, 0


class _Codes(dict):
    """Code of a token, kept for the next time it occurs."""

    def __missing__(self, x: str) -> int:
        c = x[0]
        if c in "\"'":
            code = _STRING
        elif c.isdigit():
            code = _NUMBER
        elif c == "#" or x.startswith(("//", "/*")):
            return _COMMENT
        elif c.isalpha() or c in "_$":
            code = zlib.crc32(x.encode()) + 16 if x in _KEEP else _IDENTIFIER
        else:
            code = zlib.crc32(x.encode("utf-8", "replace")) + 16
        if code != _STRING:
            self[x] = code
        return code


class _Names(dict):
    """32-bit hash of an identifier."""

    def __missing__(self, x: str) -> int:
        name = self[x] = zlib.crc32(x.encode("utf-8", "replace"))
        return name


class Lexed(NamedTuple):
    """Texts one after the other: token codes without comments and how many each text has, characters in literals, identifiers, and hashes of the distinct identifiers with the text of each."""

    codes: np.ndarray
    sizes: np.ndarray
    literal_chars: np.ndarray
    identifiers: np.ndarray
    names: np.ndarray
    name_of: np.ndarray


def masked(texts: list[str], codes: _Codes, names: _Names) -> Lexed:
    tokens: list[str] = []
    counts = []
    for text in texts:
        found = _TOKEN.findall(text)
        tokens += found
        counts.append(len(found))
    every = np.fromiter(map(codes.__getitem__, tokens), np.uint64, len(tokens))
    owner = np.repeat(np.arange(len(texts)), counts)
    literal = np.flatnonzero((every == _STRING) | (every == _NUMBER))
    lengths = np.fromiter(map(len, map(tokens.__getitem__, literal.tolist())), np.int64, len(literal))
    at = np.flatnonzero(every == _IDENTIFIER)
    hashes = np.fromiter(map(names.__getitem__, map(tokens.__getitem__, at.tolist())), np.uint32, len(at))
    kept = every != _COMMENT
    per_text = lambda of, weights=None: np.bincount(of, weights, minlength=len(texts)).astype(np.int64)
    return Lexed(every[kept], per_text(owner[kept]), per_text(owner[literal], lengths), per_text(owner[at]), *_distinct(hashes, owner[at]))


def shingle_sets(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of each text's labelled shingles, text after text, and where each text's begin."""
    counts_of = np.maximum(sizes - SHINGLE + 1, 0)
    if not counts_of.sum():
        return np.empty(0, np.uint32), np.zeros(len(sizes) + 1, np.int64)
    n = len(codes) - SHINGLE + 1
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            h = (h ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(sizes)), counts_of)
        at = np.arange(counts_of.sum()) - np.repeat(np.cumsum(counts_of) - counts_of, counts_of) + np.repeat(starts, counts_of)
        key = np.sort(owner.astype(np.uint64) << np.uint64(32) | h[at] >> np.uint64(32))
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        counts, key = np.diff(np.r_[first, len(key)]), key[first]
        labels, power = [key], 2
        while (more := counts >= power).any():
            labels.append(key[more] + np.uint64(power) * np.uint64(1 << 32) * np.uint64(len(sizes)))
            power *= 2
        key = np.concatenate(labels)
        step = key >> np.uint64(32)
        of = step % np.uint64(len(sizes))
        mixed = ((key & np.uint64(0xFFFFFFFF)) + (step // np.uint64(len(sizes))) * np.uint64(0xD1342543DE82EF95)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0x94D049BB133111EB)
    short, of = _distinct((mixed >> np.uint64(32)).astype(np.uint32), of)
    return short, np.searchsorted(of, np.arange(len(sizes) + 1))


def _distinct(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each 32-bit value of an owner once, in order of owners and values."""
    key = np.sort(owner.astype(np.uint64) << np.uint64(32) | values)
    key = key[np.r_[True, key[1:] != key[:-1]][: len(key)]]
    return key.astype(np.uint32), (key >> np.uint64(32)).astype(np.int64)


def band_keys(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """One key for each set and band, the band's number above 32 bits of hash; the sets must not be empty."""
    lows = np.empty((BANDS * ROWS, len(begins)), np.uint64)
    out = np.empty((BANDS, len(begins)), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(BANDS * ROWS):
            lows[k] = np.minimum.reduceat(values * _SEEDS[k] + _SHIFTS[k], begins)
        for band in range(BANDS):
            h = np.full(len(begins), band + 1, np.uint64)
            for k in range(ROWS):
                h = (h ^ lows[band * ROWS + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out[band] = np.uint64(band << 32) | h >> np.uint64(32)
    return out.T.copy().view(np.int64)


def parity_bitmaps(values: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """``WORDS`` words for each set; a bit tells whether an odd number of values falls on it.

    Values that only one of two sets holds are the only ones that make their bitmaps differ, each in one bit at most, so the
    number of bits that differ is never above the number of such values.
    """
    bits = WORDS * 64
    with np.errstate(over="ignore"):
        at = (values * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits.bit_length() + 1)
    odd = np.bincount(owner * bits + at, minlength=rows * bits).astype(np.uint8) & 1
    return np.packbits(odd.reshape(rows, bits), axis=1).view(np.int64)


_OPENS = (("/*", "*/"), ('"""', '"""'), ("'''", "'''"), ("<!--", "-->"))


def head_marker(text: str) -> int | None:
    """What the comments before the first line of code say about the file's origin: 1 generated, 2 vendored."""
    if not _HEAD_LINE.match(text):
        return None
    closes = None
    for line in _LINES.findall(text):
        bare = line.strip()
        if not bare:
            continue
        if closes is None:
            m = _HEAD_LINE.match(line)
            if not m:
                return None
            closes = next((end for start, end in _OPENS if bare.startswith(start) and end not in bare[len(start) :]), None)
            said = m[1]
        else:
            said = bare
            if closes in bare:
                closes = None
        if _GENERATED_HEAD.search(said):
            return 1
        if _VENDORED_HEAD.search(said):
            return 2
    return None


_SUMS = ("chars", "literal_chars", "spaces", "lines", "tokens", "idents")
_FEATURES = "file_id string, start_line int, head int, " + ", ".join(f"{c} bigint" for c in _SUMS) + ", shingles array<int>, names array<int>"


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.astype(np.uint32, copy=False).view(np.int32)))


def excerpt_features(chunks: DataFrame) -> DataFrame:
    """One row for each excerpt, or for each file of a batch that holds many excerpts of the same; the text itself is never shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [f.split()[0] for f in _FEATURES.split(", ")]
        kinds = (pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * len(_SUMS))
        codes, known = _Codes(), _Names()
        for whole in batches:
            for batch in _slices(whole, "content", CHARS_AT_ONCE):
                if len(known) > 500_000:
                    codes, known = _Codes(), _Names()
                ids, starts, texts = (c.to_pylist() for c in batch.columns)
                texts = [t or "" for t in texts]
                lexed = masked(texts, codes, known)
                shingles, ends = shingle_sets(lexed.codes, lexed.sizes)
                names, name_ends = lexed.names, np.searchsorted(lexed.name_of, np.arange(len(texts) + 1))
                rows = list(
                    zip(ids, starts, map(head_marker, texts), map(len, texts), lexed.literal_chars.tolist(), (t.count(" ") + t.count("\t") for t in texts), (max(1, sum(map(bool, map(str.strip, t.splitlines())))) for t in texts), lexed.sizes.tolist(), lexed.identifiers.tolist())
                )
                place: dict[str, int] = {}
                of = np.array([place.setdefault(i, len(place)) for i in ids])
                if len(place) <= len(rows) // 2:
                    rows = _merged(rows, of, len(place))
                    shingles, owner = _distinct(shingles, np.repeat(of, np.diff(ends)))
                    ends = np.searchsorted(owner, np.arange(len(place) + 1))
                    names, owner = _distinct(names, of[lexed.name_of])
                    name_ends = np.searchsorted(owner, np.arange(len(place) + 1))
                cols = [pa.array(list(c), kind) for c, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([*cols, _lists(shingles, ends), _lists(names, name_ends)], names=columns)

    return chunks.select(F.col("file_id").cast("string"), F.col("start_line").cast("int"), "content").filter("file_id is not null").mapInArrow(run, _FEATURES)


def _merged(rows: list[tuple], of: np.ndarray, n: int) -> list[tuple]:
    """One row for each file: the head of its first excerpt and the sums of the rest."""
    out: list[tuple | None] = [None] * n
    for row, k in zip(rows, of.tolist()):
        old = out[k]
        if old is None:
            out[k] = row
            continue
        first = min(old, row, key=lambda r: (r[1] is None, r[1] or 0))
        out[k] = (row[0], first[1], first[2], *(x + y for x, y in zip(old[3:], row[3:])))
    return out


_SKETCH = ", n int, k1 bigint, k2 bigint, name_key bigint, bands array<bigint>, bitmap binary"


def sketched(files: DataFrame) -> DataFrame:
    """The files with their sets made distinct, and for each set its size, two hashes of it, one of the names, its bands and its bitmap."""
    names = [c for c in files.columns if c not in ("shingles", "names")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, "shingles", AT_ONCE):
                sets, owner, ends = _rows_of(batch.column("shingles"))
                idents, _, ident_ends = _rows_of(batch.column("names"))
                rows = batch.num_rows
                filled = np.flatnonzero(np.diff(ends))
                digests = np.zeros((rows, 2), np.int64)
                for k in filled.tolist():
                    digests[k] = np.frombuffer(blake2b(sets[ends[k] : ends[k + 1]].tobytes(), digest_size=16).digest(), np.int64)
                name_keys = [int.from_bytes(blake2b(idents[a:b].tobytes(), digest_size=8).digest(), "little", signed=True) if b > a else None for a, b in zip(ident_ends[:-1].tolist(), ident_ends[1:].tolist())]
                bands, band_ends = np.empty(0, np.int64), np.cumsum(np.r_[0, np.where(np.diff(ends) > 0, BANDS, 0)])
                tags = np.zeros((rows, BANDS), np.uint32)
                if len(filled):
                    keys = band_keys(sets, ends[filled])
                    bands, tags[filled] = keys.ravel(), keys.astype(np.uint32)
                bitmaps = parity_bitmaps(sets, owner, rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in names),
                        _lists(sets, ends),
                        _lists(idents, ident_ends),
                        pa.array(np.diff(ends), pa.int32()),
                        pa.array(digests[:, 0].copy()),
                        pa.array(digests[:, 1].copy()),
                        pa.array(name_keys, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(band_ends, pa.int32()), pa.array(bands)),
                        pa.array([x.tobytes() + y.tobytes() for x, y in zip(bitmaps, tags)], pa.binary()),
                    ],
                    names=[*names, "shingles", "names", *(x.split()[0] for x in _SKETCH[2:].split(", "))],
                )

    ordered = files.select(*names, "shingles", "names")
    return ordered.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema) + _SKETCH)


def _rows_of(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each list, the list of each, and where each list begins; null lists are empty."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint32)
    values, owner = _distinct(flat, np.repeat(np.arange(len(column)), sizes))
    return values, owner, np.searchsorted(owner, np.arange(len(column) + 1))


def _slices(batch: pa.RecordBatch, name: str, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose lists, or texts, hold about so many values together; a longer one stays whole."""
    column = batch.column(name)
    lengths = pc.binary_length(column) if pa.types.is_string(column.type) else column.value_lengths()
    sizes = np.cumsum(lengths.fill_null(0).to_numpy(zero_copy_only=False))
    first, done = 0, 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(sizes, done + most, "right")))
        yield batch.slice(first, last - first)
        first, done = last, int(sizes[last - 1])


def _path_kind(path: Column) -> Column:
    p = F.translate(path, "\\", "/")
    return F.when(p.rlike(LOCK), "generated").when(~p.rlike(CODE), None).when(p.rlike(VENDORED_PATH), "vendored").when(p.rlike(GENERATED_PATH), "generated").when(p.rlike(MINIFIED_PATH), "minified")


def judged_files(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file_id, project_id, own, cluster, cluster_kind, verdict, by): all code and lock files; verdict is null for files written by hand.

    ``own`` is what the file says of itself; ``by`` is 'cluster', 'path', 'head' or 'shape', whichever gave the verdict.
    """
    f = files.filter("id is not null and relative_path is not null").groupBy(F.col("id").alias("file_id")).agg(F.first("project_id").alias("project_id"), F.first("relative_path").alias("path"))
    p = F.translate(F.col("path"), "\\", "/")
    f = f.filter(p.rlike(CODE) | p.rlike(LOCK)).select("file_id", "project_id", p.rlike(CODE).alias("is_code"), _path_kind(F.col("path")).alias("path_kind"))
    # excerpts of other files are left out before they are lexed, if the ids are few enough to send; else they drop out later
    ids = materialise(f.select("file_id"), "ids")
    read = chunks.join(F.broadcast(ids), "file_id", "left_semi") if estimated_bytes(ids) <= BROADCAST_BYTES else chunks
    whole = excerpt_features(read).groupBy("file_id").agg(
        F.min_by("head", F.col("start_line")).alias("head"),
        *[F.sum(c).alias(c) for c in _SUMS],
        F.flatten(F.collect_list("shingles")).alias("shingles"),
        F.flatten(F.collect_list("names")).alias("names"),
    )
    data = (F.col("chars") >= 300) & (F.col("literal_chars") >= 0.6 * F.col("chars")) & (F.col("idents") <= 0.12 * F.col("tokens"))
    dense = (F.col("chars") >= 300) & (F.col("chars") >= 220 * F.col("lines")) & (F.col("spaces") <= 0.08 * F.col("chars"))
    known = f.join(whole, "file_id", "left").select("file_id", "project_id", "path_kind", F.when(F.col("is_code"), F.col("head")).alias("head"), F.coalesce(F.col("is_code") & data, F.lit(False)).alias("literal"), F.coalesce(F.col("is_code") & dense, F.lit(False)).alias("dense"), "tokens", "shingles", "names")
    judged = materialise(sketched(known).withColumn("uid", F.monotonically_increasing_id()), "files")

    # files with equal sets are one class, represented by its smallest number
    classes = judged.filter("n > 0").groupBy("k1", "k2").agg(F.min("uid").alias("rep"), F.min("project_id").alias("p0"), F.max("project_id").alias("p1"), F.count("*").alias("members"))
    placed = materialise(judged.select("uid", "file_id", "project_id", "path_kind", "head", "literal", "dense", "tokens", "name_key", "k1", "k2").join(classes, ["k1", "k2"], "left").drop("k1", "k2"), "classes")
    home = F.when(F.col("p0") == F.col("p1"), F.xxhash64("p0"))
    reps = placed.filter("uid = rep").select("uid", home.alias("home"))
    links = materialise(_candidates(judged.join(reps, "uid").select("uid", "home", "n", "bands", "bitmap")), "candidates")
    sets = judged.select("uid", "shingles", "names", "tokens", "name_key")
    verified, clusters = _clusters(links, sets)
    copied = _copied(verified.filter("across"), sets)

    # files that agree in all names with a file of their class in another repository, or whose class has a link that does
    same = placed.filter("members > 1 and name_key is not null").groupBy("rep", "name_key").agg((F.min("project_id") != F.max("project_id")).alias("twin"))
    of = placed.join(clusters, placed["rep"] == clusters["node"], "left").drop("node").join(same, ["rep", "name_key"], "left").join(copied, "rep", "left")
    evidence = F.coalesce("path_kind", F.when(F.col("head") == 1, "generated").when(F.col("head") == 2, "vendored"), F.when(F.col("literal"), "data").when(F.col("dense"), "minified"))
    source = F.when(F.col("path_kind").isNotNull(), "path").when(F.col("head").isNotNull(), "head").when(F.col("literal") | F.col("dense"), "shape")
    of = of.select("file_id", "project_id", "literal", "dense", "tokens", evidence.alias("own"), source.alias("source"), F.coalesce("component", F.when(F.col("members") > 1, F.col("rep"))).alias("number"), (F.coalesce("twin", F.lit(False)) | F.coalesce(F.col("name_key") == F.col("copied_key"), F.lit(False))).alias("copied"))
    of = materialise(of, "placed")
    share = lambda c: F.avg(F.col(c).cast("int")).alias(c)
    stats = of.filter("number is not null").groupBy("number").agg(F.min("file_id").alias("cluster"), F.count("*").alias("n"), F.avg("tokens").alias("tokens"), F.min("project_id").alias("p0"), F.max("project_id").alias("p1"), share("literal"), share("dense"), share("copied"), F.avg(F.col("own").isNotNull().cast("int")).alias("evidence"), F.mode("own", True).alias("usual"))
    enough = F.col("n") >= F.when(F.col("tokens") < SMALL_TOKENS, FAMILY[1]).otherwise(FAMILY[0])
    kind = (
        F.when(F.col("literal") >= 0.5, "data")
        .when(F.col("dense") >= 0.5, "minified")
        .when((F.col("p0") != F.col("p1")) & (F.col("copied") >= 0.5), "vendored")
        .when((F.col("p0") == F.col("p1")) & enough, "generated")
        .when(enough & (F.col("evidence") >= 0.6), F.col("usual"))
    )
    found = of.join(stats.select("number", "cluster", kind.alias("cluster_kind")), "number", "left")
    return found.select("file_id", "project_id", "own", "cluster", "cluster_kind", F.coalesce("cluster_kind", "own").alias("verdict"), F.when(F.col("cluster_kind").isNotNull(), "cluster").otherwise(F.col("source")).alias("by"))


def _candidates(sets: DataFrame) -> DataFrame:
    """(a, b, across, apart) of classes that share a band and may be similar, a < b.

    Every pair of a band is looked at, in blocks of bounded size. It ends here if the sets' sizes or the bits in which their
    bitmaps differ (``apart``) rule out the similarity; neither test ever ends a pair that has it. A pair is given in the first
    of the bands it shares only, so it comes once: the keys of all bands travel with the bitmap.
    """
    counts = sets.select(F.explode("bands").alias("band")).groupBy("band").agg(F.count("*").alias("many")).filter(F.col("many") > BLOCK)
    crowded = broadcast_if_small(counts.select("band", F.ceil(F.col("many") / BLOCK).cast("int").alias("blocks")), "crowded")
    dealt = sets.select("uid", "home", "n", "bitmap", F.explode("bands").alias("band")).join(crowded, "band", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("uid"), "blocks").cast("int")).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # one number for each band and pair of blocks; should two ever fall together, their rows only meet needlessly
    group = F.when(F.col("blocks") == 1, F.col("band")).otherwise(F.xxhash64("band", F.least("block", "at"), F.greatest("block", "at")))
    dealt = dealt.select(group.alias("group"), (F.col("block") == F.col("at")).alias("within"), "block", F.shiftright("band", 32).cast("int").alias("nth"), "uid", F.coalesce("home", F.lit(0).cast("bigint")).alias("home"), "n", "bitmap")
    return dealt.repartition("group").sortWithinPartitions("group").mapInArrow(_meetings, "a bigint, b bigint, across boolean, apart int")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the rows that stand together in one group; no more rows than two blocks are kept besides the batch."""
    kept = None
    for batch in chain(batches, [None]):
        if batch is not None:
            sketch = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint8).reshape(-1, 8 * WORDS + 4 * BANDS)
            words, tags = np.ascontiguousarray(sketch[:, : 8 * WORDS]).view(np.uint64), np.ascontiguousarray(sketch[:, 8 * WORDS :]).view(np.uint32)
            cols = [*(batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)), words, tags]
            kept = cols if kept is None else [np.concatenate(x) for x in zip(kept, cols)]
        if kept is None or not len(kept[0]):
            continue
        group = np.cumsum(np.r_[True, kept[0][1:] != kept[0][:-1]])
        ready = len(group) if batch is None else int(np.searchsorted(group, group[-1]))
        found = _pairs_of(group[:ready], [x[:ready] for x in kept[1:]])
        kept = None if batch is None else [x[ready:] for x in kept]
        if len(found[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b", "across", "apart"])


def _pairs_of(group: np.ndarray, cols: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(a, b, across, apart) of all rows of one group with one another; each row meets the one so many places on, as long as any group is so long."""
    within, block, nth, uid, home, n, words, tags = cols
    out: list[list[np.ndarray]] = [[], [], [], []]
    left = np.arange(len(group))
    for step in range(1, len(group)):
        left = left[left + step < len(group)]
        left = left[group[left] == group[left + step]]
        if not len(left):
            break
        i, j = left, left + step
        # a pair of one block meets in that block's own group only; there all rows are within their block
        fits = ((within[i] & within[j]) | (block[i] != block[j])) & (np.minimum(n[i], n[j]) >= SIMILARITY * np.maximum(n[i], n[j]) - 1e-9)
        i, j = i[fits], j[fits]
        apart = np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int32)
        near = apart <= (1 - SIMILARITY) / (1 + SIMILARITY) * (n[i] + n[j]) + 1e-9
        i, j, apart = i[near], j[near], apart[near]
        once = (tags[i] == tags[j]).argmax(axis=1) == nth[i]
        i, j, apart = i[once], j[once], apart[once]
        for have, more in zip(out, (np.minimum(uid[i], uid[j]), np.maximum(uid[i], uid[j]), (home[i] != home[j]) | (home[i] == 0), apart)):
            have.append(more)
    return tuple(np.concatenate(x) if x else np.empty(0, kind) for x, kind in zip(out, (np.int64, np.int64, bool, np.int32)))


def _verify(links: DataFrame, sets: DataFrame, what: str = "shingles", least: str | None = None) -> DataFrame:
    """The links whose sets have the similarity, exactly; ``least`` names a column of the links that holds another one."""
    names = links.columns
    left, right = sets.select(F.col("uid").alias("a"), F.col(what).alias("x")), sets.select(F.col("uid").alias("b"), F.col(what).alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, "x", AT_ONCE):
                sizes, keys = [], []
                for side in ("x", "y"):
                    column = batch.column(side)
                    sizes.append(column.value_lengths().to_numpy())
                    owner = np.repeat(np.arange(len(column), dtype=np.uint64), sizes[-1])
                    keys.append(owner << np.uint64(32) | column.flatten().to_numpy().view(np.uint32))
                at = np.searchsorted(keys[0], keys[1])
                found = at < len(keys[0])
                found[found] = keys[0][at[found]] == keys[1][found]
                shared = np.bincount((keys[1][found] >> np.uint64(32)).astype(np.int64), minlength=batch.num_rows)
                enough = SIMILARITY if least is None else batch.column(least).to_numpy()
                yield batch.select(names).filter(pa.array((shared > 0) & (shared >= enough * (sizes[0] + sizes[1] - shared) - 1e-9)))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in links.schema)
    return links.join(left, "a").join(right, "b").select(*names, "x", "y").mapInArrow(run, schema)


#: Rounds in which only the nearest candidates are verified; those that are left then are verified all.
NEAREST_ROUNDS = 2


def _clusters(links: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b, across), and (node, component) over all candidates that have the similarity.

    First each class is verified against its nearest candidate, and the nearest in another repository; then the nearest
    candidate between any two components, and at last every candidate that still leads from one component to another. A
    candidate inside a component needs no verification, as it cannot change the components.
    """
    # the distance first, then a hash that breaks ties; the last bit tells whether the link leads to another repository
    order = F.shiftleft(F.col("apart").cast("bigint"), 32) + F.shiftleft(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 31) - 1)), 1) + F.col("across").cast("bigint")
    left = links.select("a", "b", order.alias("order"), F.col("a").alias("p"), F.col("b").alias("q"))
    abroad = F.col("order").bitwiseAND(F.lit(1)) == 1
    verified, clusters = [], None
    for round_ in range(NEAREST_ROUNDS + 1):
        tried = left.select("a", "b", abroad.alias("across"), "p", "q")
        if round_ == 0:
            ends = left.select(F.col("a").alias("x"), F.col("b").alias("y"), "order").union(left.select("b", "a", "order"))
            best = ends.groupBy("x").agg(F.min_by("y", "order").alias("y"), F.min("order").alias("order"), F.min_by("y", F.when(abroad, F.col("order"))).alias("y2"), F.min(F.when(abroad, F.col("order"))).alias("order2"))
            picked = best.select("x", "y", "order").union(best.select("x", "y2", "order2")).filter("y is not null")
            picked = picked.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), abroad.alias("across")).distinct()
            tried = picked.select("*", F.col("a").alias("p"), F.col("b").alias("q"))
        elif round_ < NEAREST_ROUNDS:
            best = left.groupBy(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).agg(F.min_by("a", "order").alias("a"), F.min_by("b", "order").alias("b"), F.min("order").alias("order"))
            tried = best.select("a", "b", abroad.alias("across"), "p", "q")
        tried = materialise(tried, "nearest")
        similar = materialise(_verify(tried, sets), "similar")
        verified.append(similar.select("a", "b", "across"))
        merged = materialise(connected_components(similar, "p", "q"), "merged")
        if clusters is None:
            clusters = merged
        else:
            moved = merged.select(F.col("node").alias("component"), F.col("component").alias("into"))
            fresh = merged.join(clusters.select("node"), "node", "left_anti")
            clusters = materialise(clusters.join(moved, "component", "left").select("node", F.coalesce("into", "component").alias("component")).unionByName(fresh), "clusters")
        if round_ == NEAREST_ROUNDS:
            break
        at = lambda c: merged.select(F.col("node").alias(c), F.col("component").alias(f"{c}_at"))
        rest = left.join(tried.select("a", "b"), ["a", "b"], "left_anti").join(at("p"), "p", "left").join(at("q"), "q", "left")
        rest = rest.select("a", "b", "order", F.coalesce("p_at", "p").alias("p"), F.coalesce("q_at", "q").alias("q")).filter("p != q")
        left = materialise(rest, "left")
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, verified), clusters


def _copied(links: DataFrame, sets: DataFrame) -> DataFrame:
    """(rep, copied_key): classes linked to one of another repository with which they have their identifiers in common; the key of these."""
    size = lambda c: sets.select(F.col("uid").alias(c), F.col("tokens").alias(f"{c}_tokens"))
    least = F.when(F.least("a_tokens", "b_tokens") < SMALL_TOKENS, COPIED[1]).otherwise(COPIED[0])
    sized = links.select("a", "b").distinct().join(size("a"), "a").join(size("b"), "b").select("a", "b", least.alias("least"))
    alike = _verify(sized, sets, "names", "least")
    ends = alike.select(F.col("a").alias("uid")).union(alike.select(F.col("b").alias("uid"))).distinct()
    return ends.join(sets.select("uid", "name_key"), "uid").select(F.col("uid").alias("rep"), F.col("name_key").alias("copied_key"))
