"""Languages of texts and of the segments of mixed texts.

A text is cleared of what is not natural language (harness blocks, code,
configuration, commands, comments, paths, identifiers, addresses, credentials,
hashes, numbers, commit prefixes) and cut into segments at line ends, sentence
ends and marked joins. A segment's words are hashed into subword buckets whose
embeddings are averaged; a linear softmax over the average gives the language.
Embeddings and softmax are trained together by stochastic gradient descent in
numpy, on at most ``SAMPLE`` labelled rows; on a held-out part of these rows
the temperature, the threshold of rejection and the least share of known words
are fitted. A segment below either is in none of the languages (``OTHER``).

The sample is the only thing that is fitted on part of the data, and the only
thing that reaches the driver; every text of every table is then classified
whole, in one narrow stage.

Result on odd input: null, empty and blank texts and texts without natural
language give no row, a segment in no known language has ``OTHER``; repeated rows count once; labels
differ only by letter case or region suffix when they mean the same; a tie of
probabilities goes to the alphabetically first language; extra columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("de", "en", "es", "fr", "ja", "ko")
#: The outcome for a segment in none of the languages.
OTHER = "und"
#: Words from which on a segment's share of known words is judged. The limit is half of what all but this share of the held-out segments have.
NOVEL_WORDS, NOVEL = 4, 0.002
SAMPLE = 12_000
BUCKETS, DIM, EPOCHS, BATCH, RATE, SEED = 1 << 15, 16, 4, 64, 0.6, 7
#: How often a character's script counts beside its other pieces.
SCRIPT = 4
#: A word counts as known from so many training rows on; a segment of one known word is enough, of unknown words two.
KNOWN = 4

#: A Latin segment of at most so many words and less than this confidence is doubtful.
DOUBT_WORDS, DOUBT = 6, 0.6

_HARNESS = re.compile(r"(?is)<([a-z]+(?:-[a-z]+)+|command|caveat|environment|stdin|stdout|stderr|instructions)(?:\s[^<>]*+)?>.*?(?:</\1\s*>|\Z)|\[request (?:was )?(?:interrupted|aborted|cancell?ed)[^\]]*\]|\(no content\)")
_FENCE = re.compile(r"(?s)```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)")
_INLINE = re.compile(r"`[^`\n]*`")
_BREAK = re.compile(r"\s+|(?<=[。！？])(?=\S)")
_JOINS = frozenset("/|—–•;")
_CLOSERS = "\"')]"
_QUOTE = re.compile(r"^\s*(?:[>/|—–•;]+\s+|[-*+]\s+|\d+[.)]\s+)+")
_PREFIX = re.compile(r"^\s*(?:(?:feat|fix|docs?|chore|perf|refactor|test|tests|build|ci|style|revert|wip|hotfix|release|merge)(?:\([^)]*\))?!?:\s+|\[[^\]\n]{1,30}\]\s*)+", re.I)
_CODE_SEGMENT = re.compile(
    r"^\s*(?:#|//|/\*|\*/|<!--|--\s|\$\s|%\s|>>>|export\s+\w+=|(?:sudo\s+)?(?:curl|wget|git|ssh|scp|docker|kubectl|npm|pip|make|cd|psql|mysql|deploy|python\d?|node)\s+[-\w./\"']|ssh-(?:rsa|ed25519|dss)\s|-----(?:BEGIN|END)|[A-Za-z0-9+/=]{40,}\s*$"
    r"|(?:const|let|var|val|def|func|fn|function|class|import|from|return|public|private|String|int|using|package|use)\s+[\w.$*{]+.*[;={}()]\s*$"
    r"|[\w.$\[\]\"'-]+\s*(?::=|=>|==?|\+=)\s*\S|[A-Za-z](?=\w*_)\w*+\s*:\s*\S+\s*,?$|[\"']?[A-Za-z_][\w.-]*[\"']?\s*:\s*(?:[\"']?[a-z][a-z0-9+.-]*://\S+$|[\"'{\[$].*|(?=[\w./+=*!?#%@&$^-]*[\d_/+=*!#%@&$^{}])\S++\s*,?|true|false|null|)\s*,?$|[\w.$]+\([^()]*\)\s*[;,{]?\s*$|[\w.$]+\((?=[^=]*+=).*\)\s*;?\s*$|[{}\[\](),;]+\s*$)"
)
_COMMAND = re.compile(r"\(\s*(?:curl|wget|git|ssh|docker|kubectl|npm|pip)\b.*?(?:\)|\Z)|(?:^|\s)(?:curl|wget)\s+-.*$")
_RUN = re.compile(r"\S+")
#: A run that holds one of these is no word at all: two separators of a path, a scope, a sign before a letter or digit.
_NO_WORD = re.compile(r"[/\\]\S*[/\\.]|::|[!?*#%&+][A-Za-z0-9]")
#: What is taken out of other runs; each branch begins where a word begins, so that no part is looked at twice.
_NOT_WORDS = re.compile(
    r"(?<![\w.+-])[\w.+-]++@[\w-]+\.\w+\b|(?<![^(\[\"'])[\w-]++\.(?:py|ts|tsx|js|jsx|go|rs|java|md|json|ya?ml|toml|lock|sum|conf|env|sh|txt|cfg)\b(?::\d+)?|\b\w*_\w+\b|\b[a-z]+[A-Z]\w*|\b[A-Z][a-z]+[A-Z]\w*|\b(?=[A-Za-z]*\d)[A-Za-z0-9]{2,}\b|(?<![\w-])--?[\w-]++=\S+|(?<![\w-])[\w-]++\([^()]*+\)|[$%{}<>=\[\]|\\^~#]\S*"
)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


def _cut(text: str) -> Iterator[str]:
    """Parts of a text between line ends, sentence ends and marked joins."""
    start = skip = 0
    for m in _BREAK.finditer(text):
        at, end = m.span()
        if at < skip:
            continue
        if at == end:
            yield text[start:at]
            start = at
            continue
        stop = at
        while stop > start and text[stop - 1] in _CLOSERS:
            stop -= 1
        if "\n" in m[0] or "\r" in m[0]:
            yield text[start:at]
            start = end
        elif stop > start and text[stop - 1] in ".!?。！？":
            yield text[start:stop]
            start = end
        elif text[end : end + 1] in _JOINS and text[end + 1 : end + 2].isspace():
            yield text[start:at]
            start = skip = end + 1
    yield text[start:]


def _words_of(part: str) -> list[str]:
    kept = _RUN.sub(lambda m: " " if _NO_WORD.search(m[0]) else _NOT_WORDS.sub(" ", m[0]), _COMMAND.sub(" ", part))
    return [w.lower() for w in _WORD.findall(kept)]


def segments(text: str | None) -> list[tuple[str, list[str]]]:
    """(segment, words) of the natural language in a text."""
    if not text:
        return []
    text = _INLINE.sub(" ", _FENCE.sub("\n", _HARNESS.sub("\n", text)))
    out = []
    for part in _cut(text):
        part = _PREFIX.sub("", _QUOTE.sub("", part))
        if not part.strip() or _CODE_SEGMENT.match(part):
            continue
        words = _words_of(part)
        if words:
            out.append((part.strip(), words))
    return out


def usable(label: str | None) -> str | None:
    """The two-letter code of a label; None if it names none of the languages."""
    code = re.split(r"[-_]", (label or "").strip().lower())[0]
    return code if code in LANGUAGES else None


def _script(c: str) -> str:
    """The block of a character, as a piece of its own."""
    return "\x01kana" if "\u3040" <= c <= "\u30ff" else "\x01hangul" if "\uac00" <= c <= "\ud7a3" or "\u1100" <= c <= "\u318f" else f"\x01{ord(c) >> 8}"


def subwords(word: str) -> list[int]:
    """Buckets of a word and its pieces of two to four characters."""
    marked = f"<{word}>"
    pieces = [marked] + [marked[i : i + n] for n in (2, 3, 4) for i in range(len(marked) - n + 1)]
    if not word.isascii():
        pieces += list(word)
        pieces += [_script(c) for c in word if c > "\u02ff"] * SCRIPT  # characters never seen before still tell their script
    return [zlib.crc32(p.encode("utf-8", "replace")) % BUCKETS for p in pieces]


class Guess(NamedTuple):
    lang: str | None
    confidence: float


class LanguageModel:
    """Averaged hashed subword embeddings with a linear softmax."""

    def __init__(self, table: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float, threshold: float, known: frozenset[int], least_known: float = 0.0):
        self.table, self.weights, self.bias, self.temperature, self.threshold, self.known, self.least_known = table, weights, bias, temperature, threshold, known, least_known
        self._cache: dict[str, tuple[np.ndarray, int, bool]] = {}

    def __getstate__(self):
        return {**self.__dict__, "_cache": {}}

    def save(self, path: str) -> None:
        """To one file, from which ``load`` gives the same model, so that it need not be fitted again."""
        np.savez_compressed(path, table=self.table, weights=self.weights, bias=self.bias, fitted=[self.temperature, self.threshold, self.least_known], known=np.array(sorted(self.known), np.uint32))

    @classmethod
    def load(cls, path: str) -> LanguageModel:
        with np.load(path) as f:
            temperature, threshold, least_known = f["fitted"].tolist()
            return cls(f["table"], f["weights"], f["bias"], temperature, threshold, frozenset(f["known"].tolist()), least_known)

    def _word(self, w: str) -> tuple[np.ndarray, int, bool]:
        found = self._cache.get(w)
        if found is None:
            pieces = subwords(w)
            if len(self._cache) > 100_000:
                self._cache.clear()
            found = self._cache[w] = ((self.table[pieces] @ self.weights).sum(0), len(pieces), zlib.crc32(w.encode()) in self.known)
        return found

    def probabilities(self, words: Sequence[str]) -> np.ndarray:
        parts = [self._word(w) for w in words]
        z = (sum(p[0] for p in parts) / sum(p[1] for p in parts) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def guess(self, words: Sequence[str]) -> Guess:
        known = sum(self._word(w)[2] for w in words)
        if not known and len(words) < 3 and all(w.isascii() for w in words):
            return Guess(None, 0.0)  # a name rather than a phrase
        p = self.probabilities(words)
        best = int(np.argmax(p))
        # words of other scripts carry particles and are seldom met again, so only their confidence counts
        stranger = not known and all(w < "\u0300" for w in words)
        novel = len(words) >= NOVEL_WORDS and (stranger or (known < self.least_known * len(words) and p[best] < DOUBT))
        if p[best] < self.threshold or novel:
            return Guess(OTHER, float(p[best]))
        return Guess(LANGUAGES[best], float(p[best]))


def train(rows: Sequence[tuple[str, str]]) -> LanguageModel:
    """Fit a model to (text, label) rows; labels may be partly wrong."""
    known: Counter[int] = Counter()
    features, labels, hashed = [], [], []
    for text, label in rows:
        code, parts = usable(label), segments(text)
        if code is None or not parts:
            continue
        known.update({zlib.crc32(w.encode()) for _, words in parts for w in words})
        for _, words in parts:
            features.append(np.array([b for w in words for b in subwords(w)], np.int64))
            labels.append(LANGUAGES.index(code))
            hashed.append([zlib.crc32(w.encode()) for w in words])
    rng = np.random.default_rng(SEED)
    n, k = len(features), len(LANGUAGES)
    table, weights, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, k)), np.zeros(k)
    y = np.array(labels, np.int64)
    order = rng.permutation(n)
    held, fit = order[: n // 10], order[n // 10 :]

    def averaged(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(features[i]) for i in ids])
        flat = np.concatenate([features[i] for i in ids])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return np.add.reduceat(table[flat], starts, axis=0) / sizes[:, None], flat, sizes

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    steps = max(1, EPOCHS * (len(fit) // BATCH + 1))
    step = 0
    for _ in range(EPOCHS if len(fit) else 0):
        rng.shuffle(fit)
        for at in range(0, len(fit), BATCH):
            ids = fit[at : at + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            h, flat, sizes = averaged(ids)
            g = softmax(h @ weights + bias)
            g[np.arange(len(ids)), y[ids]] -= 1
            back = (g @ weights.T) / sizes[:, None]
            weights -= rate * h.T @ g / len(ids) * 4
            bias -= rate * g.mean(0)
            # a bucket's step is damped by how often it occurs in the batch and bounded, so that common pieces stay stable
            buckets, place, times = np.unique(flat, return_inverse=True, return_counts=True)
            gradient = np.zeros((len(buckets), DIM))
            np.add.at(gradient, place, np.repeat(back, sizes, axis=0))
            move = 16 * rate * gradient / np.sqrt(times)[:, None]
            table[buckets] -= move * np.minimum(1.0, 0.5 / np.maximum(np.linalg.norm(move, axis=1, keepdims=True), 1e-12))
    temperature, threshold = 1.0, 0.5
    if len(held) >= 50:
        z = averaged(held)[0] @ weights + bias
        grid = np.geomspace(0.25, 4, 25)
        loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(held)), y[held]], 1e-3)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
        p = softmax(z / temperature)
        threshold = rejection(p.max(1), p.argmax(1) == y[held])
    common = frozenset(w for w, c in known.items() if c >= KNOWN)
    least_known = 0.0
    shares = np.array([np.mean([h in common for h in hashed[i]]) for i in held if len(hashed[i]) >= NOVEL_WORDS])
    if len(shares) >= 50:
        least_known = float(np.quantile(shares, NOVEL)) / 2
    return LanguageModel(table.astype(np.float32), weights.astype(np.float32), bias.astype(np.float32), temperature, threshold, common, least_known)


def rejection(sure: np.ndarray, right: np.ndarray, bins: int = 40, least: int = 50) -> float:
    """The confidence below which a guess is less likely right than wrong.

    Labels themselves are partly wrong, so the share that agrees among the surest half stands for certainty. Guesses are taken
    in bins of equal numbers, of ``least`` or more, from the least sure on; the threshold is the end of the last bin of which less than half is right. Where
    there is none, it is the least confidence seen, or a half where all were surer than that.
    """
    order = np.argsort(sure, kind="stable")
    certain = max(right[order[len(order) // 2 :]].mean(), 1e-9)
    parts = [part for part in np.array_split(order, max(1, min(bins, len(order) // least))) if len(part)]
    doubtful = [k for k, part in enumerate(parts[: len(parts) // 2]) if right[part].mean() / certain < 0.5]
    return float(sure[parts[doubtful[-1]]].max()) if doubtful else min(float(sure.min()), 0.5)


def sample(rows: DataFrame, key: str, text: str, label: str, size: int = SAMPLE) -> list[tuple[str, str]]:
    """At most ``size`` labelled rows, chosen by a hash of their key; about twice as many leave the tasks at most."""
    labelled = rows.filter(F.lower(F.substring_index(F.regexp_replace(F.trim(label), "_", "-"), "-", 1)).isin(*LANGUAGES)).filter(F.col(text).isNotNull())
    hashed = labelled.select(text, label, F.xxhash64(key, text).alias("__h"))
    there = hashed.count()
    if there > 2 * size:
        hashed = hashed.filter(F.pmod("__h", F.lit(1_000_000_007)) < int(1_000_000_007 * min(1.0, 1.5 * size / there)))
    chosen = hashed.orderBy("__h", text, label).limit(size)
    return [(r[0], r[1]) for r in chosen.collect()]


def text_languages(model: LanguageModel, text: str | None) -> list[tuple[str, str, float]]:
    """(segment, language, confidence) of each segment, ``OTHER`` for what is rejected; a short doubtful one goes with the nearest sure one if that is likely enough."""
    found = [(part, words, g) for part, words in segments(text) if (g := model.guess(words)).lang is not None]
    sure = [i for i, (_, words, g) in enumerate(found) if g.lang != OTHER and not _doubtful(words, g)]
    out = []
    for i, (part, words, g) in enumerate(found):
        if g.lang != OTHER and sure and _doubtful(words, g):
            k = bisect_left(sure, i)
            other = found[min(sure[max(k - 1, 0) : k + 1], key=lambda j: (abs(j - i), j))][2].lang
            p = float(model.probabilities(words)[LANGUAGES.index(other)])
            if p >= 0.25 * g.confidence:
                g = Guess(other, p)
        out.append((part, g.lang, g.confidence))
    return out


def _doubtful(words: list[str], g: Guess) -> bool:
    return g.confidence < DOUBT and len(words) <= DOUBT_WORDS and all(w < "\u0300" for w in words)


def segment_languages(rows: DataFrame, key: Column, text: Column, label: Column, model: LanguageModel) -> DataFrame:
    """(row_key, label, segment, text, lang, confidence): one row for each segment with a language."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # of fixed size: the buckets times the dimension, and the known words of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = []
            for k, t, lab in zip(*(c.to_pylist() for c in batch.columns)):
                code = usable(lab)
                out += [(k, code, i, part, lang, conf) for i, (part, lang, conf) in enumerate(text_languages(m, t))]
            cols = list(zip(*out)) or [[]] * 6
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(cols, kinds)], names=["row_key", "label", "segment", "text", "lang", "confidence"])

    picked = rows.select(key.cast("string").alias("k"), text.alias("t"), label.alias("l")).filter("k is not null and t is not null")
    return picked.mapInArrow(run, "row_key string, label string, segment int, text string, lang string, confidence double")


def relabelled(parts: DataFrame) -> DataFrame:
    """(row_key, lang): the languages of texts whose label is missing, unusable or wrong, or which have two."""
    per_text = parts.filter(F.col("lang") != OTHER).groupBy("row_key", "label").agg(F.collect_set("lang").alias("langs"))
    return per_text.filter(F.col("label").isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.col("label"))).select("row_key", F.explode("langs").alias("lang")).distinct()
