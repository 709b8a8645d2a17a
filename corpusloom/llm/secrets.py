"""Credentials inside code, configuration and prose: finding and redacting them.

A text is first searched for unnatural strings: random ones fall into short
subwords of a public vocabulary, so a run that holds three subwords in a row of
few characters makes the text a candidate, and a text without any is done. The
rules of the place then say where the value begins and ends and what it is
(assignments, calls, options, headers, addresses, connection strings, sentences,
key blocks, formats that name themselves; the name in front, placeholders, masks,
references and digests), and nothing is reported whose own characters per
subword are those of natural text. Redaction writes one mask character for each
character of the value, so all other offsets and the code around it stay as
they are.

Result on odd input: null and empty texts hold no credential; repeated rows
give one finding each; a text is scanned whole, whatever its length; several
findings on a line give that line once in ``found_lines``; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokenization import RANKS, TOKENIZER_DIR, Tokenizer, tokenizer

#: At most so many characters per subword make a string of 16 or more characters unnatural.
UNNATURAL = 2.75
#: A run with three subwords in a row of so many characters together is searched more closely.
NARROW = 8
MASK = "*"


class Finding(NamedTuple):
    start: int
    end: int
    kind: str
    line_start: int
    chars_per_subword: float


# The published shapes of tokens that carry their own name.
_NAMED = re.compile(
    r"(?<![A-Za-z0-9_])(?:gh[opusr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{16,}|sk-[A-Za-z0-9_-]{20,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"
    r"|xox[abeoprs]-[A-Za-z0-9-]{16,}|A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])|AIza[A-Za-z0-9_-]{28,}|npm_[A-Za-z0-9]{24,}|hf_[A-Za-z0-9]{24,}|pypi-[A-Za-z0-9_-]{24,}|dop_v1_[a-f0-9]{32,}"
    r"|SG\.[A-Za-z0-9_-]{12,}\.[A-Za-z0-9_-]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|shp(?:at|ss|ca)_[a-fA-F0-9]{24,}|ya29\.[A-Za-z0-9_-]{20,}|AGE-SECRET-KEY-1[A-Z0-9]{40,})"
)
_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_BLOCK_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: Longer values in addresses are not looked for.
LONGEST_IN_ADDRESS = 4096
_ADDRESS = re.compile(rf"(?<=[A-Za-z0-9+.-])://([^\s:/@\"'`<>]{{0,{LONGEST_IN_ADDRESS}}}+):([^\s\"'`<>]{{1,{LONGEST_IN_ADDRESS}}}?)@(?=[A-Za-z0-9\[_$-])")
_PIECE = re.compile(r"[^\s\"'`]{6,}")
_SEGMENT = re.compile(r"[^\"'`\n]+")
_HEADER = re.compile(r"(?i)(?<![A-Za-z])(?:bearer|basic|token)[ \t]+([A-Za-z0-9+/_.~=-]{12,})")
_WORD = re.compile(r"(?i)pass|pwd|pw(?![a-z])|secret|token|key|cred|auth|bearer|signature")
_NAME_LEFT = re.compile(r"[A-Za-z0-9_.-]*\Z")
_AFTER_NAME = re.compile(r"[A-Za-z0-9_-]*")
_SEPARATOR = re.compile(r"[\"'`]?\]?(?:[ \t]*:[ \t]*[A-Za-z_][\w<>\[\]&' ]{0,20}?[ \t]*=|[ \t]*(?::=|=>|=|:|,))[ \t]*(?:[|>][-+]?[ \t]*\r?\n\s*|\\?\r?\n\s*(?=[\"'`]))?")
_OPTION = re.compile(r"[ \t]+")
_QUOTED = re.compile(r"[bru]?(?:\"\"\"(.*?)\"\"\"|'''(.*?)'''|\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`)", re.S)
_JOINED = re.compile(r"\s*(?:\+|\.|\\\n)?\s*[bru]?(?:\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)')")
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>]+")
_CONNECTION = re.compile(r"(?i)(?:^|;)\s*(?:password|pwd|accountkey|sharedaccesskey|secret)\s*=\s*([^;\"'\s]+)")
_USER_OPTION = re.compile(r"(?<!\S)(?:-u|--user|--proxy-user)(?:\s+|=)[\"']?([^\s:\"']+):([^\s\"']+)")
#: A chosen password standing alone: letters, a digit and a sign inside one word.
_CHOSEN = re.compile(r"(?<![^\s\"'`(:/])[A-Za-z0-9!?*#+%@&$^~_.-]{10,}(?![^\s\"'`),;。])")
_LOGIN = re.compile(r"(?i)\b(?:log[ -]?in|login|sign in|einloggen|anmelden|credentials?|connexion|acceso)\b|로그인|ログイン")
_RUN = re.compile(r"[A-Za-z0-9+/_.~=%!@#$^&*?-]{12,}")
#: Words of prose that announce a credential, in the languages of the texts.
_ANNOUNCES = re.compile(r"(?i)\b(?:access |api |auth )?(?:token|key|secret|password|passwort|kennwort|passphrase|credential|jeton|clave|contraseña|clé|schlüssel)\b|mot de passe|토큰|비밀번호|암호|키[는가]|トークン|パスワード|合言葉|鍵")
_PROSE_VALUE = re.compile(r"(?i)(?:\b(?:token|key|secret|password|passwort|kennwort|passphrase|jeton|clave|contraseña|mot de passe)\s+(?:is|was|are|ist|lautet|est|es|:|=)|(?:토큰|비밀번호|암호|키)[은는이가:]|(?:トークン|パスワード|鍵)[はが:：])\s*[`\"'「]?([^\s`\"'「」]{6,})")

_STRONG = {"pass", "password", "passwd", "pwd", "pw", "passphrase", "secret", "token", "credential", "credentials", "cred", "creds", "authorization", "auth", "passcode", "bearer"}
#: With one of these before it, "key" names a credential.
_KEY_KIND = {"api", "secret", "access", "private", "signing", "encryption", "auth", "master", "account", "shared", "service", "hmac", "crypto", "client", "license", "admin", "deploy", "app", "webhook", "jwt", "session", "storage", "stream"}
#: Last words of names that tell about a credential but do not hold it.
_ABOUT = {"name", "names", "path", "paths", "field", "fields", "type", "types", "limit", "limits", "count", "counts", "length", "len", "size", "min", "max", "id", "ids", "file", "files", "ttl", "expiry", "expires", "url", "uri", "endpoint", "header", "headers", "prefix", "suffix", "policy", "index", "hint", "label", "format", "version", "algorithm", "alg", "age", "rotation", "days", "hours", "seconds", "enabled", "required", "hash", "digest", "checksum", "fingerprint", "pub", "public", "ref", "budget", "bucket", "column", "store", "manager", "provider", "class", "method", "error", "env", "var", "key_id"}
_PUBLIC = {"public", "primary", "foreign", "sort", "partition", "cache", "unique", "pub", "ssh"}

_PLACEHOLDER_WORDS = {"todo", "redacted", "changeme", "change", "replace", "replaceme", "your", "yours", "example", "placeholder", "dummy", "sample", "insert", "fixme", "tbd", "none", "null", "nil", "undefined", "true", "false", "masked", "hidden", "removed", "omitted", "secret", "password", "token", "xxx", "xxxx", "foo", "bar", "foobar", "test", "fake", "mock", "empty", "unset", "default", "string", "str", "value", "here", "me", "my", "the", "a", "key", "api", "apikey", "login", "form", "db", "credentials", "credential", "bearer", "basic", "user", "name", "passwd", "pass", "and", "is", "for", "to", "client", "access", "auth", "prod", "dev", "staging", "not", "set", "use", "enter", "put", "goes", "some", "any", "no", "n"}
_REFERENCE = re.compile(r"\$\{|\{\{|\}\}|\$\(|%\(|<%|^\$[A-Za-z_]|^%[A-Za-z_]+%$|^<[^>]*>$|^\{[^}]*\}$|(?i:process\.env|os\.environ|getenv|vault[.:/]|secretsmanager|secrets?\.[a-z]|keyring|env\.|config\.|settings\.|ssm:|op://|arn:|!ref|!vault)")
_MASKED = re.compile(r"\*{3,}|[xX]{6,}|\.{3,}|…|•{2,}|#{4,}|_{4,}|-{6,}|0{8,}|1{8,}|(.)\1{9,}")


def is_placeholder(value: str) -> bool:
    v = value.strip()
    if len(v) < 4 or _REFERENCE.search(v) or _MASKED.search(v):
        return True
    words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", v).lower())
    if words and all(w in _PLACEHOLDER_WORDS for w in words) and sum(c.isdigit() for c in v) < 6:
        return True
    body = re.sub(r"^(?:gh[opusr]_|sk-|xox[a-z]-|A[KS]IA|AIza|npm_|hf_|SG\.|Bearer |Basic )", "", v)
    return len(set(body)) <= max(2, len(body) // 12) or bool(re.fullmatch(r"(?i)(?:0?123456789|abcdef\w*|12345\w*)", body))


def name_strength(name: str) -> int:
    """2: names a credential; 1: may name one; 0: does not."""
    words = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]
    if not words:
        return 0
    last = words[-1]
    if last in _ABOUT:
        return 0
    if last in _STRONG:
        return 2
    if last == "key":
        if len(words) == 1:
            return 1
        return 0 if words[-2] in _PUBLIC else 2 if words[-2] in _KEY_KIND else 1
    if last.endswith(("password", "passwd", "passphrase", "secret", "apikey", "secretkey", "accesskey", "authtoken")):
        return 2
    return 0


def _classes(v: str) -> tuple[bool, bool, bool, bool]:
    return any(c.islower() for c in v), any(c.isupper() for c in v), any(c.isdigit() for c in v), any(not c.isalnum() for c in v)


_UUID = re.compile(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
_PATHLIKE = re.compile(r"(?:\.{0,2}/)?(?:[\w.-]+/)+[\w.-]+\.\w{1,5}(?::\d+)?|/[\w./-]+|[A-Za-z_][\w]*(?:\.[A-Za-z_]\w*)+|https?://\S+")


class Scanner:
    def __init__(self, tok: Tokenizer):
        self._tok = tok
        self._seen: dict[str, bool] = {}

    def _narrow(self, run: str) -> bool:
        """Whether three subwords in a row hold few characters; runs without digits and capitals never count."""
        if run == run.lower() and not any(map(str.isdigit, run)):
            return False
        found = self._seen.get(run)
        if found is None:
            sizes = self._tok.length_of[self._tok.encode(run)]
            found = len(sizes) > 2 and bool((sizes[:-2] + sizes[1:-1] + sizes[2:]).min() <= NARROW)
            if len(self._seen) > 200_000:
                self._seen.clear()
            if len(run) < 200:
                self._seen[run] = found
        return found

    def unnatural(self, text: str) -> bool:
        """Whether any string of the text is made of short subwords."""
        return any(self._narrow(m[0]) for m in _PIECE.finditer(text))

    def naturalness(self, value: str) -> float:
        """Characters per subword."""
        return len(value) / max(len(self._tok.encode(value)), 1)

    def _random(self, v: str, least: int = 16) -> bool:
        """An unnatural string of one piece: short subwords and more than one class of characters, or long hex."""
        if len(v) < least or _UUID.fullmatch(v) or _PATHLIKE.fullmatch(v):
            return False
        lower, upper, digit, _ = _classes(v)
        return digit + lower + upper >= 2 and (digit or (lower and upper)) and self.naturalness(v) <= UNNATURAL

    def _chosen(self, v: str) -> bool:
        lower, upper, digit, _ = _classes(v)
        sign = re.search(r"[!?*#+%@&$^]|[_.-](?=\w*\d)", v[1:])
        return bool(sign and digit and lower and upper and not is_placeholder(v) and not _PATHLIKE.fullmatch(v) and not re.search(r"@[\w-]+\.\w", v) and self.naturalness(v) <= UNNATURAL)

    def _accept(self, value: str, strength: int, quoted: bool) -> bool:
        if is_placeholder(value) or _UUID.fullmatch(value):
            return False
        hexlike = bool(re.fullmatch(r"[0-9a-fA-F]+", value))
        if strength == 2:
            if re.search(r"\s", value):
                return False
            lower, upper, digit, other = _classes(value)
            if _PATHLIKE.fullmatch(value) and not self._random(value, 20):
                return False
            if not value.isascii():
                return False
            if self._random(value):
                return True
            if len(value) < 6 or re.fullmatch(r"\d+(?:\.\d+)?[a-z]?", value):
                return False
            if not quoted and re.search(r"[(){}\[\]]|->|::", value):
                return False
            # a chosen password: classes are mixed, though its parts may be words
            return digit and (lower or upper) and (other or upper) or (digit and lower and len(value) >= 8) or (lower and upper and other)
        return not hexlike and self._random(value, 20) and not value.isalpha()

    def scan(self, text: str | None) -> list[Finding]:
        if not text or not self.unnatural(text):
            return []
        out: dict[tuple[int, int], tuple[str, int]] = {}

        def add(start: int, end: int, kind: str, line_at: int | None = None) -> None:
            if end > start:
                out.setdefault((start, end), (kind, start if line_at is None else line_at))

        if "PRIVATE KEY" in text:
            for m in _BLOCK.finditer(text):
                stop = _BLOCK_END.search(text, m.end())
                end = stop.start() if stop else min([len(text), *(k for k in (text.find('"', m.end()), text.find("\n\n", m.end())) if k >= 0)])
                nxt = _BLOCK.search(text, m.end())
                if nxt and nxt.start() < end:
                    end = nxt.start()
                body = re.sub(r"\\[nrt]|\s|[\"'+#/*]{0,2}", "", text[m.end() : end])
                if len(body) >= 16 and not is_placeholder(body):
                    add(m.end(), end, "private key", m.start())
        if "://" in text:
            for m in _ADDRESS.finditer(text):
                if not is_placeholder(m[2]):
                    add(m.start(2), m.end(2), "address")
        for m in _NAMED.finditer(text):
            if not is_placeholder(m[0]) and self.naturalness(m[0]) <= UNNATURAL + 0.5:
                add(m.start(), m.end(), "token")
        for m in _HEADER.finditer(text):
            v = m[1].rstrip(".")
            if not is_placeholder(v) and self._random(v):
                add(m.start(1), m.start(1) + len(v), "header")
        seen = -1
        for m in _WORD.finditer(text):
            if m.start() < seen:
                continue
            name_end = _AFTER_NAME.match(text, m.end()).end()
            left = _NAME_LEFT.search(text, max(0, m.start() - 60), m.start()).start()
            name, seen = text[left:name_end], name_end
            strength = name_strength(name)
            if not strength:
                continue
            sep = _SEPARATOR.match(text, name_end)
            option = name.startswith("-")
            if not sep and option:
                sep = _OPTION.match(text, name_end)
            if sep:
                self._value(text, sep.end(), strength, option, add)
        if ";" in text:
            for m in _SEGMENT.finditer(text):
                if ";" not in m[0]:
                    continue
                for c in _CONNECTION.finditer(m[0]):
                    if not is_placeholder(c[1]):
                        add(m.start() + c.start(1), m.start() + c.end(1), "connection string")
        for m in _USER_OPTION.finditer(text):
            if not is_placeholder(m[2]) and self._accept(m[2], 2, True):
                add(m.start(2), m.end(2), "option")
        if _ANNOUNCES.search(text) or _LOGIN.search(text):
            line_end, announced = -1, False
            for m in _CHOSEN.finditer(text):
                v = m[0].rstrip(".?")
                ends_line = text[m.end() : m.end() + 1] in ("", "\n", "\r")
                if m[0][-1] in "!?" and ends_line and self._chosen(m[0]):
                    v = m[0]  # a sign that ends the line with the value belongs to it
                elif not self._chosen(v):
                    continue
                if m.start() > line_end:  # a line is searched once, however many values it holds
                    line_start, line_end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
                    line_end = len(text) if line_end < 0 else line_end
                    announced = bool(_ANNOUNCES.search(text, line_start, line_end) or _LOGIN.search(text, line_start, line_end))
                if announced:
                    add(m.start(), m.start() + len(v), "sentence")
            for m in _PROSE_VALUE.finditer(text):
                v = m[1].rstrip(".,;:!?)」")
                if m[1][len(v) :] in ("!", "?") and text[m.end() : m.end() + 1] in ("", "\n", "\r") and self._accept(m[1], 2, False):
                    v = m[1]  # a sign that ends the line with the value belongs to it
                if self._accept(v, 2, False) and (self._random(v) or sum(_classes(v)) >= 3):
                    add(m.start(1), m.start(1) + len(v), "sentence")
            for m in _RUN.finditer(text):
                v = m[0].rstrip(".?!")
                if len(v) < 16 or not self._random(v) or is_placeholder(v):
                    continue
                before, after = text[max(0, m.start() - 14) : m.start()], text[m.end() : m.end() + 30]
                if re.search(r"(?i)(?:use|with|using|set)\s+[`\"']?$", before) and _ANNOUNCES.search(after.split("\n")[0]):
                    add(m.start(), m.start() + len(v), "sentence")
        kept: list[Finding] = []
        block: Finding | None = None  # the last key block
        for (start, end), (kind, at) in sorted(out.items(), key=lambda x: (x[0][0], -x[0][1])):
            outer = next((k for k in (kept[-1] if kept else None, block) if k is not None and start < k.end), None)
            if outer is not None and (outer.kind != "private key" or text.find("\n", outer.line_start, start) < 0):
                if end > kept[-1].end:  # overlapping an earlier finding: one credential
                    kept[-1] = kept[-1]._replace(end=end)
                continue
            # besides a free one, one that is pasted into a key block on a line of its own
            found = Finding(start, end, kind, at, round(self.naturalness(text[start:end]), 3))
            if found.chars_per_subword <= UNNATURAL:
                kept.append(found)
                block = found if kind == "private key" else block
        return kept

    def _value(self, text: str, at: int, strength: int, option: bool, add) -> None:
        quoted = _QUOTED.match(text, at)
        if quoted:
            group = next((k for k in range(1, 6) if quoted[k] is not None), None)
            if group is None:
                return
            value, start, end = quoted[group], quoted.start(group), quoted.end(group)
            if "-----BEGIN" in value or "://" in value and _ADDRESS.search(value):
                return
            m = re.match(r"(?i)(?:bearer|basic|token)\s+", value)
            if m:
                value, start = value[m.end() :], start + m.end()
            whole, stop = value, end
            more = _JOINED.match(text, quoted.end())
            while more and (text[quoted.end() : more.end()].lstrip()[:1] in "+.\\"):
                part = next(g for g in more.groups() if g is not None)
                whole, stop = whole + part, more.end() - 1
                more = _JOINED.match(text, more.end())
            if self._accept(whole, strength, True):
                add(start, stop, "assignment")
            return
        bare = _BARE.match(text, at)
        if not bare:
            return
        value = bare[0]
        follows = text[bare.end() : bare.end() + 1]
        if follows in ("(", "[", "{") or value.startswith(("&", "@@")) or (re.match(r"(?i)(?:bearer|basic)$", value)):
            return
        if not option:
            value = value.rstrip(".:")
        if self._accept(value, strength, False):
            add(bare.start(), bare.start() + len(value), "assignment")

    def redact(self, text: str | None, mask: str = MASK) -> str | None:
        """The text with each credential's characters masked; line breaks, quotes and the joins of split strings stay."""
        if not text:
            return text
        spans: list[list[int]] = []
        for f in self.scan(text):
            if spans and f.start < spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], f.end)
            else:
                spans.append([f.start, f.end])
        for start, end in reversed(spans):
            text = text[:start] + _masked(text[start:end], mask) + text[end:]
        return text


def _masked(value: str, mask: str) -> str:
    value = re.sub(r"\\[nrt]|[\"']\s*(?:\+|\.|\\\n)?\s*[\"']|\s+|[^\s\\\"']+|.", lambda m: m[0] if re.fullmatch(r"\\[nrt]|\s+|[\"'].*[\"']", m[0], re.S) else mask * len(m[0]), value, flags=re.S)
    return value


def find_secrets(df: DataFrame, key: Column, text: Column, folder: str = TOKENIZER_DIR, ranks: str = RANKS) -> DataFrame:
    """(row_key, line_no, start, end, kind, chars_per_subword): one row for each credential; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(tokenizer(folder, ranks))
        for batch in batches:
            keys, rows = batch.column(0).to_pylist(), []
            for k, value in zip(keys, batch.column(1).to_pylist()):
                line, at = 1, 0
                for f in sorted(scanner.scan(value), key=lambda f: f.line_start):
                    line, at = line + value.count("\n", at, f.line_start), f.line_start
                    rows.append((k, line, f.start, f.end, f.kind, f.chars_per_subword))
            cols = list(zip(*rows)) or [[]] * 6
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(cols, kinds)], names=["row_key", "line_no", "start", "end", "kind", "chars_per_subword"])

    rows = df.select(key.cast("string").alias("row_key"), text.alias("text")).filter("row_key is not null and text is not null")
    return rows.mapInArrow(run, "row_key string, line_no int, start int, end int, kind string, chars_per_subword double")


def redact_column(df: DataFrame, key: str, text: str, folder: str = TOKENIZER_DIR, ranks: str = RANKS) -> DataFrame:
    """(key, redacted): the same number of characters, with only the credentials' values masked."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(tokenizer(folder, ranks))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scanner.redact(t) for t in batch.column(1).to_pylist()], pa.string())], names=[key, "redacted"])

    return df.select(F.col(key), F.col(text).alias("__text")).mapInArrow(run, f"`{key}` {kind}, redacted string")
