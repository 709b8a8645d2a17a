"""Functions and methods paired with their documentation.

A source text is lexed by a small state machine that knows the strings and
comments of its language; function headers are looked for in the code that is
left, bodies are delimited by matched braces (by indentation in Python), and
the documentation comment immediately before the header (after it in Python)
is attached, with annotations allowed between. Pairs whose documentation is
trivial are dropped.

The language is told from the headers in the text, never from labels. Result on
odd input: null and empty texts, and texts without a header, give nothing; a
header whose body is cut off counts; mixed line ends are read as one kind;
repeated rows give repeated pairs until made distinct; extra columns are
ignored; a text is read whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Function(NamedTuple):
    name: str
    start: int
    end: int
    doc: str


_STRING_DQ, _STRING_SQ = r'"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z)', r"'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z)"
_LEX = {
    "python": re.compile(rf"(?P<comment>#[^\n]*)|(?P<string>[A-Za-z]{{0,2}}(?:\"\"\"(?:[^\\]|\\.)*?(?:\"\"\"|\Z)|'''(?:[^\\]|\\.)*?(?:'''|\Z)|{_STRING_DQ}|{_STRING_SQ}))", re.S),
    "go": re.compile(rf"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>{_STRING_DQ}|`[^`]*(?:`|\Z)|'(?:[^'\\\n]|\\.)+')", re.S),
    "rust": re.compile(rf"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>r#+\".*?(?:\"#+|\Z)|\"(?:[^\"\\]|\\.)*(?:\"|\Z)|'(?:\\.[^']*|[^'\\\n])')", re.S),
    "braces": re.compile(rf"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"\"\".*?\"\"\"|{_STRING_DQ}|{_STRING_SQ}|`(?:[^`\\]|\\.)*(?:`|\Z))", re.S),
}
_HEADER = {
    "python": re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)[ \t]*[\[(]", re.M),
    "go": re.compile(r"^[ \t]*func[ \t]*(?:\([^()\n]*\)[ \t]*)?(\w+)[ \t]*[\[(]", re.M),
    "rust": re.compile(r"^[ \t]*(?:(?:pub(?:[ \t]*\([^)]*\))?|default|const|async|unsafe|extern(?:[ \t]+\"[^\"]*\")?)[ \t]+)*fn[ \t]+(?:r#)?(\w+)[ \t]*[<(]", re.M),
    "braces": re.compile(
        r"(?:^|(?<=[{};]))[ \t]*(?:(?:export|default|public|private|protected|static|final|abstract|synchronized|native|override|readonly|async|declare|get|set|strictfp)[ \t]+)*"
        r"(?:"
        r"(?:async[ \t]+)?function[ \t]*\*?[ \t]*(?P<f>[\w$]+)[ \t]*[<(]"
        r"|(?:const|let|var)[ \t]+(?P<a>[\w$]+)(?:[ \t]*:[^=\n]+)?[ \t]*=[ \t]*(?:async[ \t]+)?(?:function\b|<|\(|[\w$]+[ \t]*=>)"
        r"|(?:<[^>\n]+>[ \t]*)?(?:[\w$.]+(?:<[^=;(){}\n]*>)?(?:\[\])*[ \t]+)?\*?(?P<m>\#?[A-Za-z_$][\w$]*)[ \t]*(?:<[^>\n(]*>)?[ \t]*\("
        r")",
        re.M,
    ),
}
_NOT_A_METHOD = {"if", "for", "while", "switch", "catch", "return", "new", "else", "with", "function", "await", "do", "try", "throw", "typeof", "delete", "in", "of", "case", "super", "this", "assert", "synchronized", "import", "yield", "void", "default", "finally", "instanceof"}
_CLASS = {
    "python": re.compile(r"^[ \t]*class[ \t]+\w+", re.M),
    "go": re.compile(r"^[ \t]*type[ \t]+\w+", re.M),
    "rust": re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:unsafe[ \t]+)?(?:impl|struct|trait|enum|union)\b", re.M),
    "braces": re.compile(r"(?:^|(?<=[{};]))[ \t]*(?:[\w@]+[ \t]+)*(?:class|interface|enum|record|namespace)[ \t]+[\w$]+[^\n;()=]*\{?", re.M),
}
_GUESS = (
    ("python", re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+\w+[ \t]*\(", re.M)),
    ("rust", re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:(?:async|unsafe|const)[ \t]+)*fn[ \t]+\w+", re.M)),
    ("go", re.compile(r"^[ \t]*func[ \t]+(?:\([^()\n]*\)[ \t]*)?\w+[ \t]*\(", re.M)),
    ("braces", re.compile(r"\bfunction\b|=>|\)[^;\n]{0,40}\{[ \t]*$", re.M)),
)


def language_of(text: str) -> str | None:
    """The family whose function header comes first outside its own comments and strings."""
    best, at = None, len(text) + 1
    for name, header in _GUESS:
        m = header.search(text)
        if m and m.start() < at:
            clean = _lexed(text, name)[0]
            m = header.search(clean)
            if m and m.start() < at:
                best, at = name, m.start()
    return best


def _lexed(text: str, language: str) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with strings and comments blanked at the same length, and where they stood."""
    parts, at, marks = [], 0, []
    for m in _LEX[language].finditer(text):
        parts.append(text[at : m.start()])
        parts.append("".join("\n" if c == "\n" else " " for c in m[0]) if "\n" in m[0] else " " * len(m[0]))
        marks.append((m.start(), m.end(), m.lastgroup))
        at = m.end()
    parts.append(text[at:])
    return "".join(parts), marks


class Brackets:
    """Where each bracket of a code is closed, found in one pass; kinds of brackets are matched apart from one another."""

    _PAIRS = {")": "(", "]": "[", "}": "{"}

    def __init__(self, code: str):
        self.end_of, self.at, self.size = {}, {"(": [], "[": [], "{": []}, len(code)
        opened: dict[str, list[int]] = {"(": [], "[": [], "{": []}
        for m in re.finditer(r"[(){}\[\]]", code):
            opening = self._PAIRS.get(m[0])
            if opening is None:
                opened[m[0]].append(m.start())
                self.at[m[0]].append(m.start())
            elif opened[opening]:
                self.end_of[opened[opening].pop()] = m.end()

    def closed(self, at: int) -> int:
        """The place after the bracket that closes the one at ``at``; the end of the code if none does."""
        return self.end_of.get(at, self.size)

    def next(self, kind: str, at: int) -> int:
        """The first opening bracket of a kind from ``at`` on; -1 if there is none."""
        places = self.at[kind]
        k = bisect_left(places, at)
        return places[k] if k < len(places) else -1


def functions_in(text: str | None, column_doc: str | None = None) -> list[Function]:
    """All functions defined in the text, with their raw documentation ('' if none)."""
    if not text:
        return []
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    language = language_of(text)
    if language is None:
        return []
    code, marks = _lexed(text, language)
    brackets, mark_starts = Brackets(code), [start for start, _, _ in marks]
    comment_at = {end: start for start, end, kind in marks if kind == "comment"}
    found: list[Function] = []
    for m in _HEADER[language].finditer(code):
        if language == "braces":
            name = m["f"] or m["a"] or m["m"]
            start = m.start() + len(m[0]) - len(m[0].lstrip("\n \t"))
            if m["m"]:
                end = _method_end(code, brackets, m, name)
                if end is None:
                    continue
            else:
                end = _body_end(brackets, m.end())
        else:
            name, start = m[1], m.start() + len(m[0]) - len(m[0].lstrip())
            end = _indent_end(code, brackets, m) if language == "python" else _body_end(brackets, m.end() - 1)
        doc = _docstring(text, code, brackets, marks, mark_starts, m) if language == "python" else _above(text, start, language, comment_at)
        found.append(Function(name, start, end, doc))
    if len(found) == 1 and column_doc and not is_real(found[0].doc, found[0].name) and not _CLASS[language].search(code):
        found[0] = found[0]._replace(doc=column_doc)
    return found


_NO_METHOD = re.compile(r"[ \t]*(?:return|new|throw|await|else|case|typeof|yield)\b")
_METHOD_BODY = re.compile(r"\s*(?::[^={};]+(?:\{[^{}]*\})?[^={};]*|throws[ \t]+[\w$., \t\n]+)?\s*\{")


def _method_end(code: str, brackets: Brackets, m: re.Match, name: str) -> int | None:
    if name in _NOT_A_METHOD or _NO_METHOD.match(m[0].lstrip("{};\n")):
        return None
    body = _METHOD_BODY.match(code, brackets.closed(m.end() - 1))
    return brackets.closed(body.end() - 1) if body else None


def _body_end(brackets: Brackets, at: int) -> int:
    brace, paren = brackets.next("{", at), brackets.next("(", max(0, at - 1))
    if 0 <= paren < (brace if brace >= 0 else brackets.size):
        brace = brackets.next("{", brackets.closed(paren))
    return brackets.size if brace < 0 else brackets.closed(brace)


def _indent_end(code: str, brackets: Brackets, m: re.Match) -> int:
    indent = len(m[0]) - len(m[0].lstrip(" \t"))
    at = code.find("\n", brackets.closed(m.end() - 1))
    while at >= 0:
        line_end = code.find("\n", at + 1)
        line = code[at + 1 : line_end if line_end >= 0 else len(code)]
        if line.strip() and len(line) - len(line.lstrip(" \t")) <= indent:
            return at
        at = line_end
    return len(code)


_COLON = re.compile(r"[ \t\n]*(?:->[^:\n]*(?:\[[^\n]*\])?)?[ \t]*:")


def _docstring(text: str, code: str, brackets: Brackets, marks: list[tuple[int, int, str]], mark_starts: list[int], m: re.Match) -> str:
    opening = m.end() - 1
    after = brackets.closed(opening)
    if code[opening] == "[":
        paren = brackets.next("(", after)
        after = brackets.closed(paren) if paren >= 0 else after
    colon = _COLON.match(code, after)
    if not colon:
        return ""
    at = colon.end()
    for start, end, kind in islice(marks, bisect_left(mark_starts, at), None):
        if text[at:start].strip():
            return ""
        if kind == "string":
            raw = re.sub(r"^[A-Za-z]{0,2}", "", text[start:end])
            mark = raw[:3] if raw[:3] in ('"""', "'''") else raw[:1]
            return raw[len(mark) : -len(mark)] if len(raw) >= 2 * len(mark) and raw.endswith(mark) else raw[len(mark) :]
        at = end
    return ""


_ANNOTATIONS = re.compile(r"\s*(?:@[\w.$]+(?:\([^\n]*\))?\s*)+")
_CLOSES = re.compile(r"\*/[ \t]*(?:@[\w.$]+(?:\([^\n]*\))?[ \t]*)*\Z")
_ATTRIBUTE = re.compile(r"\s*#!?\[.*\]\s*")
_LINE_DOC = {"rust": re.compile(r"\s*///(?!/) ?(.*)"), "go": re.compile(r"\s*//(?!/) ?(.*)")}


def _lines_above(text: str, end: int) -> Iterator[tuple[int, str]]:
    """Where each line begins and what it holds, upwards from the one that ends at ``end``."""
    while end >= 0:
        start = text.rfind("\n", 0, end) + 1
        yield start, text[start:end]
        end = start - 1


def _above(text: str, start: int, language: str, comment_at: dict[int, int]) -> str:
    """The documentation comment directly above, past annotations; only the lines it takes up are looked at."""
    line_start = text.rfind("\n", 0, start) + 1
    before = text[line_start:start].strip()
    if before and not (language == "braces" and before.endswith("*/")) and not before.startswith(("@", "#[")):
        return ""
    end = start if before else line_start - 1
    if language == "braces":
        for at, line in _lines_above(text, end):
            if _ANNOTATIONS.fullmatch(line):
                continue
            m = _CLOSES.search(line)
            opens = comment_at.get(at + m.start() + 2) if m else None
            if opens is None or not text.startswith("/**", opens) or at + m.start() + 2 - opens < 5:
                return ""
            return "\n".join(re.sub(r"^\s*\*+ ?|\*+$", "", x) for x in text[opens + 3 : at + m.start()].split("\n"))
        return ""
    doc: list[str] = []
    for _, line in _lines_above(text, end):
        if language == "rust" and _ATTRIBUTE.fullmatch(line):
            continue
        m = _LINE_DOC[language].fullmatch(line)
        if not m:
            break
        doc.append(m[1])
    return "\n".join(reversed(doc))


# What stands for documentation without being any.
_EMPTY_PHRASES = {
    "n/a", "na", "none", "null", "nil", "tbd", "tba", "tbc", "todo", "fixme", "xxx", "hack", "wip", "placeholder", "placeholder text", "docs pending", "doc pending", "documentation pending", "pending", "see above", "see below", "as above", "ditto",
    "no description", "no docs", "no documentation", "undocumented", "description", "documentation", "docs", "doc", "docstring", "comment", "missing", "write docs", "add description", "document", "document me", "to be documented", "to be written", "to be defined", "lorem ipsum", "auto-generated", "autogenerated",
    "작성 예정", "설명 없음", "추후 작성", "미작성", "문서화 예정", "없음", "위 참조", "위와 같음", "未記入", "説明なし", "なし", "後で書く", "作成予定", "上記参照",
    "siehe oben", "keine beschreibung", "folgt", "noch offen", "voir ci-dessus", "à compléter", "pas de description", "à documenter", "ver arriba", "sin descripción", "pendiente", "por documentar",
}
_GOES_HERE = re.compile(r"(?i)^(?:your |the |a |some |add |insert |write |put |enter )*(?:description|documentation|docs?|docstring|comment|summary|text)s?(?: text)?(?: goes| should go| to go| comes| belongs)?(?: here| later| below)$")
_GENERIC = {"helper", "helpers", "function", "method", "utility", "util", "utils", "wrapper", "class", "misc", "internal", "private", "public", "deprecated", "constructor", "getter", "setter", "main", "init", "callback", "handler", "implementation", "impl", "stuff", "test", "example", "noop", "stub", "procedure", "routine", "module", "api", "code", "common", "default", "generic", "simple", "new", "old", "temp", "temporary"}
_FILLER = {"the", "a", "an", "this", "that", "of", "to", "for", "and", "it", "its", "is", "does", "do", "will", "function", "method", "helper", "func", "def", "fn", "which", "with", "in", "on"}
_TOOL = re.compile(
    r"(?i)^\W*(?:@ts-(?:ignore|expect-error|nocheck|check)|eslint[-\w]*|tslint:\S*|prettier-ignore|jshint\b|jslint\b|pylint:|flake8:|noqa\b|type:\s*ignore|mypy:|pyright:|ruff:|fmt:\s*(?:off|on|skip)|isort:|pragma[: ]|nolint\b|nosec\b|nosonar\b|go:\w+|\+build|lint:ignore|istanbul ignore|c8 ignore|v8 ignore|coverage:|@formatter:|checkstyle|suppress\w*\b|noinspection|rustfmt|clippy|webpack\w*:|sonar|biome-ignore|deno-lint|cspell|spell-checker|region\b|endregion\b|@generated|@flow|@jsx|@preserve|@internal$|@private$|@override$|@hidden$|-\*-|vim?:)"
)
_TAG_LINE = re.compile(r"^\s*(?:[@\\](?:param|params|arg|argument|return|returns|throws|throw|exception|type|typedef|template|see|since|author|version|deprecated|override|example|private|public|protected|internal|property|prop|yields|async|static|readonly|memberof|class|module|inheritdoc|todo|ignore|hidden|api|category)\b.*|:(?:param|type|returns?|rtype|raises|yields?|arg|keyword|var)\b[^:]*:.*|\{@\w+[^}]*\})\s*$", re.I)
_SECTION = re.compile(r"^\s*(?:#+\s*)?(?:args|arguments|parameters|params|returns?|raises|yields|throws|attributes|examples?|errors|panics|safety|notes?)\s*:?\s*$", re.I)
_TODO = re.compile(r"(?i)^\W*(?:todo|fixme|xxx|tbd|hack)\b")
_CODE = re.compile(r"^\s*(?:(?:const|let|var|final|int|auto)\s+)?[\w.$\[\]]+\s*(?::=|[-+*/]?=)\s*[^=\s].*$|^\s*[\w.$]+\([^()]*(?:\([^()]*\)[^()]*)*\)\s*;\s*$|^\s*(?:return|if|for|while|else|import|from|throw|raise|print|break|continue|del|assert)\b.*[;:{}()]\s*$|^\s*[{}()\[\];,]+\s*$|^.*[{;]\s*$|^\s*(?:def|func|fn|function|class)\b.*[({:]\s*.*$")
_REFERENCE = re.compile(r"(?i)^\W*(?:see(?: also)?|cf\.?|refer to|same as|like|ditto|copied from|@see|siehe|voir|véase|참고|참조)?\W*(?:https?://\S+|\{@\w+\s+[^}]*\}|[#A-Z]*#?\d+|(?:[\w$]+(?:\.|::|#))+[\w$]+(?:\(\))?|[\w$]+\(\)|`[^`]+`|[A-Z]+-\d+)\W*$|^\W*(?:see|cf\.?|refer to|same as)\s+(?:the\s+)?[\w.]+\W*$")
_INVISIBLE = re.compile(r"[​-‏‪-‮⁠-⁤﻿­ ]")


def description(doc: str) -> str:
    """The prose of a documentation comment: without tags, sections of parameters and decoration."""
    out, section = [], None
    for line in _INVISIBLE.sub(" ", doc).replace("\r", "\n").split("\n"):
        indent = len(line) - len(line.lstrip())
        if _TAG_LINE.match(line) and not re.match(r"\s*\{@code", line):
            continue
        if _SECTION.match(line):
            section = indent
            continue
        if section is not None:
            if line.strip() and indent > section:
                continue
            if line.strip():
                section = None
        out.append(line.strip())
    return "\n".join(out).strip()


def _words(s: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+|\d+", s)]


def _stem(w: str) -> str:
    return re.sub(r"(?:ing|ies|es|ed|s|e|y)$", "", w) if len(w) > 3 and w.isascii() else w


def is_real(doc: str | None, name: str) -> bool:
    """Whether the documentation says anything beyond a placeholder, a mark for a tool, tags, signs, code, a reference or the name."""
    if not doc:
        return False
    text = description(doc)
    if not re.search(r"[^\W\d_]", text):
        return False
    lines = [x for x in text.split("\n") if x.strip()]
    lines = [x for x in lines if not _TOOL.match(x) and re.search(r"\w", x)]
    if not lines or _TODO.match(lines[0]):
        return False
    prose = [x for x in lines if not _CODE.match(x)]
    if not prose:
        return False
    joined = " ".join(prose)
    bare = re.sub(r"^[\W_]+|[\W_]+$", "", joined).lower()
    if bare in _EMPTY_PHRASES or _GOES_HERE.match(bare) or _REFERENCE.match(joined):
        return False
    words = _words(joined)
    if all(w.isascii() for w in words):
        said = [w for w in words if w not in _FILLER]
        named = {_stem(w) for w in _words(name)} | {_stem(name.lower())}
        if all(_stem(w) in named for w in said) or all(w in _GENERIC for w in said) or len(words) < 2:
            return False
    elif len(bare) < 4:
        return False
    return True


def documented_functions(df: DataFrame, key: str, content: str, docstring: str) -> DataFrame:
    """(chunk_id, name, code, description): each function with real documentation; one narrow stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, text, doc in zip(*(c.to_pylist() for c in batch.columns)):
                plain = text.replace("\r\n", "\n").replace("\r", "\n")
                rows += dict.fromkeys((k, f.name, plain[f.start : f.end], description(f.doc)) for f in functions_in(plain, doc) if is_real(f.doc, f.name))
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in cols], names=["chunk_id", "name", "code", "description"])

    rows = df.select(F.col(key).cast("string").alias("k"), F.col(content).alias("c"), F.col(docstring).alias("d")).filter("k is not null and c is not null")
    return rows.mapInArrow(run, "chunk_id string, name string, code string, description string")
