"""Cutting source texts into definitions and listing what they call.

Python is parsed; a text that does not parse, and the languages with braces, are cut at definitions that begin a line, each
ending where its braces or its indentation close. Result on odd input: null and empty texts give nothing; a text without
definitions is one block; repeated rows give repeated rows.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunkers import MOST, OVERLAP

_DEFINES = re.compile(
    r"^(?P<indent>[ \t]*)(?:@\w[^\n]*\n[ \t]*)*(?:(?:export|default|public|private|protected|static|abstract|final|async|pub(?:\([^)]*\))?|unsafe|declare)[ \t]+)*"
    r"(?:(?P<kind>class|interface|struct|enum|trait|impl|type|def|function|func|fn)[ \t*]+(?:\([^)\n]*\)[ \t]*)?(?P<name>[A-Za-z_$][\w$]*)|(?:const|let|var)[ \t]+(?P<value>[A-Za-z_$][\w$]*)[^=\n]*=[ \t]*(?:async[ \t]*)?(?:\([^\n]*\)|[\w$]+)[ \t]*(?::[^=\n]+)?=>)",
    re.M,
)
_KINDS = {"class": "class", "interface": "interface", "struct": "struct", "enum": "enum", "trait": "trait", "impl": "impl", "type": "type"}
_CALL = re.compile(r"(?<![\w$.])((?:self|this|cls)\.)?([A-Za-z_$][\w$]*)[ \t]*\(")
# Names that are part of the languages.
BUILTINS = frozenset("print len range str int float list dict set tuple sorted min max sum map filter zip enumerate open isinstance type super return if for while switch catch function new typeof await require console parseInt parseFloat append make panic println format vec match fn func def class assert raise except with and not in is or lambda yield".split())


def definitions(text: str | None) -> list[tuple[str, str, str | None, int, int]]:
    """(name, node_type, parent, first line, last line) of each definition, outer before inner."""
    if not text:
        return []
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _by_braces(text)
    out: list[tuple[str, str, str | None, int, int]] = []
    stack: list[tuple[ast.AST, str | None]] = [(tree, None)]
    while stack:
        node, parent = stack.pop()
        for child in reversed(list(ast.iter_child_nodes(node))):
            stack.append((child, node.name if isinstance(node, ast.ClassDef) else parent if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) else None))
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "method" if parent else "function"
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            out.append((node.name, kind, parent, first, node.end_lineno or node.lineno))
    return sorted(out, key=lambda d: (d[3], -d[4]))


def _by_braces(text: str) -> list[tuple[str, str, str | None, int, int]]:
    found, open_classes = [], []
    for m in _DEFINES.finditer(text):
        name, kind, start = m["name"] or m["value"], m["kind"], m.start()
        end = _end(text, m)
        open_classes = [(n, e) for n, e in open_classes if e > start]
        parent = open_classes[-1][0] if open_classes else None
        if kind in _KINDS:
            open_classes.append((name, end))
        found.append((name, _KINDS.get(kind or "", "method" if parent else "function"), parent, text.count("\n", 0, start) + 1, text.count("\n", 0, max(start, end - 1)) + 1))
    return found


def _end(text: str, m: re.Match) -> int:
    line_end = text.find("\n", m.end())
    brace = text.find("{", m.end(), line_end + 200 if line_end >= 0 else len(text))
    if m["kind"] == "def" or brace < 0:
        indent, at = len(m["indent"]), line_end
        while at >= 0:
            stop = text.find("\n", at + 1)
            line = text[at + 1 : stop if stop >= 0 else len(text)]
            if line.strip() and len(line) - len(line.lstrip()) <= indent:
                return at
            at = stop
        return len(text)
    depth = 0
    for x in re.compile(r"[{}]").finditer(text, brace):
        depth += 1 if x[0] == "{" else -1
        if not depth:
            return x.end()
    return len(text)


def code_chunks(df: DataFrame, key: str, text: str, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """(key, name, node_type, parent_name, start_line, end_line, piece, content): definitions, those above a size cut with overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = (t or "").split("\n")
                found = definitions(t) or ([(None, "block", None, 1, len(lines))] if (t or "").strip() else [])
                for name, kind, parent, first, last in found:
                    body = "\n".join(lines[first - 1 : last])
                    starts = range(0, max(1, len(body) - overlap), most - overlap) if len(body) > most else (0,)
                    rows += [(k, name, kind, parent, first, last, n, body[s : s + most]) for n, s in enumerate(starts)]
            cols = list(zip(*rows)) or [[]] * 8
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), x) for c, x in zip(cols, kinds)], names=["k", "name", "node_type", "parent_name", "start_line", "end_line", "piece", "content"])

    out = df.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).mapInArrow(run, "k string, name string, node_type string, parent_name string, start_line int, end_line int, piece int, content string")
    return out.withColumnRenamed("k", key)


_FROM = re.compile(r"^[ \t]*from[ \t]+([\w.]+)[ \t]+import[ \t]+(\([^)]*\)|[^\n#]+)", re.M)
_PLAIN = re.compile(r"^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+(?:[ \t]+as[ \t]+\w+)?(?:[ \t]*,[ \t]*[\w.]+(?:[ \t]+as[ \t]+\w+)?)*)[ \t]*(;?)[ \t]*$", re.M)
_SCRIPT = re.compile(r"^[ \t]*import[ \t]+(?:type[ \t]+)?([^'\"\n;]*?|\{[^}]*\}|\w+[ \t]*,[ \t]*\{[^}]*\})[ \t\n]*from[ \t]*['\"]([^'\"\n]+)['\"]", re.M)
_REQUIRE = re.compile(r"^[ \t]*(?:const|let|var)[ \t]+(\w+|\{[^}]*\})[ \t]*=[ \t]*require\([ \t]*['\"]([^'\"\n]+)['\"][ \t]*\)", re.M)
_USE = re.compile(r"^[ \t]*(?:pub[ \t]+)?use[ \t]+((?:\w+::)+)(\w+|\{[^}]*\})(?:[ \t]+as[ \t]+(\w+))?[ \t]*;", re.M)


def _listed(names: str) -> list[str]:
    """Local names of a list of imported ones; 'a as b' and 'a: b' are b."""
    found = (re.split(r"\s+as\s+|\s*:\s*", x.strip())[-1].strip() for x in names.strip("(){} \t\n").split(","))
    return [x for x in found if re.fullmatch(r"[\w$]+", x)]


def import_map_of(text: str | None) -> dict[str, str]:
    """Local name to module of a source text (Python, TypeScript and JavaScript, Rust, Java); the first import of a name counts."""
    out: dict[str, str] = {}
    if not text:
        return out
    for m in _SCRIPT.finditer(text):
        for part in re.findall(r"\{[^}]*\}|\*\s*as\s+\w+|\w+", m[1]):
            for name in _listed(part) if part.startswith("{") else [part.split()[-1].lstrip("*")]:
                out.setdefault(name, m[2])
    for m in _REQUIRE.finditer(text):
        for name in _listed(m[1]):
            out.setdefault(name, m[2])
    for m in _FROM.finditer(text):
        for name in _listed(m[2]):
            out.setdefault(name, m[1])
    for m in _PLAIN.finditer(text):
        for part in m[1].split(","):
            words = part.split()
            local = words[-1].rsplit(".", 1)[-1] if m[2] else words[-1] if len(words) > 1 else words[0].split(".")[0]
            out.setdefault(local, words[0].rpartition(".")[0] or words[0] if m[2] else words[0])
    for m in _USE.finditer(text):
        for name in [m[3]] if m[3] else _listed(m[2]):
            out.setdefault(name, m[1].removesuffix("::"))
    return out


def import_map(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, local, module): the names that each text imports, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, name, module) for k, t in zip(*(c.to_pylist() for c in batch.columns)) for name, module in import_map_of(t).items()]
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in cols], names=["k", "local", "module"])

    out = df.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).mapInArrow(run, "k string, local string, module string")
    return out.groupBy("k", "local").agg(F.min("module").alias("module")).withColumnRenamed("k", key)


def with_imports(call_rows: DataFrame, key: str, scope: str, imported: DataFrame) -> DataFrame:
    """Calls (key, scope, callee_name, callee_module) with the module their file imports the name from, where none is known yet.

    ``imported`` is (scope, local, module), the import map of the whole file.
    """
    known = imported.select(scope, F.col("local").alias("callee_name"), "module")
    joined = call_rows.join(known, [scope, "callee_name"], "left")
    return joined.select(key, scope, "callee_name", F.coalesce("callee_module", "module").alias("callee_module"))


def calls(df: DataFrame, key: str, text: str, parent: str) -> DataFrame:
    """(key, callee_name, callee_module): names a text calls, without the languages' own; calls on itself name the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for k, t, p in zip(*(c.to_pylist() for c in batch.columns)):
                own = {d[0] for d in definitions(t)}
                for m in _CALL.finditer(t or ""):
                    if m[2] not in BUILTINS and m[2] not in own:
                        rows.add((k, m[2], f"__self__::{p}" if m[1] and p else None))
            cols = list(zip(*sorted(rows, key=str))) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in cols], names=["k", "callee_name", "callee_module"])

    out = df.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), F.col(parent).alias("p")).mapInArrow(run, "k string, callee_name string, callee_module string")
    return out.withColumnRenamed("k", key)
