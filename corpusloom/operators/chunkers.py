"""Cutting documents into excerpts, and the texts and facts derived from them.

Result on odd input: null and blank texts give no excerpt; line ends are read as given; every character of a text that is
cut by size lies in a piece; nothing is cut short unless a limit is a stated part of the operator.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_empty, path_tokens, strip

MOST, LEAST, OVERLAP = 4000, 500, 1000


def solid_length(text: Column) -> Column:
    """Characters that are not white space."""
    return F.length(F.regexp_replace(text, r"\s", ""))


def overlapping_pieces(df: DataFrame, key: str, text: str, size: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece, piece_text): pieces of a size, each beginning before the end of the last.

    Texts with no more than ``size`` characters besides white space stay whole.
    """
    step = size - overlap
    short = F.length(F.regexp_replace(text, r"[ \t\n\r\f]", "")) <= size
    n = F.when(short, 1).otherwise(F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / step))).cast("int")
    rows = df.filter(F.length(text) > 0).select(key, text, F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    return rows.select(key, "piece", F.when(short, F.col(text)).otherwise(F.substring(F.col(text), F.col("piece") * step + 1, F.lit(size))).alias("piece_text"))


def paragraphs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, part, part_text): parts between blank lines, blank ones left out; numbered as they stand."""
    parts = F.filter(F.split(blank_to_empty(F.col(text)), r"\n{2,}"), lambda p: strip(p) != "")
    return df.select(key, F.posexplode(parts).alias("part", "part_text"))


def sections(df: DataFrame, key: str, text: str, title: str | None = None) -> DataFrame:
    """(key, section, heading, body): parts of a markdown text that each heading line opens; what stands before is section 0.

    Sections are cut inside the row, so no line is shuffled.
    """
    marked = F.regexp_replace(blank_to_empty(F.col(text)), r"(?m)^(#{1,6} )", "\x01$1")
    parts = F.split(marked, "\x01", -1)
    rows = df.select(key, *([title] if title else []), F.posexplode(parts).alias("section", "body")).filter(strip(F.col("body")) != "")
    heading = strip(F.regexp_extract("body", r"\A#{1,6} ([^\n]*)", 1))
    return rows.select(key, "section", F.when(F.col("section") > 0, heading).otherwise(F.col(title) if title else F.lit(None)).alias("heading"), "body")


def merge_small(df: DataFrame, key: str, order: str, text: str, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(key, group, first, last, merged): neighbours of less than ``least`` solid characters gathered up to ``most``; others alone.

    The rule is greedy, so each key's rows are read in order by one stream; rows are sorted by Spark and never held together.
    """
    kind = df.schema[key].dataType.simpleString()
    sized = df.select(F.col(key).alias("k"), F.col(order).cast("bigint").alias("o"), F.col(text).alias("t"), solid_length(F.col(text)).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, group, texts, total, first, last = None, 0, [], 0, 0, 0

        def flush(out: list) -> None:
            nonlocal texts, total, group
            if texts:
                out.append((current, group, first, last, "\n\n".join(texts)))
                group += 1
            texts, total = [], 0

        for batch in batches:
            out: list = []
            for k, o, t, n in zip(*(c.to_pylist() for c in batch.columns)):
                if k != current:
                    flush(out)
                    current, group = k, 0
                if n >= least or (texts and total + n > most):
                    flush(out)
                if not texts:
                    first = o
                texts.append(t)
                total, last = total + n, o
                if n >= least:
                    flush(out)
            yield _batch(out)
        out = []
        flush(out)
        yield _batch(out)

    def _batch(out: list) -> pa.RecordBatch:
        cols = list(zip(*out)) or [[]] * 5
        kinds = (pa.int64() if kind == "bigint" else pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(list(c), x) for c, x in zip(cols, kinds)], names=["k", "group", "first", "last", "merged"])

    out = sized.repartition("k").sortWithinPartitions("k", "o").mapInArrow(run, f"k {'bigint' if kind == 'bigint' else 'string'}, `group` int, `first` bigint, `last` bigint, merged string")
    return out.withColumnRenamed("k", key)


def rationale(text: Column) -> Column:
    """Notes in comments that say why: NOTE, WHY, TODO, FIXME, HACK, XXX, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(blank_to_empty(text), F.lit(r"(?im)^[ \t]*(?:#|//|\*|--)+[ \t]*((?:NOTE|WHY|TODO|FIXME|HACK|XXX)\b[^\n]*)"), 1), strip))


def embedding_text(node_type: Column, parent: Column, name: Column, path: Column, imports: Column, doc: Column, content: Column) -> Column:
    """The text that stands for an excerpt: what it is and where, up to ten imports, documentation, content."""
    head = F.concat(F.lit("passage: ["), F.coalesce(node_type, F.lit("block")), F.lit("] "), F.concat_ws(".", parent, name), F.lit(" in "), F.coalesce(path, F.lit("")))
    used = F.when(F.size(imports) > 0, F.concat(F.lit("imports: "), F.array_join(F.slice(imports, 1, 10), ", ")))
    return F.concat_ws("\n", head, used, F.when(doc != "", doc), content)


def imports(text: Column) -> Column:
    """Modules that a source text imports, each once, in order (Python, TypeScript and JavaScript, Go, Rust, Java)."""
    found = F.regexp_extract_all(blank_to_empty(text), F.lit(r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+)\s*;?$|use\s+([\w:]+)|import\s+.*?from\s+['\"]([^'\"]+)['\"])"), 0)
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"(?s)^\s*(?:import\s+.*?from\s+['\"]|from\s+|import\s+|use\s+)", ""), r"(?:\s+import|['\"]|\s*;)\s*$", "")))


def turn_text(source: Column, turn: Column, prompt: Column, reply: Column, files: Column) -> Column:
    """The text that stands for a turn: prompt and reply clipped as stored, files named."""
    return F.concat_ws("\n", F.concat(F.lit("["), source, F.lit(" turn] "), F.substring(blank_to_empty(prompt), 1, 1500)), F.when(reply != "", F.substring(reply, 1, 1800)), F.when(F.size(files) > 0, F.concat(F.lit("files: "), F.array_join(F.slice(files, 1, 40), ", "))))


def referenced_files(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, place): paths a text names, in order."""
    return df.select(key, F.posexplode(path_tokens(F.col(text))).alias("place", "path")).select(key, "path", "place")


def adjacent(df: DataFrame, key: str, start: str, end: str) -> Column:
    """Lines between an excerpt and the one before it in its file."""
    return F.col(start) - F.lag(end).over(Window.partitionBy(key).orderBy(start, end)) - 1
