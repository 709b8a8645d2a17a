"""Files as a source: which to take, in what language, with which hash, and what changed since the last state."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The language of each extension.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "rs": "rust", "go": "go", "rb": "ruby", "java": "java", "kt": "kotlin", "c": "c", "cpp": "cpp",
    "h": "c", "hpp": "cpp", "swift": "swift", "sql": "sql", "css": "css", "scss": "scss", "html": "html", "md": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml",
}
# Names and places of files that hold secrets.
SENSITIVE_NAMES = r"(?i)^(?:\.env(?:\..+)?|\.envrc|.+\.(?:pem|key|p12|pfx|crt|cer|der|p8|jks)|(?:.*[-_.])?(?:credentials?|secrets?)\.(?:json|ya?ml|toml|env|ini|conf)|service[-_.]?account.*\.json|id_(?:rsa|dsa|ecdsa|ed25519)(?:\.pub)?|\.netrc|\.pgpass|\.htpasswd)$"
SENSITIVE_PATHS = r"(?i)(?:^|/)\.ssh/id_(?:rsa|dsa|ecdsa|ed25519)|(?:^|/)\.aws/credentials$|(?:^|/)\.gcloud/.*credentials"
BINARY = ("png", "jpg", "jpeg", "gif", "webp", "ico", "pdf", "zip", "gz", "tar", "whl", "so", "dylib", "dll", "exe", "woff", "woff2", "ttf", "mp3", "mp4")
MOST_BYTES = 512 * 1024


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language(path: Column) -> Column:
    """The language of the extension; null for others."""
    return F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[extension(path)]


def is_sensitive(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1).rlike(SENSITIVE_NAMES) | path.rlike(SENSITIVE_PATHS)


def content_hash(path: Column, content: Column) -> Column:
    """SHA-256 of a text; of markdown without its front matter, so that edits there change nothing."""
    body = F.when(extension(path) == "md", F.regexp_replace(content, r"\A---\r?\n(?s:.*?)\r?\n---\r?\n", "")).otherwise(content)
    return F.sha2(body, 256)


def exclusion(path: Column, size: Column, ignored: Column) -> Column:
    """Why a file is left out, null if it is taken."""
    return F.when(ignored, "ignored").when(is_sensitive(path), "sensitive").when(extension(path).isin(*BINARY), "binary").when(size > MOST_BYTES, "too large").when(language(path).isNull(), "no language")


def ignored(path: Column, patterns: list[str]) -> Column:
    """Patterns of an ignore file over a path: the last that matches wins, ``!`` takes back."""
    out = F.lit(False)
    for raw in patterns:
        p = raw.strip()
        if not p or p.startswith("#"):
            continue
        keep, p = p.startswith("!"), p.lstrip("!")
        out = F.when(path.rlike(_ignore_regex(p)), F.lit(not keep)).otherwise(out)
    return out


def _ignore_regex(pattern: str) -> str:
    anchored, folder = "/" in pattern.rstrip("/"), pattern.endswith("/")
    body = re.escape(pattern.strip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return ("^" if anchored else "(?:^|/)") + body + ("/" if folder else "(?:/|$)")


def changes(now: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): 'added', 'changed' or 'deleted' against the stored state; an empty stored hash counts as changed.

    Both have (keys, file_hash); files whose hashes agree give nothing.
    """
    a = now.select(*keys, F.col("file_hash").alias("h")).groupBy(*keys).agg(F.max("h").alias("h"))
    b = before.select(*keys, F.col("file_hash").alias("old")).groupBy(*keys).agg(F.max("old").alias("old"), F.lit(True).alias("was"))
    j = a.withColumn("is", F.lit(True)).join(b, keys, "full_outer")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when((F.coalesce("old", F.lit("")) == "") | ~F.col("old").eqNullSafe(F.col("h")), "changed")
    return j.select(*keys, kind.alias("change")).filter("change is not null")


def walk(spark: SparkSession, folder: str, patterns: list[str] | None = None) -> DataFrame:
    """(relative_path, file_size, file_mtime, content): text files below a folder, filtered before their content is read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = re.escape(folder.rstrip("/")) if "://" in folder else re.escape(folder.rstrip("/"))
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), f"^(?:file:)?/*{root.lstrip('/')}/?|^/?{root.lstrip('/')}/?", "")
    rows = raw.filter(F.col("length") <= MOST_BYTES).select(path.alias("relative_path"), F.col("length").alias("file_size"), F.col("modificationTime").alias("file_mtime"), F.col("content"))
    rel = F.regexp_replace("relative_path", "^/", "")
    kept = rows.withColumn("relative_path", rel).filter(exclusion(F.col("relative_path"), F.col("file_size"), ignored(F.col("relative_path"), patterns or [])).isNull())
    return kept.withColumn("content", F.decode("content", "UTF-8"))


def name_status(lines: DataFrame, column: str = "value") -> DataFrame:
    """(path, change) from lines of a version control's name-status report; a rename is a deletion and an addition."""
    parts = F.split(column, "\t")
    code = F.substring(parts[0], 1, 1)
    moves = F.array(F.struct(parts[1].alias("path"), F.lit("deleted").alias("change")), F.struct(F.get(parts, 2).alias("path"), F.lit("added").alias("change")))
    one = F.array(F.struct(parts[1].alias("path"), F.when(code == "A", "added").when(code == "D", "deleted").otherwise("changed").alias("change")))
    return lines.filter(F.size(parts) > 1).select(F.inline(F.when(code.isin("R", "C"), moves).otherwise(one))).dropDuplicates(["path", "change"])
