"""Processing only new or changed records, by diffs of immutable table versions.

A ``ManifestTable`` is a folder of Parquet files and numbered JSON manifests. A
manifest names the files a version adds, the files it removes and the deletion
vectors it lays over older files (file, row position and the row as it was), and
is never changed. The difference of two versions is read from the manifests
alone: only files added, files removed and new deletion vectors are opened. A
consumer writes its output and the source version it has processed in one
manifest of the output table, created under its final name without overwriting,
so a run that fails leaves nothing behind and a run that is repeated starts from
the last commit. A manifest that cannot be read is one that was never finished
and counts for nothing.

``replay`` builds such a table from raw observations, one version for each
committed run, holding the state of each file as that run knew it, and lets each
run take up what is new by ``process_new``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch


def plain_path(path: Column) -> Column:
    """The plain spelling of a path: forward slashes, no empty or '.' parts, '..' resolved."""
    parts = F.split(F.trim(path), r"[/\\]+")
    step = lambda acc, x: (
        F.when(x.isin("", "."), acc).when((x == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(x)))
    )
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def file_id(project: Column, path: Column) -> Column:
    """First 16 hex digits of sha256 of 'project:path'."""
    return F.substring(F.sha2(F.concat_ws(":", project, path), 256), 1, 16)


#: Every so many versions a manifest names all live files.
SNAPSHOT = 16


class ManifestTable:
    """An append-only sequence of immutable versions in one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._at = hadoop.Path
        self._read_once: dict[int, dict] = {}  # manifests never change

    # -- manifests

    def _numbers(self) -> list[int]:
        folder = self._at(f"{self.path}/_manifests")
        if not self._fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(folder))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def _manifest(self, number: int) -> dict | None:
        """A manifest, read once as it never changes; None if it was never finished."""
        if number not in self._read_once:
            try:
                self._read_once[number] = json.loads(self._read(f"{self.path}/_manifests/{number:09d}.json"))
            except ValueError:
                return None
        return self._read_once[number]

    def versions(self, above: int = 0, upto: int | None = None) -> list[dict]:
        """The manifests above one version and up to another, oldest first."""
        found = (self._manifest(n) for n in self._numbers() if above < n and (upto is None or n <= upto))
        return [m for m in found if m is not None]

    def _last(self) -> dict | None:
        return next((m for n in reversed(self._numbers()) if (m := self._manifest(n)) is not None), None)

    def latest(self) -> int:
        last = self._last()
        return last["version"] if last else 0

    def processed(self, source: str) -> int:
        """The version of ``source`` whose records the committed output holds."""
        last = self._last()
        return last["processed"].get(source, 0) if last else 0

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._at(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, added: Sequence[str] = (), removed: Sequence[str] = (), deleted: Sequence[str] = (), processed: dict[str, int] | None = None, note: dict | None = None) -> int:
        """Put the next manifest in place; fails if another writer was first.

        What has been processed is carried on from manifest to manifest, and every ``SNAPSHOT``-th names all live files, so
        neither question needs the whole history.
        """
        last = self._last()
        version = max(self.latest(), *self._numbers()[-1:], 0) + 1
        manifest = {"version": version, "added": list(added), "removed": list(removed), "deleted": list(deleted), "processed": {**(last["processed"] if last else {}), **(processed or {})}, "note": note or {}}
        if version % SNAPSHOT == 0:
            manifest["live"] = self._apply(self._files(version - 1), manifest)
        final = self._at(f"{self.path}/_manifests/{version:09d}.json")
        try:
            out = self._fs.create(final, False)
        except Exception as e:  # the file system says in its own words that the name is taken
            if self._fs.exists(final):
                raise RuntimeError(f"version {version} was committed by another writer") from e
            raise
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        return version

    def files_in(self, folder: str) -> list[str]:
        where = self._at(folder)
        if not self._fs.exists(where):
            return []
        return sorted(s.getPath().toString() for s in self._fs.listStatus(where) if s.getPath().getName().endswith(".parquet"))

    # -- writing

    def append(self, rows: DataFrame, processed: dict[str, int] | None = None) -> int:
        """Commit the rows as one version, with the source versions they came from."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        return self.publish(self.files_in(folder), processed=processed)

    def delete(self, condition: Column) -> int:
        """Commit a deletion vector over the live rows that meet the condition."""
        folder = f"{self.path}/deleted/{uuid.uuid4().hex}"
        self.live(positions=True).filter(condition).write.parquet(folder)
        return self.publish(deleted=self.files_in(folder))

    def upsert(self, rows: DataFrame, keys: list[str], processed: dict[str, int] | None = None) -> int:
        """Commit the rows in place of the live ones with the same keys, as one version; a repeated key keeps all its rows."""
        return self._exchange(rows, lambda live: live.join(rows.select(*keys).distinct(), keys, "left_semi"), processed)

    def replace(self, rows: DataFrame | None, condition: Column, processed: dict[str, int] | None = None) -> int:
        """Commit the rows in place of all live ones that meet the condition, as one version."""
        return self._exchange(rows, lambda live: live.filter(condition), processed)

    def remove(self, keys: DataFrame) -> int:
        """Commit the deletion of the live rows that agree with a row of ``keys`` in all its columns."""
        return self._exchange(None, lambda live: live.join(keys.distinct(), keys.columns, "left_semi"))

    def _exchange(self, rows: DataFrame | None, chosen, processed: dict[str, int] | None = None) -> int:
        added, dead = f"{self.path}/data/{uuid.uuid4().hex}", f"{self.path}/deleted/{uuid.uuid4().hex}"
        if rows is not None:
            rows.write.parquet(added)
        if self._files(self.latest()):
            chosen(self.live(positions=True)).write.parquet(dead)
        return self.publish(self.files_in(added), deleted=self.files_in(dead), processed=processed)

    def compact(self) -> int:
        """Rewrite all live rows into new files; a later diff over this version shows no change of records."""
        version = self.latest()
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        self.live().write.parquet(folder)
        return self.publish(self.files_in(folder), removed=self._files(version))

    # -- reading

    @staticmethod
    def _apply(files: Sequence[str], manifest: dict) -> list[str]:
        gone = set(manifest["removed"])
        return [f for f in files if f not in gone] + list(manifest["added"])

    def _files(self, version: int) -> list[str]:
        later: list[dict] = []
        files: list[str] = []
        for n in reversed([n for n in self._numbers() if n <= version]):
            m = self._manifest(n)
            if m is None:
                continue
            if "live" in m:
                files = m["live"]
                break
            later.append(m)
        for m in reversed(later):
            files = self._apply(files, m)
        return list(dict.fromkeys(files))

    def _vectors(self, above: int, upto: int) -> DataFrame | None:
        files = [f for m in self.versions(above, upto) for f in m["deleted"]]
        return self.spark.read.parquet(*files) if files else None

    def _rows(self, files: Sequence[str]) -> DataFrame | None:
        if not files:
            return None
        return self.spark.read.parquet(*files).select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("row_index"))

    def live(self, version: int | None = None, positions: bool = False) -> DataFrame:
        version = self.latest() if version is None else version
        rows, gone = self._rows(self._files(version)), self._vectors(0, version)
        if rows is None:
            raise ValueError("the table has no files")
        if gone is not None:
            rows = rows.join(gone.select("file_path", "row_index"), ["file_path", "row_index"], "left_anti")
        return rows if positions else rows.drop("file_path", "row_index")

    def diff(self, older: int, newer: int) -> DataFrame | None:
        """Record deltas from one version to another: the rows with ``change`` 'insert' or 'delete'; None if nothing changed.

        A row that a rewrite only moved to another file is both inserted and deleted and cancels out.
        """
        before, after = self._files(older), self._files(newer)
        left, stayed = set(before) - set(after), set(before) & set(after)
        parts, at = [], ["file_path", "row_index"]
        newly = self._vectors(older, newer)
        fresh = self._rows([f for f in after if f not in set(before)])
        if fresh is not None:
            if newly is not None:  # older vectors cannot lie over files that were not there
                fresh = fresh.join(newly.select(*at), at, "left_anti")
            parts.append(fresh.drop(*at).withColumn("change", F.lit("insert")))
        lost = self._rows([f for f in before if f in left])
        if lost is not None:
            gone = self._vectors(0, older)
            if gone is not None:
                lost = lost.join(gone.select(*at), at, "left_anti")
            parts.append(lost.drop(*at).withColumn("change", F.lit("delete")))
        if newly is not None and stayed:
            # the vectors hold the rows as they were, so the files they lie over are not opened; file names are unique
            names = self.spark.createDataFrame([(f.rsplit("/", 1)[-1],) for f in stayed], "file_name string")
            hit = newly.withColumn("file_name", F.substring_index("file_path", "/", -1)).join(names, "file_name", "left_semi")
            parts.append(hit.drop(*at, "file_name").withColumn("change", F.lit("delete")))
        if not parts:
            return None
        union = parts[0]
        for part in parts[1:]:
            union = union.unionByName(part)
        if left:
            names = [c for c in union.columns if c != "change"]
            net = union.groupBy(*names).agg(F.sum(F.when(F.col("change") == "insert", 1).otherwise(-1)).alias("n")).filter("n != 0")
            union = net.select(*names, F.when(F.col("n") > 0, "insert").otherwise("delete").alias("change"), F.explode(F.sequence(F.lit(1), F.abs("n"))).alias("__copy")).drop("__copy")
        return union


def process_new(source: ManifestTable, output: ManifestTable, name: str, transform, upto: int | None = None) -> int | None:
    """One incremental run: transform the deltas since the last committed run, and commit result and processed version together."""
    done, newest = output.processed(name), source.latest() if upto is None else upto
    if newest <= done:
        return None
    deltas = source.diff(done, newest)
    if deltas is None:
        return output.publish(processed={name: newest})
    return output.append(transform(deltas), processed={name: newest})


def cascade(keys: DataFrame, steps: Sequence[tuple[ManifestTable, str, str]]) -> None:
    """Delete rows and what hangs on them: each step is (table, the column that refers, the column the next step refers to).

    ``keys`` has one column, the keys to begin with. Deepest tables go first, so that a lost run leaves nothing that hangs in
    the air and can be repeated.
    """
    plan, current = [], keys.toDF("__key").distinct()
    for held, refers, own in steps:
        plan.append((held, current.withColumnRenamed("__key", refers)))
        current = held.live().join(current.withColumnRenamed("__key", refers), refers, "left_semi").select(F.col(own).alias("__key")).distinct()
    for held, gone in reversed(plan):
        held.remove(gone)


def successful_runs(runs: DataFrame) -> list[tuple]:
    """(run_id, cutoff) of the runs with a log row 'ok', in order. The run log is metadata, a few rows for each run."""
    ok = runs.filter("status = 'ok'").groupBy("run_id").agg(F.max("cutoff_at").alias("cutoff_at")).filter("cutoff_at is not null")
    return [(r["run_id"], r["cutoff_at"]) for r in ok.orderBy("cutoff_at", "run_id").collect()]


def known_at(arrived: Column, runs: Sequence[tuple]) -> Column:
    """The 1-based number of the first run that knows a row which arrived then; null if none does."""
    stamps = F.array(*[F.lit(cutoff).cast("timestamp_ntz") for _, cutoff in runs])
    first = F.size(F.filter(stamps, lambda c: c < arrived)) + 1
    return F.when(first <= len(runs), first)


def replay(observations: DataFrame, runs: DataFrame, spark: SparkSession) -> DataFrame:
    """(run_id, file_id): the files that each successful run must process.

    A version of the state table is what one successful run knew: for each file the known observation with the latest
    ``scanned_at``. Observations are first reduced to one for each file and version, so a file that holds a third of
    all rows leaves at most one row for each run. Each version's files and deletion vectors are written once; then
    one run after the other reads the deltas since the last committed one and commits what it takes up with the version it
    has processed. An update counts if its hash differs from the one it replaces.

    Observations without a hash, path, project or arrival are not known to any run; repeated rows change nothing; ties
    of ``scanned_at`` go to the later arrival, then the larger ``obs_id``. No run or no observation: an empty result.
    """
    done = successful_runs(runs)
    out = "run_id bigint, file_id string"
    if not done:
        return spark.createDataFrame([], out)
    o = observations.filter("file_hash is not null and file_hash != '' and relative_path is not null and project_id is not null and scanned_at is not null")
    o = o.select(file_id(F.col("project_id"), plain_path(F.col("relative_path"))).alias("file_id"), "file_hash", "scanned_at", "arrived_at", "obs_id", known_at(F.col("arrived_at"), done).alias("version"))
    latest = o.filter("version is not null").groupBy("file_id", "version").agg(F.max_by(F.struct("scanned_at", "arrived_at", "obs_id", "file_hash"), F.struct("scanned_at", "arrived_at", "obs_id")).alias("s"))
    w = Window.partitionBy("file_id").orderBy("version")
    rank = F.struct("s.scanned_at", "s.arrived_at", "s.obs_id")
    newest = latest.withColumn("__best", F.max(rank).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    state = newest.filter("__best is null or __best < struct(s.scanned_at, s.arrived_at, s.obs_id)").select("file_id", "s.file_hash", "version")

    table = ManifestTable(spark, scratch(spark, "state"))
    data, dead = f"{table.path}/data", f"{table.path}/deleted"
    state.write.partitionBy("version").parquet(data)
    placed = spark.read.schema("file_id string, file_hash string, version int").parquet(data).select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("row_index"))
    replaced = placed.withColumn("replaced_at", F.lead("version").over(Window.partitionBy("file_id").orderBy("version"))).filter("replaced_at is not null")
    replaced.drop("version").write.partitionBy("replaced_at").parquet(dead)
    taken = ManifestTable(spark, scratch(spark, "taken"))
    for number, (run_id, _) in enumerate(done, 1):
        version = table.publish(table.files_in(f"{data}/version={number}"), deleted=table.files_in(f"{dead}/replaced_at={number}"), note={"run_id": run_id})
        process_new(table, taken, "state", lambda deltas, run_id=run_id: _changed(deltas, "file_id", "file_hash").select(F.lit(run_id).cast("bigint").alias("run_id"), "file_id"), version)
    return taken.live() if taken._files(taken.latest()) else spark.createDataFrame([], out)


def _changed(deltas: DataFrame, key: str, digest: str) -> DataFrame:
    """(key) of the records that the deltas insert, or whose digest they change; an insert and a delete of one digest cancel out."""
    value = lambda change: F.max(F.when(F.col("change") == change, F.col(digest)))
    pairs = deltas.groupBy(key).agg(value("insert").alias("now"), value("delete").alias("before"))
    return pairs.filter("now is not null and (before is null or now != before)").select(key)
