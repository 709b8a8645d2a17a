"""Session, table access and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Paths of the intermediate tables of this process.
_WRITTEN: list[str] = []


def get_session(app: str = "corpusloom", cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the engine expects on a cluster too."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share. A private one is made only in a local session that names none (tests); a cluster must name one."""
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        current = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch(spark: SparkSession, purpose: str) -> str:
    """A fresh path inside the shared folder."""
    path = f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives the loss of executors."""
    path = scratch(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimised plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Bytes up to which a written table is sent to every executor.
BROADCAST_BYTES = 16 << 20


def broadcast_if_small(df: DataFrame, purpose: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The table written once and, if its files are small, marked for broadcast; else left to a shuffled join."""
    kept = materialise(df, purpose)
    return F.broadcast(kept) if estimated_bytes(kept) <= limit else kept


def first_rows(rows: DataFrame, *identity: Column) -> DataFrame:
    """The rows of a table of files, of repeated ones the first; rows are repeated if they agree in all of ``identity``.

    Wide columns stay where they are: only the identity (pass a hash of long texts) and the place of a row are shuffled, and
    the places of repeats go to all tasks if they are few.
    """
    place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")]
    names = [f"__k{i}" for i in range(len(identity))]
    at = rows.select(*[c.alias(n) for c, n in zip(identity, names)], F.struct(*place).alias("__at"))
    several = at.groupBy(*names).agg(F.min("__at").alias("__first"), F.count("*").alias("__n")).filter("__n > 1").drop("__n")
    same = F.lit(True)
    for n in names:
        same = same & at[n].eqNullSafe(several[n])
    repeats = broadcast_if_small(at.join(several, same).filter("__at != __first").select("__at.*"), "repeats")
    return rows.select("*", *place).join(repeats, ["__file", "__row"], "left_anti").drop("__file", "__row")


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables that this process wrote; call it once no result that is read from them is needed."""
    removed = 0
    for path in _WRITTEN:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        removed += bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True))
    _WRITTEN.clear()
    return removed
