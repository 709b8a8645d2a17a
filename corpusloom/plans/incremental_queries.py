"""Queries over the incremental operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.incremental import replay
from ..session import table
from .registry import Registry

incremental = Registry()

P1_SQL = r"""
WITH ok AS (SELECT run_id, max(cutoff_at) AS cutoff_at FROM index_runs WHERE status = 'ok' GROUP BY run_id),
runs AS (SELECT *, row_number() OVER (ORDER BY cutoff_at, run_id) AS n FROM ok),
obs AS (
  SELECT DISTINCT obs_id, file_hash, scanned_at, arrived_at,
         substr(sha256(project_id || ':' || regexp_replace(regexp_replace(regexp_replace(replace(relative_path, chr(92), '/'), '/(\./)+', '/', 'g'), '^(\./)+', ''), '/+', '/', 'g')), 1, 16) AS file_id
  FROM scan_rows WHERE file_hash IS NOT NULL AND file_hash <> ''
),
known AS (SELECT o.*, (SELECT min(n) FROM runs r WHERE r.cutoff_at >= o.arrived_at) AS n FROM obs o),
state AS (
  SELECT r.n, r.run_id, k.file_id, arg_max(k.file_hash, (k.scanned_at, k.arrived_at, k.obs_id)) AS h
  FROM runs r JOIN known k ON k.n <= r.n GROUP BY ALL
)
SELECT run_id, file_id FROM (
  SELECT run_id, file_id, h, lag(h) OVER (PARTITION BY file_id ORDER BY n) AS before FROM state
) WHERE before IS NULL OR before <> h
"""


@incremental.add("p1_found", P1_SQL)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(table(spark, sf_dir, "scan_rows"), table(spark, sf_dir, "index_runs"), spark)
