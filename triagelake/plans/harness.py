"""A findings table over the star schema's ``events``: scaffolding to exercise the operators on driver data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import EXTRA, FINDING

#: One SELECT for both engines; {k} is the number in ``props``.
FINDINGS_SQL = """
SELECT event_id AS fid, event_id AS ord,
  CASE event_id % 5 WHEN 0 THEN 'dependency' WHEN 1 THEN 'secrets' WHEN 2 THEN 'crypto' WHEN 3 THEN 'bandit' ELSE 'semgrep' END AS engine,
  concat('B', 100 + k % 16, ': issue ', event_type) AS title,
  concat(CASE WHEN user_id % 9 = 0 THEN 'tests/' WHEN user_id % 9 = 1 THEN './docs/' WHEN user_id % 9 = 2 THEN 'examples/' ELSE 'src/' END, 'mod', user_id % 40, '/f', user_id % 7, '.py') AS file,
  CAST(1 + k AS INT) AS line,
  CASE k % 8 WHEN 0 THEN 'CWE-89' WHEN 1 THEN 'cwe-78' WHEN 2 THEN 'CWE-94: code' WHEN 3 THEN '327' WHEN 4 THEN 'CWE-328' WHEN 5 THEN 'CWE-798' WHEN 7 THEN 'CWE-330' END AS cwe,
  CAST(CAST(floor(value * 10) AS BIGINT) % 101 AS DOUBLE) / 10 AS severity,
  concat('uses ', CASE k % 4 WHEN 0 THEN 'SQL text' WHEN 1 THEN 'md5 hash' WHEN 2 THEN 'shell call' ELSE 'nothing' END) AS description,
  concat(event_type, '(', k % 3, ')') AS evidence,
  CAST((event_id * 7) % 101 AS DOUBLE) / 100 AS exploitability,
  CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS reachable,
  event_id % 14 AS blast_radius, CAST(user_id % 10 AS DOUBLE) / 10 AS churn, CAST(event_id % 5 AS DOUBLE) / 5 AS code_health_penalty,
  CASE event_id % 11 WHEN 0 THEN 'HTTP' WHEN 1 THEN 'REPO' WHEN 2 THEN 'HIST' WHEN 3 THEN 'WORKER' WHEN 4 THEN 'STARTUP' WHEN 5 THEN 'CLI' WHEN 6 THEN 'INTNL' WHEN 7 THEN 'TEST' WHEN 8 THEN 'DEAD' WHEN 9 THEN 'UNKNOWN' END AS exposure,
  CASE event_id % 9 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' END AS fp_likelihood,
  CASE WHEN event_id % 9 < 2 THEN concat('reason ', event_id % 7) END AS fp_reason,
  CASE WHEN event_id % 5 = 0 AND event_id % 3 = 0 THEN CAST(event_id % 97 AS DOUBLE) / 97 END AS epss,
  event_id % 31 = 0 AS kev, event_id % 17 = 0 AS suppressed, event_id % 23 = 0 AS is_ref_id, event_id % 29 = 0 AS rotated,
  CASE event_id % 4 WHEN 0 THEN 'TP' WHEN 1 THEN 'FP' WHEN 2 THEN 'UNSURE' END AS verdict, k, user_id, event_type
FROM (SELECT *, CAST({k} AS INT) AS k FROM events)
"""

#: The same as a common table expression ``f`` for DuckDB.
F_CTE = "WITH RECURSIVE f AS (" + FINDINGS_SQL.replace("{k}", "json_extract_string(props, '$.k')") + ")"


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scaffolding table with all its plain columns."""
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("_triage_events")
    return spark.sql(FINDINGS_SQL.replace("{k}", "get_json_object(props, '$.k')").replace("FROM events", "FROM _triage_events"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a finding table, with its verdict beside."""
    f = flat(spark, sf_dir)
    known = {"epss", "kev", "suppressed", "is_ref_id", "rotated"}
    extra = F.struct(*[(F.col(x.name) if x.name in known else F.lit(None)).cast(x.dataType).alias(x.name) for x in EXTRA.fields])
    cols = [(F.col(x.name) if x.name in f.columns else F.lit(None)).cast(x.dataType).alias(x.name) for x in FINDING.fields if x.name != "extra"]
    return f.select(*cols, extra.alias("extra"), "verdict", "k", "user_id", "event_type")
