"""Churn and code health."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import posix


def churn_counts(log: DataFrame) -> DataFrame:
    """(path, commits, ord) from (ord, line) rows of a log that names a path per line."""
    return log.withColumn("path", F.trim("line")).where("path <> ''").groupBy("path").agg(F.count("*").alias("commits"), F.min("ord").alias("ord"))


def normalised(rows: DataFrame, column: str, out: str = "churn") -> DataFrame:
    """``column`` over its largest value; 0 where all are 0.  The maximum is one row, joined, not a window."""
    top = rows.agg(F.max(column).alias("_top"))
    return rows.crossJoin(F.broadcast(top)).withColumn(out, F.coalesce(F.try_divide(F.col(column).cast("double"), F.col("_top").cast("double")), F.lit(0.0))).drop("_top")


def churn_of(findings: DataFrame, churn: DataFrame) -> DataFrame:
    """``findings`` with churn: the file's own path, else the first path in the log that ends in /file, else 0."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    files = findings.select("file").distinct().withColumn("_b", base(F.col("file")))
    c = churn.select("path", F.col("churn").alias("v"), "ord").withColumn("_b", base(F.col("path")))
    met = files.join(c, "_b").where((F.col("path") == F.col("file")) | F.endswith("path", F.concat(F.lit("/"), F.col("file"))))
    best = met.groupBy("file").agg(F.round(F.min_by("v", F.struct(F.col("path") != F.col("file"), "ord")), 2).alias("v"))
    return findings.drop("churn").join(best, "file", "left").withColumn("churn", F.coalesce("v", F.lit(0.0))).drop("v")


def health_of(findings: DataFrame, penalties: DataFrame) -> DataFrame:
    """``findings`` with code_health_penalty from (file, penalty) rows; files without one have none."""
    per_file = penalties.groupBy("file").agg(F.max("penalty").alias("_p"))
    own = F.regexp_replace(posix(F.col("file")), r"^(\./)+", "")
    out = findings.withColumn("_f", own).join(per_file.withColumnRenamed("file", "_f"), "_f", "left")
    return out.withColumn("code_health_penalty", F.coalesce("_p", "code_health_penalty", F.lit(0.0))).select(*findings.columns)


def high_churn(rows: DataFrame, least: float = 0.9) -> DataFrame:
    return rows.where(F.col("churn") >= least)


def health_penalty(features: DataFrame) -> DataFrame:
    """Adds penalty to (loc, max_nesting, bare_excepts, long_functions) rows."""
    loc = F.when(F.col("loc") > 1000, 0.5).when(F.col("loc") > 600, 0.35).when(F.col("loc") > 300, 0.2).when(F.col("loc") > 150, 0.1).otherwise(0.0)
    nesting = F.when(F.col("max_nesting") >= 7, 0.3).when(F.col("max_nesting") >= 4, 0.15).otherwise(0.0)
    few = lambda c: F.least(F.lit(0.2), F.col(c) * 0.05)
    return features.withColumn("penalty", F.round(F.least(F.lit(1.0), loc + nesting + few("bare_excepts") + few("long_functions")), 2))


__all__ = ["churn_counts", "churn_of", "health_of", "health_penalty", "high_churn", "normalised"]
