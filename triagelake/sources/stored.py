"""Stored tables: baselines, saved scans, graphs, labels, and a cache with an age limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import verdict
from ..schema import FINDING


def baseline(files: DataFrame, column: str = "text") -> DataFrame:
    """(fingerprint, version) of baseline files: a list (version 1) or an object (version 2)."""
    v2 = F.from_json(column, "struct<version:int,fingerprints:array<string>,findings:array<struct<fingerprint:string>>>")
    v1 = F.from_json(column, "array<string>")
    is_list = F.startswith(F.ltrim(column), F.lit("["))
    none = F.array().cast("array<string>")
    plain = F.filter(F.transform(F.coalesce(v1, none), lambda x: F.coalesce(F.get_json_object(x, "$.fingerprint"), F.when(~F.startswith(x, F.lit("{")), x))), lambda x: x.isNotNull())
    both = F.concat(F.coalesce(v2["fingerprints"], none), F.coalesce(F.transform(v2["findings"], lambda f: f["fingerprint"]), none))
    out = files.select(F.explode(F.when(is_list, plain).otherwise(both)).alias("fingerprint"), F.when(is_list, 1).otherwise(F.coalesce(v2["version"], F.lit(2))).alias("version"))
    return out.where("fingerprint is not null").distinct()


def saved_scan(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a saved scan, in the finding schema; absent members are null."""
    return spark.read.schema(FINDING).option("multiLine", "true").json(path)


def labels(rows: DataFrame) -> DataFrame:
    """(key, verdict, note) with verdicts checked."""
    return rows.select(F.trim("key").alias("key"), verdict(F.col("verdict")).alias("verdict"), F.coalesce("note", F.lit("")).alias("note"))


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges", "files"))


def cached(entries: DataFrame, now: float, ttl: float | None) -> DataFrame:
    """(ns, key, value): the newest value of each key that is not older than ``ttl`` seconds; None accepts any age."""
    fresh = entries if ttl is None else entries.where(F.col("ts") >= now - ttl)
    return fresh.where("value is not null").groupBy("ns", "key").agg(F.max_by("value", "ts").alias("value"))
