"""Joins of many rows with one row per key where a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def join_by_weight(rows: DataFrame, per_key: DataFrame, on: Sequence[str], weight: str, part: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``per_key``, an inner join in which no key loads one task.

    ``weight`` of ``per_key`` says how many rows a key has.  Keys that hold a
    ``part``-th of all rows or more are at most ``part``: they are broadcast.  All
    others are shuffled.  Both frames are read twice, so they should be written
    tables.  Null keys match nothing.
    """
    total = per_key.agg(F.sum(weight)).first()[0] or 0
    is_heavy = F.col(weight) * F.lit(part) >= F.lit(total)
    heavy = per_key.where(is_heavy).withColumn("_heavy", F.lit(True))
    marked = rows.join(F.broadcast(heavy), list(on), "left")
    light = marked.where("_heavy is null").select(*rows.columns).join(per_key.where(~is_heavy), list(on))
    return marked.where("_heavy").drop("_heavy").unionByName(light)
