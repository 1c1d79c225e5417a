"""Unions in order, scopes, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import same_path


def union_in_order(parts: list[DataFrame]) -> DataFrame:
    """All rows with src (the part's number) and ord, which keeps the parts' order and the order within them."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("src", F.lit(k))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out.withColumn("ord", F.col("src").cast("bigint") * F.lit(1 << 40) + F.col("ord"))


def changed_scope(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows whose file is a changed path, or ends in one (or is its end) at a folder's boundary.

    Both sides are keyed by the file's last part, so that only equal names meet.
    """
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    paths = changed.select(F.col("path").alias("_path")).distinct()
    return rows.join(paths, (base(F.col("file")) == base(F.col("_path"))) & same_path(F.col("file"), F.col("_path")), "left_semi")


def quotas(sizes: dict, n: int) -> dict:
    """How many rows each stratum gives, ``n`` together where the strata allow it.

    Shares are rounded, one at least.  What is too much is taken off the largest
    quota, what is missing is given where most rows are left; ties go to the last name.
    """
    total = sum(sizes.values())
    if n >= total:
        return dict(sizes)
    out = {k: max(1, round(n * v / total)) for k, v in sizes.items()}
    name = lambda k: "" if k is None else str(k)
    while sum(out.values()) != n:
        step = -1 if sum(out.values()) > n else 1
        able = [k for k in out if (out[k] > 1 if step < 0 else out[k] < sizes[k])]
        if not able:
            break
        out[max(able, key=lambda k: (out[k] if step < 0 else sizes[k] - out[k], name(k)))] += step
    return out


def stratified_sample(rows: DataFrame, strata: str, key: str, n: int, seed: str = "") -> DataFrame:
    """``n`` rows, in proportion to the strata's sizes and at least one of each; the same rows every time.

    The order within a stratum is that of md5(key and seed).  One row per
    stratum reaches the driver for :func:`quotas`; strata are few (engines, sources).
    """
    sizes = {r[0]: r[1] for r in rows.groupBy(strata).agg(F.count("*")).collect()}
    kind = rows.schema[strata].dataType.simpleString()
    quota = rows.sparkSession.createDataFrame(list(quotas(sizes, n).items()), f"_stratum {kind}, quota int")
    order = Window.partitionBy(strata).orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key)
    return rows.withColumn("_rn", F.row_number().over(order)).join(F.broadcast(quota), F.col(strata).eqNullSafe(F.col("_stratum"))).where("_rn <= quota").drop("_rn", "quota", "_stratum")
