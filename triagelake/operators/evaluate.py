"""Labels against findings: lookup, coverage, precision, recall, ranking quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import ratio


def label_lookup(keys: DataFrame, labels: DataFrame, tol: int = 3) -> DataFrame:
    """``keys`` (fid, file, line, tail: what follows the line in the key) with verdict.

    The exact key first; else the only label of the same file and tail within
    ``tol`` lines; if several are near, none.
    """
    lab = labels.select(F.col("file").alias("lf"), F.col("line").alias("ll"), F.col("tail").alias("lt"), "verdict")
    # A label is posted at every line it may stand for.
    lab = lab.withColumn("pl", F.explode(F.sequence(F.col("ll") - tol, F.col("ll") + tol)))
    near = keys.join(lab, (F.col("file") == F.col("lf")) & (F.col("tail") == F.col("lt")) & (F.col("line") == F.col("pl")))
    gap = F.abs(F.col("line") - F.col("ll"))
    hit = near.groupBy("fid").agg(F.max(F.when(gap == 0, F.col("verdict"))).alias("exact"), F.max(gap == 0).alias("is_exact"), F.count("*").alias("n"), F.max("verdict").alias("only"))
    return keys.join(hit.select("fid", F.when(F.col("is_exact"), F.col("exact")).when(F.col("n") == 1, F.col("only")).alias("verdict")), "fid", "left")


def coverage(rows: DataFrame) -> DataFrame:
    """One row: total, tp, fp, unsure, labelled, unlabelled, precision, share."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    tp, fp, unsure, total = n(F.col("verdict") == "TP"), n(F.col("verdict") == "FP"), n(F.col("verdict") == "UNSURE"), F.count("*")
    return rows.agg(total.alias("total"), tp.alias("tp"), fp.alias("fp"), unsure.alias("unsure"), (tp + fp).alias("labelled"), (total - tp - fp - unsure).alias("unlabelled"), ratio(tp, tp + fp).alias("precision"), ratio(tp + fp, total).alias("share"))


def precision_by(rows: DataFrame, group: str) -> DataFrame:
    tp, fp = F.count_if(F.col("verdict") == "TP"), F.count_if(F.col("verdict") == "FP")
    return rows.where(F.col("verdict").isin("TP", "FP")).groupBy(group).agg(tp.alias("tp"), fp.alias("fp"), ratio(tp, tp + fp).alias("precision"))


def expected_recall(expected: DataFrame, findings: DataFrame) -> DataFrame:
    """(idx, status: found / found_but_hidden / missed, keys): findings of the file within tol lines and of the listed weaknesses.

    ``findings``: key, file, line, cwe, hidden.
    """
    f = findings.select("key", F.col("file").alias("ff"), F.col("line").alias("fl"), F.col("cwe").alias("fc"), "hidden")
    some = F.coalesce(F.size("cwe"), F.lit(0)).isin(0, -1) | F.array_contains("cwe", F.col("fc"))
    # An expectation with a line is posted at every line within its tolerance; one without meets its whole file.
    tol = F.coalesce("tol", F.lit(3))
    posted = expected.where("line is not null").withColumn("pl", F.explode(F.sequence(F.col("line") - tol, F.col("line") + tol)))
    hit = posted.join(f, (F.col("file") == F.col("ff")) & (F.col("pl") == F.col("fl")) & some).select("idx", "key", "hidden")
    hit = hit.unionByName(expected.where("line is null").join(f, (F.col("file") == F.col("ff")) & some).select("idx", "key", "hidden"))
    met = expected.select("idx").distinct().join(hit, "idx", "left").groupBy("idx").agg(F.max(~F.col("hidden")).alias("seen"), F.count("key").alias("n"), F.array_sort(F.collect_set("key")).alias("keys"))
    return met.select("idx", F.when(F.col("n") == 0, "missed").when(F.col("seen"), "found").otherwise("found_but_hidden").alias("status"), "keys")


def fp_safety(rows: DataFrame) -> DataFrame:
    """One row on (verdict, fp): wrongly hidden and demoted findings, catch rates, precision before and after hiding."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    tp, fp, high, medium = F.col("verdict") == "TP", F.col("verdict") == "FP", F.col("fp") == "HIGH", F.col("fp") == "MEDIUM"
    shown = ~F.coalesce(high, F.lit(False))
    return rows.agg(
        n(tp & high).alias("wrongly_hidden"), n(tp & medium).alias("wrongly_demoted"), ratio(n(fp & high), n(fp)).alias("caught_high"), ratio(n(fp & (high | medium)), n(fp)).alias("caught_any"),
        ratio(n(tp), n(tp | fp)).alias("precision_before"), ratio(n(tp & shown), n((tp | fp) & shown)).alias("precision_after"), (n(tp & high) == 0).alias("safe"),
    )


def _ranked(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumns({"_rn": F.row_number().over(w), "_hits": F.sum("rel").over(w.rowsBetween(Window.unboundedPreceding, 0))})


def precision_at(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """sum of rel over the first k, over k; only groups of k rows or more.  ``rel``: 0 or 1."""
    # A limit by group: each task keeps its own first k before anything is shuffled.
    first = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rn") <= k)
    out = first.groupBy(*group).agg(F.sum("rel").alias("hits"), F.count("*").alias("n"))
    return out.where(F.col("n") >= k).select(*group, (F.col("hits") / F.lit(float(k))).alias("precision_at_k"))


def average_precision(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Mean over the relevant rows of hits so far over rank; null without any."""
    return _ranked(rows, group, order).groupBy(*group).agg(F.avg(F.when(F.col("rel") == 1, F.col("_hits") / F.col("_rn"))).alias("average_precision"))


def harmonic(n: Column, m: Column) -> Column:
    """1/(n+1) + ... + 1/(n+m) in a bounded number of steps: the first terms one by one, the rest by its asymptotic series."""
    plain = F.least(n + m, F.greatest(n, F.lit(64)))
    some = F.when(plain > n, F.aggregate(F.sequence(n + 1, plain), F.lit(0.0), lambda a, j: a + 1.0 / j)).otherwise(F.lit(0.0))
    series = lambda x: F.log(x) + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x)
    return some + F.when(n + m > plain, series((n + m).cast("double")) - series(plain.cast("double"))).otherwise(F.lit(0.0))


def expected_precision_at(rows: DataFrame, group: list[str], score: str, k: int) -> DataFrame:
    """(group, expected_precision): precision at ``k`` where rows of equal score come in random order; only groups of ``k`` rows or more."""
    ties = rows.groupBy(*group, score).agg(F.count("*").alias("m"), F.sum("rel").alias("r"))
    before = Window.partitionBy(*group).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    part = F.col("r") * F.least(F.greatest(F.lit(k) - F.coalesce(F.sum("m").over(before), F.lit(0)), F.lit(0)), F.col("m")) / F.col("m")
    out = ties.withColumn("part", part).groupBy(*group).agg((F.sum("part") / F.lit(float(k))).alias("expected_precision"), F.sum("m").alias("n"))
    return out.where(F.col("n") >= k).drop("n")


def expected_average_precision(rows: DataFrame, group: list[str], score: str) -> DataFrame:
    """Average precision where rows of equal score come in random order: the exact expectation, tie group by tie group."""
    ties = rows.groupBy(*group, score).agg(F.count("*").alias("m"), F.sum("rel").alias("r"))
    before = Window.partitionBy(*group).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    ties = ties.withColumns({"N": F.coalesce(F.sum("m").over(before), F.lit(0)), "H": F.coalesce(F.sum("r").over(before), F.lit(0)), "T": F.sum("r").over(Window.partitionBy(*group))})
    m, r, n, h = (F.col(c).cast("double") for c in ("m", "r", "N", "H"))
    step = F.when(F.col("m") > 1, (r - 1) / (m - 1)).otherwise(F.lit(0.0))
    # The sum over the places j of (h + 1 + (j - 1) * step) / (n + j), of which only 1 / (n + j) varies beside a constant.
    each = (r / m) * ((h + 1 - step * (n + 1)) * harmonic(F.col("N"), F.col("m")) + step * m)
    return ties.groupBy(*group).agg((F.sum(F.when(F.col("r") > 0, each).otherwise(0.0)) / F.nullif(F.max("T"), F.lit(0))).alias("expected_ap"))
