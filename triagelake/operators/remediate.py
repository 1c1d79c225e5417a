"""Upgrade plans, edited pins, and before/after comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import jump, package_name, version_key


def plan_upgrades(vulns: DataFrame, allow_major: bool = False) -> DataFrame:
    """One row per pin: file, line, package, current, target, fixes, unfixed, risk, max_risk_score, bucket, note.

    ``vulns``: file, line, package, version, vuln_id, fixed_version, risk_score.
    The target is the highest of the fixed versions; bucket is upgrade,
    needs_review (major jumps) or no_fix.
    """
    rows = vulns.where("package is not null and version is not null").withColumn("package", package_name(F.col("package"))).withColumn("fx", F.nullif(F.coalesce("fixed_version", F.lit("")), F.lit("")))
    key = version_key(F.col("fx"))
    agg = rows.groupBy(F.coalesce("file", F.lit("")).alias("file"), F.coalesce("line", F.lit(0)).alias("line"), "package", F.col("version").alias("current")).agg(
        F.max_by("fx", F.struct(key, "fx")).alias("target"), F.max(F.col("fx").isNotNull() & key.isNull()).alias("odd"),
        F.array_sort(F.collect_set(F.when(F.col("fx").isNotNull(), F.col("vuln_id")))).alias("fixes"),
        F.array_sort(F.collect_set(F.when(F.col("fx").isNull(), F.col("vuln_id")))).alias("unfixed"),
        F.round(F.max(F.coalesce("risk_score", F.lit(0.0))), 2).alias("max_risk_score"),
    )
    none = F.col("target").isNull() | F.col("odd")
    risk = F.when(~none, jump(F.col("current"), F.col("target")))
    note = F.when(risk == "patch", "bug-fix release").when(risk == "minor", "new features, normally backwards compatible").when(risk == "major", "major version jump: breaking changes are likely; review manually")
    more = F.when(F.size("unfixed") > 0, F.concat(F.lit("; "), F.size("unfixed").cast("string"), F.lit(" vulnerabilities have no known fix"))).otherwise(F.lit(""))
    bucket = F.when(none, "no_fix").when((risk == "major") & F.lit(not allow_major), "needs_review").otherwise("upgrade")
    reason = F.when(F.col("odd"), "fixed version not comparable").otherwise("no fixed version is known for any of these")
    out = agg.select("file", "line", "package", "current", F.when(~none, F.col("target")).alias("target"), F.when(~none, F.col("fixes")).otherwise(F.array().cast("array<string>")).alias("fixes"),
                     F.when(F.col("odd"), F.col("fixes")).otherwise(F.col("unfixed")).alias("unfixed"), risk.alias("risk"), "max_risk_score", bucket.alias("bucket"), F.when(none, reason).otherwise(F.concat(note, more)).alias("note"))
    return out.orderBy(F.desc("max_risk_score"), "package", "file")


def edit_pin(text: Column, package: Column, current: Column, target: Column) -> Column:
    """struct<line, reason>: the requirement line with the new version, all else as it was; or why it stays."""
    shape = r"^(\s*)([A-Za-z0-9._-]+)((?:\[[^\]]*\])?\s*===?\s*)([^\s;#,\\]+)(.*)$"
    name, version = F.regexp_extract(text, shape, 2), F.regexp_extract(text, shape, 4)
    new = F.concat(F.regexp_extract(text, shape, 1), name, F.regexp_extract(text, shape, 3), target, F.regexp_extract(text, shape, 5))
    reason = (
        F.when(F.contains(text, F.lit("--hash")), "pin has hashes").when(~text.rlike(shape), "not an exact pin")
        .when(package_name(name) != package_name(package), "another package").when(version != current, "another version")
    )
    return F.struct(F.when(reason.isNull(), new).alias("line"), reason.alias("reason"))


def apply_upgrades(plan: DataFrame, lines: DataFrame) -> DataFrame:
    """(file, line, text, new_text, reason) of the planned pins.  ``lines``: file, line, text."""
    met = plan.where("bucket = 'upgrade'").join(lines, ["file", "line"], "left")
    edit = edit_pin(F.col("text"), F.col("package"), F.col("current"), F.col("target"))
    return met.select("file", "line", "package", "text", edit["line"].alias("new_text"), F.when(F.col("text").isNull(), "line not found").otherwise(edit["reason"]).alias("reason"))


def verify_upgrades(targeted: DataFrame, before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind): resolved, remaining or introduced identities."""
    t, b, a = (d.select(*keys).distinct() for d in (targeted, before, after))
    tag = lambda d, kind: d.withColumn("kind", F.lit(kind))
    return tag(t.join(a, keys, "left_anti"), "resolved").unionByName(tag(t.join(a, keys, "left_semi"), "remaining")).unionByName(tag(a.join(b, keys, "left_anti"), "introduced"))


def compare_counts(before: DataFrame, after: DataFrame, fixed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, before, after, fixed, status): confirmed, still_there, introduced or unchanged, by numbers of findings."""
    count = lambda d, name: d.groupBy(*keys).agg(F.count("*").alias(name))
    out = count(before, "before").join(count(after, "after"), keys, "full").join(count(fixed, "fixed"), keys, "full").fillna(0, ["before", "after", "fixed"])
    status = F.when(F.col("after") > F.col("before"), "introduced").when((F.col("fixed") > 0) & (F.col("after") <= F.col("before") - F.col("fixed")), "confirmed").when(F.col("fixed") > 0, "still_there").otherwise("unchanged")
    return out.withColumn("status", status)


def verification_status(kinds: DataFrame) -> DataFrame:
    """One row: the outcome of a verification from (kind) rows."""
    n = lambda k: F.count_if(F.col("kind") == k)
    return kinds.agg(n("resolved").alias("resolved"), n("remaining").alias("remaining"), n("introduced").alias("introduced")).withColumn(
        "status", F.when(F.col("introduced") > 0, "regressed").when((F.col("remaining") == 0) & (F.col("resolved") > 0), "verified").when(F.col("resolved") > 0, "partial").otherwise("unresolved"))
