"""Dependencies against advisories, exploit scores and the list of known exploited ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import cvss3, lookup, nearest_fixed, package_name
from .components import connected_components

#: Scores of advisories that state only a label.
LABEL_SCORES = {"CRITICAL": 9.5, "HIGH": 8.0, "MODERATE": 5.5, "MEDIUM": 5.5, "LOW": 2.5}
DEFAULT_SEVERITY = 5.0

ADVISORY = "struct<id:string,aliases:array<string>,summary:string,details:string,withdrawn:string,severity:array<struct<type:string,score:string>>,database_specific:struct<cwe_ids:array<string>,severity:string>,affected:array<struct<package:struct<ecosystem:string,name:string>,ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string>>>>>>>"


def parse_advisories(raw: DataFrame, column: str = "json") -> DataFrame:
    """id, package, aliases, summary, details, cvss, source, cwe, fixed: a row per advisory and package, withdrawn ones left out."""
    v = F.from_json(F.col(column), ADVISORY)
    rows = raw.select(v.alias("v")).where(F.col("v.id").isNotNull() & F.coalesce(F.col("v.withdrawn") == "", F.lit(True)))
    scores = F.filter(F.transform(F.col("v.severity"), lambda s: cvss3(s["score"])), lambda x: x.isNotNull())
    vector, label = F.get(scores, 0), lookup(LABEL_SCORES, F.upper("v.database_specific.severity"))
    details = F.trim(F.coalesce("v.details", F.lit("")))
    names = F.array_distinct(F.transform(F.filter("v.affected", lambda a: a["package"]["ecosystem"] == "PyPI"), lambda a: package_name(a["package"]["name"])))
    each = rows.withColumn("package", F.explode(names))
    of = F.filter("v.affected", lambda a: (a["package"]["ecosystem"] == "PyPI") & (package_name(a["package"]["name"]) == F.col("package")))
    ranges = F.filter(F.flatten(F.transform(of, lambda a: a["ranges"])), lambda r: r["type"].isin("ECOSYSTEM", "SEMVER"))
    fixed = F.filter(F.flatten(F.transform(ranges, lambda r: F.transform(r["events"], lambda e: e["fixed"]))), lambda f: f.isNotNull())
    return each.select(
        F.col("v.id").alias("id"), "package", F.coalesce("v.aliases", F.array().cast("array<string>")).alias("aliases"),
        F.trim(F.coalesce(F.nullif(F.col("v.summary"), F.lit("")), F.get(F.split(details, "\n"), 0))).alias("summary"), details.alias("details"),
        F.coalesce(vector, label).alias("cvss"), F.when(vector.isNotNull(), "cvss3").when(label.isNotNull(), "label").otherwise("none").alias("source"),
        F.get("v.database_specific.cwe_ids", F.lit(0)).alias("cwe"), fixed.alias("fixed"),
    )


def alias_groups(advisories: DataFrame) -> DataFrame:
    """(key, id, group): advisories of one (package, version) key that share an id or alias, however indirectly.

    ``advisories``: key, id, aliases.  Nodes of the graph are hashes of (key, id);
    the id itself decides again in the result's names.
    """
    rows = advisories.select("key", "id", F.explode(F.array_union("aliases", F.array("id"))).alias("alias"))
    node = lambda c: F.xxhash64("key", c)
    parts = connected_components(rows.select(node("id").alias("src"), node("alias").alias("dst")))
    return advisories.select("key", "id").distinct().join(parts, node("id") == F.col("node")).select("key", "id", F.col("component").alias("group"))


def combine(grouped: DataFrame) -> DataFrame:
    """One advisory per (key, group): the least CVE or id as name, the best severity, the longest texts.

    ``grouped``: key, group, ord, id, aliases, summary, details, cvss, source, cwe, fixed.
    """
    priority = F.create_map(F.lit("cvss3"), F.lit(2), F.lit("label"), F.lit(1), F.lit("none"), F.lit(0))[F.col("source")]
    best = F.struct(priority, F.coalesce("cvss", F.lit(0.0)), -F.col("ord"))
    longest = lambda c: F.max_by(c, F.struct(F.length(c), -F.col("ord")))
    agg = grouped.groupBy("key", "group").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_union(F.array("id"), "aliases"))))).alias("ids"),
        F.max_by(F.struct("cvss", "source"), best).alias("best"), longest("summary").alias("summary"), longest("details").alias("details"),
        F.min_by("cwe", F.when(F.col("cwe").isNotNull(), F.col("ord"))).alias("cwe"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "fixed"))), lambda s: s["fixed"]))).alias("fixed"),
    )
    cves = F.filter("ids", lambda i: F.startswith(i, F.lit("CVE-")))
    name = F.coalesce(F.get(cves, 0), F.get("ids", F.lit(0)))
    return agg.withColumn("id", name).select("key", "id", F.array_remove("ids", F.col("id")).alias("aliases"), "summary", "details", F.col("best.cvss").alias("cvss"), F.col("best.source").alias("source"), "cwe", "fixed")


def cves(ids: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(ids, lambda i: F.startswith(i, F.lit("CVE-")))))


def with_exploit_data(rows: DataFrame, key: str, ids: str, epss: DataFrame, kev: DataFrame) -> DataFrame:
    """Adds epss (the highest of the row's CVEs, null if none is known) and kev to rows with a unique ``key``."""
    each = rows.select(key, F.explode(cves(F.col(ids))).alias("cve"))
    met = each.join(epss.select("cve", "epss"), "cve", "left").join(kev.select("cve").distinct().withColumn("hit", F.lit(True)), "cve", "left")
    known = met.groupBy(key).agg(F.max("epss").alias("epss"), F.max(F.coalesce("hit", F.lit(False))).alias("kev"))
    return rows.join(known, key, "left").withColumn("kev", F.coalesce("kev", F.lit(False)))


def dependency_findings(pins: DataFrame, advisories: DataFrame, epss: DataFrame, kev: DataFrame) -> DataFrame:
    """Findings of pinned packages: package, version, vuln_id, severity, exploitability, fixed_version, locations and more.

    ``pins``: name, version, file, line, ord.  ``advisories``: (name, version) with the parsed members.
    """
    places = pins.where("version is not null").groupBy("name", "version").agg(F.array_sort(F.collect_list(F.struct("ord", "file", "line"))).alias("locations"))
    met = places.join(advisories, ["name", "version"]).withColumn("key", F.concat_ws("==", "name", "version"))
    # Advisories of equal worth are taken in an order that their ids decide.
    met = met.withColumn("ord", F.xxhash64("id"))
    grouped = combine(met.join(alias_groups(met.select("key", "id", "aliases")), ["key", "id"]))
    rows = grouped.join(met.select("key", "name", "version", "locations").distinct(), "key").withColumn("rid", F.concat_ws("|", "key", "id")).withColumn("all_ids", F.array_union(F.array("id"), "aliases"))
    full = with_exploit_data(rows, "rid", "all_ids", epss, kev)
    return full.select(
        F.lit("dependency").alias("engine"), F.col("name").alias("package"), "version", F.col("id").alias("vuln_id"), "aliases",
        F.get("locations", F.lit(0))["file"].alias("file"), F.get("locations", F.lit(0))["line"].alias("line"),
        F.coalesce("cvss", F.lit(DEFAULT_SEVERITY)).alias("severity"), F.col("source").alias("severity_source"), "cwe",
        F.when(F.col("kev"), 1.0).otherwise(F.coalesce("epss", F.lit(0.0))).alias("exploitability"), "epss", "kev",
        nearest_fixed(F.col("fixed"), F.col("version")).alias("fixed_version"), F.substring(F.coalesce("details", "summary"), 1, 700).alias("description"),
        F.transform("locations", lambda s: F.struct(s["file"].alias("file"), s["line"].alias("line"))).alias("locations"),
    )
