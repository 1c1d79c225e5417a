"""Reports: sparse JSON, SARIF, Markdown summaries, baselines and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import tables as T
from ..functions.columns import band, report_level, report_uri
from ..operators.score import ranked
from ..operators.scratch import keep
from ..operators.suppress import baseline_rows

#: Findings in a baseline file.
PER_BASELINE = 10_000


def rule_id() -> Column:
    """By engine first, then advisory, weakness, and a slug of the title."""
    e = F.col("extra")
    full = lambda c: F.nullif(c, F.lit(""))
    prefixed = lambda engine, c: F.when((F.col("engine") == engine) & full(c).isNotNull(), F.concat(F.lit(f"{engine}-"), c))
    slug = F.btrim(F.regexp_replace(F.substring("title", 1, 32), r"[^A-Za-z0-9_-]", "-"), F.lit("-"))
    return F.coalesce(
        prefixed("bandit", e["test_id"]), F.when(F.col("engine") == "semgrep", full(e["check_id"])), prefixed("secrets", e["rule"]), prefixed("crypto", e["rule"]),
        full(e["vuln_id"]), full(F.col("cwe")), F.when(slug != "", F.concat(F.col("engine"), F.lit("-"), slug)).otherwise(F.col("engine")),
    )


def rules(findings: DataFrame) -> DataFrame:
    """(rule_id, title, level, fix_hint, cwe, n): the first finding in order defines its rule."""
    first = F.min_by(F.struct("title", report_level(F.col("severity")).alias("level"), "fix_hint", "cwe"), "ord")
    return findings.groupBy(rule_id().alias("rule_id")).agg(first.alias("r"), F.count("*").alias("n")).select("rule_id", "r.*", "n")


def results(findings: DataFrame, repo: str | None = None) -> DataFrame:
    """One row per result, with its place and whether and how it is suppressed."""
    reason = F.col("extra.suppression_reason")
    return findings.select(
        "fid", "ord", rule_id().alias("rule_id"), report_level(F.col("severity")).alias("level"), report_uri(F.col("file"), repo).alias("uri"),
        F.greatest(F.coalesce("line", F.lit(1)), F.lit(1)).alias("line"), F.coalesce(F.nullif(F.col("description"), F.lit("")), "title").alias("message"),
        F.coalesce("extra.suppressed", F.lit(False)).alias("suppressed"), F.when(F.startswith(reason, F.lit("Inline")), "inSource").otherwise("external").alias("suppression"), "risk_score",
    )


def sarif(findings: DataFrame, version: str = "1.0") -> DataFrame:
    """The SARIF 2.1.0 document in lines: one ``value`` row per rule and result, so that no task or driver holds it whole.

    Rows are (part, ord, value); written in order they are one JSON document.
    """
    head = '{"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "triagelake", "version": "' + version + '", "rules": ['
    spark = findings.sparkSession
    r = rules(findings).select(F.lit(1).alias("part"), "rule_id", F.to_json(F.struct(F.col("rule_id").alias("id"), F.struct(F.col("title").alias("text")).alias("shortDescription"), F.struct("level").alias("defaultConfiguration"))).alias("value"))
    place = F.array(F.struct(F.struct(F.struct(F.col("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation")))
    quiet = F.when(F.col("suppressed"), F.array(F.struct(F.col("suppression").alias("kind"))))
    x = results(findings).select(F.lit(3).alias("part"), F.format_string("%020d", F.coalesce("ord", F.lit(0))).alias("rule_id"), F.to_json(F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations"), quiet.alias("suppressions"))).alias("value"))
    frame = spark.createDataFrame([(0, "", head), (2, "", ']}}, "results": ['), (4, "", "]}]}")], "part int, rule_id string, value string")
    return frame.unionByName(r).unionByName(x).withColumnRenamed("rule_id", "ord").orderBy("part", "ord")


def sparse_json(findings: DataFrame) -> DataFrame:
    """(fid, json): members that are null, empty or (of four measures) zero are left out, as is an empty ``extra``."""
    cols = []
    for name, kind in findings.dtypes:
        c = F.col(name)
        if name in ("fid", "ord"):
            continue
        if name == "extra":
            c = F.when(F.to_json(c) != "{}", c)
        if name in ("blast_radius", "churn", "code_health_penalty", "exploitability"):
            c = F.when(c != 0, c)
        elif kind == "string":
            c = F.nullif(c, F.lit(""))
        cols.append(c.alias(name))
    return findings.select("fid", F.to_json(F.struct(*cols), {"ignoreNullFields": "true"}).alias("json"))


def write_json(findings: DataFrame, path: str) -> None:
    sparse_json(ranked(findings)).select(F.col("json").alias("value")).write.text(path)


def write_baseline(findings: DataFrame, path: str) -> None:
    """A folder of baseline files; each is an object of version 2 with at most ``PER_BASELINE`` findings."""
    rows = keep(baseline_rows(findings), "baseline")
    files = max(1, -(-rows.count() // PER_BASELINE))
    dealt = rows.groupBy(F.pmod(F.xxhash64("fingerprint"), F.lit(files)).alias("file")).agg(F.collect_list(F.struct(*rows.columns)).alias("findings"))
    dealt.select(F.to_json(F.struct(F.lit(2).alias("version"), "findings")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def summary(findings: DataFrame, k: int = 15) -> str:
    """A Markdown summary: band counts and the k highest risks (bounded rows on the driver)."""
    counts = {r["b"]: r["n"] for r in findings.groupBy(band(F.col("severity")).alias("b")).agg(F.count("*").alias("n")).collect()}
    lines = ["# Findings", "", "| Band | Findings |", "|---|---:|", *[f"| {b} | {counts.get(b, 0)} |" for b in ("critical", "high", "medium", "low")], "", "| Risk | Severity | Engine | File | Title |", "|---:|---:|---|---|---|"]
    for r in ranked(findings).limit(k).collect():
        lines.append(f"| {r['risk_score'] or 0:.2f} | {r['severity'] or 0:.1f} | {r['engine']} | {r['file']}:{r['line'] or '-'} | {r['title']} |")
    return "\n".join(lines) + "\n"


def posture(findings: DataFrame) -> DataFrame:
    """One row: counts by band, the highest risk and a badge; what is suppressed doesn't count."""
    n = lambda b: F.count_if(band(F.col("severity")) == b).alias(b)
    rows = findings.where(~F.coalesce("extra.suppressed", F.lit(False))).agg(n("critical"), n("high"), n("medium"), n("low"), F.coalesce(F.max("risk_score"), F.lit(0.0)).alias("max_risk"), F.count("*").alias("n"))
    badge = F.lit("Clean Security Status")
    for name, counted, risk in reversed([*T.BADGES, ("Low Risk", "n", float("inf"))]):
        badge = F.when((F.col(counted) > 0) | (F.col("max_risk") >= risk), name).otherwise(badge)
    return rows.withColumn("badge", badge).drop("n")


def gate(findings: DataFrame, least: float = 7.0) -> bool:
    """Whether any finding that is not suppressed has at least that severity."""
    return not findings.where((F.col("severity") >= least) & ~F.coalesce("extra.suppressed", F.lit(False))).isEmpty()


def write_graph(nodes: DataFrame, edges: DataFrame, hashes: DataFrame, path: str) -> None:
    for name, df in (("nodes", nodes), ("edges", edges), ("files", hashes)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
