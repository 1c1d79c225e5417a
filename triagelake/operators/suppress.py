"""Fingerprints, baselines and inline suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import clean_evidence, cwe, fingerprint, posix, rule_id_valid, rule_key

#: A folder of findings that share file, rule and evidence is bounded by one file's size.
ENGINES = ["bandit", "semgrep", "secrets", "dependency", "crypto", "churn", "dummy"]


def fingerprinted(findings: DataFrame) -> DataFrame:
    """Adds rule, clean, occurrence (from 0 in input order) and fp."""
    e = F.col("extra")
    named = findings.withColumns({"rule": rule_key(F.col("engine"), F.col("title"), F.col("cwe"), e), "clean": clean_evidence(F.col("engine"), F.col("evidence"), e["line_range"], F.col("line"))})
    order = Window.partitionBy(F.lower(posix(F.col("file"))), "rule", "clean").orderBy("ord")
    named = named.withColumn("occurrence", F.row_number().over(order) - 1)
    return named.withColumn("fp", fingerprint(F.col("file"), F.col("rule"), F.col("clean"), F.col("occurrence")))


def baseline_rows(findings: DataFrame) -> DataFrame:
    """What a version-2 baseline file holds of each finding."""
    return fingerprinted(findings).orderBy("ord").select(F.col("fp").alias("fingerprint"), "occurrence", "file", "line", "rule", "cwe", "title", "engine", "severity")


def in_baseline(findings: DataFrame, baseline: DataFrame, version: int = 2) -> DataFrame:
    """Fingerprinted findings with ``known``; version 1 also accepts the fingerprint of occurrence 0."""
    rows = fingerprinted(findings)
    keys = F.array_distinct(F.array("fp", fingerprint(F.col("file"), F.col("rule"), F.col("clean"), F.lit(0)))) if version == 1 else F.array("fp")
    hit = rows.select("fid", F.explode(keys).alias("fingerprint")).join(baseline.select("fingerprint").distinct(), "fingerprint", "left_semi").select("fid").distinct()
    return rows.join(hit.withColumn("known", F.lit(True)), "fid", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def tokens(findings_extra: Column, code: Column) -> Column:
    """All ids, upper-case, by which a finding can be named in a comment."""
    e = findings_extra
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    single = [cwe(code), F.trim(code), e["test_id"], e["check_id"], last(e["check_id"]), e["vuln_id"], e["rule"], e["secret_type"]]
    none = F.array().cast("array<string>")
    rules = F.coalesce(e["all_rules"], none)
    all_of = F.concat(F.array(*single), F.coalesce(e["aliases"], none), rules, F.transform(rules, last))
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.array_compact(all_of), lambda t: F.upper(F.trim(t))), lambda t: t != "")))


def directives(text: Column) -> Column:
    """array<struct<marker, engines, ids, bare>> of the suppression comments in a source line."""
    rest = lambda name: F.regexp_extract(text, rf"(?i)#\s*{name}(?::|\b)(.*)$", 1)
    has = lambda name: text.rlike(rf"(?i)#\s*{name}(:|\b)")
    ids = lambda r, pattern, check: F.transform(F.filter(F.regexp_extract_all(r, F.lit(pattern), F.lit(1)), lambda t: rule_id_valid(t) if check else F.lit(True)), F.upper)
    short, dotted = r"(?i)\b(B\d{3}|CWE-\d+)\b", r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+"
    one = lambda marker, engines, found: F.struct(F.lit(marker).alias("marker"), F.array(*[F.lit(x) for x in engines]).alias("engines"), found.alias("ids"))
    none = F.array().cast("array<string>")
    noqa = ids(F.regexp_extract(text, r"(?i)#\s*noqa:\s*(.*)$", 1), short, False)
    return F.array_compact(F.array(
        F.when(has("nosec"), one("nosec", ["bandit"], ids(rest("nosec"), short, False))),
        F.when(F.size(noqa) > 0, one("noqa", ["bandit"], noqa)),
        F.when(has("nosemgrep"), one("nosemgrep", ["semgrep"], ids(rest("nosemgrep"), rf"(?i)\b(CWE-\d+|{dotted})\b", True))),
        F.when(text.rlike(r"(?i)#\s*(gitleaks:allow|pragma:\s*allowlist\s*secret|pragma:\s*no-audit)\b"), one("secrets", ["secrets"], none)),
        F.when(has("scip:ignore"), one("scip:ignore", ENGINES, ids(rest("scip:ignore"), rf"(?i)\b(CVE-\d{{4}}-\d+|GHSA-[a-z0-9-]+|CWE-\d+|B\d{{3}}|{dotted})\b", True))),
    ))


def inline(findings: DataFrame, source_lines: DataFrame) -> DataFrame:
    """(fid, reason) of findings that a comment on their lines, or a pure comment line above one, silences.

    ``source_lines``: file, line, text.  Only lines with a marker take part in the join.
    """
    e = F.col("extra")
    before = F.lag("text").over(Window.partitionBy("file").orderBy("line"))
    marked = source_lines.withColumn("above", before)
    own = marked.select("file", "line", F.col("line").alias("at"), F.lit(0).alias("nth"), "text")
    above = marked.where(F.trim("above").startswith("#")).select("file", "line", (F.col("line") - 1).alias("at"), F.lit(1).alias("nth"), F.col("above").alias("text"))
    comments = own.unionByName(above).withColumn("d", F.explode(directives(F.col("text")))).select("file", "line", "at", "nth", "d.*")
    engines = F.when(F.size(F.coalesce(e["corroborating_engines"], F.array().cast("array<string>"))) > 0, e["corroborating_engines"]).otherwise(F.array("engine"))
    live = findings.where(F.coalesce(e["in_working_tree"], F.lit(True)) & F.col("line").isNotNull())
    ranges = F.when(F.size(F.coalesce(e["line_range"], F.array().cast("array<int>"))) > 0, e["line_range"]).otherwise(F.array("line"))
    asks = live.select(
        "fid", "file", F.posexplode(ranges).alias("k", "line"), engines.alias("mine"), tokens(e, F.col("cwe")).alias("tokens"),
        ((F.col("engine") == "dependency") | F.coalesce(e["vuln_id"] != "", F.lit(False))).alias("dependency"),
        F.transform(F.array_compact(F.concat(F.array(e["vuln_id"]), F.coalesce(e["aliases"], F.array().cast("array<string>")))), F.upper).alias("advisories"),
    )
    met = asks.join(comments, ["file", "line"])
    fits = (F.size(F.array_except("mine", "engines")) == 0) & F.when(
        F.col("dependency"), F.arrays_overlap("ids", "advisories")
    ).otherwise((F.size("ids") == 0) | F.arrays_overlap("ids", "tokens"))
    hit = F.get(F.filter("ids", lambda i: F.array_contains(F.col("tokens"), i)), 0)
    at = F.concat(F.lit(" at line "), F.col("at").cast("string"))
    reason = (
        F.when(F.col("dependency"), F.concat(F.lit("Inline targeted suppression for dependency ("), F.array_join("ids", ", "), F.lit(")"), at))
        .when(F.size("ids") == 0, F.concat(F.lit("Inline suppression ("), F.col("marker"), F.lit(")"), at))
        .otherwise(F.concat(F.lit("Inline targeted suppression for '"), hit, F.lit("'"), at))
    )
    order = F.array_position(F.array(*[F.lit(m) for m in ("nosec", "noqa", "nosemgrep", "secrets", "scip:ignore")]), F.col("marker"))
    return met.where(F.coalesce(fits, F.lit(False))).groupBy("fid").agg(F.min_by(reason, F.struct("k", "nth", order)).alias("reason"))


def suppress(findings: DataFrame, baseline: DataFrame, source_lines: DataFrame, version: int = 2) -> DataFrame:
    """All findings with extra.suppressed and extra.suppression_reason; the baseline's reason comes first."""
    known = in_baseline(findings, baseline, version)
    both = known.join(inline(findings, source_lines), "fid", "left")
    reason = F.when(F.col("known"), F.concat(F.lit("Suppressed by baseline ("), F.col("fp"), F.lit(")"))).otherwise(F.col("reason"))
    extra = F.col("extra").withField("suppressed", reason.isNotNull()).withField("suppression_reason", reason)
    return both.withColumn("extra", extra).select(*findings.columns)


def split(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Active and suppressed rows."""
    on = F.coalesce(F.col("extra.suppressed"), F.lit(False))
    return findings.where(~on), findings.where(on)
