"""Scanner reports as finding tables.  Reports are read as text, one JSON document per row."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import tables as T
from ..functions.columns import cwe, file_role, lookup, posix, scanner_exploitability, scanner_severity
from ..schema import EXTRA, FINDING

BANDIT = "struct<results:array<struct<code:string,filename:string,issue_confidence:string,issue_severity:string,issue_cwe:struct<id:int>,issue_text:string,line_number:int,line_range:array<int>,test_id:string,test_name:string,more_info:string>>,errors:array<struct<filename:string,reason:string>>>"
SEMGREP = "struct<results:array<struct<check_id:string,path:string,start:struct<line:int,col:int>,`end`:struct<line:int,col:int>,extra:struct<message:string,severity:string,lines:string,fingerprint:string,fix:string,metadata:struct<cwe:string,confidence:string,fix:string>>>>,errors:array<struct<message:string>>>"


def recover_json(reports: DataFrame, column: str = "text", members: tuple[str, ...] = ("results", "errors", "metrics")) -> DataFrame:
    """Adds json: the first balanced object with one of the members, from texts with banners, colours or several objects; null if there is none."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reports.schema.fields) + ", json string"

    def find(text: str | None) -> str | None:
        text, at, decoder = re.sub(r"\x1b\[[0-9;]*m", "", text or ""), 0, json.JSONDecoder()
        while (at := text.find("{", at)) >= 0:
            try:
                value, end = decoder.raw_decode(text, at)
            except ValueError:
                at += 1
                continue
            if isinstance(value, dict) and any(m in value for m in members):
                return text[at:end]
            at = end
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(json=[find(t) for t in b[column]])

    return reports.mapInPandas(run, schema)


def _findings(rows: DataFrame, extra: dict) -> DataFrame:
    e = F.struct(*[(extra.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in EXTRA.fields])
    return rows.withColumn("extra", e).select(*[(F.col(f.name) if f.name in rows.columns or f.name == "extra" else F.lit(None)).cast(f.dataType).alias(f.name) for f in FINDING.fields])


def _results(reports: DataFrame, column: str, schema: str) -> DataFrame:
    """The results of all reports.  ``fid`` follows from the report's text and the place in it, so that it is the same whenever it is computed."""
    each = reports.select(F.col(column).alias("report"), F.from_json(column, schema).alias("v")).select("report", F.posexplode("v.results").alias("ord", "r"))
    return each.select(F.xxhash64("report", "ord").alias("fid"), "ord", "r.*")


def bandit(reports: DataFrame, column: str = "json") -> DataFrame:
    """Findings of Bandit reports; test and sample files are damped and marked."""
    rows = _results(reports, column, BANDIT)
    role = file_role(F.col("filename"))
    ease = scanner_exploitability(F.col("issue_severity"), F.col("issue_confidence"), F.col("test_id"))
    damped = F.when(role == "test", F.greatest(F.lit(0.05), F.round(ease * 0.3, 2))).when(role.isin("sample", "docs"), F.greatest(F.lit(0.05), F.round(ease * 0.5, 2))).otherwise(ease)
    mock = F.col("test_id").isin("B105", "B106", "B107", "B108", "B311")
    level = F.when(role == "test", F.when(F.col("test_id") == "B101", "HIGH").when(F.col("test_id").isin("B602", "B608"), "LOW").otherwise("MEDIUM")).when(role.isin("sample", "docs"), "MEDIUM")
    reason = (
        F.when(role == "test", F.when(F.col("test_id") == "B101", "assert statement in test code is standard practice").when(mock, "Test fixture or mock data context").when(F.col("test_id").isin("B602", "B608"), "Command or SQL execution in test code").otherwise("Test or test fixture code context"))
        .when(role.isin("sample", "docs"), "Sample or documentation code context")
    )
    full = rows.select(
        "fid", "ord", F.lit("bandit").alias("engine"), F.concat_ws(": ", "test_id", "issue_text").alias("title"), F.regexp_replace(posix(F.col("filename")), r"^(\./)+", "").alias("file"), F.col("line_number").alias("line"),
        cwe(F.col("issue_cwe.id").cast("string"), F.col("test_id")).alias("cwe"), scanner_severity(F.col("issue_severity"), F.col("issue_confidence"), F.col("test_id")).alias("severity"), F.col("issue_text").alias("description"), F.col("code").alias("evidence"),
        F.col("more_info").alias("fix_hint"), damped.alias("exploitability"), F.when(role == "test", "TEST").alias("exposure"), level.alias("fp_likelihood"), reason.alias("fp_reason"), "test_id", "issue_severity", "issue_confidence", "line_range", role.alias("role"),
    )
    known = {"test_id": F.col("test_id"), "issue_severity": F.col("issue_severity"), "issue_confidence": F.col("issue_confidence"), "line_range": F.col("line_range"), "file_role": F.col("role"), "is_test_code": F.col("role") == "test", "is_sample_code": F.col("role").isin("sample", "docs"), "fp_likelihood": F.col("fp_likelihood"), "fp_reason": F.col("fp_reason"), "exposure": F.col("exposure")}
    return _findings(full, known)


def clean_check_id(check: Column) -> Column:
    """The id from its own namespace on, or what follows the first ``rules.``."""
    own = F.regexp_extract(check, T.OWN_RULES, 1)
    return F.when(own != "", own).when(F.contains(check, F.lit("rules.")), F.regexp_replace(check, r"^.*?rules\.", "")).otherwise(check)


def semgrep(reports: DataFrame, column: str = "json") -> DataFrame:
    """Findings of Semgrep reports.  Evidence that the scanner withholds is null; :func:`snippets` fills it from the source."""
    rows = _results(reports, column, SEMGREP)
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    withheld = lambda c: F.nullif(given(c), F.lit(T.WITHHELD))
    level = F.upper(F.coalesce("extra.severity", F.lit("WARNING")))
    check = clean_check_id(F.coalesce("check_id", F.lit(T.UNNAMED_RULE)))
    message = F.coalesce(given(F.col("extra.message")), F.lit(T.UNNAMED_FINDING))
    first = F.coalesce(given(F.get(F.split(message, r"\.\s+"), 0)), check)
    fix = F.coalesce(given(F.col("extra.fix")), given(F.col("extra.metadata.fix")))
    line = F.col("start.line")
    full = rows.select(
        "fid", "ord", F.lit("semgrep").alias("engine"), F.concat(F.lit("Semgrep "), F.element_at(F.split(check, r"\."), -1), F.lit(": "), first).alias("title"), F.regexp_replace(posix(F.col("path")), r"^(\./)+", "").alias("file"), line.alias("line"),
        cwe(F.col("extra.metadata.cwe")).alias("cwe"), F.coalesce(lookup(T.RULE_SEVERITY, level), F.lit(5.0)).alias("severity"), message.alias("description"), withheld(F.col("extra.lines")).alias("evidence"),
        F.when(fix.isNotNull(), F.concat(F.lit("Suggested fix: "), fix)).otherwise(F.format_string("Review rule %s and refactor code to remediate this issue.", check)).alias("fix_hint"),
        F.coalesce(lookup(T.RULE_EXPLOIT, level), F.lit(0.4)).alias("exploitability"), check.alias("check_id"), F.when(line.isNotNull(), F.sequence(line, F.greatest(line, F.col("end.line")))).alias("lines"), withheld(F.col("extra.fingerprint")).alias("fingerprint"),
    )
    return _findings(full, {"check_id": F.col("check_id"), "line_range": F.col("lines"), "fingerprint": F.col("fingerprint")})


def snippets(findings: DataFrame, source_lines: DataFrame) -> DataFrame:
    """Findings with the lines of their range as evidence where the scanner gave none.  ``source_lines``: file, line, text."""
    asks = findings.where("evidence is null and line is not null").select("fid", "file", F.explode(F.coalesce("extra.line_range", F.array("line"))).alias("line"))
    found = asks.join(source_lines.select("file", "line", "text"), ["file", "line"]).groupBy("fid").agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")).alias("_snippet"))
    out = findings.join(found, "fid", "left")
    return out.withColumn("evidence", F.coalesce("evidence", "_snippet")).select(*findings.columns)


def stats(reports: DataFrame, column: str = "json") -> DataFrame:
    """One row: reports, readable ones, results and errors."""
    v = F.from_json(column, BANDIT)
    return reports.select(v.alias("v")).agg(F.count("*").alias("reports"), F.count("v").alias("readable"), F.coalesce(F.sum(F.size(F.coalesce("v.results", F.array()))), F.lit(0)).alias("results"), F.coalesce(F.sum(F.size(F.coalesce("v.errors", F.array()))), F.lit(0)).alias("errors"))
