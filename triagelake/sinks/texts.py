"""Texts for people: help of rules, tables of findings, attack paths, label templates, evaluations, fixes.

What grows with the findings stays a DataFrame with a row per line or entry, in
order; only texts of bounded size are put together on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, functions as F

from ..operators.selection import not_automated, rule_name
from .report import rule_id

ADVICE = "Review the affected code and apply standard security mitigations."


def _or(c: str | Column, other: str) -> Column:
    return F.coalesce(F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")), F.lit(other))


def _place() -> Column:
    return F.when(F.coalesce(F.col("line"), F.lit(0)) > 0, F.concat("file", F.lit(":"), F.col("line"))).otherwise(F.col("file"))


def rule_help(findings: DataFrame) -> DataFrame:
    """(rule_id, name, text, markdown): plain and Markdown help of each rule, from its first finding in order."""
    number = lambda c, form: F.format_string(form, F.coalesce(c, F.lit(0.0)))
    sev, risk, expl = number(F.col("severity"), "%.1f"), number(F.col("risk_score"), "%.2f"), number(F.col("exploitability"), "%.2f")
    full = lambda c: F.nullif(F.col(c), F.lit(""))
    plain = F.concat(
        F.col("title"), F.lit("\n\nEngine: "), F.col("engine"), F.lit("\nSeverity: "), sev, F.lit(" / 10.0\nRisk Score: "), risk, F.lit(" / 100.0\nCWE: "), _or("cwe", "N/A"),
        F.lit("\nExposure: "), _or("exposure", "N/A"), F.lit("\n\nRemediation:\n"), _or("fix_hint", ADVICE), F.lit("\n\nDetails:\n"), F.coalesce(full("description"), F.col("title")),
    )
    row = lambda name, value: F.concat(F.lit(f"| **{name}** | "), value, F.lit(" |"))
    code = lambda c, tail="": F.concat(F.lit("`"), c, F.lit(f"{tail}`"))
    link = F.concat(F.lit("["), F.col("cwe"), F.lit("](https://cwe.mitre.org/data/definitions/"), F.replace(F.col("cwe"), F.lit("CWE-"), F.lit("")), F.lit(".html)"))
    parts = [
        F.concat(F.lit("### "), F.col("title"), F.lit("\n\n| Attribute | Value |\n|---|---|")), row("Engine", code(F.col("engine"))), row("Severity", code(sev, " / 10.0")), row("Risk Score", code(risk, " / 100.0")),
        row("Exploitability", code(expl)), row("Exposure", code(_or("exposure", "N/A"))), F.when(full("cwe").isNotNull(), row("CWE", link)), F.concat(F.lit("\n### Remediation Hint\n> "), full("fix_hint")),
        F.when(F.col("description") != F.col("title"), F.concat(F.lit("\n### Details\n"), full("description"))), F.concat(F.lit("\n### Evidence\n```\n"), F.trim(full("evidence")), F.lit("\n```")),
    ]
    first = F.min_by(F.struct(rule_name(F.col("title"), F.col("extra")).alias("name"), plain.alias("text"), F.concat_ws("\n", *parts).alias("markdown")), "ord")
    return findings.groupBy(rule_id().alias("rule_id")).agg(first.alias("r")).select("rule_id", "r.*")


def table_rows(findings: DataFrame, by_risk: bool = True) -> DataFrame:
    """(risk, severity, exploitability, reach, engine, location, title) as a console shows them, best first.

    By risk, or (before there are scores) by severity and exploitability; equal
    ones keep their order.  Long places lose their head, long titles their tail.
    """
    place, wide = _place(), 55 if by_risk else 60
    likely = F.coalesce("fp_likelihood", "extra.fp_likelihood") == "HIGH"
    title = F.concat(F.when(likely & F.lit(by_risk), "[FP?] ").otherwise(""), F.regexp_replace("title", r"[^\x00-\x7F]", "?"))
    reach = F.coalesce(F.nullif(F.col("exposure"), F.lit("")), F.when(F.col("reachable"), "YES").when(~F.col("reachable"), "NO").otherwise("?"))
    rows = findings.orderBy(*([F.desc_nulls_last("risk_score")] if by_risk else []), F.desc_nulls_last("severity"), F.desc_nulls_last("exploitability"), "ord")
    return rows.select(
        "fid", F.round(F.coalesce("risk_score", F.lit(0.0)), 2).alias("risk"), F.round("severity", 1).alias("severity"), F.round("exploitability", 2).alias("exploitability"), reach.alias("reach"),
        F.concat("engine", F.when(F.col("extra.corroborated"), "*").otherwise("")).alias("engine"), F.when(F.length(place) > 28, F.concat(F.lit("..."), F.right(place, F.lit(25)))).otherwise(place).alias("location"),
        F.when(F.length(title) > wide, F.concat(F.substring(title, 1, wide - 3), F.lit("..."))).otherwise(title).alias("title"),
    )


def path_lines(findings: DataFrame) -> DataFrame:
    """(fid, text): what a console shows of each finding with an attack path, those of the repository or its history apart."""
    shown = findings.where((F.size("extra.attack_path") > 0) & ~F.coalesce(F.col("exposure").isin("REPO", "HIST"), F.lit(False)))
    hop = lambda h, k: F.when(k == 0, F.concat(F.lit("  Entry: "), h)).otherwise(F.concat(F.repeat(F.lit(" "), k * 2 + 2), F.lit("|--> "), h))
    head = F.concat(F.col("title"), F.lit("\n  Location: "), _place(), F.format_string("\n  Severity: %.1f | Risk Score: %.2f | Exposure: %s\n", F.coalesce("severity", F.lit(0.0)), F.coalesce("risk_score", F.lit(0.0)), _or("exposure", "REACHABLE")))
    hint = F.coalesce(F.concat(F.lit("\n  Remediation: "), F.nullif(F.col("fix_hint"), F.lit(""))), F.lit(""))
    return shown.orderBy("ord").select("fid", F.concat(head, F.array_join(F.transform("extra.attack_path", hop), "\n"), hint).alias("text"))


def label_template(findings: DataFrame, labels: DataFrame, repo: str = "") -> DataFrame:
    """(part, file, line, key, text): the lines of a labels file, in order; written verdicts and notes stay.

    ``findings``: key, file, line, engine, title, evidence, ord, of which the first of
    a key counts; ``labels``: key, verdict, note.  Parts: 0 head, 1 to label (by
    file and line), 2 labelled, 3 not in the findings any more.  No score is shown,
    so that it can't sway the labels.
    """
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    comment = lambda c, n: F.substring(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), 1, n)
    one = findings.groupBy("key").agg(F.min_by(F.struct("file", "line", "engine", "title", "evidence"), "ord").alias("f"))
    met = one.join(labels.select("key", F.coalesce("verdict", F.lit("")).alias("verdict"), F.coalesce("note", F.lit("")).alias("note")), "key", "full")
    part = F.when(F.col("f").isNull(), 3).when(F.coalesce("verdict", F.lit("")) != "", 2).otherwise(1)
    seen = F.concat(F.lit("  # ["), _or("f.engine", "?"), F.lit("] "), comment(F.col("f.title"), 90), F.coalesce(F.concat(F.lit("\n  #   evidence: "), F.nullif(comment(F.col("f.evidence"), 100), F.lit(""))), F.lit("")))
    entry = F.concat(F.lit("\n  "), quoted(F.col("key")), F.lit(": {verdict: "), quoted(F.coalesce("verdict", F.lit(""))), F.lit(", note: "), quoted(F.coalesce("note", F.lit(""))), F.lit("}"))
    by_place = part == 1
    rows = met.select(part.alias("part"), F.when(by_place, F.coalesce("f.file", F.lit(""))).otherwise("").alias("file"), F.when(by_place, F.coalesce("f.line", F.lit(0))).otherwise(0).alias("line"), "key",
                      F.concat(F.when(F.col("f").isNull(), "  # (not in the findings any more)").otherwise(seen), entry).alias("text"))
    head = F.concat(F.lit('# verdict: TP (real), FP (false alarm), UNSURE, or "" to skip; note: why\nrepo: '), quoted(F.lit(repo)), F.lit("\nfindings:"))
    first = findings.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit("").alias("file"), F.lit(0).alias("line"), F.lit("").alias("key"), head.alias("text"))
    return first.unionByName(rows).orderBy("part", "file", "line", "key")


def percent(x: float | None) -> str:
    return "n/a" if x is None else f"{x * 100:.1f}%"


def evaluation(coverage: Row, engines: list[Row], recall: dict[str, int], safety: Row, ranking: dict[str, Row] | None = None, repo: str = "") -> str:
    """An evaluation as Markdown, from rows of ``operators.evaluate``: all of bounded number.

    ``engines``: rows of ``precision_by`` with engine; ``recall``: expectations by
    status; ``ranking``: average precision (``ap``) and ``p5`` by ordering.
    """
    known = sum(recall.values())
    lines = [
        f"# Evaluation {repo}".rstrip(), "", "## Labels", "", "| Findings | Labelled | Unsure | Unlabelled | Real | False alarm |", "|---:|---:|---:|---:|---:|---:|",
        f"| {coverage['total']} | {coverage['labelled']} ({percent(coverage['share'])}) | {coverage['unsure']} | {coverage['unlabelled']} | {coverage['tp']} | {coverage['fp']} |", "",
        "## Precision", "", f"Of the labelled findings {percent(coverage['precision'])} are real.", "", "| Engine | Real | False alarm | Precision |", "|---|---:|---:|---:|",
        *[f"| {e['engine']} | {e['tp']} | {e['fp']} | {percent(e['precision'])} |" for e in sorted(engines, key=lambda e: e["engine"])], "", "## Recall", "",
    ]
    if known:
        found, hidden = recall.get("found", 0), recall.get("found_but_hidden", 0)
        lines += [f"{found} of {known} known vulnerabilities were found ({percent(found / known)}); {hidden} more were hidden, {recall.get('missed', 0)} missed. A floor of the true recall."]
    else:
        lines += ["There is no list of expected findings."]
    lines += ["", "## Safety of hiding", "", f"Real findings wrongly hidden: {safety['wrongly_hidden']} ({'PASS' if safety['safe'] else 'FAIL'}; this must be 0).", "", "| Measure | Value |", "|---|---:|",
              f"| False alarms hidden | {percent(safety['caught_high'])} |", f"| False alarms hidden or demoted | {percent(safety['caught_any'])} |", f"| Real findings demoted | {safety['wrongly_demoted']} |",
              f"| Precision before hiding | {percent(safety['precision_before'])} |", f"| Precision after hiding | {percent(safety['precision_after'])} |"]
    if ranking:
        lines += ["", "## Ranking", "", "| Order | P@5 | Average precision |", "|---|---:|---:|", *[f"| {name} | {percent(r['p5'])} | {percent(r['ap'])} |" for name, r in ranking.items()]]
    return "\n".join(lines) + "\n"


def evaluation_summary(coverage: Row, recall: dict[str, int], safety: Row) -> str:
    """The same in three or four lines."""
    lines = [f"Findings: {coverage['total']}  labelled: {coverage['labelled']}  (TP {coverage['tp']}, FP {coverage['fp']}, unsure {coverage['unsure']}, unlabelled {coverage['unlabelled']})", f"Precision: {percent(coverage['precision'])}"]
    if known := sum(recall.values()):
        lines.append(f"Recall on known list: {recall.get('found', 0)}/{known} ({percent(recall.get('found', 0) / known)})")
    return "\n".join([*lines, f"Real findings wrongly hidden: {safety['wrongly_hidden']}  [{'PASS' if safety['safe'] else 'FAIL'}]"])


def fix_report(edits: DataFrame, findings: DataFrame, moved: DataFrame | None = None) -> DataFrame:
    """(part, json): applied, skipped, not_automated and warnings of code fixes, a row each.

    ``edits``: :func:`patch.apply_patches`' rows; ``moved``: those of
    ``secrets.move_to_environment``, whose lines are masked and whose new text is left out.
    """
    shown = ["file", "line", "rule", "status", "reason", "original", "patched"]
    rows = edits.select(*shown)
    if moved is not None:
        rows = rows.unionByName(moved.select("file", "line", F.lit("secret").alias("rule"), "status", "reason", "original", "patched"))
    out = rows.select(F.when(F.col("status") == "applied", "applied").otherwise("skipped").alias("part"), F.to_json(F.struct(*shown)).alias("json"))
    out = out.unionByName(not_automated(findings).select(F.lit("not_automated").alias("part"), F.to_json(F.struct("rule", "n")).alias("json")))
    if moved is not None:
        warn = "Rotate every secret that was moved: the old value is valid still and stays in the history."
        out = out.unionByName(moved.where("status = 'applied'").limit(1).select(F.lit("warnings").alias("part"), F.to_json(F.struct(F.lit(warn).alias("text"))).alias("json")))
    return out


def upgrade_report(plan: DataFrame, edited: DataFrame, verified: DataFrame | None = None) -> DataFrame:
    """(part, json): plan, applied, skipped and verification of upgrades, a row each."""
    as_rows = lambda d, part: d.select(part.alias("part"), F.to_json(F.struct(*d.columns)).alias("json"))
    out = as_rows(plan, F.lit("plan")).unionByName(as_rows(edited, F.when(F.col("new_text").isNotNull(), "applied").otherwise("skipped")))
    return out if verified is None else out.unionByName(as_rows(verified, F.lit("verification")))
