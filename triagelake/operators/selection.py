"""Which findings a fix, a mask or a picture is for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import tables as T
from ..functions.columns import lookup


def source_rule(engine: Column, title: Column, extra: Column) -> Column:
    """The scanner's own name of the rule: a test id, the last part of a check id (or what the title says), a rule."""
    check = F.element_at(F.split(F.coalesce(extra["check_id"], F.lit("")), r"\."), -1)
    said = F.regexp_extract(title, r"^\s*Semgrep\s+([\w.-]+):", 1)
    test = F.coalesce(F.nullif(extra["test_id"], F.lit("")), F.regexp_extract(title, r"\b(B[0-9]{3})\b", 1))
    return F.when(engine == "bandit", test).when(engine == "semgrep", F.when(check != "", check).otherwise(said)).otherwise(F.coalesce(extra["rule"], F.lit("")))


def patcher(engine: Column, title: Column, extra: Column) -> Column:
    """The patcher for a finding, or null: a test id that has one, or an alias; never for hashes of passwords."""
    rule = source_rule(engine, title, extra)
    known = F.when(engine == "bandit", rule).otherwise(lookup(T.PATCHER_ALIASES, F.concat(engine, F.lit(" "), rule)))
    password = (engine == "crypto") & F.startswith(rule, F.lit("weak-hash")) & F.coalesce(extra["context"] == "password", F.lit(False))
    return F.when(~password & known.isin(*T.PATCHERS), known)


def not_automated(findings: DataFrame) -> DataFrame:
    """(rule: engine and rule, n) of what no patcher is for, the most frequent first."""
    e = F.col("extra")
    left = findings.where(patcher(F.col("engine"), F.col("title"), e).isNull())
    return left.groupBy(F.concat_ws(" ", "engine", F.nullif(source_rule(F.col("engine"), F.col("title"), e), F.lit(""))).alias("rule")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule")


def fixable_secrets(findings: DataFrame) -> DataFrame:
    """Secrets that stand in Python files of the working tree and not in tests."""
    e = F.col("extra")
    return findings.where((F.col("engine") == "secrets") & F.coalesce(e["in_working_tree"], F.lit(True)) & F.endswith("file", F.lit(".py")) & ~F.coalesce(e["is_test_code"], F.lit(False)))


def target_version(hint: Column) -> Column:
    """The version that a fix hint names after ``to`` or ``>=``; null without one."""
    return F.nullif(F.regexp_extract(F.coalesce(hint, F.lit("")), r"(?:to|>=)\s*([0-9]+(?:\.[0-9a-zA-Z]+)+)", 1), F.lit(""))


def rule_name(title: Column, extra: Column) -> Column:
    """The rule's title, else the finding's title up to its first colon, else its first 60 characters."""
    head = F.trim(F.substring_index(title, ":", 1))
    return F.coalesce(F.nullif(extra["rule_title"], F.lit("")), F.nullif(head, F.lit("")), F.substring(title, 1, 60))


def uncovered(findings: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Findings on whose line no suggestion (file, line, end_line) stands."""
    at = suggestions.select("file", F.explode(F.sequence("line", F.greatest("line", "end_line"))).alias("line")).distinct()
    return findings.join(at, ["file", "line"], "left_anti").select(*findings.columns)


def attack_paths(findings: DataFrame, k: int = 3) -> DataFrame:
    """(nth, edge) lines of a flow chart of the first ``k`` reachable findings' paths, each of two steps or more."""
    shown = findings.where((F.size("extra.attack_path") >= 2) & ~F.coalesce(F.col("exposure").isin("REPO", "HIST"), F.lit(False))).orderBy("ord").limit(k)
    # At most k rows are numbered.
    path = shown.select(F.row_number().over(Window.orderBy("ord")).alias("n"), F.col("extra.attack_path").alias("path"))
    step = path.select((F.col("n") - 1).alias("nth"), F.posexplode("path").alias("at", "node"), "path").where("at > 0")
    name = lambda c: F.replace(c, F.lit('"'), F.lit("'"))
    return step.select("nth", "at", F.format_string('E%d_%d["%s"] --> E%d_%d["%s"]', "nth", F.col("at") - 1, name(F.get("path", F.col("at") - 1)), "nth", "at", name(F.col("node"))).alias("edge"))
