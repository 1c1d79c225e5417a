"""The scan pipeline as one lazy plan, and the flagship report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import credential_literals, is_test_path, replace_all
from ..operators import dedup, fp, graph, health, score, sets, suppress
from ..operators.scratch import keep
from ..sources import constants
from .harness import findings


def redact(rows: DataFrame) -> DataFrame:
    """Credential values in evidence are masked there and in title, description and hint; secrets rows are left."""
    values = credential_literals(F.col("evidence"))
    with_values = rows.withColumn("_v", F.when(F.col("engine") == "secrets", F.array().cast("array<string>")).otherwise(values))
    masked = {c: F.when(F.size("_v") > 0, replace_all(F.coalesce(c, F.lit("")), F.col("_v"))).otherwise(F.col(c)) for c in ("title", "description", "evidence", "fix_hint")}
    out = with_values.withColumns({f"_{c}": v for c, v in masked.items()} | {"_hit": F.size("_v") > 0})
    extra = F.col("extra").withField("redacted", F.when(F.col("_hit"), True).otherwise(F.col("extra.redacted")))
    return out.select(*[(extra if c == "extra" else F.col(f"_{c}") if c in masked else F.col(c)).alias(c) for c in rows.columns])


def scan(parts: list[DataFrame], baseline: DataFrame, source_lines: DataFrame, env: DataFrame, churn: DataFrame | None = None, code_graph: tuple[DataFrame, DataFrame, DataFrame] | None = None, components: DataFrame | None = None, penalties: DataFrame | None = None, files: DataFrame | None = None, exclude_tests: bool = False, hide_fp: bool = False, changed: DataFrame | None = None, training_paths: tuple[str, ...] = (), weights: dict[str, float] | None = None) -> DataFrame:
    """Findings of all engines: suppressed, merged, enriched, classified, scored, filtered, redacted and ranked.

    ``code_graph``: nodes, edges and entry points of ``python_source.graph_tables``,
    from which reachability, exposure and blast radius follow; ``components``: the
    map of :func:`..operators.graph.component_used`; ``penalties``: (file, penalty);
    ``files``: (path, text), by which SQL made of constants and hashes of sensitive
    data are told.
    """
    rows = sets.union_in_order(parts).drop("src")
    rows = dedup.deduplicate(suppress.split(suppress.suppress(rows, baseline, source_lines))[0])
    if churn is not None:
        rows = health.churn_of(rows, churn)
    if code_graph is not None:
        rows = graph.expose(rows, *code_graph, components)
    if penalties is not None:
        rows = health.health_of(rows, penalties)
    told = keep(constants.judged(rows, files), "judged") if files is not None else None
    rows = score.score(fp.classify(rows, env, training_paths, *([told.where("sql_constant"), told] if files is not None else [])), weights)
    if exclude_tests:
        rows = rows.where(~(is_test_path(F.col("file")) | F.coalesce(F.col("exposure") == "TEST", F.lit(False))))
    if hide_fp:
        rows = fp.hide(rows)[0]
    if changed is not None:
        rows = sets.changed_scope(rows, changed)
    return score.ranked(redact(rows))


def risk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 highest risks of the scaffolding findings, with their explanation."""
    return score.top(score.score(findings(spark, sf_dir)), 50).select("fid", "engine", "file", "line", "cwe", "severity", "risk_score", "explanation")
