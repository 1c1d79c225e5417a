"""The composite risk score, its explanation, and rankings."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import tables as T
from ..functions.columns import band, clamp, lookup


@dataclass(frozen=True)
class ScoringConfig:
    """Knobs of the score; all in [0, 1] but ``rotated``, in [0.05, 1], and ``live_verified``, in [1, 3]."""

    repo: float = T.REACH["REPO"]
    hist: float = T.REACH["HIST"]
    worker: float = T.REACH["WORKER"]
    startup: float = T.REACH["STARTUP"]
    cli: float = T.REACH["CLI"]
    internal: float = T.REACH["INTNL"]
    unknown: float = 0.50
    ref_id: float = 0.50
    rotated: float = 0.20
    live_verified: float = 1.50
    unevaluated: float = 0.50
    status_unknown: float = 0.80
    fp_high: float = 0.20
    fp_medium: float = 0.60

    def __post_init__(self) -> None:
        for name, value in asdict(self).items():
            low, high = {"live_verified": (1.0, 3.0), "rotated": (0.05, 1.0)}.get(name, (0.0, 1.0))
            if not low <= value <= high:
                raise ValueError(f"{name}={value} is not in [{low}, {high}]")


def weights_from(values: dict[str, object] | None) -> dict[str, float]:
    """Weights with defaults for what is missing, not finite or not in [0, 1]; all zero gives the defaults."""
    out = dict(T.WEIGHTS)
    for k in out:
        try:
            v = float((values or {}).get(k, out[k]))
        except (TypeError, ValueError):
            continue
        if 0.0 <= v <= 1.0:
            out[k] = v
    return out if sum(out.values()) > 0 else dict(T.WEIGHTS)


def reach(config: ScoringConfig, exposure: Column, reachable: Column, engine: Column, cwe: Column) -> Column:
    credential = (engine == "secrets") | F.coalesce(cwe, F.lit("")).isin("CWE-259", "CWE-798")
    return (
        F.when(exposure == "HTTP", 1.0)
        .when(exposure == "REPO", config.repo)
        .when(exposure == "HIST", config.hist)
        .when(exposure == "WORKER", config.worker)
        .when(exposure == "STARTUP", config.startup)
        .when(exposure == "CLI", config.cli)
        .when(exposure == "INTNL", config.internal)
        .when(exposure == "TEST", F.when(credential, config.repo).otherwise(0.0))
        .when(exposure.isin("DEAD", "NONE"), 0.0)
        .when((exposure == "UNKNOWN") | reachable.isNull(), config.unknown)
        .when(reachable, 1.0)
        .otherwise(0.0)
    )


def signals(config: ScoringConfig) -> dict[str, Column]:
    """The seven signals of a finding row, each in [0, 1]."""
    e = F.col("extra")
    exposure = F.coalesce(F.nullif(F.col("exposure"), F.lit("")), e["exposure"])
    return {
        "cvss": clamp(F.col("severity") / 10.0),
        "epss": clamp(F.coalesce(e["epss"], F.col("exploitability"))),
        "kev": F.when(F.coalesce(e["kev"], F.lit(False)), 1.0).otherwise(0.0),
        "reach": reach(config, exposure, F.col("reachable"), F.col("engine"), F.col("cwe")),
        "blast": clamp(F.col("blast_radius") / 10.0),
        "churn": clamp(F.col("churn")),
        "health": clamp(F.col("code_health_penalty")),
    }


def combine(signal: dict[str, Column], weights: dict[str, float]) -> Column:
    """100 times the weighted mean, not rounded."""
    total = sum(weights.values()) or 1.0
    parts = [F.lit(weights[k]) * signal[k] for k in T.WEIGHTS]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return clamp(out / F.lit(total) * 100.0, 0.0, 100.0)


def score(findings: DataFrame, weights: dict[str, float] | None = None, config: ScoringConfig | None = None) -> DataFrame:
    """Fill risk_score and explanation.  Each factor's product is rounded to 2 places before the next."""
    config, weights = config or ScoringConfig(), weights_from(weights)
    e, s = F.col("extra"), signals(config)
    # Each step names the value once, so that the expression stays linear; a factor of 1 changes nothing.
    factor_if = lambda x, on: F.round(x * on.otherwise(1.0), 2)
    rotated, live = F.coalesce(e["rotated"], F.lit(False)), F.coalesce(e["live_verified"], F.lit(False))
    status = F.lower(F.coalesce(e["affected_status"], F.lit("confirmed")))
    value = F.round(combine(s, weights), 2)
    value = factor_if(value, F.when(F.coalesce(e["is_ref_id"], F.lit(False)), config.ref_id))
    value = F.least(F.lit(100.0), factor_if(value, F.when(rotated, config.rotated).when(live, config.live_verified)))
    value = factor_if(value, F.when(status == "unevaluated", config.unevaluated).when(status == "unknown", config.status_unknown))
    fp = F.coalesce(F.nullif(F.col("fp_likelihood"), F.lit("")), e["fp_likelihood"])
    seed, own = e["seed_classification"], e["damping_multiplier"]
    factor = (
        F.when(seed == "SEED_FULL", config.fp_high).when(seed == "SEED_PARTIAL", config.fp_medium)
        .when(own < 1.0, own).when(fp == "HIGH", config.fp_high).when(fp == "MEDIUM", config.fp_medium)
    )
    staged = findings.withColumns({f"_{k}": v for k, v in s.items()} | {"_value": value, "_factor": factor, "_fp": fp, "_status": status})
    final = F.round(F.col("_value") * F.coalesce("_factor", F.lit(1.0)), 2)
    has_epss = e["epss"].isNotNull() | ((F.col("engine") == "dependency") & (F.col("exploitability") > 0))
    exposure = F.coalesce(F.nullif(F.col("exposure"), F.lit("")), e["exposure"])
    label = F.coalesce(exposure, F.when(F.col("reachable"), "YES").when(~F.col("reachable"), "NO").otherwise("?"))
    note = lambda on, text: F.when(on, text).otherwise(F.lit(""))
    seeded = F.coalesce(seed, F.lit("")).isin("SEED", "SEED_FULL", "SEED_PARTIAL")
    w = weights
    text = F.concat(
        F.format_string("Risk Score: %.2f/100 | CVSS: %.1f (s=%.2f, w=%.2f), ", F.col("risk_score"), F.coalesce("severity", F.lit(0.0)), F.col("_cvss"), F.lit(w["cvss"])),
        F.when(has_epss, F.format_string("EPSS: %.4f", F.col("_epss"))).otherwise(F.format_string("Exploit: %.2f", F.col("_epss"))),
        F.format_string(" (w=%.2f), KEV: %d (w=%.2f), Exposure: %s (s=%.2f, w=%.2f", F.lit(w["epss"]), F.col("_kev").cast("int"), F.lit(w["kev"]), label, F.col("_reach"), F.lit(w["reach"])),
        note(F.coalesce(F.size(e["attack_path"]), F.lit(0)) > 0, F.format_string(", hops=%d", F.size(e["attack_path"]))),
        F.format_string("), Blast: %.2f (w=%.2f, count=%d), Churn: %.2f (w=%.2f), Health: %.2f (w=%.2f)", F.col("_blast"), F.lit(w["blast"]), F.coalesce("blast_radius", F.lit(0)), F.col("_churn"), F.lit(w["churn"]), F.col("_health"), F.lit(w["health"])),
        note(F.coalesce(e["is_ref_id"], F.lit(False)), F.format_string(", PRNG Ref-ID: %.2fx", F.lit(config.ref_id))),
        F.when(rotated, F.format_string(", Rotated: %.2fx", F.lit(config.rotated))).when(live, F.format_string(", Live Verified: %.2fx", F.lit(config.live_verified))).otherwise(F.lit("")),
        F.when(F.col("_status") == "unevaluated", F.format_string(", Unevaluated: %.2fx", F.lit(config.unevaluated))).when(F.col("_status") == "unknown", F.format_string(", Status Unknown: %.2fx", F.lit(config.status_unknown))).otherwise(F.lit("")),
        note(F.col("_factor").isNotNull(), F.format_string(", %s: %.2fx (%s)", F.when(seeded, "Seed Damped").otherwise("FP Damped"), F.col("_factor"), F.coalesce(F.nullif(F.col("fp_reason"), F.lit("")), e["fp_reason"], F.lit("")))),
    )
    out = staged.withColumn("risk_score", final).withColumn("explanation", text)
    return out.drop(*[f"_{k}" for k in s], "_value", "_factor", "_fp", "_status")


def ranked(findings: DataFrame) -> DataFrame:
    """Highest risk first; ties by severity, exploitability and input order."""
    return findings.orderBy(F.desc("risk_score"), F.desc("severity"), F.desc("exploitability"), "ord")


def top(findings: DataFrame, k: int) -> DataFrame:
    return ranked(findings).limit(k)


def severity_bands(findings: DataFrame) -> DataFrame:
    return findings.groupBy(band(F.col("severity")).alias("band")).agg(F.count("*").alias("n"))


__all__ = ["ScoringConfig", "combine", "lookup", "ranked", "reach", "replace", "score", "severity_bands", "signals", "top", "weights_from"]


def legacy_ranked(rows: DataFrame) -> DataFrame:
    """By severity and exploitability alone."""
    return rows.orderBy(F.desc("severity"), F.desc("exploitability"), "ord")


def engine_order(rows: DataFrame, dependency: bool = False) -> DataFrame:
    """The order in which an engine gives its findings; dependencies are told apart by title at the end."""
    last = [F.col("title")] if dependency else []
    return rows.orderBy(F.desc("severity"), F.desc("exploitability"), "file", F.coalesce("line", F.lit(0)), *last)
