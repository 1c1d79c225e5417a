"""The finding row and the tables around it."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "strings": T.ArrayType(T.StringType()), "ints": T.ArrayType(T.IntegerType()),
          "sources": T.ArrayType(T.StructType([T.StructField("engine", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("severity", T.DoubleType()), T.StructField("cwe", T.StringType()), T.StructField("line", T.IntegerType())]))}


def struct(text: str) -> T.StructType:
    """A struct from "name kind, ..."; needs no session."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (x.split() for x in text.split(","))])


EXTRA = struct("""
  package string, version string, vuln_id string, aliases strings, fixed_version string, severity_source string,
  epss double, epss_percentile double, kev boolean, dependency_scope string, test_id string, check_id string,
  issue_severity string, issue_confidence string, line_range ints, file_role string, is_test_code boolean,
  is_sample_code boolean, rule string, secret_type string, fingerprint string, variable string,
  is_provider_token boolean, provider_prefix string, in_working_tree boolean, in_history boolean,
  corroborating_engines strings, corroborated boolean, sources_count int, sources sources, all_rules strings,
  suppressed boolean, suppression_reason string, damping_multiplier double, is_ref_id boolean, rotated boolean,
  live_verified boolean, affected_status string, seed_classification string, exposure string, fp_likelihood string,
  fp_reason string, attack_path strings, redacted boolean, transitive_via string, context string, fp_blocked string, rule_title string
""")

FINDING = T.StructType([
    T.StructField("fid", T.LongType()),
    T.StructField("ord", T.LongType()),
    *[T.StructField(n, T.StringType()) for n in ("engine", "title", "file")],
    T.StructField("line", T.IntegerType()),
    T.StructField("cwe", T.StringType()),
    T.StructField("severity", T.DoubleType()),
    *[T.StructField(n, T.StringType()) for n in ("description", "evidence", "fix_hint")],
    T.StructField("exploitability", T.DoubleType()),
    *[T.StructField(n, T.BooleanType()) for n in ("reachable", "symbol_reachable", "package_imported")],
    T.StructField("blast_radius", T.LongType()),
    *[T.StructField(n, T.DoubleType()) for n in ("churn", "code_health_penalty", "risk_score")],
    *[T.StructField(n, T.StringType()) for n in ("explanation", "exposure", "fp_likelihood", "fp_reason")],
    T.StructField("extra", EXTRA),
])

NODES = struct("node_id string, kind string, label string, file_path string, line_number int, is_test boolean")
EDGES = struct("source_id string, target_id string, kind string, exported boolean, referenced boolean")
LABELS = struct("key string, verdict string, note string")
EXPECTED = struct("idx int, file string, line int, tol int, cwe strings, note string")


def finding(spark, rows: list[dict]):
    """A finding table from dicts; absent members are null, fid and ord follow the order."""
    full = []
    for k, r in enumerate(rows):
        extra = {f.name: (r.get("extra") or {}).get(f.name) for f in EXTRA.fields}
        full.append(tuple({"fid": k, "ord": k, **r, "extra": tuple(extra.values())}.get(f.name) for f in FINDING.fields))
    return spark.createDataFrame(full, FINDING)
