import pytest
from packaging.version import Version
from pyspark.sql import functions as F

from triagelake.functions import columns as C
from triagelake.operators import dedup, evaluate, fp, graph, health, remediate, score, sets, suppress, threat
from triagelake.operators.components import connected_components
from triagelake.schema import finding
from triagelake.sinks import report


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_score_of_a_known_row_and_its_factors(spark):
    base = {"engine": "bandit", "title": "t", "file": "a.py", "severity": 10.0, "exploitability": 0.5, "reachable": True, "blast_radius": 5, "churn": 0.2, "code_health_penalty": 0.4}
    rows = [base, base | {"extra": {"is_ref_id": True}}, base | {"fp_likelihood": "HIGH", "fp_reason": "why"}, base | {"extra": {"live_verified": True}}, base | {"reachable": None}, base | {"exposure": "TEST", "engine": "secrets"}]
    got = {r["fid"]: r for r in score.score(finding(spark, rows)).collect()}
    assert [got[k]["risk_score"] for k in range(6)] == [63.0, 31.5, 12.6, 94.5, 55.5, 60.0]
    assert got[0]["explanation"].startswith("Risk Score: 63.00/100 | CVSS: 10.0 (s=1.00, w=0.30), Exploit: 0.50")
    assert "FP Damped: 0.20x (why)" in got[2]["explanation"]


def test_weights_and_knobs_are_checked():
    assert score.weights_from({"cvss": "x", "epss": 7, "kev": float("nan")}) == score.weights_from(None)
    assert sum(score.weights_from(dict.fromkeys(score.weights_from(None), 0)).values()) == pytest.approx(1)
    with pytest.raises(ValueError):
        score.ScoringConfig(fp_high=2)


@pytest.mark.parametrize(("vector", "expected"), [
    ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:H", 7.5),
    ("CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N", 6.1), ("CVSS:3.0/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N", 0.0), ("CVSS:4.0/AV:N", None), ("rubbish", None), ("CVSS:3.1/AV:N", None),
])
def test_cvss(spark, vector, expected):
    assert one(spark, C.cvss3(F.col("v")), v=vector) == expected


def test_weaknesses_and_paths(spark):
    assert [one(spark, C.cwe(F.col("c")), c=c) for c in ("cwe-79 x", "502", "nope")] == ["CWE-79", "CWE-502", None]
    assert one(spark, C.cwe(F.col("c"), F.lit("b506")), c="CWE-1") == "CWE-502"
    pairs = [("CWE-78", "CWE-94", True), ("CWE-78", "CWE-89", False), ("78", "CWE-78", True), (None, "CWE-1", False)]
    assert [one(spark, C.cwe_compatible(F.col("a").cast("string"), F.col("b")), a=a, b=b) for a, b, _ in pairs] == [x[2] for x in pairs]
    roles = {"tests/a.py": "test", "src/test_a.py": "test", "docs/a.py": "docs", "examples/x.py": "sample", "src/a.py": "production", "testing.py": "production"}
    assert {p: one(spark, C.file_role(F.col("p")), p=p) for p in roles} == roles
    assert one(spark, C.report_uri(F.col("p")), p="././.github/x") == ".github/x"
    assert one(spark, C.matches_glob(F.col("p"), "labs/*"), p="labs/a/b.py") and not one(spark, C.matches_glob(F.col("p"), "labs"), p="labs2/a.py")


def test_versions_order_like_the_public_scheme(spark):
    names = ["1.0", "1.0.1", "1.0a1", "1.0rc2", "1.0.dev3", "1.0.post1", "1!0.1", "2.0", "1.10", "1.9", "1.0b2", "v1.2"]
    df = spark.createDataFrame([(n,) for n in names], "v string").select("v", C.version_key(F.col("v")).alias("k"))
    got = [r["v"] for r in df.orderBy("k").collect()]
    assert [Version(v) for v in got] == sorted(Version(v) for v in names)
    cases = [("1.0", "1.0.1", "patch"), ("1.0", "1.2", "minor"), ("1.0", "2.0", "major"), ("2022.1", "2023.1", "minor"), ("x", "1", "major")]
    assert [one(spark, C.jump(F.col("a"), F.col("b")), a=a, b=b) for a, b, _ in cases] == [c[2] for c in cases]
    assert one(spark, C.nearest_fixed(F.array(F.lit("3.0"), F.lit("1.4"), F.lit("1.0")), F.lit("1.2")), a=1) == "1.4"


def test_fingerprints_number_equal_lines(spark):
    row = {"engine": "bandit", "title": "t", "file": "A\\b.py", "line": 3, "evidence": "3  x = 1\n4  y = 2", "extra": {"test_id": "B1"}}
    got = suppress.fingerprinted(finding(spark, [row, row, row | {"evidence": "3  x =  1\n"}])).orderBy("ord").collect()
    assert [r["occurrence"] for r in got] == [0, 1, 2] and {r["clean"] for r in got} == {"x=1"} and len({r["fp"] for r in got}) == 3
    import hashlib

    assert got[0]["fp"] == hashlib.sha256(b"a/b.py:b1:x=1:0").hexdigest()[:16]


def test_suppression_comments(spark):
    lines = spark.createDataFrame([("a.py", 1, "# nosec"), ("a.py", 2, "x()"), ("a.py", 3, "y()  # nosec B602"), ("a.py", 4, "z()  # nosemgrep: utils.py"), ("a.py", 5, "w()  # noqa"), ("a.py", 6, "d  # scip:ignore CVE-2024-1")], "file string, line int, text string")
    f = finding(spark, [
        {"engine": "bandit", "title": "t", "file": "a.py", "line": 2, "extra": {"test_id": "B101"}}, {"engine": "bandit", "title": "t", "file": "a.py", "line": 3, "extra": {"test_id": "B101"}},
        {"engine": "bandit", "title": "t", "file": "a.py", "line": 3, "extra": {"test_id": "B602"}}, {"engine": "semgrep", "title": "t", "file": "a.py", "line": 4, "extra": {"check_id": "r.x"}},
        {"engine": "bandit", "title": "t", "file": "a.py", "line": 5, "extra": {"test_id": "B101"}}, {"engine": "dependency", "title": "t", "file": "a.py", "line": 6, "extra": {"vuln_id": "CVE-2024-1"}},
        {"engine": "bandit", "title": "t", "file": "a.py", "line": 2, "extra": {"corroborating_engines": ["bandit", "semgrep"]}},
    ])
    assert {r["fid"]: r["reason"] for r in suppress.inline(f, lines).collect()} == {
        0: "Inline suppression (nosec) at line 1", 2: "Inline targeted suppression for 'B602' at line 3", 3: "Inline suppression (nosemgrep) at line 4", 5: "Inline targeted suppression for dependency (CVE-2024-1) at line 6"}
    # Rows 0, 1 and 4 are equal but for their place: the baseline's occurrence 0 is row 0.
    base = suppress.baseline_rows(f.where("fid = 4"))
    active, quiet = suppress.split(suppress.suppress(f, base, lines))
    assert {r["fid"] for r in active.collect()} == {1, 4, 6}
    assert {r["fid"]: r["extra"]["suppression_reason"][:10] for r in quiet.collect()} == {0: "Suppressed", 2: "Inline tar", 3: "Inline sup", 5: "Inline tar"}


def test_findings_of_several_engines_merge(spark):
    f = finding(spark, [
        {"engine": "bandit", "title": "sql", "file": "./a.py", "line": 3, "cwe": "CWE-89", "severity": 8.0, "extra": {"test_id": "B608"}}, {"engine": "semgrep", "title": "sql", "file": "a.py", "line": 3, "cwe": "CWE-89", "severity": 8.0, "extra": {"check_id": "q.w.e"}},
        {"engine": "bandit", "title": "sql", "file": "a.py", "line": 4, "cwe": "CWE-89", "severity": 5.0}, {"engine": "crypto", "title": "md5 used", "file": "a.py", "line": 4, "severity": 6.0}, {"engine": "semgrep", "title": "weak md5", "file": "a.py", "line": 4, "severity": 3.0},
        {"engine": "dependency", "title": "d", "file": "a.py", "line": 3, "cwe": "CWE-89", "severity": 1.0},
    ])
    assert {(r["fid_a"], r["fid_b"]) for r in dedup.duplicate_pairs(f).collect()} == {(0, 1), (3, 4)}
    out = dedup.deduplicate(f).collect()
    assert [(r["engine"], r["severity"], r["extra"]["corroborating_engines"]) for r in out] == [("semgrep", 8.0, ["bandit", "semgrep"]), ("crypto", 6.0, ["crypto", "semgrep"]), ("bandit", 5.0, None), ("dependency", 1.0, None)]
    assert out[0]["extra"]["all_rules"] == ["B608", "q.w.e"]


def test_graph_operators_survive_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "d")], "source_id string, target_id string")
    nodes = spark.createDataFrame([(n, "FUNCTION", n == "x") for n in "abcdx"], "node_id string, kind string, is_test boolean")
    target = spark.createDataFrame([("d",), ("a",)], "target string")
    assert {r["target"]: r["blast_radius"] for r in graph.blast_radius(edges, nodes, target).collect()} == {"d": 3, "a": 2}
    entries = spark.createDataFrame([("x", "cli"), ("a", "web")], "node_id string, framework string")
    best = graph.entry_paths(edges, entries, target).where("target = 'd'").first()
    assert (best["framework"], best["path"]) == ("web", ["a", "b", "c", "d"])
    ring = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)], "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(ring).collect()}
    assert got == dict.fromkeys(range(41), 0) | {100: 100, 101: 100}
    assert connected_components(ring.where("false")).count() == 0


def test_graph_searches_have_no_depth_limit(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(67)], "src long, dst long")
    start = spark.createDataFrame([(0,)], "start long")
    assert {r["node"]: r["hops"] for r in graph.distances(chain, start).collect()} == {k: k for k in range(1, 68)}
    assert graph.shortest_paths(chain, start).where("node = 67").first()["path"] == list(range(68))
    with pytest.raises(ValueError):
        graph.distances(chain, start, max_depth=3)


def test_evaluation(spark):
    rows = spark.createDataFrame([("g", 3.0, 1), ("g", 2.0, 0), ("g", 1.0, 1)], "g string, s double, rel int")
    order = [F.desc("s")]
    assert evaluate.average_precision(rows, ["g"], order).first()["average_precision"] == pytest.approx((1 + 2 / 3) / 2)
    assert evaluate.precision_at(rows, ["g"], order, 2).first()["precision_at_k"] == 0.5
    ties = spark.createDataFrame([("g", 1.0, r) for r in (1, 0, 0)], "g string, s double, rel int")
    assert evaluate.expected_average_precision(ties, ["g"], "s").first()["expected_ap"] == pytest.approx((1 + 1 / 2 + 1 / 3) / 3)
    lab = spark.createDataFrame([("a", 10, "c", "TP"), ("a", 12, "c", "FP"), ("b", 5, "c", "FP")], "file string, line int, tail string, verdict string")
    keys = spark.createDataFrame([(1, "a", 10, "c"), (2, "a", 11, "c"), (3, "b", 7, "c"), (4, "b", 9, "c")], "fid long, file string, line int, tail string")
    assert {r["fid"]: r["verdict"] for r in evaluate.label_lookup(keys, lab).collect()} == {1: "TP", 2: None, 3: "FP", 4: None}


def test_false_positive_rules(spark):
    env = fp.environment(spark.createDataFrame([("Dockerfile", "FROM python:3-slim"), ("Procfile", "web: gunicorn app.wsgi")], "path string, text string"))
    assert tuple(env.first()) == (True, True, False)
    f = finding(spark, [
        {"engine": "dependency", "title": "x", "file": "r.txt", "description": "only on Windows"}, {"engine": "bandit", "title": "pw", "file": "tests/a.py", "cwe": "CWE-259", "evidence": "p = 'x'"},
        {"engine": "bandit", "title": "pw", "file": "tests/a.py", "cwe": "CWE-259", "evidence": "p = 'AKIA1'"}, {"engine": "bandit", "title": "B324 md5", "file": "a.py", "evidence": "etag = md5(body)"},
        {"engine": "bandit", "title": "B324 md5", "file": "a.py", "evidence": "etag = md5(password)"}, {"engine": "bandit", "title": "B311", "file": "a.py", "evidence": "invoice_id = r()"},
        {"engine": "dependency", "title": "x", "file": "r.txt", "description": "only on windows", "extra": {"kev": True}}, {"engine": "bandit", "title": "x", "file": "labs/a.py"},
    ])
    got = {r["fid"]: r for r in fp.classify(f, env, ("labs",)).collect()}
    assert [got[k]["fp_likelihood"] for k in range(8)] == ["HIGH", "HIGH", None, "HIGH", None, None, None, "HIGH"]
    assert got[5]["title"] == "[REF-ID] B311" and got[5]["extra"]["is_ref_id"] and got[7]["extra"]["damping_multiplier"] == 0.1


def test_upgrades(spark):
    v = spark.createDataFrame([("r", 1, "Py_X", "1.0", "A", "1.2", 5.0), ("r", 1, "py-x", "1.0", "B", "1.10", 9.0), ("r", 1, "py-x", "1.0", "C", None, 1.0), ("r", 2, "z", "1.0", "D", "2.0", 7.0), ("r", 3, "q", "1.0", "E", "", 2.0)], "file string, line int, package string, version string, vuln_id string, fixed_version string, risk_score double")
    got = {r["line"]: r for r in remediate.plan_upgrades(v).collect()}
    assert (got[1]["target"], got[1]["fixes"], got[1]["unfixed"], got[1]["bucket"], got[1]["risk"]) == ("1.10", ["A", "B"], ["C"], "upgrade", "minor")
    assert (got[2]["bucket"], got[3]["bucket"]) == ("needs_review", "no_fix")
    lines = spark.createDataFrame([("r", 1, "py_x[a]==1.0 ; python_version > '3'  # keep")], "file string, line int, text string")
    assert remediate.apply_upgrades(remediate.plan_upgrades(v), lines).first()["new_text"] == "py_x[a]==1.10 ; python_version > '3'  # keep"


def test_advisories(spark):
    import json

    raw = [{"id": "GHSA-1", "aliases": ["CVE-2"], "summary": "s", "severity": [{"type": "CVSS_V3", "score": "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"}], "affected": [{"package": {"ecosystem": "PyPI", "name": "Foo_Bar"}, "ranges": [{"type": "ECOSYSTEM", "events": [{"introduced": "0"}, {"fixed": "2.0"}]}]}]},
           {"id": "PYSEC-1", "aliases": ["CVE-2"], "database_specific": {"severity": "LOW", "cwe_ids": ["CWE-79"]}, "details": "long details", "affected": [{"package": {"ecosystem": "PyPI", "name": "foo-bar"}, "ranges": []}]}, {"id": "GONE", "withdrawn": "2020"}]
    parsed = threat.parse_advisories(spark.createDataFrame([(json.dumps(r),) for r in raw], "json string"))
    assert {(r["id"], r["cvss"], r["source"]) for r in parsed.collect()} == {("GHSA-1", 9.8, "cvss3"), ("PYSEC-1", 2.5, "label")}
    pins = spark.createDataFrame([("foo-bar", "1.0", "r.txt", 3, 1), ("foo-bar", "1.0", "s.txt", 4, 2)], "name string, version string, file string, line int, ord long")
    adv = parsed.withColumnRenamed("package", "name").withColumn("version", F.lit("1.0"))
    epss = spark.createDataFrame([("CVE-2", 0.3)], "cve string, epss double")
    out = threat.dependency_findings(pins, adv, epss, epss.select("cve")).collect()
    assert len(out) == 1 and (out[0]["vuln_id"], out[0]["severity"], out[0]["exploitability"], out[0]["fixed_version"], out[0]["cwe"], len(out[0]["locations"])) == ("CVE-2", 9.8, 1.0, "2.0", "CWE-79", 2)


def test_sets_health_and_reports(spark):
    rows = spark.createDataFrame([("a/b.py",), ("b.py",), ("xb.py",), ("c.py",)], "file string")
    changed = spark.createDataFrame([("repo/a/b.py",), ("c.py",)], "path string")
    assert {r["file"] for r in sets.changed_scope(rows, changed).collect()} == {"a/b.py", "b.py", "c.py"}
    feats = spark.createDataFrame([(1001, 7, 9, 1)], "loc int, max_nesting int, bare_excepts int, long_functions int")
    assert health.health_penalty(feats).first()["penalty"] == 1.0
    f = finding(spark, [{"engine": "bandit", "title": "B1: x", "file": "a.py", "line": 1, "severity": 9.5, "extra": {"test_id": "B1"}}, {"engine": "crypto", "title": "odd title!", "file": "b.py", "severity": 2.0}])
    import json

    doc = json.loads("".join(_joined(report.sarif(f))))
    assert [r["id"] for r in doc["runs"][0]["tool"]["driver"]["rules"]] == ["bandit-B1", "crypto-odd-title"] and doc["runs"][0]["results"][0]["level"] == "error"
    assert report.gate(f) and "| critical | 1 |" in report.summary(f)
    assert json.loads(report.sparse_json(f).where("fid = 1").first()["json"]) == {"engine": "crypto", "title": "odd title!", "file": "b.py", "severity": 2.0}


def _joined(rows):
    last = None
    for r in rows.collect():
        if last == r["part"]:
            yield ", "
        last = r["part"]
        yield r["value"]
