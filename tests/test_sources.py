import json

from pyspark.sql import functions as F

from triagelake.operators import graph
from triagelake.plans import pipeline
from triagelake.schema import finding
from triagelake.sources import manifests, python_source, reports, stored
from triagelake.streaming.findings import append_new, arriving


def test_requirement_lines(spark):
    cases = {"Foo_Bar==1.0": ("foo-bar", "1.0"), "a[x]===2 ; python_version>'3'": ("a", "2"), "b>=1,<2": ("b", None), "c": ("c", None), "# no": None, "-r x.txt": None, "https://x/y": None, "d==1.*": ("d", None), "e == 1.2  # c": ("e", "1.2"), "f==1 --hash=sha256:1": ("f", "1")}
    df = spark.createDataFrame([(c,) for c in cases], "l string").select("l", manifests.requirement(F.col("l")).alias("r"))
    assert {r["l"]: r["r"] and tuple(r["r"]) for r in df.collect()} == cases


def test_manifests(spark):
    files = spark.createDataFrame([("requirements.txt", "a==1 \\\n --hash=x\nb==2\n-r more.txt"), ("pyproject.toml", '[project]\ndependencies = ["c==3"]'), ("x/poetry.lock", '[[package]]\nname = "d"\nversion = "4"\n'), ("Pipfile.lock", '{\n"default": {\n"e": {"version": "==5"}}}')], "path string, text string")
    got = {(r["name"], r["version"], r["file"], r["line"]) for r in manifests.collect(files).collect()}
    assert got == {("a", "1", "requirements.txt", 1), ("b", "2", "requirements.txt", 3), ("c", "3", "pyproject.toml", 2), ("d", "4", "x/poetry.lock", 2), ("e", "5", "Pipfile.lock", 3)}
    assert manifests.includes(files).first()["included"] == "more.txt"


def test_reports(spark):
    doc = {"results": [{"code": "x", "filename": "./tests/a.py", "issue_confidence": "HIGH", "issue_severity": "LOW", "issue_text": "t", "line_number": 3, "line_range": [3], "test_id": "B101"}], "errors": []}
    raw = spark.createDataFrame([("banner {oops}\n\x1b[31m" + json.dumps({"x": 1}) + json.dumps(doc),), ("nothing",)], "text string")
    found = reports.bandit(reports.recover_json(raw)).collect()
    assert [(r["file"], r["cwe"], r["severity"], r["exploitability"], r["fp_likelihood"], r["exposure"]) for r in found] == [("tests/a.py", "CWE-703", 2.5, 0.05, "HIGH", "TEST")]
    sem = {"results": [{"check_id": "a/b/rules.py.x", "path": "m.py", "start": {"line": 2}, "end": {"line": 3}, "extra": {"message": "First. Second.", "severity": "ERROR", "lines": "l", "metadata": {"cwe": "CWE-89: x"}}}]}
    r = reports.semgrep(spark.createDataFrame([(json.dumps(sem),)], "json string")).first()
    assert (r["title"], r["cwe"], r["extra"]["check_id"], r["extra"]["line_range"]) == ("Semgrep x: First", "CWE-89", "py.x", [2, 3])


def test_python_facts_and_graph(spark):
    files = spark.createDataFrame([("app.py", "from util import helper\n@app.route('/')\ndef home():\n    return helper()\n"), ("util.py", "import hashlib\ndef helper():\n    return hashlib.md5(b'')\ndef unused():\n    try:\n        pass\n    except:\n        pass\n"), ("bad.py", "def (")], "path string, text string")
    rows = python_source.facts(files).cache()
    assert rows.where("kind = 'error'").count() == 1
    assert [tuple(r)[:4] for r in python_source.weak_crypto(rows).collect()] == [("util.py", 3, "weak-hash-md5", "CWE-328")]
    nodes, edges, entries = python_source.graph_tables(rows)
    best = graph.entry_paths(edges, entries, spark.createDataFrame([("util.py::helper",), ("util.py::unused",)], "target string")).collect()
    assert [(r["target"], r["framework"], r["path"]) for r in best] == [("util.py::helper", "web", ["app.py::home", "util.py::helper"])]
    assert python_source.health_features(rows).where("file = 'util.py'").first()["bare_excepts"] == 1


def test_stored_tables(spark):
    files = spark.createDataFrame([('["a", {"fingerprint": "b"}]',), ('{"version": 2, "fingerprints": ["c"], "findings": [{"fingerprint": "d"}]}',)], "text string")
    assert {tuple(r) for r in stored.baseline(files).collect()} == {("a", 1), ("b", 1), ("c", 2), ("d", 2)}
    cache = spark.createDataFrame([("n", "k", "old", 1.0), ("n", "k", "new", 5.0)], "ns string, key string, value string, ts double")
    assert stored.cached(cache, 10.0, 6.0).first()["value"] == "new" and stored.cached(cache, 10.0, 1.0).count() == 0


def test_scan_plan_end_to_end(spark):
    f = finding(spark, [{"engine": "bandit", "title": "pw", "file": "src/a.py", "line": 1, "severity": 8.0, "evidence": "password = 'hunter2hunter'"}, {"engine": "bandit", "title": "x", "file": "tests/a.py", "line": 2, "severity": 3.0}])
    env = spark.range(1).select(F.lit(False).alias("is_linux"), F.lit(False).alias("is_wsgi_only"), F.lit(False).alias("has_proxy"))
    lines = spark.createDataFrame([], "file string, line int, text string")
    out = pipeline.scan([f], spark.createDataFrame([], "fingerprint string"), lines, env, exclude_tests=True).collect()
    assert [r["file"] for r in out] == ["src/a.py"] and "hunter2hunter" not in out[0]["evidence"] and out[0]["extra"]["redacted"]


def test_streamed_findings_are_appended_once(spark, tmp_path):
    f = finding(spark, [{"engine": "bandit", "title": "t", "file": "a.py", "line": 1, "evidence": "e"}])
    for _ in range(2):
        f.write.mode("append").json(str(tmp_path / "in"))
        append_new(arriving(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
