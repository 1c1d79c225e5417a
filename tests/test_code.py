"""Facts of source files and what is made of them; correlation against a plain version."""

import random

import pytest
from pyspark.sql import functions as F

from triagelake.operators import dedup, evaluate, graph, selection, sets
from triagelake.plans import pipeline
from triagelake.schema import finding
from triagelake.sinks import report
from triagelake.sources import manifests, python_source, reports, stored

WEAK = '''import hashlib, ssl, random
import requests as rq
from Crypto.PublicKey import RSA
from Crypto.Cipher import AES, DES
from cryptography.hazmat.primitives.ciphers import modes
"""see http://docs.org/page"""
IV = b"0123456789abcdef"
session_token = random.choice("abc")
shown = str(random.random())
password_hash = hashlib.md5(pw)
etag = hashlib.sha1(body)
plain = hashlib.new("md5", body)
fine = hashlib.md5(body, usedforsecurity=False)
key = RSA.generate(1024)
draw(bits=8)
good = RSA.generate(bits=4096)
c = AES.new(k, AES.MODE_ECB)
d = DES.new(k)
m = modes.CBC(IV)
e = modes.ECB()
rq.get("http://shop.example.org/x", verify=False)
rq.get("http://localhost/x")
ssl._create_unverified_context()
p = ssl.PROTOCOL_TLSv1
'''


def test_weak_cryptography(spark):
    rows = python_source.facts(spark.createDataFrame([("a.py", WEAK)], "path string, text string"))
    got = {(r["line"], r["rule"], r["cwe"], r["severity"], r["context"]) for r in python_source.weak_crypto(rows).collect()}
    assert got == {
        (8, "insecure-prng", "CWE-338", 6.5, None), (10, "weak-hash-md5", "CWE-916", 8.5, "password"), (11, "weak-hash-sha1", "CWE-328", 2.5, "checksum"), (12, "weak-hash-md5", "CWE-328", 7.0, "general"),
        (14, "weak-key-size", "CWE-326", 7.0, None), (17, "insecure-mode-ecb", "CWE-327", 8.0, None), (18, "insecure-cipher-des", "CWE-327", 7.5, None), (19, "static-iv", "CWE-329", 7.5, None),
        (20, "insecure-mode-ecb", "CWE-327", 8.0, None), (21, "tls-verify-disabled", "CWE-295", 8.0, None), (21, "cleartext-http", "CWE-319", 5.5, None), (23, "tls-verify-disabled", "CWE-295", 8.5, None), (24, "insecure-tls-version", "CWE-327", 7.5, None),
    }


REPO = {
    "web.py": 'import yaml\nfrom svc.core import work\n@app.get("/items")\ndef items():\n    return work()\n@cache.get("x")\ndef cached():\n    pass\n@receiver(sig)\ndef on_save():\n    pass\n',
    "svc/core.py": "import yaml\nimport requests\ndef work():\n    return yaml.load(x)\ndef unused():\n    pass\ndef handed():\n    pass\nclass A:\n    def m(self):\n        return [handed]\n",
    "app/management/commands/sync.py": "class Command(BaseCommand):\n    def handle(self):\n        pass\n",
    "app/views.py": "def page(request):\n    pass\n",
    "tests/test_x.py": "from svc.core import unused\ndef test_a():\n    unused()\n",
    "settings.py": 'INSTALLED_APPS = ["corsheaders.mid", "app"]\n',
}


@pytest.fixture(scope="module")
def code(spark):
    rows = python_source.facts(spark.createDataFrame(list(REPO.items()), "path string, text string")).cache()
    return rows, *(d.cache() for d in python_source.graph_tables(rows))


def test_entry_points(code):
    assert {(r["node_id"], r["framework"], r["label"]) for r in code[3].collect()} == {
        ("web.py::items", "web", "WEB GET /items"), ("web.py::on_save", "worker", "WORKER on_save"), ("app/management/commands/sync.py::Command.handle", "cli", "CLI Command.handle"), ("app/views.py::page", "web", "WEB page"),
    }


def test_exposure_of_dependencies_code_and_secrets(spark, code):
    _, nodes, edges, entries = code
    dep = lambda p, d="": {"engine": "dependency", "title": p, "file": "requirements.txt", "description": d, "extra": {"package": p}}
    at = lambda f, n: {"engine": "bandit", "title": "t", "file": f, "line": n}
    f = finding(spark, [
        dep("PyYAML"), dep("urllib3"), dep("flask"), dep("unheard-of"), dep("django-cors-headers"), at("svc/core.py", 4), at("./svc/core.py", 6), at("svc/core.py", 8), at("tests/test_x.py", 3), at("none.py", 1),
        {"engine": "secrets", "title": "s", "file": "web.py", "line": 1}, dep("pyyaml", "in the CLoader"), {"engine": "secrets", "title": "s", "file": "x", "extra": {"in_working_tree": False, "in_history": True}},
    ])
    gates = spark.createDataFrame([("pyyaml", "cloader", "yaml.cyaml")], "package string, keyword string, component string")
    out = {r["fid"]: r for r in graph.expose(f, nodes, edges, entries, gates).collect()}
    assert [(out[k]["reachable"], out[k]["exposure"], out[k]["fp_likelihood"]) for k in range(13)] == [
        (True, "HTTP", None), (False, "INTNL", None), (False, "DEAD", "HIGH"), (None, "UNKNOWN", None), (False, "INTNL", None), (True, "HTTP", None), (False, "DEAD", "MEDIUM"), (False, "INTNL", "MEDIUM"), (False, "TEST", None), (None, "UNKNOWN", None),
        (None, "REPO", None), (False, "DEAD", "HIGH"), (None, "HIST", None),
    ]
    assert out[5]["extra"]["attack_path"] == ["web.py::items", "svc/core.py::work"] and out[5]["blast_radius"] == 1
    assert out[0]["package_imported"] and not out[1]["package_imported"] and out[1]["extra"]["transitive_via"] == "requests" and out[10]["blast_radius"] == 1
    steps = graph.describe_paths(f.sparkSession.createDataFrame([(["web.py::items", "svc/core.py::work", "pkg::yaml"],)], "path array<string>"), nodes, entries).first()["steps"]
    assert steps == ["Entrypoint: WEB GET /items [web.py:4]", "work [svc/core.py:3]", "Package: yaml"]


def test_blast_radius_without_a_graph(spark, code):
    points = spark.createDataFrame([(1, "svc/core.py", 4), (2, "svc/core.py", 1), (3, "settings.py", 1), (4, "svc/core.py", 6)], "pid long, file string, line int")
    assert {r["pid"]: r["blast_radius"] for r in graph.fallback_blast(points, code[0]).collect()} == {1: 1, 2: 2, 3: 0, 4: 1}


def test_smallest_spans_equal_a_plain_version(spark):
    rng = random.Random(8)
    spans = [(rng.choice("ab"), f"s{k}", a := rng.randint(-40, 300), a + rng.choice([-1, 0, 1, 6, 7, 30, 127, 128, 200]), k) for k in range(160)] + [("c", "all", -(2**31), 2**31 - 1, 1), (None, "x", 1, 9, 2), ("d", "late", 5, 9, 4), ("d", "early", 1, 5, 3)]
    points = [(k, rng.choice("abcd"), rng.randint(-60, 500)) for k in range(600)] + [(900, "c", 2**31 - 1), (901, "c", -(2**31)), (902, "d", 5), (903, None, 5), (904, "d", None), (905, "d", 1), (905, "d", 9), (905, "c", 9)]
    want: dict = {}
    for pid, file, line in points:
        for f, name, start, end, ord_ in spans:
            if line is not None and f is not None and f == file and start <= line <= end:
                want[pid] = min(want.get(pid, (9e9,)), (end - start, ord_, name))
    out = graph.enclosing(spark.createDataFrame(points, "pid long, file string, line int"), spark.createDataFrame(spans, "file string, name string, start int, end int, ord int"))
    assert sorted(tuple(r) for r in out.collect()) == sorted((pid, best[-1]) for pid, best in want.items())


def test_rows_of_enclosing_grow_with_points_and_spans_not_their_product(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    points = spark.range(3000).select(F.col("id").alias("pid"), F.lit("a.py").alias("file"), (F.col("id") % 50).cast("int").alias("line"))
    spans = spark.range(3000).select(F.lit("a.py").alias("file"), F.concat(F.lit("s"), "id").alias("name"), (-F.col("id") % 40).cast("int").alias("start"), (F.col("id") % 90 + 10).cast("int").alias("end"), F.col("id").alias("ord"))
    assert graph.enclosing(points, spans).count() == 3000
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    made = 0
    runs = store.executionsList(before, 1000)
    for k in range(runs.size()):
        run = runs.apply(k)
        values, metrics = store.executionMetrics(run.executionId()), run.metrics()
        for m in (metrics.apply(j) for j in range(metrics.size())):
            if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                made = max(made, int(values.apply(m.accumulatorId()).replace(",", "")))
    assert 3000 <= made < 60_000


def test_included_requirements_and_their_order(spark):
    files = spark.createDataFrame([("requirements.txt", "-r req/base.txt\nz==1"), ("req/base.txt", "-r ../requirements.txt\na==1"), ("requirements-dev.txt", "b==2")], "path string, text string")
    got = {(r["root"], r["path"]) for r in manifests.with_includes(files).collect()}
    assert got == {("requirements.txt", "requirements.txt"), ("requirements.txt", "req/base.txt"), ("req/base.txt", "req/base.txt"), ("req/base.txt", "requirements.txt"), ("requirements-dev.txt", "requirements-dev.txt")}
    assert [(r["name"], r["ord"]) for r in manifests.collect(files).orderBy("ord").collect()] == [("a", 1), ("b", 2), ("z", 3)]


def test_withheld_evidence_is_read_from_the_source(spark):
    f = finding(spark, [{"engine": "semgrep", "title": "t", "file": "a.py", "line": 2, "extra": {"line_range": [2, 3]}}, {"engine": "semgrep", "title": "t", "file": "a.py", "line": 2, "evidence": "own"}])
    lines = spark.createDataFrame([("a.py", k, f" l{k} ") for k in range(1, 5)], "file string, line int, text string")
    assert [r["evidence"] for r in reports.snippets(f, lines).orderBy("fid").collect()] == ["l2 \n l3", "own"]


def test_saved_baselines_are_read_back(spark, tmp_path):
    f = finding(spark, [{"engine": "bandit", "title": f"t{k}", "file": "a.py", "line": k} for k in range(5)])
    report.write_baseline(f, f"{tmp_path}/base")
    want = {r["fingerprint"] for r in report.baseline_rows(f).collect()}
    by_file = spark.read.option("wholetext", "true").text(f"{tmp_path}/base").withColumnRenamed("value", "text")
    assert {tuple(r) for r in stored.baseline(by_file).collect()} == {(x, 2) for x in want} and len(want) == 5


@pytest.mark.parametrize(("rows", "badge"), [([(9.5, 1.0)], "Critical Risk"), ([(1.0, 71.0)], "Critical Risk"), ([(7.0, 1.0)], "High Risk"), ([(5.0, 2.0)], "Moderate Risk"), ([(1.0, 0.0)], "Low Risk"), ([], "Clean Security Status")])
def test_posture(spark, rows, badge):
    f = finding(spark, [{"engine": "bandit", "title": "t", "file": "a", "severity": s, "risk_score": r} for s, r in rows])
    assert report.posture(f).first()["badge"] == badge


def test_quotas_are_trimmed_and_topped_up():
    assert sets.quotas({"a": 97, "b": 1, "c": 1, "d": 1}, 5) == {"a": 2, "b": 1, "c": 1, "d": 1}
    assert sum(sets.quotas({f"s{k}": 50 for k in range(20)}, 50).values()) == 50 and sets.quotas({"a": 2}, 9) == {"a": 2}


def test_harmonic_sums(spark):
    cases = [(0, 1), (0, 64), (0, 500), (10, 3), (100, 7), (1000, 5000)]
    got = spark.createDataFrame(cases, "n long, m long").select("n", "m", evaluate.harmonic(F.col("n"), F.col("m")).alias("h")).collect()
    assert all(abs(r["h"] - sum(1 / j for j in range(r["n"] + 1, r["n"] + r["m"] + 1))) < 1e-10 for r in got)


def test_clusters_equal_a_plain_version(spark):
    rng = random.Random(4)
    rows = [{"engine": rng.choice(["bandit", "semgrep", "crypto", "secrets"]), "title": rng.choice(["md5 used", "sql text", "odd"]), "file": rng.choice(["a.py", "./a.py", "b.py"]), "line": rng.randint(1, 6), "cwe": rng.choice(["CWE-327", "CWE-328", "CWE-89", None]), "severity": float(rng.randint(1, 9)), "extra": {"suppressed": rng.random() < 0.2}} for _ in range(150)]
    rank = {"semgrep": 3, "bandit": 2, "secrets": 1}
    family = {"CWE-327": 1, "CWE-328": 1}
    clusters, want = [], {}
    for k, r in enumerate(rows):
        r = dict(r, fid=k, file=r["file"].removeprefix("./"), engines={r["engine"]}, off=r["extra"]["suppressed"], words={w for w in ("md5", "sql") if w in r["title"]})
        for c in clusters:
            lead = c["lead"]
            alike = (lead["cwe"] == r["cwe"] or (family.get(lead["cwe"], 0) == family.get(r["cwe"], 9))) if lead["cwe"] and r["cwe"] else bool(lead["words"] & r["words"])
            if lead["file"] == r["file"] and lead["line"] == r["line"] and not lead["engines"] & r["engines"] and alike:
                better = lead["off"] and not r["off"] if lead["off"] != r["off"] else (r["severity"], rank.get(r["engine"], 0)) > (lead["severity"], rank.get(lead["engine"], 0))
                c["lead"] = dict(r if better else lead, engines=lead["engines"] | r["engines"], severity=max(lead["severity"], r["severity"]), off=lead["off"] and r["off"])
                want[k] = c
                break
        else:
            clusters.append(c := {"id": k, "lead": r})
            want[k] = c
    f = finding(spark, rows)
    assert {r["fid"]: (r["cluster"], r["leader"]) for r in dedup.cluster(f).collect()} == {k: (c["id"], c["lead"]["fid"]) for k, c in want.items()}
    merged = {r["fid"]: r for r in dedup.deduplicate(f).collect()}
    assert {c["lead"]["fid"]: (c["lead"]["severity"], sorted(c["lead"]["engines"])) for c in clusters} == {k: (r["severity"], sorted(r["extra"]["corroborating_engines"] or [r["engine"]])) for k, r in merged.items()}
    assert all(len(r["extra"]["sources"]) == r["extra"]["sources_count"] for r in merged.values() if r["extra"]["sources_count"])


def test_selection_of_findings(spark):
    f = finding(spark, [
        {"engine": "bandit", "title": "B506: x", "file": "a.py", "line": 1, "ord": 0, "fix_hint": "Upgrade x from 1.0 to 10.0.1 or later.", "extra": {"test_id": "B506", "attack_path": ["in", "a\"b", "c"]}},
        {"engine": "crypto", "title": "md5", "file": "a.py", "line": 2, "extra": {"rule": "weak-hash-md5", "context": "password"}}, {"engine": "crypto", "title": "md5", "file": "a.py", "line": 3, "extra": {"rule": "weak-hash-md5", "context": "general"}},
        {"engine": "semgrep", "title": "Semgrep unsafe-load: y", "file": "b.py", "line": 4}, {"engine": "secrets", "title": "s", "file": "b.py", "line": 5}, {"engine": "secrets", "title": "s", "file": "b.txt"},
    ])
    e = F.col("extra")
    got = f.select("fid", selection.patcher(F.col("engine"), F.col("title"), e).alias("p"), selection.target_version(F.col("fix_hint")).alias("v"), selection.rule_name(F.col("title"), e).alias("n")).orderBy("fid").collect()
    assert [r["p"] for r in got] == ["B506", None, "B303", "B506", None, None] and got[0]["v"] == "10.0.1" and got[1]["v"] is None and got[3]["n"] == "Semgrep unsafe-load"
    assert [tuple(r) for r in selection.not_automated(f).collect()] == [("secrets", 2), ("crypto weak-hash-md5", 1)]
    assert [r["line"] for r in selection.fixable_secrets(f).collect()] == [5]
    assert {r["fid"] for r in selection.uncovered(f, spark.createDataFrame([("a.py", 1, 2)], "file string, line int, end_line int")).collect()} == {2, 3, 4, 5}
    assert [r["edge"] for r in selection.attack_paths(f).orderBy("at").collect()] == ['E0_0["in"] --> E0_1["a\'b"]', 'E0_1["a\'b"] --> E0_2["c"]']


def test_scan_with_the_code_graph(spark, code):
    rows, *tables = code
    f = finding(spark, [{"engine": "bandit", "title": "t", "file": "./svc/core.py", "line": 4, "severity": 8.0}])
    env = spark.range(1).select(F.lit(False).alias("is_linux"), F.lit(False).alias("is_wsgi_only"), F.lit(False).alias("has_proxy"))
    penalties = spark.createDataFrame([("svc/core.py", 0.35)], "file string, penalty double")
    out = pipeline.scan([f], spark.createDataFrame([], "fingerprint string"), spark.createDataFrame([], "file string, line int, text string"), env, code_graph=tuple(tables), penalties=penalties).first()
    assert (out["reachable"], out["exposure"], out["blast_radius"], out["code_health_penalty"]) == (True, "HTTP", 1, 0.35) and out["risk_score"] > 0
