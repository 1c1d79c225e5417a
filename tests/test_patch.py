import pytest

from triagelake.operators.patch import apply_patches, patch_text, unsafe_path


@pytest.mark.parametrize(("rule", "before", "after"), [
    ("B201", "app.run(debug=True)", "app.run(debug=False)"), ("B113", "requests.get(u, x=(1))", "requests.get(u, x=(1), timeout=10)"), ("B113", "requests.get()", "requests.get(timeout=10)"),
    ("B506", "d = yaml.load(f, Loader=yaml.Loader)", "d = yaml.safe_load(f)"), ("B303", "h = hashlib.md5(é)", "h = hashlib.sha256(é)"), ("B501", "é(); c.get(u, verify=False)", "é(); c.get(u, verify=True)"),
    ("B614", "torch.load(p,)", "torch.load(p, weights_only=True,)"), ("B701", "Environment(autoescape=False)", "Environment(autoescape=True)"), ("HTTP", "get('http://a.org/x')", "get('https://a.org/x')"),
])
def test_each_rule(rule, before, after):
    new, done = patch_text(before + "\n", [(1, rule)])
    assert new == after + "\n" and done[0][3] == "applied"


def test_what_is_left_alone():
    for rule, text in [("B113", "requests.get(u, timeout=1)"), ("B113", "requests.get(u, **k)"), ("HTTP", "get('http://localhost:1/')"), ("B201", "app.run()"), ("B999", "x()")]:
        assert patch_text(text, [(1, rule)])[0] == text
    assert patch_text("def (", [(1, "B201")])[1][0][3] == "syntax_error" and patch_text("x()", [(9, "B201")])[1][0][3] == "invalid_line"
    assert unsafe_path("/etc/x") and unsafe_path("a/../../b") and unsafe_path("C:\\x") and not unsafe_path("a/b.py")


def test_several_edits_in_one_file(spark):
    files = spark.createDataFrame([("a.py", "import yaml\nx = yaml.load(f)\napp.run(debug=True)")], "path string, text string")
    asks = spark.createDataFrame([("a.py", 2, "B506"), ("a.py", 2, "B506"), ("a.py", 3, "B201"), ("gone.py", 1, "B201"), ("../b.py", 1, "B201")], "file string, line int, rule string")
    got = {(r["file"], r["line"]): r for r in apply_patches(asks, files).collect()}
    assert len(got) == 4 and got["a.py", 2]["new_text"] == "import yaml\nx = yaml.safe_load(f)\napp.run(debug=False)"
    assert got["a.py", 3]["patched"] == "app.run(debug=False)" and "+app.run(debug=False)\n\\ No newline" in got["a.py", 3]["diff"]
    assert (got["gone.py", 1]["status"], got["../b.py", 1]["status"]) == ("file_not_found", "path_traversal")
