"""Mechanical code edits for findings, a file at a time in a worker.

A rule names the calls it applies to and one change to make in them.  Changes
become text replacements at the places the parser gives, applied from the end of
the file to its start, so that no replacement moves another.  A file whose
patched text no longer parses is left as it was.
"""

from __future__ import annotations

import ast
import difflib
import re

import pandas as pd
from pyspark.sql import DataFrame

#: Rule -> calls, change, tier.  A change sets a keyword from one
#: constant to another, adds one, renames the call, or keeps its first argument only.
RULES = {
    "B201": (r"(^|\.)run$", ("set", "debug", True, "False"), "mechanical"),
    "B113": (r"^(requests|session|self\.session)\.(get|post|put|delete|patch|head|options|request)$", ("add", "timeout", "10"), "needs_review"),
    "B506": (r"^yaml\.load$", ("first", "yaml.safe_load"), "needs_review"),
    "B303": (r"^hashlib\.(md5|sha1)$", ("rename", "hashlib.sha256"), "needs_review"),
    "B501": (r"", ("set", "verify", False, "True"), "needs_review"),
    "B614": (r"^torch\.load$", ("add", "weights_only", "True"), "needs_review"),
    "B701": (r"(^|\.)Environment$", ("set", "autoescape", False, "True"), "needs_review"),
    "HTTP": (r"", ("scheme",), "needs_review"),
}
#: Hosts that are not public.
LOCAL = re.compile(r"^(localhost|127\.|0\.0\.0\.0|\[?::1|10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|.*\.(local|internal|localdomain)$)", re.I)

RESULT = "file string, line int, rule string, tier string, status string, original string, patched string, reason string, new_text string, diff string"


class _Places:
    """Offsets in the text of the parser's lines and UTF-8 columns."""

    def __init__(self, text: str) -> None:
        self.lines = text.splitlines(keepends=True)
        self.starts = [0]
        for x in self.lines:
            self.starts.append(self.starts[-1] + len(x))

    def at(self, line: int, column: int) -> int:
        return self.starts[line - 1] + len(self.lines[line - 1].encode()[:column].decode())

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self.at(node.lineno, node.col_offset), self.at(node.end_lineno, node.end_col_offset)


def change(text: str, places: _Places, call: ast.Call, how: tuple) -> tuple[tuple[int, int, str] | None, str]:
    """(start, end, new text) of one change in a call, or why there is none."""
    keywords = {k.arg: k.value for k in call.keywords}
    match how:
        case ("set", name, old, new):
            value = keywords.get(name)
            if isinstance(value, ast.Constant) and value.value is old:
                return (*places.span(value), new), ""
            return None, f"{name}={old} not found in the call"
        case ("add", name, value):
            if name in keywords:
                return None, f"{name} is already given"
            if None in keywords:
                return None, f"**kwargs may give {name}"
            inside = [*call.args, *(k.value for k in call.keywords)]
            if not inside:
                end = places.span(call)[1] - 1
                return (end, end, f"{name}={value}"), ""
            # Right after the last argument (and its closing brackets), so that comments and trailing commas stay.
            end = places.span(max(inside, key=lambda n: (n.end_lineno, n.end_col_offset)))[1]
            stop = places.span(call)[1] - 1
            while end < stop and text[end] in ")":
                end += 1
            return (end, end, f", {name}={value}"), ""
        case ("rename", new):
            return (*places.span(call.func), new), ""
        case ("first", new):
            if not call.args:
                return None, "the call has no argument"
            a, b = places.span(call.args[0])
            return (*places.span(call), f"{new}({text[a:b]})"), ""
        case ("scheme",):
            why = "no http:// argument found"
            for v in [*call.args, *keywords.values()]:
                if isinstance(v, ast.Constant) and isinstance(v.value, str) and v.value.lower().startswith("http://"):
                    host = re.split(r"[/?]", v.value[7:], maxsplit=1)[0].rsplit("@", 1)[-1]
                    host = host if host.startswith("[") else host.split(":", 1)[0]
                    if LOCAL.match(host):
                        why = f"{host} is local or private"
                        continue
                    a, b = places.span(v)
                    at = text[a:b].lower().find("http://")
                    if at >= 0:
                        return (a + at, a + at + 7, "https://"), ""
            return None, why
    raise ValueError(how)


def patch_text(text: str, wanted: list[tuple[int, str]]) -> tuple[str, list[tuple[int, str, str, str, str]]]:
    """The patched text and (line, rule, tier, status, reason) for each wanted (line, rule)."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError) as e:
        return text, [(n, r, "", "syntax_error", str(e)[:200]) for n, r in wanted]
    places, edits, out = _Places(text), {}, []
    calls = [n for n in ast.walk(tree) if isinstance(n, ast.Call)]
    for line, rule in wanted:
        if rule not in RULES:
            out.append((line, rule, "", "not_auto_fixable", "no patcher for this rule"))
            continue
        name, how, tier = RULES[rule]
        if not 1 <= line <= len(places.lines):
            out.append((line, rule, tier, "invalid_line", "the file has no such line"))
            continue
        here = [c for c in calls if c.lineno <= line <= c.end_lineno and re.search(name, ast.unparse(c.func))]
        here.sort(key=lambda c: (c.lineno != line, c.end_lineno - c.lineno, c.lineno, c.col_offset))
        why = "no call of this kind on the line"
        for c in here:
            edit, why = change(text, places, c, how)
            if edit and not any(a < edit[1] and edit[0] < b or (a, b) == edit[:2] for a, b, _ in edits.values()):
                edits[line, rule] = edit
                break
        out.append((line, rule, tier, "applied" if (line, rule) in edits else "pattern_not_found", "" if (line, rule) in edits else why))
    new = text
    for a, b, t in sorted(edits.values(), reverse=True):
        new = new[:a] + t + new[b:]
    try:
        ast.parse(new)
    except SyntaxError as e:
        return text, [(n, r, t, "syntax_error" if s == "applied" else s, str(e)[:200]) for n, r, t, s, _ in out]
    return new, out


def unsafe_path(path: str) -> bool:
    """Absolute, on a drive, or climbing out of the folder."""
    p = path.replace("\\", "/")
    return p.startswith("/") or bool(re.match(r"^[A-Za-z]:", p)) or ".." in p.split("/")


def apply_patches(findings: DataFrame, files: DataFrame) -> DataFrame:
    """A row per distinct (file, line, rule) of ``findings`` with what was done, the new text and its unified diff.

    ``files``: path, text.  A task holds the findings and the text of one file at a time.
    """

    def run(f: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(f):
            return pd.DataFrame(columns=[c.split()[0] for c in RESULT.split(", ")])
        path = f["file"].iloc[0]
        wanted = list(dict.fromkeys((int(n), r) for n, r in zip(f["line"], f["rule"], strict=True)))
        if unsafe_path(path) or not len(t):
            status = "path_traversal" if unsafe_path(path) else "file_not_found"
            rows = [(path, n, r, "", status, "", "", "", None, None) for n, r in wanted]
        else:
            text = t["text"].iloc[0]
            new, done = patch_text(text, wanted)
            diff = "".join(x if x.endswith("\n") else x + "\n\\ No newline at end of file\n" for x in difflib.unified_diff(text.splitlines(keepends=True), new.splitlines(keepends=True), f"a/{path}", f"b/{path}"))
            line = lambda s, n: s.splitlines()[n - 1].strip() if 1 <= n <= len(s.splitlines()) else ""
            rows = [(path, n, r, tier, status, line(text, n), line(new, n) if status == "applied" else "", why, new, diff) for n, r, tier, status, why in done]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    asked = findings.select("file", "line", "rule").where("line is not null").distinct()
    texts = files.selectExpr("path as file", "text")
    return asked.groupBy("file").cogroup(texts.groupBy("file")).applyInPandas(run, RESULT)
