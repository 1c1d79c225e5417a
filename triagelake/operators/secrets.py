"""Secrets: found in lines by formats and names, and moved from Python files to environment variables.

No value ever stands in a result but in ``new_text`` and ``diff`` of the patched
files; everything else carries digests and masked values.
"""

from __future__ import annotations

import ast
import difflib
import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import PLACEHOLDER, label_path, mask
from .patch import _Places, unsafe_path
from .scratch import keep

#: Formats of well-known providers' credentials.
FORMATS = {
    "aws-access-key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github-token": r"\bgh[pousr]_[A-Za-z0-9]{36}\b",
    "gitlab-token": r"\bglpat-[A-Za-z0-9_-]{20}\b",
    "slack-token": r"\bxox[bp]-[A-Za-z0-9-]{10,200}",
    "stripe-key": r"\b[sr]k_(?:live|test)_[A-Za-z0-9]{16,200}",
    "private-key": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----",
}
#: A quoted value of 8 to 200 characters given to a name that says what it is.  Every repeat has a bound: long lines take linear time.
ASSIGNED = r"""(?i)([a-z0-9_]{0,40}(?:pass(?:word|wd|phrase)|pwd|secret|token|api_?key|credential|private_?key)[a-z0-9_]{0,40})["'\]]{0,2}[ \t]*[:=][ \t]*(?:"([^"\n]{8,200})"|'([^'\n]{8,200})')"""
#: Bits a character below which an assigned value is taken for a word.
LEAST_ENTROPY = 2.5
NOTE = "set this variable before running, and rotate the secret: it is valid still and stays in the history"
RECORD = "file string, line int, status string, reason string, start int, end int, base string, digest string"
PATCHED = "file string, line int, status string, reason string, env_name string, original string, patched string, new_text string, diff string"


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 of an empty text."""
    n = F.length(text).cast("double")
    each = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.length(text) - F.length(F.replace(text, c, F.lit(""))))
    spread = F.aggregate(F.filter(each, lambda k: k > 0), F.lit(0.0), lambda a, k: a + k * F.log2(k.cast("double")))
    return F.when(n > 0, F.log2(n) - spread / n).otherwise(0.0)


def detect(lines: DataFrame) -> DataFrame:
    """The columns of ``lines`` but text, and rule, variable, masked, digest, entropy, is_provider_token for every secret.

    Column operations only.  A value of a provider's format counts once, as that;
    placeholders and values of low entropy are none.  Null lines hold none; a
    value twice on a line is two rows.
    """
    text = F.coalesce("text", F.lit(""))
    one = lambda rule, name, value, known: F.struct(F.lit(rule).alias("rule"), name.alias("variable"), value.alias("value"), F.lit(known).alias("is_provider_token"))
    none = F.lit(None).cast("string")
    of_format = lambda rule: lambda v: one(rule, none, v, True)
    formats = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), of_format(r)) for r, p in FORMATS.items()]
    part = lambda m, k: F.regexp_extract(m, ASSIGNED, k)
    named = F.transform(F.regexp_extract_all(text, F.lit(ASSIGNED), F.lit(0)), lambda m: one("assigned-secret", part(m, 1), F.concat(part(m, 2), part(m, 3)), False))
    rest = [c for c in lines.columns if c != "text"]
    rows = lines.select(*rest, F.explode(F.concat(*formats, named)).alias("s")).select(*rest, "s.*")
    rows = rows.withColumn("entropy", F.round(entropy(F.col("value")), 4))
    format_ = F.lit(False)
    for p in FORMATS.values():
        format_ = format_ | F.col("value").rlike(p)
    fine = F.col("is_provider_token") | (~format_ & ~F.col("value").rlike(PLACEHOLDER) & (F.col("entropy") >= LEAST_ENTROPY))
    return rows.where(fine).select(*rest, "rule", "variable", mask(F.col("value")).alias("masked"), F.sha2("value", 256).alias("digest"), "entropy", "is_provider_token")


def named_literals(tree: ast.AST) -> list[tuple[ast.Constant, str]]:
    """String constants of one line with the name they are given to: assignments, keyword arguments, members of dicts."""
    pairs: list[tuple[ast.AST | None, object]] = []
    for node in ast.walk(tree):
        match node:
            case ast.Assign(targets=targets, value=value):
                pairs += [(value, _name(t)) for t in targets]
            case ast.AnnAssign(target=target, value=value):
                pairs.append((value, _name(target)))
            case ast.keyword(arg=arg, value=value):
                pairs.append((value, arg))
            case ast.Dict(keys=keys, values=values):
                pairs += [(v, k.value) for k, v in zip(keys, values, strict=True) if isinstance(k, ast.Constant) and isinstance(k.value, str)]
    return [(v, str(name)) for v, name in pairs if name and isinstance(v, ast.Constant) and isinstance(v.value, str) and v.value and v.lineno == v.end_lineno]


def _name(target: ast.AST) -> object:
    match target:
        case ast.Name(id=name) | ast.Attribute(attr=name) | ast.Subscript(slice=ast.Constant(value=name)):
            return name
    return None


def import_place(text: str, tree: ast.Module) -> int | None:
    """Where ``import os`` goes: after the docstring and future imports, before decorators; null if it is there."""
    if any(isinstance(n, ast.Import) and any(a.name == "os" and a.asname is None for a in n.names) for n in tree.body):
        return None
    body = tree.body[1:] if ast.get_docstring(tree, clean=False) is not None else tree.body
    later = [n for n in body if not (isinstance(n, ast.ImportFrom) and n.module == "__future__")]
    if not later:
        return len(text)
    first = min([later[0].lineno, *(d.lineno for d in getattr(later[0], "decorator_list", []))])
    return _Places(text).starts[first - 1]


def secret_values(findings: DataFrame, files: DataFrame, least: int = 4) -> DataFrame:
    """(file, value) of the literals on the lines of ``findings``: what masking needs, never for a report."""

    def run(f: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(f) and len(t):
            try:
                found = named_literals(ast.parse(t["text"].iloc[0] or ""))
            except (SyntaxError, ValueError):
                found = []
            on = set(f["line"])
            rows = sorted({(f["file"].iloc[0], c.value) for c, _ in found if c.lineno in on and len(c.value) >= least})
        return pd.DataFrame(rows, columns=["file", "value"])

    asked = findings.where("line is not null").select(label_path(F.col("file")).alias("file"), "line").distinct()
    return asked.groupBy("file").cogroup(files.selectExpr("path as file", "text").groupBy("file")).applyInPandas(run, "file string, value string")


def mask_report(text: Column, values: Column) -> Column:
    """``text`` without any of ``values`` (an array), the longest first."""
    order = F.array_sort(values, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.aggregate(order, text, lambda t, v: F.when(v == "", t).otherwise(F.replace(t, v, F.lit("********"))))


def _locate(findings: DataFrame, files: DataFrame) -> DataFrame:
    """One row per finding (file, line, variable) with the place, name and digest of its literal, or why there is none."""

    def run(f: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        rows, taken = [], set()
        if len(f):
            path, bad, found = f["file"].iloc[0], ("", ""), []
            if unsafe_path(path) or not len(t):
                bad = ("path_traversal" if unsafe_path(path) else "file_not_found", "")
            else:
                text = t["text"].iloc[0] or ""
                try:
                    found, places = named_literals(ast.parse(text)), _Places(text)
                except (SyntaxError, ValueError) as e:
                    bad = ("syntax_error", f"the file does not parse: {type(e).__name__}")
            for line, want in sorted(set(zip(f["line"].fillna(0).astype(int), f["variable"].fillna(""), strict=True))):
                here = sorted((c for c in found if c[0].lineno == line), key=lambda c: (c[1].lower() != want.lower(), c[0].col_offset))
                here = [c for c in here if places.span(c[0]) not in taken]
                if bad[0] or not here:
                    rows.append((path, line, bad[0] or "pattern_not_found", bad[1] or "no named literal on the line", None, None, None, None))
                    continue
                span = places.span(here[0][0])
                taken.add(span)
                base = re.sub(r"[^A-Za-z0-9]+", "_", here[0][1]).strip("_").upper() or "SECRET"
                rows.append((path, line, "applied", "", *span, base, hashlib.sha256(here[0][0].value.encode()).hexdigest()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")]).astype({"start": "Int32", "end": "Int32"})

    asked = findings.select(label_path(F.col("file")).alias("file"), "line", F.col("extra.variable").alias("variable"))
    return asked.groupBy("file").cogroup(files.selectExpr("path as file", "text").groupBy("file")).applyInPandas(run, RECORD)


def env_names(places: DataFrame) -> DataFrame:
    """(base, digest, env_name): a value has one variable a name, a further value of that name gets a number.

    Values are numbered in the order of file and, in a file, from its last line up.
    Where a number makes a name that another literal has by itself, digits of the
    digest follow, so that no variable stands for two values.
    """
    each = places.where("digest is not null").groupBy("base", "digest").agg(F.min(F.struct("file", -F.col("line"), "start")).alias("first"))
    nth = each.withColumn("nth", F.row_number().over(Window.partitionBy("base").orderBy("first", "digest")))
    made = nth.withColumn("made", F.when(F.col("nth") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), "nth")))
    own = nth.select(F.col("base").alias("made")).distinct().withColumn("clash", F.lit(True))
    joined = made.join(own, "made", "left")
    return joined.select("base", "digest", F.when((F.col("nth") > 1) & F.col("clash"), F.concat("made", F.lit("_"), F.upper(F.substring("digest", 1, 8)))).otherwise(F.col("made")).alias("env_name"))


def move_to_environment(findings: DataFrame, files: DataFrame) -> DataFrame:
    """A row per secret finding with what was done, and the file's new text and unified diff.

    ``findings``: finding rows (see ``selection.fixable_secrets``); ``files``: path,
    text.  ``original`` and ``patched`` are the line with the value masked.  A task
    holds one file.  A file whose new text does not parse is left as it was.
    """

    def run(e: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(e):
            edits, path, text, new, diff = e[e["status"] == "applied"], e["file"].iloc[0], "", None, None
            if len(edits):
                text = new = t["text"].iloc[0]
                for a, b, name in sorted(zip(edits["start"].astype(int), edits["end"].astype(int), edits["env_name"], strict=True), reverse=True):
                    new = new[:a] + f'os.environ["{name}"]' + new[b:]
                try:
                    at = import_place(new, ast.parse(new))
                    if at is not None:
                        gap = "" if at == 0 or new[at - 1] == "\n" else "\n"
                        new = new[:at] + gap + "import os" + ("\r\n" if "\r\n" in new else "\n") + new[at:]
                    ast.parse(new)
                    diff = "".join(x if x.endswith("\n") else x + "\n\\ No newline at end of file\n" for x in difflib.unified_diff(text.splitlines(keepends=True), new.splitlines(keepends=True), f"a/{path}", f"b/{path}"))
                except SyntaxError:
                    new = None
            for r in e.itertuples():
                if r.status == "applied" and new is not None:
                    a, b = int(r.start), int(r.end)
                    low, high = text.rfind("\n", 0, a) + 1, text.find("\n", b)
                    line = text[low : high if high >= 0 else None].rstrip("\r")
                    # Every edited literal of the line is masked, a neighbour's too.
                    spans = sorted((int(x.start), int(x.end), x.env_name) for x in edits.itertuples() if low <= int(x.start) and int(x.end) <= low + len(line))
                    before = after = line
                    for x, y, name in reversed(spans):
                        before = before[: x - low] + "'********'" + before[y - low :]
                        after = after[: x - low] + f'os.environ["{name}"]' + after[y - low :]
                    rows.append((path, r.line, "applied", f"{r.env_name}: {NOTE}", r.env_name, before, after, new, diff))
                else:
                    left = r.status != "applied"
                    rows.append((path, r.line, r.status if left else "syntax_error", r.reason if left else "the patched file would not parse", None, "", "", None, None))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PATCHED.split(", ")])

    places = keep(_locate(findings, files), "secret-places")
    named = places.join(env_names(places), ["base", "digest"], "left")
    return named.groupBy("file").cogroup(files.selectExpr("path as file", "text").groupBy("file")).applyInPandas(run, PATCHED)


def example_lines(done: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(env_name, line) to add to ``.env.example``; ``existing``: its lines as (text)."""
    names = done.where("env_name is not null").select("env_name").distinct()
    if existing is not None:
        names = names.join(existing.select(F.trim(F.substring_index("text", "=", 1)).alias("env_name")), "env_name", "left_anti")
    return names.select("env_name", F.concat("env_name", F.lit("=")).alias("line")).orderBy("env_name")
