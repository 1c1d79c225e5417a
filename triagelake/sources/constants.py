"""What source code says of two kinds of findings: SQL built from constants only, and hashes of sensitive data.

Both are decided per file in a worker that parses it once; whatever can't be
resolved counts against the code (not constant, sensitive by its words).
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import label_path
from ..operators.fp import SENSITIVE_COMPOUNDS, SENSITIVE_WORDS, SQL_KEYWORDS

#: Methods that run SQL, methods that keep a constant constant, names of what comes from outside.
RUNS_SQL = {"execute", "executemany", "execute_sql", "raw", "cursor_execute"}
KEEPS = {"lower", "upper", "strip", "lstrip", "rstrip"}
OUTSIDE = {"request", "req", "params", "args", "query", "json", "data", "headers", "cookies", "flask", "django"}
SQL_WORDS = re.compile(rf"(?<![a-z])({'|'.join(SQL_KEYWORDS)})(?![a-z])", re.I)
LOGS = re.compile(r"^(print|log|logger|logging|debug|info|warning|warn|error|critical|exception)$", re.I)
#: Lines around a finding in which its statement is sought.
NEAR = 6


class Constants:
    """Which expressions of a file have values that the file itself writes down."""

    def __init__(self, tree: ast.AST) -> None:
        self.tree = tree
        self.bound: dict[str, list[tuple[int, ast.AST]]] = defaultdict(list)
        self.lists: dict[str, list[ast.AST]] = {}
        for node in ast.walk(tree):
            match node:
                case ast.Assign(targets=targets, value=value):
                    for name in {n.id for t in targets for n in ast.walk(t) if isinstance(n, ast.Name)}:
                        self.bound[name].append((node.lineno, node))
                    if isinstance(value, ast.List | ast.Tuple):
                        self.lists.update({t.id: value.elts for t in targets if isinstance(t, ast.Name)})
                case ast.AnnAssign(target=ast.Name(id=name)):
                    self.bound[name].append((node.lineno, node))
                case ast.For(target=target):
                    for name in {n.id for n in ast.walk(target) if isinstance(n, ast.Name)}:
                        self.bound[name].append((node.lineno, node))
        for found in self.bound.values():
            found.sort(key=lambda b: b[0])

    def holds(self, expr: ast.AST | None, line: int, seen: frozenset[str] = frozenset()) -> bool:
        """Whether ``expr``, used on ``line``, is made of constants."""
        every = lambda parts: all(self.holds(p, line, seen) for p in parts)
        match expr:
            case ast.Constant():
                return True
            case ast.JoinedStr(values=values):
                return every([v.value for v in values if isinstance(v, ast.FormattedValue)])
            case ast.BinOp(left=left, op=ast.Add(), right=right):
                return every([left, right])
            case ast.BinOp(op=ast.Mod(), right=right):
                return every([right])
            case ast.Call(func=ast.Attribute(value=owner, attr="format"), args=args, keywords=keywords):
                return every([owner, *args, *(k.value for k in keywords)])
            case ast.Call(func=ast.Attribute(value=owner, attr="get"), args=args):
                return every([owner, *args[1:2]])
            case ast.Call(func=ast.Attribute(value=owner, attr=method)) if method in KEEPS:
                return self.holds(owner, line, seen)
            case ast.Attribute(attr=last):
                names = _chain(expr)
                if names is None or OUTSIDE & {n.lower() for n in names}:
                    return False
                # Constants of a class or an enumeration.
                return names[0].isupper() or names[0].endswith("Enum") or (names[0][0].isupper() and last.isupper())
            case ast.Subscript(value=ast.Dict() | ast.List() | ast.Tuple() as whole):
                return _flat(whole)
            case ast.Subscript(value=ast.Name(id=name)):
                return self.variable(name, line, seen, whole=True)
            case ast.List(elts=parts) | ast.Tuple(elts=parts) | ast.Set(elts=parts) | ast.Dict(values=parts):
                return every(parts)
            case ast.Name(id=name):
                return self.variable(name, line, seen)
        return False

    def variable(self, name: str, line: int, seen: frozenset[str], whole: bool = False) -> bool:
        """The same of a variable by its last binding up to ``line``, else its first assignment; parameters and imports have none.

        ``whole``: its members are used, so that it must be a container of constants.
        """
        found = self.bound.get(name, [])
        before = bisect_right(found, line, key=lambda b: b[0])
        later = next((b for b in found if isinstance(b[1], ast.Assign)), None)
        if name in seen or not (before or later):
            return False
        at, node = found[before - 1] if before else later
        match node:
            case ast.For(target=target, iter=over):
                items = over.elts if isinstance(over, ast.List | ast.Tuple) else self.lists.get(over.id) if isinstance(over, ast.Name) else None
                if not items:
                    return False
                if isinstance(target, ast.Name):
                    return all(isinstance(i, ast.Constant) for i in items)
                place = next((k for k, t in enumerate(getattr(target, "elts", [])) if isinstance(t, ast.Name) and t.id == name), None)
                return place is not None and all(isinstance(i, ast.List | ast.Tuple) and place < len(i.elts) and isinstance(i.elts[place], ast.Constant) for i in items)
            case ast.Assign(value=value) if whole:
                return _flat(value)
            case ast.Assign(value=value) | ast.AnnAssign(value=value):
                return value is not None and self.holds(value, at, seen | {name})
        return False

    def statement(self, line: int) -> ast.AST | None:
        """The SQL nearest to ``line``: what a call runs, else an expression that builds text, those with SQL words first."""
        runs, built = [], []
        for node in ast.walk(self.tree):
            gap = abs(getattr(node, "lineno", 10**9) - line)
            if gap > NEAR:
                continue
            match node:
                case ast.Call(func=ast.Attribute(attr=method), args=[first, *_]) if method.lower() in RUNS_SQL:
                    runs.append((gap, first))
                case ast.JoinedStr() | ast.BinOp() | ast.Call() if not _is_log(node):
                    words = any(isinstance(n, ast.Constant) and isinstance(n.value, str) and SQL_WORDS.search(n.value) for n in ast.walk(node))
                    built.append((gap if words else gap + 10, node))
        return min(runs or built, key=lambda x: x[0], default=(0, None))[1]


def _chain(expr: ast.AST) -> list[str] | None:
    """The names of a.b.c from its root on; none if the root is no name."""
    names: list[str] = []
    while isinstance(expr, ast.Attribute):
        names.append(expr.attr)
        expr = expr.value
    return [expr.id, *reversed(names)] if isinstance(expr, ast.Name) else None


def _flat(value: ast.AST) -> bool:
    parts = value.values if isinstance(value, ast.Dict) else value.elts if isinstance(value, ast.List | ast.Tuple) else [None]
    return all(isinstance(p, ast.Constant) for p in parts)


def _is_log(node: ast.AST) -> bool:
    return isinstance(node, ast.Call) and bool(LOGS.match(node.func.attr if isinstance(node.func, ast.Attribute) else getattr(node.func, "id", "")))


def sql_is_constant(tree: ast.AST, line: int) -> bool:
    code = Constants(tree)
    found = code.statement(line)
    return found is not None and code.holds(found, line)


def is_sensitive_name(name: str) -> bool:
    words = [w for w in re.split(r"[_\W]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()) if w]
    return any(w in SENSITIVE_WORDS for w in words) or bool(re.search(SENSITIVE_COMPOUNDS, "".join(words)))


def _names(node: ast.AST) -> set[str]:
    return {n.id if isinstance(n, ast.Name) else n.attr for n in ast.walk(node) if isinstance(n, ast.Name | ast.Attribute)}


def hashes_sensitive_data(tree: ast.AST, line: int) -> bool:
    """Whether what a call on ``line`` takes is named like a credential, or got its value from what is.

    The enclosing function's name and parameters count, and two steps of assignments in it.
    """
    on = lambda n: n.lineno <= line <= (n.end_lineno or n.lineno)
    around = [n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef) and on(n)]
    scope = min(around, key=lambda n: n.end_lineno - n.lineno, default=None)
    tainted: set[str] = set()
    if scope is not None:
        a = scope.args
        tainted = {n for n in [scope.name, *(x.arg for x in a.posonlyargs + a.args + a.kwonlyargs)] if is_sensitive_name(n)}
    assigned = [n for n in ast.walk(scope or tree) if isinstance(n, ast.Assign)]
    for _ in range(2):
        for n in assigned:
            if any(x in tainted or is_sensitive_name(x) for x in _names(n.value)):
                tainted |= set().union(*map(_names, n.targets))
    used = set().union(*(_names(x) for n in ast.walk(tree) if isinstance(n, ast.Call) and on(n) for x in [*n.args, *(k.value for k in n.keywords)]))
    return bool(used & tainted) or any(map(is_sensitive_name, used | tainted))


def judged(findings: DataFrame, files: DataFrame) -> DataFrame:
    """(fid, sql_constant, hash_sensitive) of the findings with a line; ``files``: path, text.  A task holds one file.

    Where the file is missing or does not parse, the evidence stands for it.
    """

    def run(f: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        rows = []
        try:
            whole = ast.parse(t["text"].iloc[0] or "") if len(f) and len(t) else None
        except (SyntaxError, ValueError):
            whole = None
        for fid, line, evidence in zip(f["fid"], f["line"], f["evidence"].fillna(""), strict=True):
            tree, at = whole, int(line)
            if tree is None:
                try:
                    tree, at = ast.parse(evidence.strip()), 1
                except (SyntaxError, ValueError):
                    tree = None
            words = any(map(is_sensitive_name, re.findall(r"[A-Za-z_][A-Za-z0-9_]*", evidence)))
            rows.append((fid, tree is not None and bool(tree.body) and sql_is_constant(tree, at), hashes_sensitive_data(whole, at) if whole is not None else words))
        return pd.DataFrame(rows, columns=["fid", "sql_constant", "hash_sensitive"])

    asked = findings.where("line is not null").select("fid", label_path(F.col("file")).alias("file"), "line", "evidence")
    return asked.groupBy("file").cogroup(files.selectExpr("path as file", "text").groupBy("file")).applyInPandas(run, "fid long, sql_constant boolean, hash_sensitive boolean")
