"""Facts of Python files: each is parsed once, in a worker; everything after it is joins."""

from __future__ import annotations

import ast
import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import tables as T
from ..functions.columns import is_test_path, strings
from ..operators import crypto

FACT = "file string, kind string, name string, scope string, line int, end int, detail string, value double"

#: Settings whose strings name imported packages, bases of command classes and of class-based views, words of long-running files.
APP_SETTINGS = ("INSTALLED_APPS", "MIDDLEWARE", "MIDDLEWARE_CLASSES")
COMMAND_BASES = ("BaseCommand", "NoArgsCommand", "LabelCommand", "AppCommand")
VIEW_BASES = ("View", "APIView", "ViewSet")
WORKER_FILES = ("worker", "daemon", "engine", "consumer", "cron")


def constant(node: ast.AST | None, known: dict[str, ast.Constant] | None = None) -> dict[str, str] | None:
    """The type and text of a constant, or of a name that was given one; null for all else."""
    if isinstance(node, ast.Name) and known:
        node = known.get(node.id)
    if not isinstance(node, ast.Constant) or node.value is None:
        return None
    return {"y": type(node.value).__name__, "v": str(node.value)[:200]}


def names_in(nodes: list[ast.AST]) -> list[str]:
    """Names and attributes used in some expressions."""
    return [n.id if isinstance(n, ast.Name) else n.attr for top in nodes for n in ast.walk(top) if isinstance(n, (ast.Name, ast.Attribute))]


def _dotted(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else ".".join(reversed(parts))


class _Walk(ast.NodeVisitor):
    """Collects facts of one file; what they mean is decided later, in columns."""

    def __init__(self, file: str, text: str) -> None:
        self.file, self.lines, self.rows, self.scope, self.alias = file, text.splitlines(), [], [], {}
        self.types: dict[str, str] = {}
        self.known: dict[str, ast.Constant] = {}
        self.targets: list[str] = []
        self.value: ast.AST | None = None
        self.called: set[int] = set()
        self.command = False
        self.depth = self.deepest = self.bare = self.long = 0

    def add(self, kind: str, name: str, node: ast.AST, detail: object = "", value: float = 0.0) -> None:
        line = getattr(node, "lineno", 1)
        text = detail if isinstance(detail, str) else json.dumps(detail)
        self.rows.append((self.file, kind, name, ".".join(self.scope), line, getattr(node, "end_lineno", line), text, float(value)))

    def source(self, node: ast.AST) -> str:
        return self.lines[node.lineno - 1].strip()[:160] if 0 < getattr(node, "lineno", 0) <= len(self.lines) else ""

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.alias[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
            self.add("import", a.name, node)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        base = node.module or ""
        if node.level:
            folder = self.file.split("/")[: -node.level]
            base = ".".join([*folder, *([base] if base else [])])
        for a in node.names:
            self.alias[a.asname or a.name] = f"{base}.{a.name}"
            self.add("import", base, node, a.name)
            if self.file.endswith("__init__.py") and node.level:
                self.add("export", a.asname or a.name, node, f"{base}.{a.name}")

    def _full(self, node: ast.AST) -> str:
        name = _dotted(node)
        head, _, rest = name.partition(".")
        if rest and head in self.types:
            return f"{self.types[head]}.{rest}"
        return self.alias.get(head, head) + ("." + rest if rest else "")

    def _function(self, node: ast.FunctionDef) -> None:
        first = (node.args.posonlyargs + node.args.args)[:1]
        self.add("function", node.name, node, {"first": first[0].arg if first else "", "command": self.command})
        if (node.end_lineno or node.lineno) - node.lineno > 80:
            self.long += 1
        for k, d in enumerate(node.decorator_list):
            call = d if isinstance(d, ast.Call) else None
            named = call.func if call else d
            receiver = getattr(getattr(named, "value", None), "id", "")
            text = f"{receiver}.{named.attr}" if isinstance(named, ast.Attribute) else getattr(named, "id", "")
            route = constant(call.args[0]) if call and call.args else None
            self.add("decorator", node.name, node, {"text": text.lower(), "method": named.attr.upper() if call and isinstance(named, ast.Attribute) else "", "route": route["v"] if route and route["y"] == "str" else ""}, k)
        self.scope.append(node.name)
        for part in [*node.args.defaults, *(d for d in node.args.kw_defaults if d), *(a.annotation for a in [*node.args.args, *node.args.kwonlyargs] if a.annotation)]:
            for call in ast.walk(part):
                if isinstance(call, ast.Call) and _dotted(call.func).split(".")[-1] == "Depends" and call.args:
                    self.add("call", self._full(call.args[0]), call, {})
        outer, self.types = self.types, dict(self.types)
        self.generic_visit(node)
        self.types = outer
        self.scope.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        bases = [_dotted(b).split(".")[-1] for b in node.bases]
        self.add("class", node.name, node)
        if any(v in b for b in bases for v in VIEW_BASES):
            self.add("view", node.name, node)
        outer, self.command = self.command, any(b in COMMAND_BASES for b in bases)
        self.scope.append(node.name)
        self.generic_visit(node)
        self.scope.pop()
        self.command = outer

    def _nest(self, node: ast.AST) -> None:
        if isinstance(node, ast.If) and not self.scope and ast.unparse(node.test).replace('"', "'") in ("__name__ == '__main__'", "'__main__' == __name__"):
            framework = "worker" if any(w in self.file.lower() for w in WORKER_FILES) else "cli"
            ran = [_dotted(c.func) for c in ast.walk(node) if isinstance(c, ast.Call)]
            for name in [n for n in ran if n and n.count(".") < 2] or ["__main__"]:
                self.add("main", name, node, framework)
        self.depth += 1
        self.deepest = max(self.deepest, self.depth)
        self.generic_visit(node)
        self.depth -= 1

    visit_If = visit_For = visit_While = visit_Try = visit_AsyncFor = _nest

    def visit_ExceptHandler(self, node: ast.ExceptHandler) -> None:
        self.bare += node.type is None
        self.generic_visit(node)

    def _assigned(self, targets: list[ast.AST], value: ast.AST | None, node: ast.AST) -> None:
        names = [t.id for t in targets if isinstance(t, ast.Name)]
        for name in names:
            if isinstance(value, ast.Constant):
                self.known[name] = value
            if isinstance(value, ast.Call):
                self.types[name] = self._full(value.func)
            else:
                self.types.pop(name, None)
            if name in APP_SETTINGS and isinstance(value, (ast.List, ast.Tuple, ast.Set)):
                for e in value.elts:
                    if isinstance(e, ast.Constant) and isinstance(e.value, str):
                        self.add("app", e.value.lower().strip(), node)
            if name == "__all__" and isinstance(value, (ast.List, ast.Tuple)):
                for e in value.elts:
                    if isinstance(e, ast.Constant) and isinstance(e.value, str):
                        self.add("export", e.value, node)
        outer, self.targets = self.targets, names
        self.value = value if isinstance(node, ast.Assign) else None
        self.generic_visit(node)
        self.targets = outer

    def visit_Assign(self, node: ast.Assign) -> None:
        self._assigned(node.targets, node.value, node)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self._assigned([node.target], node.value, node)

    def visit_Call(self, node: ast.Call) -> None:
        self.called.add(id(node.func))
        given = {k.arg: constant(k.value, self.known) for k in node.keywords if k.arg}
        self.add("call", self._full(node.func), node, {
            "t": self.targets, "i": names_in([*node.args, *(k.value for k in node.keywords if k.arg != "usedforsecurity")]),
            "a": constant(node.args[0], self.known) if node.args else None, "k": {k: v for k, v in given.items() if v}, "s": self.source(node), "n": node is self.value,
        })
        for k in node.keywords:
            if k.arg in ("target", "func", "callback") and isinstance(k.value, (ast.Name, ast.Attribute)):
                self.called.add(id(k.value))
                self.add("call", self._full(k.value), node, {})
        self.generic_visit(node)

    def visit_Attribute(self, node: ast.Attribute) -> None:
        name = self._full(node)
        if node.attr == "MODE_ECB" or name.startswith("ssl."):
            self.add("attribute", name, node, {"s": self.source(node)})
        self._used(node, name)
        self.generic_visit(node)

    def visit_Name(self, node: ast.Name) -> None:
        self._used(node, self._full(node))

    def _used(self, node: ast.AST, name: str) -> None:
        """A name read other than to call it may be a function that is handed on."""
        if isinstance(getattr(node, "ctx", None), ast.Load) and id(node) not in self.called:
            self.add("reference", name, node)


def facts(files: DataFrame) -> DataFrame:
    """Tagged rows of every (path, text) file: functions, decorators, classes, imports, calls with their arguments, references, health; or one error row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"], strict=True):
                text = text or ""
                loc = len(text.splitlines())
                rows.append((path, "sha256", hashlib.sha256(text.encode()).hexdigest(), "", 1, loc, "", float(loc)))
                try:
                    walk = _Walk(path, text)
                    walk.visit(ast.parse(text))
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append((path, "error", type(e).__name__, "", 1, loc, str(e)[:200], 0.0))
                    continue
                rows += walk.rows
                rows += [(path, "health", n, "", 1, loc, "", float(v)) for n, v in (("max_nesting", walk.deepest), ("bare_excepts", walk.bare), ("long_functions", walk.long))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FACT.split(", ")])

    return files.select("path", "text").mapInPandas(run, FACT)


def health_features(rows: DataFrame) -> DataFrame:
    """(file, loc, max_nesting, bare_excepts, long_functions)."""
    of = lambda n: F.coalesce(F.max(F.when((F.col("kind") == "health") & (F.col("name") == n), F.col("value"))), F.lit(0.0)).cast("int").alias(n)
    return rows.groupBy("file").agg(F.max(F.when(F.col("kind") == "sha256", F.col("value"))).cast("int").alias("loc"), of("max_nesting"), of("bare_excepts"), of("long_functions"))


def entry_framework(decorator: Column) -> Column:
    """What a decorator (lower case, its receiver before the dot) makes of its function; null if nothing."""
    holds = lambda words: F.exists(strings(words), lambda w: F.contains(decorator, w))
    return (
        F.when(holds(T.STARTUP_DECORATORS), "startup").when(holds(T.WEB_DECORATORS), "web").when(holds(T.CLI_DECORATORS), "cli")
        .when(holds(T.TASK_DECORATORS) | F.endswith(decorator, F.lit(".task")) | (decorator == "receiver") | F.endswith(decorator, F.lit(".receiver")), "worker")
    )


def entry_points(rows: DataFrame) -> DataFrame:
    """(node_id, framework, label): functions that a framework calls, by their first decorator that says so, else by where they stand; and main blocks."""
    node = F.concat("file", F.lit("::"), F.when(F.col("scope") == "", F.col("name")).otherwise(F.concat_ws(".", "scope", "name")))
    d = lambda k: F.get_json_object("detail", f"$.{k}")
    marked = rows.where("kind = 'decorator'").select(node.alias("node_id"), F.col("value").alias("nth"), entry_framework(d("text")).alias("framework"), d("method").alias("method"), d("route").alias("route")).where("framework is not null")
    label = F.concat_ws(" ", F.upper("r.framework"), F.when(F.col("r.method").isin(*T.HTTP_METHODS), F.col("r.method")), F.coalesce(F.nullif("r.route", F.lit("")), F.element_at(F.split("node_id", "::"), -1)))
    first = marked.groupBy("node_id").agg(F.min_by(F.struct("framework", "method", "route"), "nth").alias("r")).select("node_id", "r.framework", label.alias("label"))
    command = (d("command") == "true") & F.col("name").isin("handle", "handle_noargs")
    view = F.contains(F.lower("file"), F.lit("views")) & d("first").isin("request", "req")
    placed = rows.where("kind = 'function'").select(node.alias("node_id"), F.when(command, "cli").when(view, "web").alias("framework")).where("framework is not null").join(first, "node_id", "left_anti")
    placed = placed.select("node_id", "framework", F.concat_ws(" ", F.upper("framework"), F.element_at(F.split("node_id", "::"), -1)).alias("label"))
    main = rows.where("kind = 'main'").select(
        F.when(F.col("name") == "__main__", F.concat(F.lit("module::"), "file")).otherwise(F.concat("file", F.lit("::"), "name")).alias("node_id"), F.col("detail").alias("framework"), F.concat_ws(" ", F.upper("detail"), "file").alias("label")
    )
    return first.unionByName(placed).unionByName(main).distinct()


def graph_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, entrypoints): functions, modules and packages; calls, references and imports resolved by joins; frameworks of entry points.

    A call is resolved within its file first, then by module and name; a name
    imported from no file of the tree is a package, ``pkg::`` and its first part
    in lower case.  Names that a package's ``__init__`` hands on are followed once.
    """
    module = F.regexp_replace(F.regexp_replace(F.regexp_replace("file", r"\.py$", ""), r"/__init__$", ""), "/", ".")
    node = F.concat("file", F.lit("::"), F.when(F.col("scope") == "", F.col("name")).otherwise(F.concat_ws(".", "scope", "name")))
    functions = rows.where("kind = 'function'").select(node.alias("node_id"), F.lit("FUNCTION").alias("kind"), F.when(F.col("scope") == "", F.col("name")).otherwise(F.concat_ws(".", "scope", "name")).alias("label"), F.col("name").alias("last"), F.col("file").alias("file_path"), F.col("line").alias("line_number"), F.col("end").alias("end_line"), module.alias("module"))
    modules = rows.select("file").distinct().select(F.concat(F.lit("module::"), "file").alias("node_id"), F.lit("MODULE").alias("kind"), F.col("file").alias("label"), F.col("file").alias("last"), F.col("file").alias("file_path"), F.lit(1).alias("line_number"), F.lit(None).cast("int").alias("end_line"), module.alias("module"))
    known = modules.select(F.col("node_id").alias("module_id"), "module")
    owner = F.when(F.col("scope") == "", F.concat(F.lit("module::"), "file")).otherwise(F.concat("file", F.lit("::"), "scope"))
    here = F.concat(F.lit("module::"), "file")
    last = F.element_at(F.split("name", r"\."), -1)
    uses = rows.where("kind in ('call', 'reference') and name <> ''").select(owner.alias("source_id"), "file", "name", last.alias("last"), F.when(F.col("kind") == "call", "CALLS").otherwise("REFERENCES").alias("edge")).distinct()
    own = functions.select(F.col("node_id").alias("target_id"), F.col("file_path").alias("file"), "label", "last")
    local = uses.join(own, ["file", "last"]).where((F.col("name") == F.col("label")) | (F.col("name") == F.concat(F.lit("self."), F.col("last"))) | (F.col("name") == F.concat(F.lit("cls."), F.col("last"))))
    exports = rows.where("kind = 'export' and detail <> ''").select(F.concat(module, F.lit("."), F.col("name")).alias("name"), F.col("detail").alias("real"))
    named = functions.select(F.col("node_id").alias("target_id"), F.concat("module", F.lit("."), "label").alias("name"))
    handed_on = exports.join(named.withColumnRenamed("name", "real"), "real").select("target_id", "name")
    edge = lambda df: df.select("source_id", "target_id", F.col("edge").alias("kind"))
    far = uses.join(named.unionByName(handed_on), "name")
    contains = functions.select(F.concat(F.lit("module::"), "file_path").alias("source_id"), F.col("node_id").alias("target_id"), F.lit("CONTAINS").alias("kind"))
    exposed = exports.join(named.withColumnRenamed("name", "real"), "real").join(modules.select("module", F.col("node_id").alias("source_id")), F.startswith("name", F.concat("module", F.lit("."))) & (F.regexp_replace("name", r"\.[^.]*$", "") == F.col("module")))
    exposed = exposed.select("source_id", "target_id", F.lit("EXPORTS").alias("kind"))

    # Imports: a module of the tree, or else a package.
    brought = rows.where("kind = 'import' and name <> ''").select(here.alias("source_id"), "name", "detail").distinct()
    whole = F.when(F.col("detail") != "", F.concat_ws(".", "name", "detail")).otherwise(F.col("name"))
    inside = brought.withColumn("module", F.explode(F.array_distinct(F.array("name", whole)))).join(known, "module").select("source_id", F.col("module_id").alias("target_id"), F.lit("IMPORTS").alias("kind"), "name", "detail")
    outside = brought.join(inside.select("source_id", "name", "detail").distinct(), ["source_id", "name", "detail"], "left_anti")
    apps = rows.where("kind = 'app'").select(here.alias("source_id"), "name")
    package = lambda c: F.concat(F.lit("pkg::"), F.lower(c))
    top = lambda c: F.get(F.split(c, r"\."), 0)
    both = lambda df: df.withColumn("p", F.explode(F.array_distinct(F.array(package(top(F.col("name"))), package(F.col("name")))))).select("source_id", F.col("p").alias("target_id"), F.lit("IMPORTS").alias("kind"))
    imports = both(outside.select("source_id", "name")).unionByName(both(apps))
    # A call through an imported name reaches its package.
    heads = outside.select(F.regexp_replace("source_id", "^module::", "").alias("file"), F.col("name").alias("head")).distinct()
    outer = uses.where("edge = 'CALLS'").withColumn("top", top(F.col("name"))).join(heads.withColumn("top", top(F.col("head"))), ["file", "top"]).select("source_id", package(F.col("top")).alias("target_id"), F.col("edge").alias("kind"))

    edges = edge(local).unionByName(edge(far)).unionByName(contains).unionByName(exposed).unionByName(inside.select("source_id", "target_id", "kind")).unionByName(imports).unionByName(outer).distinct()
    packages = edges.where(F.startswith("target_id", F.lit("pkg::"))).select(F.col("target_id").alias("node_id")).distinct()
    packages = packages.select("node_id", F.lit("PACKAGE").alias("kind"), F.substring_index("node_id", "::", -1).alias("label"), F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("int").alias("line_number"), F.lit(None).cast("int").alias("end_line"))
    views = rows.where("kind = 'view'").select(F.concat(F.lit("entrypoint::view::"), node).alias("node_id"), F.lit("ENTRYPOINT").alias("kind"), F.concat(F.lit("VIEW "), F.col("name")).alias("label"), F.col("file").alias("file_path"), F.col("line").alias("line_number"), F.col("end").alias("end_line"))
    nodes = functions.drop("module", "last").unionByName(modules.drop("module", "last")).unionByName(packages).unionByName(views)
    nodes = nodes.withColumn("is_test", F.coalesce(is_test_path(F.col("file_path")), F.lit(False)))
    return nodes, edges, entry_points(rows)


def weak_crypto(rows: DataFrame) -> DataFrame:
    """(file, line, rule, cwe, severity, exploitability, evidence, context): see :mod:`..operators.crypto`."""
    return crypto.weaknesses(rows)


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """(file, change: added, removed or modified) from two (file, sha256) tables."""
    both = now.select("file", F.col("sha256").alias("a")).join(before.select("file", F.col("sha256").alias("b")), "file", "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("file", F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("modified").alias("change"))
