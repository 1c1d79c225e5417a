"""Reachability, shortest paths, blast radius and exposure on a code graph.

Graphs may have cycles, so each search is a loop of joins: the frontier meets
the edges, what was met before is taken off, and every level is written to the
shared folder.  Only counts come to the driver.  A search ends when nothing new
is met; where ``max_depth`` ends it sooner, it raises.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import tables as T
from ..functions.columns import is_test_path, lookup, package_name, posix
from .scratch import drop, keep


def merge_edges(edges: DataFrame, order: str = "seq") -> DataFrame:
    """One edge per ordered pair: the last kind, and whether any was an export or a reference."""
    return edges.groupBy("source_id", "target_id").agg(
        F.max_by("kind", order).alias("kind"),
        F.bool_or(F.col("kind") == "EXPORTS").alias("exported"), F.bool_or(F.col("kind") == "REFERENCES").alias("referenced"),
    )


def _deeper(depth: int, max_depth: int | None) -> None:
    if max_depth is not None and depth > max_depth:
        raise ValueError(f"paths of more than {max_depth} edges")


def _all(levels: list[DataFrame]) -> DataFrame:
    """The rows of all levels: one scan, however many there are."""
    first = levels[0]
    return first.sparkSession.read.schema(first.schema).parquet(*[level.triagelake_path for level in levels])


def distances(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """(start, node, hops) of every node that a path of at least one edge leads to, with the fewest hops.

    ``starts``: one column ``start``.  A start on a cycle is reached by itself only through the cycle.
    """
    e = keep(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct(), "edges")
    frontier = keep(starts.select("start").distinct().join(e, F.col("start") == F.col("src")).select("start", F.col("dst").alias("node")).distinct().withColumn("hops", F.lit(1)), "level-1")
    seen = [frontier]
    for depth in count(2):
        if frontier.isEmpty():
            break
        _deeper(depth - 1, max_depth)
        ahead = frontier.join(e, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        ahead = ahead.join(_all(seen).select("start", "node"), ["start", "node"], "left_anti")
        frontier = keep(ahead.withColumn("hops", F.lit(depth)), f"level-{depth}")
        seen.append(frontier)
    return _all(seen)


def shortest_paths(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, src: str = "src", dst: str = "dst", from_end: bool = False) -> DataFrame:
    """(start, node, path array): the shortest path, of equally short ones the least in order of nodes.

    With ``from_end`` paths are written, and compared, from the node to the start.
    """
    e = keep(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct(), "edges")
    frontier = keep(starts.select("start").distinct().withColumn("node", F.col("start")).withColumn("path", F.array("start")), "path-0")
    seen = [frontier]
    for depth in count(1):
        ahead = frontier.join(e, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), (F.array_prepend("path", F.col("dst")) if from_end else F.array_append("path", F.col("dst"))).alias("path"))
        ahead = ahead.groupBy("start", "node").agg(F.min("path").alias("path"))
        ahead = ahead.join(_all(seen).select("start", "node"), ["start", "node"], "left_anti")
        frontier = keep(ahead, f"path-{depth}")
        if frontier.isEmpty():
            break
        _deeper(depth, max_depth)
        seen.append(frontier)
    return _all(seen)


def blast_radius(edges: DataFrame, nodes: DataFrame, targets: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(target, blast_radius): functions outside tests with a path to the target."""
    back = edges.select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"))
    above = distances(back, targets.select(F.col("target").alias("start")), max_depth).where("node <> start")
    counted = above.join(nodes.where((F.col("kind") == "FUNCTION") & ~F.coalesce("is_test", F.lit(False))).select(F.col("node_id").alias("node")), "node", "left_semi")
    n = counted.groupBy("start").agg(F.countDistinct("node").alias("n"))
    return targets.select("target").distinct().join(n, F.col("target") == F.col("start"), "left").select("target", F.coalesce("n", F.lit(0)).alias("blast_radius"))


def entry_paths(edges: DataFrame, entrypoints: DataFrame, targets: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(target, entrypoint, framework, path): the best entry point of each target that one reaches.

    ``entrypoints``: node_id, framework (web, startup, worker, cli).  Best is the
    highest rank, then the shortest path, then the least path.
    """
    back = edges.select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"))
    # Only what leads to a target is searched; of equally short paths the least, read from the entry point on.
    paths = shortest_paths(back, targets.select(F.col("target").alias("start")), max_depth, from_end=True)
    hit = paths.select(F.col("start").alias("target"), F.col("node").alias("start"), "path").join(entrypoints.select(F.col("node_id").alias("start"), "framework").distinct(), "start").withColumnRenamed("target", "node")
    rank = F.coalesce(F.create_map(*[x for k, v in T.FRAMEWORK_RANK.items() for x in (F.lit(k), F.lit(v))])[F.col("framework")], F.lit(0))
    best = hit.groupBy("node").agg(F.min(F.struct((-rank).alias("rank"), F.size("path").alias("n"), "path", "start", "framework")).alias("b"))
    return best.select(F.col("node").alias("target"), F.col("b.start").alias("entrypoint"), "b.framework", "b.path")


def exposure_of(framework: Column) -> Column:
    return F.coalesce(F.create_map(*[x for k, v in T.FRAMEWORK_EXPOSURE.items() for x in (F.lit(k), F.lit(v))])[framework], F.lit("HTTP"))


def exposure_case(engine: Column, cwe: Column, in_graph: Column, framework: Column, is_test: Column, any_entry: Column, callers: Column, referenced: Column, in_tree: Column, in_history: Column, known_name: Column, component: Column) -> Column:
    """struct<reachable, exposure, fp>: the first rule that holds, for dependencies, secrets and code."""
    row = lambda reach, exposure, fp=None: F.struct(F.lit(reach).cast("boolean").alias("reachable"), (exposure if isinstance(exposure, Column) else F.lit(exposure)).alias("exposure"), F.lit(fp).cast("string").alias("fp"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    dependency = (
        F.when(~yes(in_graph) & yes(known_name), row(False, "DEAD", "HIGH"))
        .when(~yes(in_graph), row(None, "UNKNOWN"))
        .when(~F.coalesce(component, F.lit(True)), row(False, "DEAD", "HIGH"))
        .when(framework.isNotNull(), row(True, exposure_of(framework)))
        .when(yes(is_test), row(False, "TEST"))
        .otherwise(row(False, "INTNL"))
    )
    secret = F.when(yes(in_tree), row(None, "REPO")).when(yes(in_history), row(None, "HIST")).otherwise(row(None, "NONE"))
    code = (
        F.when(~yes(in_graph), row(None, "UNKNOWN"))
        .when(framework.isNotNull(), row(True, exposure_of(framework)))
        .when(yes(is_test), row(False, "TEST"))
        .when(~yes(any_entry), row(None, "UNKNOWN"))
        .when((F.coalesce(callers, F.lit(0)) == 0) & ~yes(referenced), row(False, "DEAD", "MEDIUM"))
        .otherwise(row(False, "INTNL", "MEDIUM"))
    )
    return F.when(engine == "dependency", dependency).when((engine == "secrets") | yes(cwe.isin("CWE-259", "CWE-798")), secret).otherwise(code)


def enclosing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(pid, name): the smallest span of the point's file around its line; ties to the earliest span.

    ``points``: pid, file, line.  ``spans``: file, name, start, end, ord.
    """
    # A span is cut into the aligned ranges of 2^level lines that make it up, two a level at most.  Each range keeps
    # the best of its spans, and a line meets one range a level: rows grow with points and spans, not with their product.
    long = lambda c: F.col(c).cast("bigint")
    own = spans.where("start <= end").select("file", long("start").alias("start"), (long("end") + 1).alias("past"), F.struct((long("end") - long("start")).alias("size"), "ord", "name").alias("best"))
    inside = own.withColumn("level", F.explode(F.expr("sequence(0, length(bin(past - start)) - 1)"))).select("file", "level", F.expr("-shiftright(-start, level)").alias("first"), F.expr("shiftright(past, level)").alias("after"), "best").where("first < after")
    ends = F.array(F.when(F.col("first").bitwiseAND(1) == 1, F.col("first")), F.when(F.col("after").bitwiseAND(1) == 1, F.col("after") - 1))
    ranges = inside.withColumn("at", F.explode(F.array_compact(ends))).groupBy("file", "level", "at").agg(F.min("best").alias("best"))
    ranges = keep(ranges, "span-ranges")
    lines = points.where("file is not null and line is not null").select("pid", "file", F.col("line").cast("bigint").alias("line"))
    asked = lines.select("file", "line").distinct().crossJoin(F.broadcast(ranges.select("level").distinct())).withColumn("at", F.expr("shiftright(line, level)"))
    around = keep(asked.join(ranges, ["file", "level", "at"]).groupBy("file", "line").agg(F.min("best").alias("best")), "span-lines")
    drop(ranges)
    # Rows of one pid are one point.
    return lines.join(around, ["file", "line"]).groupBy("pid").agg(F.min("best").alias("best")).select("pid", F.col("best.name").alias("name"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, kind, n): nodes and edges by kind."""
    count = lambda df, what: df.groupBy(F.coalesce("kind", F.lit("UNKNOWN")).alias("kind")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    return count(nodes, "node").unionByName(count(edges, "edge"))


def import_names(package: Column) -> Column:
    """array<string>: the names a distribution may be imported under, the surest first."""
    norm = package_name(F.trim(F.coalesce(package, F.lit(""))))
    table = F.coalesce(lookup(T.IMPORT_NAMES, norm), F.array().cast("array<string>"))
    return F.filter(F.array_distinct(F.concat(table, F.array(F.replace(norm, F.lit("-"), F.lit("_")), norm, F.lower(package)))), lambda n: n != "")


def import_name_known(package: Column) -> Column:
    """Whether those names are certain, so that a package nobody imports is unused."""
    norm = package_name(F.trim(F.coalesce(package, F.lit(""))))
    return norm.isin(*T.IMPORT_NAMES, *T.SIMPLE_NAMES) | F.replace(norm, F.lit("-"), F.lit("_")).isin(*T.SIMPLE_NAMES)


def package_nodes(packages: DataFrame, nodes: DataFrame, levels: int = 3) -> DataFrame:
    """(package, node_id, via): the graph's nodes of each package; of one that nobody imports, those of the first that brings it along.

    ``packages``: one column ``package``.  ``via`` is null for direct imports.
    """
    spark = packages.sparkSession
    brought = spark.createDataFrame([(c, p, k) for k, (p, cs) in enumerate(T.BROUGHT_ALONG.items()) for c in cs], "child string, parent string, nth int")
    known = nodes.where("kind = 'PACKAGE'").select("node_id").distinct()
    direct = lambda df: df.withColumn("node_id", F.explode(F.transform(import_names(F.col("at")), lambda n: F.concat(F.lit("pkg::"), n)))).join(known, "node_id", "left_semi")
    open_ = packages.select("package").where("package is not null").distinct().withColumn("at", package_name(F.trim("package"))).withColumn("order", F.array().cast("array<int>"))
    found = None
    for level in range(levels + 1):
        hit = keep(direct(open_.withColumn("at", F.when(F.lit(level == 0), F.col("package")).otherwise(F.col("at")))), "package-nodes")
        # Of several parents the first in order counts.
        best = hit.groupBy("package").agg(F.min(F.struct("order", "at")).alias("b")).select("package", F.col("b.at").alias("at"))
        mine = hit.join(best, ["package", "at"], "left_semi").select("package", "node_id", F.when(F.lit(level > 0), F.col("at")).alias("via")).distinct()
        found = mine if found is None else found.unionByName(mine)
        if level < levels:
            left = open_.join(best.select("package"), "package", "left_anti")
            open_ = keep(left.join(brought, package_name(F.col("at")) == F.col("child")).groupBy("package", F.col("parent").alias("at")).agg(F.min(F.array_append("order", F.col("nth"))).alias("order")), "package-parents")
    return found


def component_used(findings: DataFrame, component_map: DataFrame, nodes: DataFrame) -> DataFrame:
    """(fid, component): false where the advisory names components of the package none of which the graph holds; rows without any are absent.

    ``component_map``: package, keyword, component.
    """
    text = F.lower(F.concat_ws(" ", "title", "description"))
    asks = findings.select("fid", package_name(F.col("extra.package")).alias("package"), text.alias("text")).join(component_map.withColumn("package", package_name(F.col("package"))), "package")
    asks = asks.where(F.contains("text", F.lower("keyword"))).select("fid", F.lower("component").alias("c")).distinct()
    # A node is named by its last part after :: or a dot, so that the join is by equality.
    last = nodes.select(F.explode(F.array_distinct(F.array(F.substring_index("node_id", "::", -1), F.element_at(F.split("node_id", r"[.:]"), -1)))).alias("c")).distinct().withColumn("_is", F.lit(True))
    return asks.join(last, "c", "left").groupBy("fid").agg(F.coalesce(F.max("_is"), F.lit(False)).alias("component"))


def expose(findings: DataFrame, nodes: DataFrame, edges: DataFrame, entrypoints: DataFrame, component_map: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """Findings with reachable, exposure, blast_radius, package_imported and what goes with them, from the code graph.

    ``nodes``: node_id, kind, file_path, line_number, end_line, is_test; ``edges``
    and ``entrypoints`` as :func:`..sources.python_source.graph_tables` makes them.
    Dependencies stand at their packages, code at the function around its line
    (or its module), secrets at their file.  Paths are sought backwards, from the
    nodes that findings stand at, so that nothing else is searched.
    """
    f = keep(findings, "exposed-findings")
    file = F.regexp_replace(posix(F.col("file")), r"^(\./)+", "")
    spans = nodes.where("kind = 'FUNCTION'").select(F.col("file_path").alias("file"), F.col("node_id").alias("name"), F.col("line_number").alias("start"), F.coalesce("end_line", "line_number").alias("end"), F.col("line_number").alias("ord"))
    code = f.where("engine <> 'dependency'").select("fid", file.alias("file"), "line")
    inner = enclosing(code.select(F.col("fid").alias("pid"), "file", "line"), spans)
    module = nodes.where("kind = 'MODULE'").select(F.col("node_id").alias("module_id"))
    placed = code.join(inner, F.col("fid") == F.col("pid"), "left").withColumn("module_id", F.concat(F.lit("module::"), "file")).join(module.withColumn("_m", F.lit(True)), "module_id", "left")
    at_code = placed.select("fid", F.coalesce("name", F.when(F.col("_m"), F.col("module_id"))).alias("target"), F.lit(None).cast("string").alias("via"))
    packages = package_nodes(f.where("engine = 'dependency'").select(F.col("extra.package").alias("package")), nodes)
    at_dependency = f.where("engine = 'dependency'").select("fid", F.col("extra.package").alias("package")).join(packages, "package").select("fid", F.col("node_id").alias("target"), "via")
    at = keep(at_code.unionByName(at_dependency).where("target is not null"), "exposed-at")
    targets = at.select("target").distinct()
    paths = keep(entry_paths(edges, entrypoints, targets, max_depth), "exposed-paths")
    rank = F.coalesce(lookup(T.FRAMEWORK_RANK, F.col("framework")), F.lit(0))
    best = at.join(paths, "target", "left").groupBy("fid").agg(F.min(F.when(F.col("framework").isNotNull(), F.struct((-rank).alias("rank"), F.size("path").alias("n"), "path", "framework"))).alias("b"), F.max("via").alias("via"), F.lit(True).alias("in_graph"))

    back = distances(edges.select(F.col("target_id").alias("src"), F.col("source_id").alias("dst")), targets.select(F.col("target").alias("start")), max_depth).where("node <> start")
    above = back.join(nodes.where(~F.col("is_test")).select(F.col("node_id").alias("node"), "kind"), "node")
    blast = at.join(above, F.col("target") == F.col("start")).groupBy("fid").agg(F.count_distinct(F.when(F.col("kind") == "FUNCTION", F.col("node"))).alias("functions"), F.count_distinct(F.when(F.col("kind") != "ENTRYPOINT", F.col("node"))).alias("all_nodes"))
    near = edges.join(targets, F.col("target_id") == F.col("target")).join(nodes.select(F.col("node_id").alias("source_id"), F.col("is_test").alias("_t")), "source_id", "left")
    use = near.groupBy("target").agg(F.count_if((F.col("kind") == "CALLS") & ~F.coalesce("_t", F.lit(False))).alias("callers"), F.coalesce(F.bool_or(F.col("kind").isin("REFERENCES", "EXPORTS", "EXPOSES")), F.lit(False)).alias("referenced"))
    use = at.join(use, "target").groupBy("fid").agg(F.sum("callers").alias("callers"), F.max("referenced").alias("referenced"))
    any_entry = not entrypoints.isEmpty() or not nodes.where("kind = 'ENTRYPOINT'").isEmpty()

    rows = f.join(best, "fid", "left").join(blast, "fid", "left").join(use, "fid", "left")
    rows = rows.join(component_used(f.where("engine = 'dependency'"), component_map, nodes), "fid", "left") if component_map is not None else rows.withColumn("component", F.lit(None).cast("boolean"))
    e = F.col("extra")
    case = exposure_case(
        F.col("engine"), F.col("cwe"), F.col("in_graph"), F.col("b.framework"), is_test_path(file), F.lit(any_entry), F.col("callers"), F.col("referenced"),
        F.coalesce(e["in_working_tree"], F.lit(True)), e["in_history"], import_name_known(e["package"]), F.col("component"),
    )
    rows = rows.withColumn("case", case)
    dependency, secret = F.col("engine") == "dependency", F.col("case.exposure").isin("REPO", "HIST", "NONE")
    gone = dependency & (~F.coalesce("in_graph", F.lit(False)) | ~F.coalesce("component", F.lit(True)))
    radius = F.when(secret, F.when(F.col("case.exposure") == "REPO", 1).otherwise(0)).when(gone, 0).when(dependency, F.coalesce("all_nodes", F.lit(0))).when(F.col("in_graph"), F.coalesce("functions", F.lit(0))).otherwise(F.col("blast_radius"))
    fp = F.when(dependency & (F.col("case.fp") == "HIGH"), "HIGH").otherwise(F.coalesce("fp_likelihood", "case.fp"))
    unused = F.format_string("package '%s' is not imported in the codebase", F.lower(e["package"]))
    why = F.when(dependency & (F.col("case.fp") == "HIGH"), F.when(F.coalesce("in_graph", F.lit(False)), T.COMPONENT_UNUSED).otherwise(unused)).otherwise(F.col("fp_reason"))
    extra = e.withField("exposure", F.col("case.exposure")).withField("attack_path", F.coalesce("b.path", F.array().cast("array<string>"))).withField("transitive_via", F.col("via")).withField("fp_likelihood", fp).withField("fp_reason", why)
    new = {
        "reachable": F.col("case.reachable"), "exposure": F.col("case.exposure"), "blast_radius": radius.cast("bigint"), "fp_likelihood": fp, "fp_reason": why, "extra": extra,
        "package_imported": F.when(dependency, F.coalesce("in_graph", F.lit(False)) & F.col("via").isNull()).otherwise(F.col("package_imported")),
        "symbol_reachable": F.when(dependency & ~F.coalesce("component", F.lit(True)), F.lit(False)).otherwise(F.col("symbol_reachable")),
    }
    return rows.select(*[(new[c] if c in new else F.col(c)).alias(c) for c in findings.columns])


def describe_paths(paths: DataFrame, nodes: DataFrame, entrypoints: DataFrame | None = None) -> DataFrame:
    """``paths`` (with an array column ``path``) with ``steps``: each node's label and place; entry points and packages are named as such."""
    e = entrypoints.groupBy("node_id").agg(F.min("label").alias("entry")) if entrypoints is not None else nodes.select("node_id", F.lit(None).cast("string").alias("entry")).limit(0)
    known = nodes.select("node_id", "kind", "label", "file_path", "line_number").join(e, "node_id", "left")
    rows = keep(paths.withColumn("_row", F.monotonically_increasing_id()), "paths")
    each = rows.select("_row", F.posexplode("path").alias("k", "node_id")).join(known, "node_id", "left")
    place = F.coalesce(F.concat(F.lit(" ["), "file_path", F.lit(":"), F.col("line_number").cast("string"), F.lit("]")), F.lit(""))
    label = F.coalesce("label", "node_id")
    text = F.when((F.col("k") == 0) & F.col("entry").isNotNull(), F.concat(F.lit("Entrypoint: "), "entry", place)).when(F.col("kind") == "PACKAGE", F.concat(F.lit("Package: "), label)).otherwise(F.concat(label, place))
    steps = each.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", text.alias("t")))), lambda x: x["t"]).alias("steps"))
    return rows.join(steps, "_row", "left").drop("_row")


def fallback_blast(points: DataFrame, rows: DataFrame) -> DataFrame:
    """(pid, blast_radius) without a code graph: callers of callers of the function around a line, else the files that import its module.

    ``points``: pid, file, line; ``rows``: facts.  Modules are known by their full
    name, and by their last part where no two files share it.
    """
    functions = rows.where("kind = 'function'")
    spans = functions.select("file", F.concat("file", F.lit("::"), F.when(F.col("scope") == "", F.col("name")).otherwise(F.concat_ws(".", "scope", "name"))).alias("name"), F.col("line").alias("start"), "end", F.col("line").alias("ord"))
    module = F.regexp_replace(F.regexp_replace("file", r"\.py$", ""), "/", ".")
    full = rows.select("file").distinct().withColumn("module", module)
    bare = full.withColumn("module", F.element_at(F.split("module", r"\."), -1)).groupBy("module").agg(F.min("file").alias("file"), F.count("*").alias("n")).where("n = 1").select("file", "module")
    known = full.unionByName(bare).distinct()
    owner = F.when(F.col("scope") == "", F.concat(F.lit("module::"), "file")).otherwise(F.concat("file", F.lit("::"), "scope"))
    calls = rows.where("kind = 'call' and name <> ''").select(owner.alias("caller"), F.col("file").alias("here"), F.regexp_replace("name", r"\.?[^.]*$", "").alias("module"), F.element_at(F.split("name", r"\."), -1).alias("last"))
    top = functions.where("scope = ''").select("file", F.col("name").alias("last")).distinct()
    far = calls.where("module <> ''").join(known, "module").join(top, ["file", "last"]).select("caller", F.concat("file", F.lit("::"), "last").alias("callee"))
    own = calls.where("module = ''").join(top, (F.col("here") == top["file"]) & (calls["last"] == top["last"])).select("caller", F.concat("here", F.lit("::"), top["last"]).alias("callee"))
    reverse = far.unionByName(own).distinct().select(F.col("callee").alias("src"), F.col("caller").alias("dst"))
    at = keep(points.join(enclosing(points, spans), "pid", "left").select("pid", "file", "name"), "fallback-at")
    called = distances(reverse, at.where("name is not null").select(F.col("name").alias("start")).distinct()).groupBy("start").agg(F.count("*").alias("n"))
    imports = rows.where("kind = 'import'").select(F.col("file").alias("by"), F.explode(F.array_distinct(F.array("name", F.concat_ws(".", "name", F.nullif("detail", F.lit("")))))).alias("module")).distinct()
    used = imports.join(known, "module").where("by <> file").groupBy("file").agg(F.count_distinct("by").alias("importers"))
    return at.join(called, F.col("name") == F.col("start"), "left").join(used, "file", "left").select("pid", F.coalesce("n", "importers", F.lit(0)).alias("blast_radius"))
