"""Dependency manifests as rows of (name, version, file, line, ord)."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.columns import package_name, posix
from ..operators.graph import distances
from ..operators.scratch import keep

#: Those folders, and the names of requirement files.
SKIPPED = r"(^|/)(\.git|\.hg|venv|\.venv|env|node_modules|__pycache__|site-packages|\.tox|\.mypy_cache|\.pytest_cache|build|dist)/"
MANIFEST = r"(^|/)((?i:([^/]*[-_.])?requirements([-_.][^/]*)?\.txt)|pyproject\.toml|poetry\.lock|Pipfile\.lock)$"


def discover(spark: SparkSession, root: str, pattern: str = MANIFEST) -> DataFrame:
    """(path relative to root, text) of the files below ``root`` that match."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.col("path"), "^.*?" + root.rstrip("/").lstrip("/") + "/", "")
    return files.select(posix(path).alias("path"), F.decode("content", "UTF-8").alias("text")).where(F.col("path").rlike(pattern) & ~F.col("path").rlike(SKIPPED))


def requirement(line: Column) -> Column:
    """struct<name, version>: version only where it is pinned exactly; null for what is no requirement."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(line, r"(^|\s)#.*$", ""), r"\s--hash=\S+", ""), r"\s*;.*$", ""))
    shape = r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*(.*)$"
    pin = F.regexp_extract(bare, r"(?:^|[^=!<>~])===?\s*([A-Za-z0-9.!+_-]+)\s*$", 1)
    other = bare.rlike(r"^(-|https?:|git\+|file:|\.|/)") | bare.rlike(r"://") | (bare == "") | ~bare.rlike(shape)
    wild = F.contains(bare, F.lit("*"))
    return F.when(~other, F.struct(package_name(F.regexp_extract(bare, shape, 1)).alias("name"), F.when((pin != "") & ~wild & ~F.contains(bare, F.lit(",")), pin).alias("version")))


def requirements(files: DataFrame) -> DataFrame:
    """Rows of requirement files; a line that ends in a backslash goes on, and keeps its first number."""
    lines = files.select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|\n|\r")).alias("k", "line"))
    order = Window.partitionBy("path").orderBy("k")
    starts = lines.withColumn("goes_on", F.coalesce(F.lag(F.col("line").rlike(r"\\\s*$")).over(order), F.lit(False)))
    starts = starts.withColumn("nth", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(order))
    whole = starts.groupBy("path", "nth").agg(F.min("k").alias("k"), F.array_sort(F.collect_list(F.struct("k", "line"))).alias("p"))
    text = F.array_join(F.transform("p", lambda s: F.regexp_replace(s["line"], r"\\\s*$", "")), " ")
    parsed = whole.select("path", (F.col("k") + 1).alias("line"), text.alias("text"), requirement(text).alias("r"))
    return parsed.where("r is not null").select("r.name", "r.version", F.col("path").alias("file"), "line")


def with_includes(files: DataFrame, max_depth: int = 50) -> DataFrame:
    """(root, path): the requirement files that each one reads, itself and those it includes in turn, each once whatever the cycles."""
    known = files.select("path").distinct()
    edges = keep(includes(files).select(F.col("path").alias("src"), _normal(F.col("included")).alias("dst")).join(known, F.col("dst") == F.col("path"), "left_semi"), "includes")
    below = distances(edges, known.select(F.col("path").alias("start")), max_depth)
    own = known.select(F.col("path").alias("root"), "path")
    return own.unionByName(below.where("node <> start").select(F.col("start").alias("root"), F.col("node").alias("path")))


def _normal(path: Column) -> Column:
    """The path without . and .. parts; null if it leaves the root."""
    step = lambda at, part: F.when(part.isin("", "."), at).when(part == "..", F.when(F.size(at) > 0, F.slice(at, 1, F.size(at) - 1))).otherwise(F.array_append(at, part))
    return F.aggregate(F.split(posix(path), "/"), F.array().cast("array<string>"), step, lambda at: F.array_join(at, "/"))


def includes(files: DataFrame) -> DataFrame:
    """(path, included) of the -r lines, relative to the file's folder."""
    lines = files.select("path", F.explode(F.split("text", r"\r\n|\n|\r")).alias("line"))
    name = F.regexp_extract("line", r"^\s*(?:-r|--requirement)[\s=]+(\S+)", 1)
    return lines.where(name != "").select("path", F.concat(F.regexp_replace("path", r"[^/]*$", ""), name).alias("included"))


def pipfile_lock(files: DataFrame) -> DataFrame:
    kind = "struct<default:map<string,struct<version:string>>,develop:map<string,struct<version:string>>>"
    both = files.select("path", "text", F.from_json("text", kind).alias("v")).select("path", "text", F.map_concat(F.coalesce("v.default", F.create_map().cast("map<string,struct<version:string>>")), F.coalesce(F.map_filter("v.develop", lambda k, x: ~F.coalesce(F.map_contains_key("v.default", k), F.lit(False))), F.create_map().cast("map<string,struct<version:string>>"))).alias("m"))
    each = both.select("path", "text", F.explode("m").alias("name", "x"))
    before = F.call_function("substring_index", F.col("text"), F.concat(F.lit("\""), F.col("name"), F.lit("\"")), F.lit(1))
    return each.select(package_name(F.col("name")).alias("name"), F.regexp_replace("x.version", "^==", "").alias("version"), F.col("path").alias("file"), F.size(F.split(before, "\n")).alias("line"))


def toml_manifests(files: DataFrame) -> DataFrame:
    """(spec or name==version, file, line) of pyproject.toml and poetry.lock, which need a TOML parser."""

    def specs(path: str, text: str) -> list[str]:
        try:
            data = tomllib.loads(text)
        except tomllib.TOMLDecodeError:
            return []
        if path.endswith("poetry.lock"):
            return [f"{p['name']}=={p['version']}" for p in data.get("package", []) if "name" in p and "version" in p]
        project = data.get("project", {})
        lists = [project.get("dependencies", []), *project.get("optional-dependencies", {}).values(), *data.get("dependency-groups", {}).values()]
        return [s for group in lists for s in group if isinstance(s, str)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"], strict=True):
                lines = (text or "").splitlines()
                for s in specs(path, text or ""):
                    key = s.split("==")[0] if path.endswith("poetry.lock") else s
                    rows.append((s, path, next((k for k, x in enumerate(lines, 1) if key in x), 1)))
            yield pd.DataFrame(rows, columns=["spec", "file", "line"])

    out = files.select("path", "text").mapInPandas(run, "spec string, file string, line int")
    return out.select(requirement(F.col("spec")).alias("r"), "file", "line").where("r is not null").select("r.name", "r.version", "file", "line")


def collect(files: DataFrame) -> DataFrame:
    """All dependencies once each; ``ord`` numbers them by kind of manifest, file and line.

    The kinds are requirement files, TOML manifests and lock files.
    """
    name = F.element_at(F.split("path", "/"), -1)
    toml = files.where(name.isin("pyproject.toml", "poetry.lock"))
    parts = [requirements(files.where(name.rlike(r"\.txt$"))), toml_manifests(toml), pipfile_lock(files.where(name == "Pipfile.lock"))]
    out = None
    for k, part in enumerate(parts):
        part = part.withColumn("part", F.lit(k))
        out = part if out is None else out.unionByName(part)
    once = out.groupBy("name", "version", "file", "line").agg(F.min("part").alias("part"))
    # Manifests are a bounded part of a tree; the numbers need one order over all of them.
    return once.withColumn("ord", F.row_number().over(Window.orderBy("part", "file", "line", "name", "version")).cast("bigint")).drop("part")
