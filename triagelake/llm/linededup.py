"""Line deduplication with levelled sorted runs, by DataFrame operations only.

A run is a table (k1, k2, n): the 128-bit hash of a line's key and the number of
documents that hold it, bucketed and sorted by the key.  All runs have the same
buckets, so that a batch, once it is dealt by its keys, meets every run by a merge
join without another exchange, and runs are merged bucket by bucket.  Texts are
read once to write their keys, batch by batch.  A batch first merge-anti-joins the
runs: keys that they already hold often enough need no more counting.  What is
left is written as a new run of level 0.  As soon as a level has ``fanout`` runs
they are merged into one of the next level, so a key is rewritten a logarithmic
number of times.

A line's key is the line with white space stripped at both ends and A-Z
lower-cased.  Lines whose key has at least ``min_chars`` code points and is
found in at least ``min_docs`` documents (rows) are dropped wherever they stand.

Cases: a null or empty text is one empty line; empty keys are never dropped;
a text that loses all lines becomes empty; repeated rows are separate documents;
an empty table gives no rows; further columns are passed through untouched.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.scratch import keep, new_path, remove

#: The white space that is stripped.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hash(key: Column) -> Column:
    """Two 64-bit hashes with different seeds; one alone would collide among 10^12 lines."""
    return F.struct(F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(7), key).alias("k2"))


class LineRuns:
    """Levels of sorted runs.  ``add`` takes a batch's keys, one row per key and document.

    Runs are tables of the session's catalog whose files are in the shared folder;
    :meth:`close` removes them.
    """

    def __init__(self, spark: SparkSession, saturated: int, fanout: int = 3) -> None:
        self.spark, self.saturated, self.fanout = spark, saturated, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _read(self, run: str) -> DataFrame:
        return self.spark.table(run)

    def add(self, keys: DataFrame) -> None:
        """Count a batch of (k1, k2) rows, drop what is saturated, and add the rest as a run."""
        # Counted where they are read and again where they are dealt.
        batch = keys.groupBy("k1", "k2").agg(F.count("*").alias("n"))
        for run in (r for level in self.levels for r in level):
            batch = batch.join(self._read(run).where(F.col("n") >= self.saturated).hint("merge"), ["k1", "k2"], "left_anti")
        self._put(0, batch)

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = new_path(self.spark, f"line-run-{level}")
        dealt = run.repartition(self.buckets, "k1", "k2")
        dealt.write.bucketBy(self.buckets, "k1", "k2").sortBy("k1", "k2").option("compression", "zstd").option("path", self.paths[name]).saveAsTable(name)
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            self.compact(level)

    def compact(self, level: int) -> None:
        """Merge a level's runs into one of the next."""
        old, self.levels[level] = self.levels[level], []
        self._put(level + 1, self._merged(old))
        for run in old:
            self._drop(run)

    def _merged(self, runs: list[str]) -> DataFrame:
        """The sums of all runs: they are joined bucket by bucket, as a union would lose the buckets."""
        out = self._read(runs[0])
        for k, run in enumerate(runs[1:]):
            out = out.join(self._read(run).withColumnRenamed("n", f"n{k}").hint("merge"), ["k1", "k2"], "full").select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.coalesce(f"n{k}", F.lit(0))).alias("n"))
        return out

    def frequent(self, least: int) -> DataFrame:
        """(k1, k2) of the keys that at least ``least`` documents hold."""
        return self._merged([r for level in self.levels for r in level]).where(F.col("n") >= least).select("k1", "k2")

    def _drop(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        remove(self.spark, self.paths.pop(run))

    def close(self) -> None:
        for run in list(self.paths):
            self._drop(run)


def _among(gone: Column) -> Callable[[Column], Column]:
    """Whether a hash is among ``gone``, an array of arrays: looked up in the one its first half names."""
    return lambda k: F.array_contains(F.get(gone, F.pmod(k["k1"], F.size(gone)).cast("int")), k)


def _dealt(hashes: Column) -> Column:
    """Hashes in about as many arrays as each then has members."""
    n = F.ceil(F.sqrt(F.size(hashes))).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.filter(hashes, lambda k: F.pmod(k["k1"], n) == i))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int | None = None, fanout: int = 3, docs_per_batch: int = 50_000_000) -> DataFrame:
    """``docs`` with shortened texts, as (doc struct<all columns>, kept string, n_lines, n_dropped).

    There are as many batches as the number of documents asks for, 4 at least.
    """
    spark = docs.sparkSession
    batches = batches or max(4, -(-docs.count() // docs_per_batch))
    keyed = F.filter(F.transform(lines_of(F.col("text")), line_key), lambda k: F.length(k) >= min_chars)
    at = F.xxhash64("doc_id", "text")
    hashed = docs.select(F.pmod(at, F.lit(batches)).alias("batch"), F.col("doc_id").alias("id"), at.alias("at"), F.explode(F.transform(F.array_distinct(keyed), _hash)).alias("k"))
    path = new_path(spark, "line-keys")
    hashed.select("batch", "id", "at", "k.k1", "k.k2").write.option("compression", "zstd").partitionBy("batch").parquet(path)
    keys = spark.read.schema("id " + docs.schema["doc_id"].dataType.simpleString() + ", at bigint, k1 bigint, k2 bigint, batch bigint").parquet(path)
    runs = LineRuns(spark, min_docs, fanout)
    for b in range(batches):
        runs.add(keys.where(F.col("batch") == b).select("k1", "k2"))
    common = keep(runs.frequent(min_docs), "line-common")
    runs.close()

    # Which common keys a document holds: slim rows only; the text itself moves once.
    held = keys.select("id", "at", "k1", "k2").join(common, ["k1", "k2"], "left_semi")
    held = held.groupBy("id", "at").agg(F.collect_set(F.struct("k1", "k2")).alias("gone")).select("id", "at", _dealt(F.col("gone")).alias("gone"))
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("own_id"), at.alias("own_at"))
    both = rows.join(held.hint("shuffle_hash"), F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_at") == F.col("at")), "left")
    lines = lines_of(F.col("doc.text"))
    is_gone = _among(F.col("gone"))
    stays = F.filter(lines, lambda x: (F.length(line_key(x)) < min_chars) | ~is_gone(_hash(line_key(x))))
    kept = F.when(F.col("gone").isNull(), F.lit(None).cast("array<string>")).otherwise(stays)
    out = both.select("doc", F.size(lines).cast("bigint").alias("n_lines"), kept.alias("stays"))
    return out.select(
        "doc",
        F.when(F.col("stays").isNull(), F.coalesce(F.col("doc.text"), F.lit(""))).otherwise(F.array_join("stays", "\n")).alias("kept"),
        "n_lines",
        F.when(F.col("stays").isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("stays")).cast("bigint").alias("n_dropped"),
    )
