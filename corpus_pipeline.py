"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the
last return the columns of ``docs``, whatever they are; decisions are taken on
doc_id and text alone.  Columns of other names than doc_id, text and n_chars
pass through; n_chars, where there is one, follows a changed text.

Cases: null texts pass every filter unless they repeat, and line dedup makes
them empty texts; empty tables give empty results; repeated rows count as copies,
of which near-dedup keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from triagelake.llm import decontam, linededup, minhash, packing, toxicity
from triagelake.operators.scratch import keep


def _matching(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, text) is among the (id, at) of ``decided``."""
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("own_id"), F.xxhash64("doc_id", "text").alias("own_at"))
    some = decided.select(F.col("id").alias("id"), F.col("at").alias("at")).distinct()
    return rows.join(some.hint("shuffle_hash"), F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_at") == F.col("at")), "left_semi")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted toxic go.  Each row is judged by itself, so that nothing is shuffled."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model, 0.7)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more go from every text."""
    done = linededup.dedup_lines(docs, min_docs=10, min_chars=1)
    changed = F.col("n_dropped") > 0
    new = {"text": F.col("kept"), "n_chars": F.when(changed, F.length("kept").cast("bigint")).otherwise(F.col("doc.n_chars")) if "n_chars" in docs.columns else None}
    return done.select(*[(new[c] if new.get(c) is not None else F.col("doc").getField(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates stays, that with the least doc_id."""
    kept = minhash.near_duplicates(docs, 0.8).where("kept")
    # Equal rows share id and hash: one of them stays.
    return _matching(docs, kept).groupBy("own_id", "own_at").agg(F.first("doc").alias("doc")).select("doc.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words of a benchmark item (or a whole shorter item) go."""
    found = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10)
    return _matching(docs, found.where("n_hit = 0").select(F.col("doc_id").alias("id"), "at")).select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of at most 2048 tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return packing.pack(docs, longest=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Toxicity, near-dedup and packing can't be stated in SQL; tests hold them against plain versions.
ORACLE_SQL = None
