"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, decontam, fitting, huffman, linededup, minhash, packing, pii, quality, sharding, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), shards=16)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.find(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", *[pii.count_of(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS], F.sha2(pii.as_text(F.col("base")), 256).alias("base_sha256"), pii.as_text(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("bigint").alias("n_added"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return done.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op4_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = minhash.near_duplicates(_table(spark, sf_dir, "documents"), 0.8)
    return done.select(F.col("id").alias("doc_id"), "class_id", "class_size", "first_id", "kept")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), folds=3, held_out=1)
    return toxicity.score(docs, model, 0.7).select("doc_id", (fitting.fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), folds=4, held_out=2)
    return quality.score(docs, model, 0.7).select("doc_id", (fitting.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = huffman.write_files(_table(spark, sf_dir, "documents"))
    return huffman.read_files(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=10)
    return done.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), longest=2048)


def op10_permutation_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ann.Index(_table(spark, sf_dir, "embeddings"))
    return index.search(index.table.where("vec_id % 20 = 0").select("vec_id", "v"), k=20)


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_pii": op2_pii,
    "op3_line_dedup": op3_line_dedup,
    "op4_bagminhash": op4_bagminhash,
    "op5_toxicity": op5_toxicity,
    "op6_quality": op6_quality,
    "op7_token_output": op7_token_output,
    "op8_decontamination": op8_decontamination,
    "op9_packing": op9_packing,
    "op10_permutation_ann": op10_permutation_ann,
}

#: DuckDB: the words of a text.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op3_line_dedup": """
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT rid, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10),
g AS (SELECT k.rid, count(*) AS n, count(*) FILTER (f.key IS NOT NULL) AS gone,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '') AS kept
      FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.rid)
SELECT d.doc_id, CAST(g.n AS BIGINT) AS n_lines, CAST(g.gone AS BIGINT) AS n_dropped, sha256(g.kept) AS kept_sha256
FROM d JOIN g ON d.rid = g.rid""",
    "op8_decontamination": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS s
        FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT rid, k, n, array_to_string(w[k:k + n - 1], ' ') AS s
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT rid, k, dw.n, item_id FROM dw JOIN win ON dw.n = win.n AND dw.s = win.s),
words AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids
        FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY rid)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(its.ids, '')) AS items_sha256,
       words.n IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN its USING (rid)""",
}
