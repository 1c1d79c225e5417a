"""Packing by power-of-two decomposition.

A document of n tokens becomes n div L pieces of L tokens and one piece for each
binary digit of the rest, from long to short.  Each piece is a sequence of its
own and pieces of one length form a bucket, so no sequence crosses documents
and none needs padding: their lengths are powers of two.

Cases: a null or empty text is its end id alone, one piece of length 1; null
ids and repeated rows are packed like others; no documents, no pieces; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.arrays import long_array
from ..operators.scratch import keep
from .tokens import binaries, default_path, encoder


def lengths_of(n: int, longest: int) -> list[int]:
    """The pieces' lengths of a document of ``n`` tokens."""
    return all_lengths(np.array([n]), longest)[0].tolist()


def all_lengths(n: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The pieces' lengths of documents of ``n`` tokens one after the other, and how many pieces each has."""
    bits = np.arange(longest.bit_length() - 2, -1, -1)
    times = np.concatenate([(n // longest)[:, None], (n % longest)[:, None] >> bits & 1], axis=1)
    sizes = np.tile(np.concatenate([[longest], 1 << bits]), len(n))
    return np.repeat(sizes, times.ravel()), times.sum(axis=1)


def pieces(docs: DataFrame, path: str | None = None, longest: int = 2048) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids binary uint32) of every piece."""
    if longest < 1 or longest & longest - 1:
        raise ValueError("the longest sequence must be a power of two")
    path = path or default_path()
    names = ["doc_id", "start", "length", "doc_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            flat, count = enc.encode_flat(batch["text"])
            sizes, times = all_lengths(count, longest)
            # A document's pieces start where those before them end, which its own first token counts from.
            start = np.cumsum(sizes) - sizes - np.repeat(np.cumsum(count) - count, times)
            doc_id = batch["doc_id"].take(pa.array(np.repeat(np.arange(len(count)), times)))
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(start), pa.array(sizes), pa.array(np.repeat(count, times)), binaries(flat, sizes, "<u4")], names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary")


def number(cut: DataFrame, rows_per_cell: int = 200_000) -> DataFrame:
    """Adds sequence_id (gapless from 0, longest bucket first) and offset to slim piece rows with ids_crc32."""
    cut = keep(cut, "pieces")
    n = cut.count()
    cells = max(1, min(n // rows_per_cell + 1, 4096))
    celled = cut.withColumn("cell", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(cells)).cast("int"))
    sizes = {(r["length"], r["cell"]): r["n"] for r in celled.groupBy("length", "cell").agg(F.count("*").alias("n")).collect()}
    # At most 12 buckets and 4,096 cells: their counts fit the driver.
    buckets = sorted({k for k, _ in sizes}, reverse=True)
    counts = [sizes.get((b, c), 0) for b in buckets for c in range(cells)]
    base = long_array([0, *accumulate(counts)][:-1])
    nth = F.row_number().over(Window.partitionBy("length", "cell").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1
    bucket = F.array_position(long_array(buckets), F.col("length")) - 1
    at = (bucket * cells + F.col("cell") + 1).cast("int")
    return celled.withColumn("sequence_id", (F.element_at(base, at) + nth).cast("bigint")).withColumn("offset", F.lit(0).cast("bigint")).drop("cell")


def pack(docs: DataFrame, path: str | None = None, longest: int = 2048) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    slim = pieces(docs, path, longest).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return number(slim).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def write_sequences(docs: DataFrame, to: str, path: str | None = None, longest: int = 2048) -> None:
    """Write all pieces with their ids as Parquet, a folder for each bucket of equal lengths."""
    pieces(docs, path, longest).withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(to)
