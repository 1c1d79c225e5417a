"""Approximate nearest neighbours by inner product with a permutation index.

Pivots are a bounded sample of the vectors (``pivots``, 4,096).  A vector is
represented by its ``prefix`` nearest pivots in order.  Inner product is turned into an angle first: with M
the largest norm, a vector x becomes (x/M, sqrt(1 - |x|^2/M^2)) and a query q
becomes (q/|q|, 0), whose inner product has the same order.  The index is a
table of blocks; within a block each pivot posts the vectors that name it, with
their ranks (the inverted files).  A query adds up the footrule gains of the
postings of its own pivots, takes the best ``share`` of the block as candidates
and reranks them by the exact inner product of the original vectors in double
precision.  Each block returns its best ``k``; the best of these are the result.

Blocks and batches of queries have a bounded size, every pair of them is a task
of its own, and no block's answer depends on another's.

Cases: vectors that are null, empty or zero or hold null or non-finite
components take no part, nor do those of another dimension than most have (of
equally frequent ones the larger); a null id takes no part; fewer candidates
than ``k`` are returned all; repeated rows of one id are one candidate each, and
those with the query's own id are none; equal query rows are one query, rows of
one id with different vectors are queries of their own, each with its ranks; no
vectors, no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window

from ..operators.scratch import keep

RESULT = "query_id bigint, rank int, vec_id bigint, score double"


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id bigint, v array<double>) of the rows that take part."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(F.col("v"), lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return rows.where(F.coalesce(fine, F.lit(False)) & F.coalesce(some, F.lit(False)))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


class Index:
    """``table``: (vec_id, block, v, perm binary: the nearest pivots' numbers in order, uint16)."""

    def __init__(self, vectors: DataFrame, pivots: int = 4096, prefix: int = 64, block_rows: int = 16_384) -> None:
        rows = keep(usable(vectors), "vectors")
        dims = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("m")).orderBy(F.desc("n"), F.desc("d")).first()
        self.dim = dims["d"] if dims else 0
        n, self.largest = (dims["n"], dims["m"]) if dims else (0, 1.0)
        rows = rows.where(F.size("v") == self.dim)
        # A bounded sample: at most ``pivots`` different vectors, chosen by a hash.
        chosen = rows.groupBy("v").agg(F.min("vec_id").alias("vec_id")).orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
        self.pivots = self.lift(np.array([r["v"] for r in chosen], dtype=float).reshape(len(chosen), self.dim))
        self.prefix = min(prefix, len(self.pivots))
        self.blocks = max(1, -(-n // block_rows))
        block = F.pmod(F.xxhash64("vec_id"), F.lit(self.blocks)).cast("int")
        pivot, largest, dim, l = self.pivots, self.largest, self.dim, self.prefix

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                perm = permutations(lift(_matrix(batch["v"], dim), largest), pivot, l)
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["block"], batch["v"], pa.array([p.tobytes() for p in perm], pa.binary())], ["vec_id", "block", "v", "perm"])

        self.table = keep(rows.select("vec_id", block.alias("block"), "v").mapInArrow(post, "vec_id bigint, block int, v array<double>, perm binary"), "ann-index")

    def lift(self, x: np.ndarray) -> np.ndarray:
        return lift(x, self.largest)

    def search(self, wanted: DataFrame, k: int = 20, share: float = 0.08, batch_rows: int = 4096) -> DataFrame:
        """The ``k`` nearest of every (vec_id, v) row of ``wanted``, as :data:`RESULT`."""
        wanted = keep(wanted.where(F.size("v") == self.dim).select("vec_id", "v", F.xxhash64("v").alias("own")).distinct(), "queries")
        n = wanted.count()
        spark = wanted.sparkSession
        if not n or not self.dim:
            return spark.createDataFrame([], RESULT)
        batches = max(1, -(-n // batch_rows))
        dim, pivot, l = self.dim, self.pivots, self.prefix
        part = F.pmod(F.xxhash64("vec_id", F.lit("q")), F.lit(batches)).cast("int")
        ask = wanted.select("vec_id", "own", "v", part.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))).alias("block"))
        data = self.table.select("vec_id", "v", "perm", "block", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("part"))

        def answer(queries: pa.Table, rows: pa.Table) -> pa.Table:
            got: list = []
            if queries.num_rows and rows.num_rows:
                x = _matrix(rows["v"], dim)
                ids = rows["vec_id"].to_numpy()
                perm = np.frombuffer(b"".join(rows["perm"].to_pylist()), dtype=np.uint16).reshape(-1, l)
                files = inverted(perm, len(pivot))
                q = _matrix(queries["v"], dim)
                unit = np.c_[q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros(len(q))]
                order = permutations(unit, pivot, l)
                take = min(len(x), max(16 * k, int(np.ceil(share * len(x)))) + 1)
                for i, (query, own) in enumerate(zip(queries["vec_id"].to_pylist(), queries["own"].to_pylist(), strict=True)):
                    cand = candidates(order[i], files, len(x), l, take)
                    score = x[cand] @ q[i]
                    score[ids[cand] == query] = -np.inf
                    best = min(k, len(cand))
                    edge = np.partition(score, len(score) - best)[len(score) - best]
                    top = np.flatnonzero((score >= edge) & (score > -np.inf))
                    top = top[np.lexsort((ids[cand[top]], -score[top]))][:k]
                    got.append((np.full(len(top), query), np.full(len(top), own), ids[cand[top]], score[top]))
            cols = [np.concatenate(c) for c in zip(*got, strict=True)] if got else [[], [], [], []]
            return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "own", "vec_id", "score"])

        found = ask.groupBy("block", "part").cogroup(data.groupBy("block", "part")).applyInArrow(answer, "query_id bigint, own bigint, vec_id bigint, score double")
        rank = F.row_number().over(Window.partitionBy("query_id", "own").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def lift(x: np.ndarray, largest: float) -> np.ndarray:
    """Unit vectors of one more dimension, for the order by inner product."""
    x = x / largest
    return np.c_[x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))]


def nearest(near: np.ndarray, l: int) -> np.ndarray:
    """For each row the numbers of its ``l`` largest entries, from the largest on."""
    some = np.argpartition(-near, l - 1, axis=1)[:, :l] if l < near.shape[1] else np.broadcast_to(np.arange(near.shape[1]), near.shape)
    order = np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable")
    return np.take_along_axis(some, order, axis=1).astype(np.uint16)


def permutations(x: np.ndarray, pivot: np.ndarray, l: int, rows: int = 256) -> np.ndarray:
    """For each row of ``x`` its ``l`` nearest pivots; so many ``rows`` at a time, as each has a number for every pivot."""
    return np.concatenate([nearest(x[at : at + rows] @ pivot.T, l) for at in range(0, len(x), rows)])


def inverted(perm: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The posting lists of all pivots one after the other: rows, each one's rank of the pivot, and where lists start."""
    l = perm.shape[1]
    flat = perm.ravel()
    order = np.argsort(flat, kind="stable")
    return order // l, order % l, np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=pivots))])


def candidates(order: np.ndarray, files: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, l: int, take: int) -> np.ndarray:
    """The ``take`` rows of least footrule distance, where a pivot that is not named has rank ``l``.

    A row's distance is a constant less what its postings gain: for a pivot at
    rank i with the query and j with the row, (l - i) + (l - j) - |i - j|.
    """
    rows, ranks, starts = files
    size = starts[order.astype(np.int64) + 1] - starts[order]
    read = np.repeat(starts[order] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    gain = np.bincount(rows[read], weights=2 * (l - np.maximum(ranks[read], np.repeat(np.arange(len(order)), size))), minlength=n)
    return np.argpartition(-gain, take - 1)[:take] if take < n else np.arange(n)
