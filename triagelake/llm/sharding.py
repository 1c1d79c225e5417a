"""Sampled splitters: size-balanced shards of a corpus, by DataFrame operations only.

Every row gets a sort key, the 64-bit hash of its text, so that equal texts lie
side by side.  A size-weighted sample of keys gives quantile boundaries; they
cut the key space into many ranges of about equal bytes.  Ranges that hold far
more than their part (one text with very many copies) are subdivided: such a
text gets ranges of its own, by a hash of the row.  Sizes are then summed exactly: each range adds up its own rows,
only one row per range reaches the driver, and a record's shard follows from
the bytes that lie before it in key order.

Law ``bytes``: the shards' sums of sizes differ from total/shards by less than
one record, or by less than ``snap`` of it where a boundary would cut a group of
equal texts: such a group stays whole, in the shard where it starts, as long as
it holds at most ``snap`` of a shard's bytes.  Larger groups are cut.

Cases: a null text has size 1 and counts as the empty text; null ids are kept;
repeated rows are separate records; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.arrays import bucket_of, long_array
from ..operators.scratch import keep

SCHEMA = "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int"


def _unit(key: Column) -> Column:
    """A number in [0, 1) that the key decides."""
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 52)) / float(1 << 52)


def shard_by_bytes(docs: DataFrame, shards: int = 16, rows_per_range: int = 50_000, sample_per_range: int = 32, snap: float = 0.02) -> DataFrame:
    """A row per record of ``docs`` (doc_id, text): its shard and its gapless slot there."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("bigint"),
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.monotonically_increasing_id().alias("rid"),
    )
    slim = keep(slim, "shard-keys")
    rows, total = slim.agg(F.count("*"), F.sum("size")).first()
    if not rows:
        return spark.createDataFrame([], SCHEMA)
    n_ranges = min(max(rows // rows_per_range, 4 * shards), 8192)

    # Splitters.  A record is drawn with a probability in proportion to its size.
    expected = sample_per_range * n_ranges
    share = F.col("size") * (expected / total)
    quantiles = "array(" + ",".join(f"{i / n_ranges:.9f}D" for i in range(1, n_ranges)) + ")"
    drawn = slim.where(_unit(F.col("rid")) < share).select("h", F.greatest(F.lit(1), F.round(share)).cast("bigint").alias("w"))
    splits = drawn.select(F.expr(f"percentile(h, {quantiles}, w)")).first()[0] or []
    bounds = sorted({int(x) for x in splits})

    # Overfull ranges are subdivided.  At most one row per range comes to the driver.
    in_range = slim.withColumn("range", bucket_of(F.col("h"), bounds))
    stats = {r["range"]: (r["n"], r["b"]) for r in in_range.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()}
    mean_n, mean_b = rows / (len(bounds) + 1), total / (len(bounds) + 1)
    over = [k for k, (n, b) in stats.items() if max(n / mean_n, b / mean_b) > 3]
    # In such ranges the keys that alone exceed a range's part: fewer than there are ranges.
    heavy: dict[int, int] = {}
    if over:
        per_key = in_range.where(F.array_contains(long_array(over), F.col("range").cast("bigint"))).groupBy("h").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
        for r in per_key.where((F.col("n") > mean_n) | (F.col("b") > mean_b)).collect():
            heavy[r["h"]] = int(max(r["n"] / mean_n, r["b"] / mean_b)) + 1
    keys = sorted(heavy)
    first_part = [len(bounds) + 1 + x for x in [0, *accumulate(heavy[k] for k in keys)]]
    nth = bucket_of(F.col("h"), keys) if keys else F.lit(0)
    is_heavy = (F.element_at(long_array(keys), F.greatest(nth, F.lit(1))) == F.col("h")) & (nth > 0) if keys else F.lit(False)
    part = F.element_at(long_array(first_part), F.greatest(nth, F.lit(1))) + F.pmod(F.xxhash64("rid"), F.element_at(long_array([heavy[k] for k in keys] or [1]), F.greatest(nth, F.lit(1))))
    in_cell = in_range.select("doc_id", "size", "text_crc32", "h", "rid", F.when(is_heavy, part).otherwise(F.col("range").cast("bigint")).alias("cell"), (~is_heavy).alias("whole"))

    # Exact sums: per range on the executors, across ranges from one row each.
    sums = {r["cell"]: (r["n"], r["b"]) for r in in_cell.groupBy("cell").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()}
    in_order = [sums.get(c, (0, 0)) for c in range(first_part[-1])]
    rows_before = long_array([0, *accumulate(n for n, _ in in_order)][:-1])
    bytes_before = long_array([0, *accumulate(b for _, b in in_order)][:-1])
    order = Window.partitionBy("cell").orderBy("h", "doc_id", "rid")
    group = Window.partitionBy("cell", "h")
    at = F.col("cell").cast("int") + 1
    placed = (
        in_cell.withColumn("own", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("rank", F.row_number().over(order) - 1 + F.element_at(rows_before, at))
        .withColumn("group_start", F.min("own").over(group))
        .withColumn("group_bytes", F.sum("size").over(group))
    )
    whole = F.col("whole") & (F.col("group_bytes") <= F.lit(snap * total / shards))
    start = F.element_at(bytes_before, at) + F.when(whole, F.col("group_start")).otherwise(F.col("own"))
    placed = placed.select("doc_id", "size", "text_crc32", "rank", F.least(F.lit(shards - 1), F.floor(start / F.lit(total / shards))).cast("int").alias("shard"))
    placed = keep(placed, "shard-places")
    firsts = {r["shard"]: r["f"] for r in placed.groupBy("shard").agg(F.min("rank").alias("f")).collect()}
    first = long_array([firsts.get(s, 0) for s in range(shards)])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("rank") - F.element_at(first, F.col("shard") + 1)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
