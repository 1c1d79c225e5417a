"""Benchmark decontamination by a prefix-filtered set join, by DataFrame operations only.

Item texts are cut into windows of ``width`` words (a shorter item is one
window); a document is hit where it holds all words of a window in order.
Windows and documents are sets of placed shingles, hashes of up to three
neighbouring words.  One pass over the texts keeps the few places whose shingle
stands in any window.  They give each shingle's rarity in the whole corpus.
Containment is exact, so the necessary prefix of a window is one shingle, its
rarest.  Places that hold a window's prefix are its candidates: the shingle's
offset gives the only start a match can have, the document's length bounds it,
and all shingles of the window are compared with those at the places from that
start on.  A wrong match takes a collision of 64-bit hashes at one such place.

Cases: null texts and texts without words have no words and no hits; equal
items each count; items without words are ignored; repeated rows are separate
documents with the same result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.scratch import keep

#: Fixed value: what separates words, after A-Z were lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shingles of the windows are broadcast up to so many (under 100 MB); beyond, both sides are shuffled.
BROADCAST_SHINGLES = 2_000_000
SHINGLE = 3


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def _windows(items: DataFrame, width: int) -> DataFrame:
    """(wid, item_ids, length, size: words of a shingle, shingles) of the distinct windows."""
    words = items.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    span = F.least(F.size("w"), F.lit(width))
    cut = words.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - span + 1), lambda i: F.slice("w", i, span))).alias("win"))
    size = F.least(F.size("win"), F.lit(SHINGLE))
    starts = F.sequence(F.lit(0), F.size("win") - size)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.get("win", i), F.when(size > 1, F.get("win", i + 1)), F.when(size > 2, F.get("win", i + 2))))
    return cut.groupBy("win").agg(F.collect_set("item_id").alias("item_ids")).select(F.monotonically_increasing_id().alias("wid"), "item_ids", F.size("win").alias("length"), size.alias("size"), hashes.alias("shingles"))


def _places(docs: DataFrame, wanted: DataFrame, sizes: list[int], small: bool) -> DataFrame:
    """(id, at, n_words, pos, sh): the places with a wanted shingle, and one row with null sh for each document."""
    words = docs.select(F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("at"), words_of(F.col("text")).alias("w"))
    n = F.greatest(F.size("w"), F.lit(1))
    zipped = F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, n).alias("b"), F.slice("w", 3, n).alias("c"))
    each = words.select("id", "at", F.size("w").alias("n_words"), F.posexplode_outer(zipped).alias("pos", "s"))
    last = F.col("n_words") - F.col("pos")  # words from here to the end
    a, b, c = F.col("s.a"), F.col("s.b"), F.col("s.c")
    of = {1: F.xxhash64(a), 2: F.when(last >= 2, F.xxhash64(a, b)), 3: F.when(last >= 3, F.xxhash64(a, b, c))}
    if len(sizes) == 1:
        each = each.select("id", "at", "n_words", "pos", of[sizes[0]].alias("sh"), F.lit(True).alias("first"))
    else:
        each = each.select("id", "at", "n_words", "pos", F.posexplode(F.array(*[of[k] for k in sizes])).alias("k", "sh"))
        each = each.select("id", "at", "n_words", "pos", "sh", (F.col("k") == 0).alias("first"))
    joined = each.join(F.broadcast(wanted) if small else wanted, F.col("sh") == F.col("wanted"), "left")
    found, head = F.col("wanted").isNotNull(), F.col("first") & (F.coalesce("pos", F.lit(0)) == 0)
    kept = joined.where(found | head)
    rows = F.array_compact(F.array(F.when(head, F.struct(F.lit(None).cast("int").alias("pos"), F.lit(None).cast("bigint").alias("sh"))), F.when(found, F.struct("pos", "sh"))))
    return kept.select("id", "at", "n_words", F.explode(rows).alias("p")).select("id", "at", "n_words", "p.pos", "p.sh")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """One row per document: doc_id, at (hash of the row), n_words, n_hit, item_ids (sorted strings)."""
    windows = keep(_windows(items, width), "windows")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # of 1, 2, 3
    wanted = keep(windows.select(F.explode("shingles").alias("wanted")).distinct(), "wanted")
    places = keep(_places(docs, wanted, sizes or [SHINGLE], wanted.count() <= BROADCAST_SHINGLES), "places")
    heads = places.where(F.col("sh").isNull())
    occurs = places.where(F.col("sh").isNotNull()).dropDuplicates(["id", "at", "pos", "sh"])

    # The rarest shingle of each window; a shingle that no document holds rules its window out.
    rarity = occurs.groupBy("sh").agg(F.count("*").alias("n"))
    by_shingle = windows.select("wid", "item_ids", "length", "size", "shingles", F.posexplode("shingles").alias("off", "sh")).join(rarity, "sh", "left")
    prefix = by_shingle.groupBy("wid").agg(F.min_by(F.struct("item_ids", "length", "size", "shingles", "off", "sh", "n"), F.struct(F.coalesce("n", F.lit(0)), "off")).alias("r"))
    prefix = prefix.select("r.*").where(F.col("n").isNotNull()).drop("n")

    by_size = Window.partitionBy("id", "at").orderBy("pos", "sh").rowsBetween(-3 * width, 3 * width)
    around = occurs.withColumn("around", F.collect_list(F.struct("pos", "sh")).over(by_size))
    found = around.join(prefix, "sh")
    start, m = F.col("pos") - F.col("off"), F.size("shingles")
    there = F.transform("shingles", lambda sh, k: F.struct((start + k).alias("pos"), sh.alias("sh")))
    found = found.where((start >= 0) & (start + F.col("length") <= F.col("n_words")) & (F.size(F.array_intersect(there, "around")) == m))
    hits = keep(found.select("id", "at", start.alias("start"), "length", "item_ids"), "hits")

    spans = hits.groupBy("id", "at", "start").agg(F.max("length").alias("length"))
    before = F.max(F.col("start") + F.col("length")).over(Window.partitionBy("id", "at").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col("start") + F.col("length") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0)))
    n_hit = spans.withColumn("fresh", F.greatest(fresh, F.lit(0))).groupBy("id", "at").agg(F.sum("fresh").alias("n_hit"))
    named = hits.select("id", "at", F.explode("item_ids").alias("item")).distinct().groupBy("id", "at").agg(F.array_sort(F.collect_list(F.col("item").cast("string"))).alias("item_ids"))
    hit = n_hit.join(named, n_hit["id"].eqNullSafe(named["id"]) & (n_hit["at"] == named["at"])).select(n_hit["id"].alias("hit_id"), n_hit["at"].alias("hit_at"), "n_hit", "item_ids")
    both = heads.join(hit, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("at") == F.col("hit_at")), "left")
    return both.select(F.col("id").alias("doc_id"), "at", F.col("n_words").cast("bigint").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
