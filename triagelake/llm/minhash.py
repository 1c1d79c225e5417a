"""Near-duplicates by BagMinHash: weighted MinHash of shingle multisets.

A text is the multiset of its shingles of five words (the op8 words; a shorter
text is one shingle).  Two texts are linked if their weighted Jaccard
similarity, sum of minima over sum of maxima of the counts, is 0.8 or more.

Signature.  For each shingle a Poisson process with rate 1 runs over every unit
of its count; points are shared by all texts, as a hash of the shingle drives
them.  Units are grouped in a hierarchy of levels, [0,1), [1,2), [2,4), [4,8)
...: a level's points come from one process of its rate and each carries a
place in it, so that a text with count c takes the points below c.  A point
falls on a random component; a component is the least time of its points.  Two
texts agree in a component with the probability of their similarity.
Processes run in order of time and stop at the text's largest component.

Links.  Texts with equal words are one class from the start.  The others meet
in the buckets of their bands.  In each bucket all are compared with its most
central member, the one that shares most buckets with others; what is linked
becomes one component.  In buckets that still hold several components, members
of different components are compared, if they can be linked at all: a link
needs an overlap of t/(1+t) of both sizes, and shingles that no other text of
those buckets has can't be in it.  So every bucket is either one component or
compared in full: no link that the bands bring together is lost, and a bucket of
many copies costs about as much as it has rows.
25 bands of 5 miss a pair at 0.8 with probability 5e-5.  Links are decided on
the whole multisets.

Cases: null is the empty text; texts without words are linked only with equal
texts; repeated rows are one class; very long texts count with all their
shingles; no documents, no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators.components import connected_components
from ..operators.scratch import keep
from ..operators.skew import join_by_weight

#: Words as in benchmark decontamination.
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SHINGLE, BANDS, ROWS = 5, 25, 5
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(ASCII_LOWER)) if text and not text.isascii() else WORD.findall((text or "").lower())


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's fixed constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, remembered in bounded number."""

    def __init__(self, size: int = 300_000) -> None:
        self.memo, self.size = {}, size

    def __call__(self, words: list[str]) -> np.ndarray:
        got = list(map(self.memo.get, words))
        if None in got:
            if len(self.memo) > self.size:
                self.memo.clear()
            for i, h in enumerate(got):
                if h is None:
                    got[i] = self.memo[words[i]] = xxhash.xxh3_64_intdigest(words[i])
        return np.array(got, dtype=np.uint64)


def shingles(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``size`` words from the words' hashes."""
    n = min(size, len(h))
    out = np.zeros(len(h) - n + 1 if n else 0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = mix(out * GOLDEN + h[k : k + len(out)])
    return out


def bag(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(h, return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int = BANDS * ROWS) -> np.ndarray:
    """A row of ``m`` float32 times for each bag."""
    n = len(bags)
    sig = np.full(n * m, np.inf)
    if not n:
        return sig.reshape(0, m).astype(np.float32)
    item = np.concatenate([b[0] for b in bags])
    count = np.concatenate([b[1] for b in bags]).astype(np.int64)
    owner = np.repeat(np.arange(n), [len(b[0]) for b in bags])
    # One process for each item and level that its count reaches.
    level = np.zeros(len(item), dtype=np.int64)
    parts = [(item, count, owner, level)]
    top, k = int(count.max(initial=1)), 1
    while 1 << (k - 1) < top:
        on = np.flatnonzero(count > 1 << (k - 1))
        parts.append((item[on], count[on], owner[on], np.full(len(on), k)))
        k += 1
    item, count, owner, level = (np.concatenate(c) for c in zip(*parts, strict=True))
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    rate = np.where(level == 0, 1, low).astype(np.float64)
    with np.errstate(over="ignore"):
        state = mix(item + GOLDEN * (level.astype(np.uint64) + np.uint64(1)))
        time = np.zeros(len(item))
        while len(item):
            state = mix(state + GOLDEN)
            u = ((state >> np.uint64(11)).astype(np.float64) + 0.5) / 9007199254740992.0
            time = time - np.log(u) / rate
            second = mix(state ^ np.uint64(0xD6E8FEB86659FD93))
            slot = ((second & np.uint64(0xFFFFFFFF)) * np.uint64(m)) >> np.uint64(32)
            place = low + rate * ((second >> np.uint64(32)).astype(np.float64) / 4294967296.0)
            taken = place < count
            np.minimum.at(sig, (owner * m + slot.astype(np.int64))[taken], time[taken])
            worst = sig.reshape(n, m).max(axis=1)
            go = time < worst[owner]
            item, count, owner, low, rate, state, time = (a[go] for a in (item, count, owner, low, rate, state, time))
    return sig.reshape(n, m).astype(np.float32)


def bands_of(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit bucket for each band of each signature."""
    n, m = sig.shape
    bits = sig.view(np.uint32).astype(np.uint64).reshape(n, m // rows, rows)
    out = np.broadcast_to(np.arange(m // rows, dtype=np.uint64), (n, m // rows)).copy()
    with np.errstate(over="ignore"):
        for k in range(rows):
            out = mix(out * GOLDEN + bits[:, :, k])
    return out.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two bags."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1, int(a[1].sum()) + int(b[1].sum()) - both)


def sign(docs: DataFrame) -> DataFrame:
    """(id, at: hash of the row, k1, k2: hash of the words, n: shingles, bands array<bigint>; empty for a text without words)."""
    names = ["id", "at", "k1", "k2", "n", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                keys, bags, with_words, sizes = [], [], [], []
                for i, text in enumerate(part["text"].to_pylist()):
                    words = words_of(text)
                    whole = " ".join(words) if words else "\n" + (text or "")
                    d = xxhash.xxh3_128_intdigest(whole)
                    keys.append(((d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)))
                    sizes.append(max(0, len(words) - SHINGLE + 1) or bool(words))
                    if words:
                        bags.append(bag(shingles(hashes(words))))
                        with_words.append(i)
                bands: list = [[]] * part.num_rows
                for i, row in zip(with_words, bands_of(signatures(bags)), strict=True):
                    bands[i] = row
                yield pa.RecordBatch.from_arrays([part["id"], part["at"], pa.array([a for a, _ in keys], pa.int64()), pa.array([b for _, b in keys], pa.int64()), pa.array([int(n) for n in sizes], pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("doc_id", "text").alias("at"), "text")
    return rows.mapInArrow(run, "id bigint, at bigint, k1 bigint, k2 bigint, n bigint, bands array<bigint>")


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) pairs of nodes whose texts are similar enough."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    # Sorted by b by the join, so that the text that many pairs share is cut up once.
    both = pairs.join(left, "a").join(right.hint("merge"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, last_bag = WordHashes(), None, None
        for batch in batches:
            a, b, ok = batch["a"].to_pylist(), batch["b"].to_pylist(), []
            for i in range(batch.num_rows):
                if b[i] != last:
                    last, last_bag = b[i], bag(shingles(hashes(words_of(batch["text_b"][i].as_py()))))
                if similarity(bag(shingles(hashes(words_of(batch["text_a"][i].as_py())))), last_bag) >= threshold:
                    ok.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in ok], pa.int64()), pa.array([b[i] for i in ok], pa.int64())], ["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def _unique_shingles(texts: DataFrame) -> DataFrame:
    """(node, alone): how many of a text's shingles, copies counted apart, no other of these texts has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for node, text in zip(batch["node"].to_pylist(), batch["text"], strict=True):
                item, count = bag(shingles(hashes(words_of(text.as_py()))))
                nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                with np.errstate(over="ignore"):
                    unit = mix(np.repeat(item, count) + GOLDEN * nth.astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unit), node), pa.int64()), pa.array(unit.view(np.int64))], ["node", "unit"])

    units = texts.mapInArrow(run, "node bigint, unit bigint")
    return units.groupBy("unit").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1").groupBy("node").agg(F.count("*").alias("alone"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row per document: id, at, class_id, class_size, first_id, kept.

    ``class_id`` names a class by a row number that no other class has, whatever
    the documents' ids; ``first_id`` is its least id.  ``kept`` marks one row of
    each class, the one with the least id.
    """
    signed = keep(sign(docs).withColumn("rid", F.monotonically_increasing_id()), "signed")
    # Equal texts first: a node per text.  Copies are counted where they are read.
    first_row = F.min(F.struct(F.col("id").isNull(), "id", "rid")).alias("one")
    nodes = keep(signed.groupBy("k1", "k2").agg(F.min("rid").alias("node"), F.count("*").alias("copies"), first_row, F.min_by(F.struct("id", "at", "n", "bands"), "rid").alias("r")).select("k1", "k2", "node", "copies", "one", "r.*"), "nodes")
    members = keep(nodes.select("node", F.explode("bands").alias("bucket")), "members")
    full = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = keep(members.join(full, "bucket"), "shared")
    central = shared.groupBy("node").agg(F.sum("size").alias("central"))
    heads = shared.join(central, "node").groupBy("bucket").agg(F.max_by("node", F.struct("central", -F.col("node"))).alias("b"))
    met = keep(shared.select("bucket", "node").join(heads, "bucket"), "met")
    first = keep(met.where("node <> b").select(F.col("node").alias("a"), "b").distinct(), "pairs")

    def texts_of(pairs: DataFrame) -> DataFrame:
        """(node, text) of the nodes of ``pairs``."""
        used = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        at = nodes.select("node", F.col("id").alias("node_id"), F.col("at").alias("node_at")).join(used, "node", "left_semi")
        rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("doc_id", "text").alias("at"), "text")
        found = rows.join(at.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("node_id")) & (F.col("at") == F.col("node_at")))
        return keep(found.select("node", "text"), "texts")

    links = keep(_verify(first, texts_of(first), threshold), "links")
    done = connected_components(links, "a", "b")
    placed = met.join(done, "node", "left").select("bucket", "node", "b", F.coalesce("component", "node").alias("component"))
    split = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    open_ = keep(placed.join(split, "bucket", "left_semi"), "open")
    if open_.isEmpty():
        more = None
    else:
        alone = _unique_shingles(texts_of(open_.select(F.col("node").alias("a"), F.col("node").alias("b"))))
        able = open_.join(nodes.select("node", "n"), "node").join(alone, "node", "left")
        able = able.withColumn("s", F.col("n") - F.coalesce("alone", F.lit(0))).where(F.col("s") >= F.lit(threshold) * F.col("n") - 1e-6)
        # A pair that shares several buckets is made in the first of them only.
        able = able.join(able.groupBy("node").agg(F.array_sort(F.collect_set("bucket")).alias("all")), "node")
        left = able.select("bucket", F.col("node").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("s").alias("sx"), F.col("all").alias("ax"))
        right = able.select("bucket", F.col("node").alias("y"), F.col("component").alias("cy"), F.col("n").alias("ny"), F.col("s").alias("sy"), F.col("all").alias("ay"))
        need = F.lit(threshold / (1 + threshold)) * (F.col("nx") + F.col("ny")) - 1e-6
        more = left.join(right, "bucket").where((F.col("cx") < F.col("cy")) & (F.least("sx", "sy") >= need) & (F.array_min(F.array_intersect("ax", "ay")) == F.col("bucket")))
        more = more.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        either = first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        more = keep(more.join(either, ["a", "b"], "left_anti"), "more-pairs")
    if more is not None and not more.isEmpty():
        # Only what joins two components is new: the graph of components is small.
        found = _verify(more, texts_of(more), threshold)
        part = lambda end: done.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        bridges = found.join(part("a"), "a", "left").join(part("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        joined = keep(connected_components(bridges, "a", "b").select("node", F.col("component").alias("to")), "bridges")
        nodes = nodes.join(done, "node", "left").withColumn("component", F.coalesce("component", "node")).join(joined.withColumnRenamed("node", "component"), "component", "left")
        nodes = nodes.withColumn("component", F.coalesce("to", "component"))
    else:
        nodes = nodes.join(done, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # Copies were counted with their text, so that a class is as many rows as it has texts.
    placed = keep(nodes.select("k1", "k2", "component", "copies", "one"), "placed")
    best = keep(placed.groupBy("component").agg(F.sum("copies").alias("class_size"), F.count("*").alias("texts"), F.min("one").alias("best")), "classes")
    classed = keep(join_by_weight(placed, best, ["component"], "texts"), "placed-classes")
    rows = join_by_weight(signed.select("id", "at", "rid", "k1", "k2"), classed, ["k1", "k2"], "copies")
    return rows.select("id", "at", F.col("component").alias("class_id"), "class_size", F.col("best.id").alias("first_id"), (F.col("rid") == F.col("best.rid")).alias("kept"))
