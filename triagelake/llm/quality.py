"""Quality by compression: zstandard dictionaries from good and from bad text.

A text is cut into stretches; each is compressed with either dictionary.  Text
like the good samples gets smaller with theirs.  The difference of the two sizes
over the text's own size, calibrated by a logistic regression on other labelled
rows than the dictionaries came from, is the score.

Cases: null and empty texts are scored as texts of no length; texts of any
length are compressed whole, stretch by stretch; repeated rows get the same
score; with labels of one kind or none every text gets the same score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from ..operators.scratch import drop, keep
from .fitting import Logistic, fold, labelled_sample

#: Bytes of a stretch, and the level of compression.
STRETCH, LEVEL = 1024, 3
FEATURES = 7


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: Logistic | None = None


class Sizer:
    """Compressed sizes of a text with both dictionaries and with none."""

    def __init__(self, model: Model) -> None:
        self.by = []
        for raw in (model.good, model.bad):
            params = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
            if raw:
                d = zstandard.ZstdCompressionDict(raw)
                d.precompute_compress(level=LEVEL)
                params["dict_data"] = d
            self.by.append(zstandard.ZstdCompressor(**params))
        self.plain = zstandard.ZstdCompressor(level=1, write_content_size=False)

    def features(self, text: str) -> list[float]:
        raw = text.encode("utf-8", "replace")
        if not raw:
            return [0.0] * FEATURES
        parts = [raw[k : k + STRETCH] for k in range(0, len(raw), STRETCH)]
        good, bad = ([len(c.compress(p)) for p in parts] for c in self.by)
        each = [(b - g) / (b + g) for g, b in zip(good, bad, strict=True) if g + b > 40] or [0.0]
        diff, plain = (sum(bad) - sum(good)) / (sum(bad) + sum(good)), len(self.plain.compress(raw)) / len(raw)
        return [diff, min(each), max(each), sum(good) / len(raw), plain, max(0.0, 0.3 - plain), float(np.log1p(len(raw)))]


def train_dictionary(texts: list[str], size: int = 65_536) -> bytes:
    """A dictionary of the texts' common strings; of a few texts, their own bytes."""
    samples = [raw[k : k + 4 * STRETCH] for t in texts for raw in [t.encode("utf-8", "replace")] for k in range(0, len(raw), 4 * STRETCH)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, rows: int = 6_000, max_bytes: int = 32_768, dictionary_chars: int = 6_000_000) -> Model:
    """Learn from at most ``rows`` labelled documents outside the held-out fold.

    A label's dictionary is built from at most ``dictionary_chars`` characters of
    them, in the order of the sample's hash, and a text more.

    Half of them give the dictionaries, the other half the calibration.
    """
    sample = keep(labelled_sample(docs, labels, "quality", folds, held_out, rows, max_bytes).withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2))), "quality-sample")
    texts: dict[int, list[str]] = {0: [], 1: []}
    room = {0: dictionary_chars, 1: dictionary_chars}
    for r in sample.where("half = 0").orderBy(F.xxhash64("doc_id"), "doc_id", "text").toLocalIterator():
        if room[r["y"]] > 0:
            texts[r["y"]].append(r["text"])
            room[r["y"]] -= len(r["text"])
    model = Model(*(train_dictionary(texts[y]) if texts[y] else b"" for y in (1, 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["y"], pa.array([sizer.features(t) for t in batch["text"].to_pylist()], pa.list_(pa.float64()))], ["y", "features"])

    # Bounded by ``rows``: a few numbers each.
    got = sample.where("half = 1").select(F.col("y").cast("int").alias("y"), "text").mapInArrow(run, "y int, features array<double>").collect()
    prior = labels.where(F.col("quality").isin(0, 1) & (fold(F.col("doc_id"), folds) != held_out)).agg(F.avg("quality")).first()[0]
    model.weights = Logistic(np.array([r["features"] for r in got], dtype=float).reshape(-1, FEATURES), np.array([r["y"] for r in got], dtype=float), prior=min(max(prior or 0.5, 0.02), 0.98))
    drop(sample)
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, at: hash of the row, score, predicted) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(model)
        for batch in batches:
            x = np.array([sizer.features(t or "") for t in batch["text"].to_pylist()], dtype=float).reshape(-1, FEATURES)
            s = model.weights.score(x)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["at"], pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "at", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("doc_id", "text").alias("at"), "text")
    return rows.mapInArrow(run, "doc_id bigint, at bigint, score double, predicted int")
