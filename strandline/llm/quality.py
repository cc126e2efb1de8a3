"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader, scored as sparse dot products.

Training uses a bounded sample of labelled rows (``max_rows`` documents with the smallest id hashes, whose n-grams all count; and at most
``max_bytes`` of n-grams in all); scoring reads every whole text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SAMPLE_BYTES, Hashes, derive, mix, sampled_features, sparse
from .ftrl import Ftrl

#: A word, or a run of other visible signs.
TOKEN = re.compile(r"\w+|[^\w\s]+")


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  # one per bucket, the intercept last
    bits: int


def featuriser(bits: int):
    """Function from a text to the hash buckets of its word n-grams (n = 1 to 3, with repetition): a 2-gram of equal words is one bucket whatever the word, and a 3-gram whose ends are one word counts in a bucket of its own too."""
    hashes = Hashes()
    shift = np.uint64(64 - bits)
    again = mix(np.array([2, 3], np.uint64))

    def buckets(text: str | None) -> np.ndarray:
        h = hashes.of(TOKEN.findall((text or "").lower()))
        if not len(h):
            return np.empty(0, np.int64)
        two = np.where(h[1:] == h[:-1], again[0], mix(h[:-1] * np.uint64(3) + h[1:]))
        three = mix((h[:-2] * np.uint64(5) + h[1:-1]) * np.uint64(3) + h[2:])
        framed = again[np.ones(int((h[2:] == h[:-2]).sum()), np.int64)]
        return (np.concatenate([mix(h), two, three, framed]) >> shift).astype(np.int64)

    return buckets


def _scale(n: int) -> float:
    """Occurrences weigh by frequency, so that a text's length doesn't matter."""
    return 20.0 / max(n, 1)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, usable, max_rows: int) -> DataFrame:
    """(doc_id, text, y) of at most ``max_rows`` labelled rows with usable ids, by the smallest id hash. Only their ids, bounded by ``max_rows``, are broadcast."""
    spark = documents.sparkSession
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & usable(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).collect()
    small = spark.createDataFrame([(int(r[0]), int(r[1])) for r in chosen], "doc_id long, y int")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(small), "doc_id")


def train(documents: DataFrame, labels: DataFrame, usable, label: str = "quality", bits: int = 18, max_rows: int = 4000, max_bytes: int = SAMPLE_BYTES, epochs: int = 5) -> QualityModel:
    """Fits on rows whose id is ``usable`` (a function of the id column). Without labelled rows every score is 0.5; null texts count as empty."""

    def make():
        buckets = featuriser(bits)

        def features(texts):
            found = []
            for text in texts:
                b = buckets(text)
                at, count = np.unique(b, return_counts=True)
                found.append((at.astype("<i4").tobytes(), (count * _scale(len(b))).astype("<f4").tobytes()))
            return [[f[0] for f in found], [f[1] for f in found]]

        return features

    sample = sampled_features(labelled_sample(documents, labels, label, usable, max_rows), make, ["y"], max_bytes)
    if not sample:
        return QualityModel(np.zeros((1 << bits) + 1, np.float32), bits)
    y = np.array([r["y"] for r in sample])
    return QualityModel(Ftrl(1 << bits, 1, alpha=0.3, l1=0.01, l2=0.01).fit(sparse(sample), y, epochs)[:, 0].astype(np.float32), bits)


def score(documents: DataFrame, model: QualityModel, column: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Adds ``column``, the probability of good quality in 0 to 1. Null and empty texts get the intercept's probability; repeated rows get equal scores; extra columns stay."""
    shared = documents.sparkSession.sparkContext.broadcast((model.weights, model.bits))

    def make():
        weights, bits = shared.value
        buckets, bias = featuriser(bits), float(weights[-1])

        def scores(texts):
            out = []
            for text in texts:
                b = buckets(text)
                s = bias + float(weights[b].sum(dtype=np.float64)) * _scale(len(b))
                out.append(float(1 / (1 + np.exp(-np.clip(s, -35, 35)))))
            return [out]

        return scores

    return derive(documents, make, ["text"], f"{column} double", keep)
