"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader with elastic-net penalties on a bounded sample (``max_rows`` documents by the smallest id hash, whose
n-grams all count; and at most ``max_bytes`` of n-grams in all), then calibrated by a temperature on a part of the sample that was kept aside.
Prediction reads every whole text.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SAMPLE_BYTES, derive, sampled_features, sparse
from .ftrl import Ftrl, softmax, temperature

UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    weights: np.ndarray  # buckets x languages, idf included; the intercepts last
    heat: float
    bits: int


@cache
def _classes() -> tuple[re.Pattern, re.Pattern]:
    """Patterns of one letter (general category L) and of a run of signs that are neither letters nor marks (category M)."""
    runs: dict[str, list[list[int]]] = {"L": [], "M": []}
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in runs:
            if runs[kind] and runs[kind][-1][1] == c - 1:
                runs[kind][-1][1] = c
            else:
                runs[kind].append([c, c])
    signs = {kind: "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in found) for kind, found in runs.items()}
    return re.compile(f"[{signs['L']}]"), re.compile(f"[^{signs['L']}{signs['M']}]+")


def featuriser(bits: int, largest: int = 3):
    """Function from a text to the hash buckets of its lower-case letter n-grams, n = 1 to ``largest``; marks belong to their letters, runs of other signs are one space. Without a letter there are none."""
    letter, other = _classes()
    shift, factor = np.uint64(64 - bits), np.uint64(0x100000001B3)

    def buckets(text: str | None) -> np.ndarray:
        if not text or not letter.search(text):
            return np.empty(0, np.int64)
        letters = other.sub(" ", text).lower().strip()
        a = np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        found, h = [], np.zeros(len(a), np.uint64)
        for n in range(largest):
            h = h[: len(a) - n] * factor + a[n:] + np.uint64(n + 1)
            found.append((h * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int64))
        return np.concatenate(found)

    return buckets


def train(documents: DataFrame, usable, bits: int = 16, max_rows: int = 3000, max_bytes: int = SAMPLE_BYTES, epochs: int = 4, aside: float = 0.2) -> LanguageModel:
    """Fits on rows with a non-null lang whose id is ``usable``. Without such rows the model knows no language and answers ``und`` always."""
    spark = documents.sparkSession
    known = documents.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & usable(F.col("doc_id")))
    ids = [(int(r[0]),) for r in known.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).collect()]
    languages = tuple(sorted(r[0] for r in known.select(F.col("lang").cast("string")).distinct().collect()))
    if not ids:
        return LanguageModel((), np.zeros(((1 << bits) + 1, 0), np.float32), 1.0, bits)
    sample = known.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).join(F.broadcast(spark.createDataFrame(ids, "doc_id long")), "doc_id")

    def make():
        buckets = featuriser(bits)

        def features(texts):
            found = []
            for text in texts:
                b = buckets(text)
                at, count = np.unique(b, return_counts=True)
                found.append((at.astype("<i4").tobytes(), (count / max(len(b), 1)).astype("<f4").tobytes()))
            return [[f[0] for f in found], [f[1] for f in found]]

        return features

    got = [r for r in sampled_features(sample, make, ["lang"], max_bytes) if r["at"]]
    if not got:
        return LanguageModel((), np.zeros(((1 << bits) + 1, 0), np.float32), 1.0, bits)
    rows = sparse(got)
    y = np.array([languages.index(r["lang"]) for r in got])
    seen = np.bincount(np.concatenate([a for a, _ in rows]), minlength=1 << bits)
    idf = np.log((1 + len(rows)) / (1 + seen)) + 1
    rows = [(a, (10 * x * idf[a]).astype(np.float32)) for a, x in rows]
    kept = int(len(rows) * (1 - aside)) or len(rows)
    order = np.random.default_rng(3).permutation(len(rows))
    w = Ftrl(1 << bits, len(languages), alpha=0.5, l1=0.002, l2=0.002).fit([rows[i] for i in order[:kept]], y[order[:kept]], epochs)
    rest = order[kept:]
    logits = np.array([x @ w[a] + w[-1] for a, x in (rows[i] for i in rest)]).reshape(len(rest), len(languages))
    heat = temperature(logits, y[rest])
    w[:-1] *= 10 * idf[:, None]
    return LanguageModel(languages, w.astype(np.float32), heat, bits)


def predict(documents: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score, the calibrated probability of lang_pred. A null text and one without letters are ``und`` with score 0.0; extra columns stay."""
    shared = documents.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.heat, model.bits))

    def make():
        languages, weights, heat, bits = shared.value
        buckets = featuriser(bits)

        def answers(texts):
            names, scores = [], []
            for text in texts:
                b = buckets(text)
                if not len(b) or not languages:
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                total = np.zeros(len(languages))
                for start in range(0, len(b), 1 << 16):
                    total += weights[b[start : start + (1 << 16)]].sum(axis=0, dtype=np.float64)
                p = softmax((total / len(b) + weights[-1]) / heat)
                names.append(languages[int(p.argmax())])
                scores.append(float(p.max()))
            return [names, scores]

        return answers

    return derive(documents, make, ["text"], "lang_pred string, score double", keep)
