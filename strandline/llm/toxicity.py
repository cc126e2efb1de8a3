"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017), in numpy, from confirmed toxic examples and unlabelled text.

The sample is bounded: ``max_positive`` toxic documents and ``max_unlabelled`` documents of any kind, by the smallest id hash, whose words
all count; and at most ``max_bytes`` of words in all. Scoring reads every whole text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SAMPLE_BYTES, Hashes, derive, sampled_features, sparse

WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray  # one per bucket, the intercept last
    bits: int


#: Lengths of the word beginnings that count besides the word, as insults are inflected and compounded.
STEMS = (5, 6, 7, 8)
#: So many standard errors tell a bucket from chance among all 2^18 of them.
LEAST_Z = 6.0


class _Buckets(dict):
    """From a word to the hash buckets of the word and its beginnings, remembered up to a bound; ``wanted`` drops the buckets where it is false."""

    def __init__(self, bits: int, wanted: np.ndarray | None = None, bound: int = 100_000):
        super().__init__()
        self.shift, self.wanted, self.bound, self.digest = 64 - bits, wanted, bound, Hashes().digest

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.bound:
            self.clear()
        parts = [word, *(f"{word[:n]}\0" for n in STEMS if len(word) > n)]
        found = tuple(b for b in (self.digest(p) >> self.shift for p in parts) if self.wanted is None or self.wanted[b])
        self[word] = found
        return found


def featuriser(bits: int, wanted: np.ndarray | None = None):
    """Function from a text to (buckets with repetition, number of words)."""
    known = _Buckets(bits, wanted)

    def buckets(text: str | None) -> tuple[np.ndarray, int]:
        words = WORD.findall((text or "").lower())
        return np.array([b for w in words for b in known[w]], np.int64), len(words)

    return buckets


class Sparse:
    """Rows (columns, values) one after the other, with the products that a linear model needs."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], columns: int):
        lengths = np.array([len(a) for a, _ in rows], np.int64)
        self.columns, self.ends = columns, np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.at = np.concatenate([a for a, _ in rows]).astype(np.int32) if rows else np.empty(0, np.int32)
        self.x = np.concatenate([x for _, x in rows]).astype(np.float32) if rows else np.empty(0, np.float32)

    def __len__(self) -> int:
        return len(self.ends)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(row number, column, value) of each entry of the rows, and how many rows."""
        lengths = self.ends[rows] - self.starts[rows]
        owner = np.repeat(np.arange(len(rows)), lengths)
        entry = np.arange(len(owner)) + np.repeat(self.starts[rows] - (np.cumsum(lengths) - lengths), lengths)
        return owner, self.at[entry], self.x[entry], len(rows)


def _times(part, w: np.ndarray) -> np.ndarray:
    owner, at, x, n = part
    return np.bincount(owner, x * w[at], n) + w[-1]


def _back(part, g: np.ndarray, size: int) -> np.ndarray:
    """The mean of the rows, each times its value of ``g``; the constant column comes last."""
    owner, at, x, n = part
    out = np.bincount(at, x * g[owner], size)
    out[-1] += g.sum()
    return out / n


def _weighed(rows: list[tuple[np.ndarray, np.ndarray]], columns: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows over the places in the sorted bucket list ``columns``; the square root of a word's share of the text, so that one mention in a long text still counts."""
    out = []
    for at, x in rows:
        i = np.minimum(np.searchsorted(columns, at), max(len(columns) - 1, 0))
        ok = columns[i] == at if len(columns) else np.zeros(len(at), bool)
        out.append((i[ok], 10 * np.sqrt(x[ok])))
    return out


def nnpu(positive: Sparse, unlabelled: Sparse, prior: float, steps: int = 600, rate: float = 0.05, l1: float = 5e-3, batch: int = 1024, seed: int = 5) -> np.ndarray:
    """Weights of the linear model that lowers pi*E_p[l(+)] + max(0, E_u[l(-)] - pi*E_p[l(-)]), l being the logistic loss; the intercept comes last.

    Where the second part turns negative, its gradient is followed the other way (the paper's correction). Adam steps, then soft thresholds.
    """
    rng = np.random.default_rng(seed)
    size = positive.columns + 1
    w = np.zeros(size)
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda s: 1 / (1 + np.exp(-np.clip(s, -35, 35)))
    softplus = lambda s: np.logaddexp(0, s)
    for step in range(1, steps + 1):
        p = positive.take(rng.permutation(len(positive))[:batch])
        u = unlabelled.take(rng.permutation(len(unlabelled))[:batch])
        sp, su = _times(p, w), _times(u, w)
        negative = softplus(su).mean() - prior * softplus(sp).mean()
        g_negative = _back(u, sigmoid(su), size) - prior * _back(p, sigmoid(sp), size)
        g_positive = -prior * _back(p, sigmoid(-sp), size)
        g = g_positive + g_negative if negative >= 0 else -g_negative
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        now = rate * (1 - step / (steps + 1))
        w = w - now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - now * l1 * 10, 0)
    return w


def train(documents: DataFrame, labels: DataFrame, usable, bits: int = 18, max_positive: int = 2000, max_unlabelled: int = 6000, max_bytes: int = SAMPLE_BYTES, prior: float | None = None, least_z: float = LEAST_Z, **options) -> ToxicityModel:
    """Fits on rows whose id is ``usable``; the class prior defaults to the share of toxic rows among all labels of usable rows.

    Columns are all buckets that occur in 3 or more positives (in all, if there are fewer) and are over-represented there by ``least_z`` standard errors of the difference of shares; the penalty selects among them.
    Without toxic examples every score is 0.0. Null texts count as empty; labels of a repeated id count once, toxic if any is.
    """
    spark = documents.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & usable(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    total, toxic = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    none = ToxicityModel(np.append(np.zeros(1 << bits), -35.0).astype(np.float32), bits)
    if not toxic:
        return none
    prior = prior if prior is not None else min(max(toxic / total, 1e-4), 0.9)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & usable(F.col("doc_id")))
    ids = {int(r[0]): 1 for r in known.where("y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positive).collect()}
    for r in texts.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(max_unlabelled).collect():
        ids[int(r[0])] = ids.get(int(r[0]), 0) + 2  # a positive one may be among the unlabelled ones
    sample = texts.join(F.broadcast(spark.createDataFrame(sorted(ids.items()), "doc_id long, part int")), "doc_id")

    def make():
        buckets = featuriser(bits)

        def features(texts):
            found = []
            for text in texts:
                b, n = buckets(text)
                at, count = np.unique(b, return_counts=True)
                found.append((at.astype("<i4").tobytes(), (count / max(n, 1)).astype("<f4").tobytes()))
            return [[f[0] for f in found], [f[1] for f in found]]

        return features

    got = sampled_features(sample, make, ["part"], max_bytes)
    positive, unlabelled = sparse([r for r in got if r["part"] & 1]), sparse([r for r in got if r["part"] & 2])
    if not positive or not unlabelled:
        return none
    in_p, in_u = (np.bincount(np.concatenate([a for a, _ in rows]), minlength=1 << bits) for rows in (positive, unlabelled))
    pooled = (in_p + in_u) / (len(positive) + len(unlabelled))
    error = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / len(positive) + 1 / len(unlabelled)))
    columns = np.flatnonzero((in_p >= min(3, len(positive))) & (in_p / len(positive) - in_u / len(unlabelled) >= least_z * error))
    w = nnpu(Sparse(_weighed(positive, columns), len(columns)), Sparse(_weighed(unlabelled, columns), len(columns)), prior, **options)
    weights = np.zeros((1 << bits) + 1, np.float32)
    weights[columns], weights[-1] = w[:-1], w[-1]
    return ToxicityModel(weights, bits)


def score(documents: DataFrame, model: ToxicityModel, column: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Adds ``column``, the probability of toxicity in 0 to 1. Null and empty texts get the intercept's; repeated rows equal scores; extra columns stay."""
    shared = documents.sparkSession.sparkContext.broadcast((model.weights, model.bits))

    def make():
        weights, bits = shared.value
        buckets, bias = featuriser(bits, weights != 0), float(weights[-1])

        def scores(texts):
            out = []
            for text in texts:
                b, n = buckets(text)
                hit, count = np.unique(b, return_counts=True)
                s = bias + float(weights[hit] @ (10 * np.sqrt(count / max(n, 1))))
                out.append(float(1 / (1 + np.exp(-np.clip(s, -35, 35)))))
            return [out]

        return scores

    return derive(documents, make, ["text"], f"{column} double", keep)
