"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A fingerprint is the base64 text of the ``K`` smallest distinct 48-bit shingle hashes in ascending order. Fingerprints of parts merge into that
of the whole, and they estimate resemblance, containment and the number of distinct shingles. No words give the empty fingerprint.
"""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import derive, even_keys, generate, partitions, shingle_hashes

K = 128
BITS = 48


def sketch(text: str | None, k: int = K) -> np.ndarray:
    """The ``k`` smallest distinct hashes; the top 48 bits of each, so that order is kept."""
    h = shingle_hashes(text)
    return np.unique(h[: 2 * k] >> np.uint64(64 - BITS))[:k]


def pack(values: np.ndarray) -> str:
    """Base64 of the values as 6-byte big-endian integers: 8 signs each."""
    return base64.b64encode(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def unpack(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (2, 0))).copy().view(">u8").reshape(-1).astype(np.uint64)


def merge(a: str, b: str, k: int = K) -> str:
    """The fingerprint of the union of both shingle sets."""
    return pack(np.union1d(unpack(a), unpack(b))[:k])


def _union(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    return np.union1d(x, y)[:k]


def resemblance(x: np.ndarray, y: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity, exact for small sets: the share of the union's ``k`` smallest hashes that are in both. Two empty sets: 1.0; one: 0.0."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = np.concatenate([x, y])
    both.sort()
    same = both[1:] == both[:-1]
    first = np.append(True, ~same)
    rank = np.cumsum(first)
    return float((same & (rank[1:] <= k)).sum() / min(k, int(rank[-1])))


def distinct(x: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below ``k``."""
    return float(len(x)) if len(x) < k else (k - 1) * float(2**BITS) / max(float(x[k - 1]), 1.0)


def containment(x: np.ndarray, y: np.ndarray, k: int = K) -> float:
    """Estimated share of x's shingles that are in y; 1.0 for an empty x."""
    if not len(x):
        return 1.0
    together = distinct(_union(x, y, k), k)
    return float(min(1.0, resemblance(x, y, k) * together / distinct(x, k)))


def fingerprints(documents: DataFrame, keep: list[str] | None = None, k: int = K) -> DataFrame:
    """Adds ``fingerprint``. Null and empty texts have the empty one, equal texts equal ones; extra columns stay."""

    def make():
        return lambda texts: [[pack(sketch(t, k)) for t in texts]]

    return derive(documents, make, ["text"], "fingerprint string", keep)


def merged(fingerprinted: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """(the columns ``by``, fingerprint): for each group the fingerprint of all its parts together. Null fingerprints count as empty; nulls in ``by`` are a group; other columns are left out.

    Parts are merged in each task first, so a group sends one fingerprint a task, however many parts it has.
    """
    held = fingerprinted.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(by)], F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))
    keys = [f"k{i}" for i in range(len(by))]

    def make():
        def run(rows):
            at, now = None, np.empty(0, np.uint64)
            for *key, text in rows:
                if key != at:
                    if at is not None:
                        yield (*at, pack(now))
                    at, now = key, np.empty(0, np.uint64)
                now = _union(now, unpack(text), k)
            if at is not None:
                yield (*at, pack(now))

        return run

    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema)
    parts = generate(held.sortWithinPartitions(*keys), make, out)
    whole = generate(parts.repartition(partitions(held.sparkSession), *keys).sortWithinPartitions(*keys), make, out)
    return whole.toDF(*by, "fingerprint")


def compared(pairs: DataFrame, a: str, b: str, k: int = K) -> DataFrame:
    """Adds resemblance, containment (of a in b), distinct_a, distinct_b and distinct_both, estimated from the fingerprints in the columns ``a`` and ``b``; nulls count as empty."""

    def make():
        def run(left, right):
            out = []
            for x, y in zip(left, right, strict=True):
                x, y = unpack(x or ""), unpack(y or "")
                out.append((resemblance(x, y, k), containment(x, y, k), distinct(x, k), distinct(y, k), distinct(_union(x, y, k), k)))
            return list(zip(*out, strict=True))

        return run

    return derive(pairs, make, [a, b], "resemblance double, containment double, distinct_a double, distinct_b double, distinct_both double")


def compare_with_next(documents: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of each text and its edited text: the last quarter of its code points gives way to the first as many of the next document's.

    The next document follows in ascending (doc_id, text), nulls first; after the last comes the first, so one document follows itself, and repeated rows one
    another. Null texts count as empty; an empty table gives none; extra columns are left out. Rows are dealt by ranges of doc_id,
    between bounds taken from quantiles of all ids; each range's first row also goes to the range before it, so one shuffle of the texts
    is enough, and a task streams through its sorted rows with one row ahead. Bounds and first ids are one per partition.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n = partitions(spark)
    cuts = sorted(set(rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    bucket = F.lit(0)
    if cuts:  # the number of bounds at or below the id, by bisection: the expression is as deep as log2 of the partitions
        def place(low: int, high: int):
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(F.col("doc_id") >= F.lit(int(cuts[middle])), place(middle + 1, high)).otherwise(place(low, middle))

        bucket = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(place(0, len(cuts)))
    placed = rows.select(bucket.alias("bucket"), "doc_id", "text")
    heads = sorted((int(r[0]), r[1]) for r in placed.groupBy("bucket").agg(F.min(F.coalesce(F.col("doc_id"), F.lit(-(2**63))))).collect())
    if not heads:
        return spark.createDataFrame([], OUT)
    first = {heads[i][0]: (heads[i][1], heads[i - 1][0]) for i in range(len(heads))}
    at = lambda i, kind: F.get(F.array(*[F.lit(first[b][i] if b in first else None).cast(kind) for b in range(len(cuts) + 1)]), F.col("bucket"))
    giver = F.when(F.coalesce(F.col("doc_id"), F.lit(-(2**63))) == at(0, "long"), at(1, "int"))
    both = F.array(F.struct(F.col("bucket").alias("to"), F.lit(0).alias("lent")), F.struct(giver.alias("to"), F.lit(1).alias("lent")))
    dealt = placed.withColumn("x", F.explode(F.filter(both, lambda s: s["to"].isNotNull()))).select(F.col("x.to").alias("bucket"), F.col("x.lent").alias("lent"), "doc_id", "text")
    key = F.get(F.array(*map(F.lit, even_keys(spark, n))), F.col("bucket"))  # one range a task
    ordered = dealt.withColumn("key", key).repartition(n, "key").sortWithinPartitions("bucket", "lent", F.col("doc_id").asc_nulls_first(), "text").drop("key")

    def make():
        from hashlib import sha256

        def pair(this, after):
            text, sketched, doc_id = this
            cut = len(text) // 4
            edited = text[: len(text) - cut] + after[0][:cut]
            changed = sketch(edited, k)
            digest = sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            return doc_id, len(text), digest, pack(sketched), pack(changed), resemblance(sketched, changed, k), resemblance(sketched, after[1], k)

        def run(rows):
            this, at, done = None, None, False
            for to, lent, doc_id, text in rows:
                if to != at:
                    this, at, done = None, to, False
                if done:
                    continue
                now = (text, sketch(text, k), doc_id)
                if this is not None:
                    yield pair(this, now)
                this, done = now, bool(lent)

        return run

    return generate(ordered, make, OUT)


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
