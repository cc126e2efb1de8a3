"""The queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprint, jaccard, langid, pieces, pii, quality, toxicity, warc, wrapper
from ._common import held_out, tables


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.train(documents, table(spark, sf_dir, "labels"), lambda c: ~held_out(c, 3, 1))
    scored = quality.score(documents.select("doc_id", "text"), model, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.train(documents, table(spark, sf_dir, "labels"), lambda c: ~held_out(c, 4, 2))
    scored = toxicity.score(documents.select("doc_id", "text"), model, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{tables(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.report(warc.read_archive(spark, path))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_text(table(spark, sf_dir, "pages"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = langid.train(documents, lambda c: ~held_out(c, 3, 1))
    answered = langid.predict(documents.select("doc_id", "text"), model, keep=["doc_id"])
    return answered.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_quality, op2_sentencepiece, op3_fingerprint, op4_toxicity, op5_jaccard_join, op6_warc, op7_html, op8_decontaminate, op9_pii, op10_langid)}

#: Text with A-Z as a-z, and no text as an empty one.
LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: DuckDB twins. Trained models, a tokenizer's merges, sketches, tree alignment and learnt patterns are beyond SQL.
ORACLES: dict[str, str] = {
    "op6_warc": """WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
        f AS (SELECT d, min(page_id) AS m FROM p WHERE n >= 100 GROUP BY d)
        SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN m IS NULL OR m = page_id THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN m <> page_id THEN m END AS refers_to FROM p LEFT JOIN f USING (d)""",
    "op5_jaccard_join": rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT r, doc_id, list_distinct([array_to_string(w[i + 1:i + least(5, len(w))], ' ') FOR i IN range(0, CASE WHEN len(w) = 0 THEN 0 ELSE len(w) - least(5, len(w)) + 1 END)]) AS h FROM d),
        t AS (SELECT min(r) AS r, list_sort(h) AS h, len(h) AS n FROM s GROUP BY ALL),
        e AS (SELECT r, n, unnest(h) AS x FROM t),
        p AS (SELECT a.r AS i, b.r AS j FROM e a JOIN e b ON a.x = b.x AND a.r <> b.r GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        g(r, m) AS (SELECT r, r FROM t WHERE n > 0 UNION SELECT g.r, p.j FROM g JOIN p ON p.i = g.m),
        k AS (SELECT s.r, s.doc_id, CAST(len(s.h) AS BIGINT) AS n_shingles, t.r AS c FROM s JOIN t ON list_sort(s.h) = t.h),
        f AS (SELECT c, min(doc_id) AS first FROM k GROUP BY c),
        q AS (SELECT g.r AS c, min(first) AS least FROM g JOIN f ON f.c = g.m GROUP BY g.r)
        SELECT doc_id, n_shingles, coalesce(least, doc_id) AS component_id FROM k LEFT JOIN q USING (c)""",
    "op8_decontaminate": rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
        i AS (SELECT DISTINCT item, least(8, len(w)) AS n, unnest([array_to_string(w[i + 1:i + least(8, len(w))], ' ') FOR i IN range(0, len(w) - least(8, len(w)) + 1)]) AS x FROM b WHERE len(w) > 0),
        v AS (SELECT r, n, unnest(range(0, len(w) - n + 1)) AS pos, unnest([array_to_string(w[i + 1:i + n], ' ') FOR i IN range(0, len(w) - n + 1)]) AS x FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n),
        h AS (SELECT r, v.n, pos, item FROM v JOIN i ON v.n = i.n AND v.x = i.x),
        c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(pos, pos + n)) AS p FROM h) GROUP BY r),
        o AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
        FROM d LEFT JOIN c USING (r) LEFT JOIN o USING (r)""",
}
