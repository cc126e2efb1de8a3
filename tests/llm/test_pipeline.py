import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import decontaminate

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    from test_operators import prose as p

    return p(seed, n)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    good = [(i, prose(i, 60), "en", "s", 0) for i in range(90)]
    bad = [(i, prose(i, 60).upper().replace(" ", "!! "), "en", "s", 0) for i in range(90, 180)]
    item = prose(500, 12)
    extra = [(200, prose(1, 60), "en", "s", 0), (201, f"{prose(300, 30)} {item} {prose(301, 30)}", "en", "s", 0), (202, f"{prose(302, 40)} bob@mail.example.com {prose(303, 30)}", "en", "s", 0), (203, None, None, None, None), (None, prose(310, 50), None, None, None)]
    documents = spark.createDataFrame(good + bad + extra, COLUMNS)
    documents.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 90), 0) for r in good + bad], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.columns, spark.createDataFrame(stage(spark, docs, folder).collect(), COLUMNS)
        assert docs.columns == before
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert not set(range(90, 180)) & set(seen["quality"]) and set(range(90)) <= set(seen["quality"])
    assert 200 not in seen["near_duplicates"] and 1 in seen["near_duplicates"] and None in seen["near_duplicates"]
    words = decontaminate.words_of(seen["decontamination"][201])
    assert len(words) == 60 and set(range(90)) <= set(seen["decontamination"])
    assert "[EMAIL]" in seen["personal_data"][202]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r["doc_id"]: r["decoded_text"] for r in last} == {k: v or "" for k, v in seen["personal_data"].items()}


def test_near_copies_with_clashing_ids(spark):
    """Rows that share an id but not the text are told apart, and so are rows without an id; repeated rows and copies go; other columns stay, also those named as ours."""
    a, b, c, d = (prose(i, 60) for i in range(4))
    near = a + " tail"
    rows = [(1, a, "x"), (1, b, "x"), (1, a, "y"), (2, near, "x"), (3, c, "x"), (None, c, "x"), (None, d, "x"), (None, d, "x"), (4, None, "x"), (5, None, "x"), (5, None, "x"), (6, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string").withColumn("text_hash", F.lit(1)).withColumn("__id", F.lit("k"))
    out = corpus_pipeline.one_of_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"], r["component"]) for r in out.collect()), key=repr)
    assert got == sorted([(1, a, "x"), (1, b, "x"), (3, c, "x"), (None, d, "x"), (4, None, "x"), (5, None, "x"), (6, "", "x")], key=repr)


def test_run_and_empty(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).where(F.col("n_tokens") > 2).count() > 90
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_small_tables_make_few_files(spark, folder):
    """Files follow the rows, not the shuffle partitions: executors start processes for each file that they write."""
    from glob import glob

    from strandline.plans.lineage import tables

    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    at, docs = tables(spark).removeprefix("file:"), spark.read.parquet(f"{folder}/documents.parquet")
    known = set(glob(f"{at}/*"))
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        good = corpus_pipeline.good_quality(spark, docs, folder)
        one = corpus_pipeline.one_of_near_copies(spark, docs, folder)
        corpus_pipeline.without_personal_data(spark, docs, folder)
        assert good.count() > 90 and one.count() > 90 and one.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = {d: len(glob(f"{d}/*.parquet")) for d in set(glob(f"{at}/*")) - known}
    assert len(files) > 10 and all(n <= (32 if "/sample-" in d else 8) for d, n in files.items())
