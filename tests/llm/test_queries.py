"""The registered queries over whole small tables against plain Python: columns, held-out marks, thresholds, digests; and the scores of trained models as plain sums."""

import math
import os
import random
import re
from zlib import crc32
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import decontaminate, fingerprint, langid, pieces, quality, queries, toxicity
from strandline.llm._common import shingle_hashes, word_hashes
from test_operators import WORDS, prose, true_shingles

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows_of(frame):
    return {r["doc_id"]: r for r in frame.collect()}


@needs_tables
@pytest.mark.parametrize("name, modulus, rest, least", [("op1_quality", 3, 1, 0.5), ("op4_toxicity", 4, 2, 0.3)])
def test_scores(spark, documents, name, modulus, rest, least):
    got = rows_of(queries.QUERIES[name](spark, SF))
    assert got.keys() == documents.keys()
    for i, r in got.items():
        assert r["held_out"] == (crc32(str(i).encode()) % modulus == rest) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least)


@needs_tables
def test_pieces(spark, documents):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    for i, r in rows_of(queries.op2_sentencepiece(spark, SF)).items():
        ids = library.encode(documents[i]["text"] or "", add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r["decoded_sha256"] == sha256(library.decode(ids).encode()).hexdigest()


def test_digests_of_nothing(spark):
    rows = pieces.digests(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), queries.tokenizer_path()).collect()
    assert len({tuple(r)[1:] for r in rows}) == 1 and rows[0]["n_tokens"] == 2 and rows[0]["decoded_sha256"] == sha256(b"").hexdigest()


@needs_tables
def test_fingerprints(spark, documents):
    """Digests are exact; likeness is near the Jaccard similarity of the true shingle sets."""
    got, ids = rows_of(queries.op3_fingerprint(spark, SF)), sorted(documents)
    errors = []
    for i, after in zip(ids, ids[1:] + ids[:1], strict=True):
        text, other, r = documents[i]["text"] or "", documents[after]["text"] or "", got[i]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + other[:cut]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == sha256(edited.encode()).hexdigest()
        a, b, c = true_shingles(text), true_shingles(edited), true_shingles(other)
        likeness = lambda x, y: len(x & y) / len(x | y) if x or y else 1.0
        errors += [r["near_edited"] - likeness(a, b), r["near_next"] - likeness(a, c)]
    assert max(map(abs, errors)) < 0.2 and abs(float(np.mean(errors))) < 0.01


def test_fingerprints_merge_and_compare_on_the_cluster(spark):
    words = prose(1, 4000).split()
    parts = [(k, " ".join(words[max(0, i - 4) : i + 100])) for k in ("a", None) for i in range(0, 4000, 100)]
    frame = fingerprint.fingerprints(spark.createDataFrame([*parts, ("b", prose(2, 500)), ("c", None)], "owner string, text string").repartition(7))
    got = {r["owner"]: r["fingerprint"] for r in fingerprint.merged(frame, ["owner"]).collect()}
    assert got["a"] == got[None] == fingerprint.pack(fingerprint.sketch(" ".join(words))) and got["c"] == ""
    pairs = spark.createDataFrame([(got["a"], got["a"]), (got["a"], got["b"]), ("", None)], "x string, y string")
    same, other, empty = fingerprint.compared(pairs, "x", "y").collect()
    n = len(true_shingles(" ".join(words)))
    assert same["resemblance"] == same["containment"] == 1 and abs(same["distinct_a"] / n - 1) < 0.3
    assert other["resemblance"] < 0.1 and other["distinct_b"] > 300 and empty["resemblance"] == 1 and empty["distinct_both"] == 0
    assert fingerprint.merged(frame.limit(0), ["owner"]).count() == 0


@needs_tables
def test_languages(spark, documents):
    got = rows_of(queries.op10_langid(spark, SF))
    known = {d["lang"] for d in documents.values() if d["lang"]}
    for i, r in got.items():
        letters = any(c.isalpha() for c in documents[i]["text"] or "")
        assert r["held_out"] == (crc32(str(i).encode()) % 3 == 1) and (r["lang_pred"] in known if letters else (r["lang_pred"], r["score"]) == ("und", 0.0))


def test_what_is_no_letter(spark):
    frame = spark.createDataFrame([(i, prose(i, 30), "en") for i in range(20)] + [(90, "½ ² Ⅷ _ 12", None), (91, "́́", None), (92, "áb", None)], "doc_id long, text string, lang string")
    got = rows_of(langid.predict(frame, langid.train(frame, lambda c: c.isNotNull())))
    assert got[90]["lang_pred"] == got[91]["lang_pred"] == "und" and got[92]["lang_pred"] == "en"
    buckets = langid.featuriser(16, 2)
    assert len(buckets("ét")) == 5 + 4  # a mark stays with its letter: five signs with the spaces, four pairs


@needs_tables
def test_personal_data_base(spark, documents):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def fits(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 12 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    for i, r in rows_of(queries.op9_pii(spark, SF)).items():
        spans = [(m.start(), k, m.end()) for k, p in patterns.items() for m in re.finditer(p, documents[i]["text"] or "") if fits(k, m[0])]
        spans.sort(key=lambda s: (s[0], list(patterns).index(s[1])))
        base = [f"{k}:{a}:{b}" for a, k, b in spans]
        assert r["base_sha256"] == sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r["spans"].split(",")) | {""}
        assert all(r[f"n_{k}"] == sum(s[1] == k for s in spans) for k in patterns)


@needs_tables
def test_pages(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op7_html(spark, SF).collect():
        html = pages[r["page_id"]]["html"] or ""
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", html, re.S)
        import html as entities

        want = entities.unescape(re.sub(r"<(?:script|style).*?</(?:script|style)>|<[^>]*>", " ", inside[1], flags=re.S)).split() if inside else []
        assert r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]
        assert "".join(r["text"].split()) == "".join(want) or not inside


def test_features_are_all_grams():
    text = " ".join(f"w{i}" for i in range(10))
    assert len(quality.featuriser(30)(text)) == len(set(quality.featuriser(30)(text).tolist())) == 27
    long = prose(3, 30_000)
    assert len(quality.featuriser(18)(long)) >= 3 * 30_000 - 3


def test_scores_are_sparse_dot_products(spark):
    rng = random.Random(1)
    texts = [None, "", *(prose(i, rng.randint(1, 400)) for i in range(30)), prose(9, 20_000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weights = np.random.default_rng(2).normal(size=(1 << 12) + 1).astype(np.float32)
    sigmoid = lambda s: 1 / (1 + math.exp(-s))
    buckets = quality.featuriser(12)
    for i, r in rows_of(quality.score(frame, quality.QualityModel(weights, 12))).items():
        b = buckets(texts[i])
        assert abs(r["score"] - sigmoid(float(weights[-1]) + 20 * sum(float(weights[k]) for k in b) / max(len(b), 1))) < 1e-6
    words = toxicity.featuriser(12)
    for i, r in rows_of(toxicity.score(frame, toxicity.ToxicityModel(weights, 12))).items():
        b, n = words(texts[i])
        s = float(weights[-1]) + sum(10 * float(weights[k]) * math.sqrt((b == k).sum() / max(n, 1)) for k in set(b.tolist()))
        assert abs(r["score"] - sigmoid(max(-35, min(35, s)))) < 1e-5
    model = langid.LanguageModel(("x", "y", "z"), np.random.default_rng(3).normal(size=((1 << 12) + 1, 3)).astype(np.float32), 0.7, 12)
    grams = langid.featuriser(12)
    for i, r in rows_of(langid.predict(frame, model)).items():
        b = grams(texts[i])
        if not len(b):
            assert r["lang_pred"] == "und"
            continue
        z = [(sum(float(model.weights[k, j]) for k in b) / len(b) + float(model.weights[-1, j])) / 0.7 for j in range(3)]
        p = [math.exp(x - max(z)) for x in z]
        assert r["lang_pred"] == "xyz"[p.index(max(p))] and abs(r["score"] - max(p) / sum(p)) < 1e-5


def test_a_long_labelled_text_teaches_whole(spark, monkeypatch):
    """The signs of low quality stand at the end of long texts, beyond any number of more frequent n-grams."""
    filler = " ".join(f"f{k}" for k in range(2000))
    signs = [" ".join(f"{x}{k}" for k in range(1500)) for x in "ab"]
    frame = spark.createDataFrame([(i, f"{filler} {filler} {signs[i % 2]}", int(i % 2 == 0)) for i in range(60)], "doc_id long, text string, quality int")
    model = quality.train(frame, frame, lambda c: c % 3 != 0)
    got = quality.score(frame, model).where("doc_id % 3 = 0").collect()
    assert all((r["score"] >= 0.5) == (r["quality"] == 1) for r in got)
    small = quality.train(frame, frame, lambda c: c % 3 != 0, max_bytes=200_000)  # bounded in bytes: fewer documents, each whole
    assert np.count_nonzero(small.weights) and not np.array_equal(small.weights, model.weights)


def test_benchmark_blocks_are_fetched_one_by_one(spark):
    items = spark.createDataFrame([(i, prose(i, 30)) for i in range(20)], "item_id long, text string")
    sizes = [sum(len(t) for _, t in b) for b in decontaminate.blocks(items, 400)]
    assert len(sizes) > 5 and max(sizes) <= 400
    docs = spark.createDataFrame([(i, f"{prose(100 + i, 20)} {prose(i, 30)}") for i in range(20)], "doc_id long, text string")
    one, many = (sorted(map(tuple, decontaminate.report(docs, items, block_chars=n).collect())) for n in (10**6, 400))
    assert one == many and all(r[2] >= 30 for r in one)


def test_long_texts_in_blocks(monkeypatch):
    text = prose(5, 4000, [*WORDS, "a" * 300]) + "\x0b\x0c last"
    whole, shingles = word_hashes(text), shingle_hashes(text)
    monkeypatch.setattr("strandline.llm._common.BLOCK_BYTES", 77)
    assert (word_hashes(text) == whole).all() and (shingle_hashes(text) == shingles).all()
    assert len(whole) == len(re.findall(r"[^\x20\x09-\x0D]+", text))
