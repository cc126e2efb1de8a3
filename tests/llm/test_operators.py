import random
import re
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import align, decontaminate, fingerprint, jaccard, langid, pieces, pii, quality, toxicity, warc, wrapper
from strandline.llm._common import held_out, shingle_hashes, word_hashes
from strandline.llm.queries import tokenizer_path

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score double, n_tokens string, spans string, items string, bucket int, set_key string"
WORDS = "the of to and in is on that with for was be at or by from this have not are".split()


def prose(seed, n, words=WORDS):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + rng.choice(["", "", "s", "ing", "er"]) for _ in range(n))


@pytest.fixture(scope="module")
def nasty(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns that clash."""
    long = prose(1, 30_000)
    texts = [None, "", " ", "one", prose(2, 40), prose(2, 40), prose(3, 80), prose(3, 80) + " tail", long, "x" * 50_000, "1" * 50_000, "a." * 30_000, "@" * 10_000, "\n".join(["same line"] * 500), "日本語 😀 ▁▁ \x00 é", "Call +1 (555) 123-4567 or bob@mail.example.com, 10.0.0.1, 4111 1111 1111 1111."]
    rows = [(i, t, "en" if i % 2 else None, None, None, 1.0, "x", None, None, None, None) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "lost words " * 9, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(0, 16)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def everyone(c):
    return c.isNotNull()


def runs(spark, documents, labels):
    benchmark = spark.createDataFrame([(1, prose(2, 40)), (2, "tail"), (3, None), (4, "...")], "item_id long, text string")
    yield quality.score(documents, quality.train(documents, labels, everyone, bits=12))
    yield toxicity.score(documents, toxicity.train(documents, labels, everyone, bits=12))
    yield langid.predict(documents, langid.train(documents, everyone, bits=12))
    yield pieces.encode(documents, tokenizer_path(), decoded=True)
    yield fingerprint.fingerprints(documents)
    yield fingerprint.compare_with_next(documents)
    yield jaccard.classes(documents)
    yield decontaminate.report(documents, benchmark)
    yield pii.report(documents)


def test_nasty_rows_keep_their_number(spark, nasty, labels):
    for out in runs(spark, nasty, labels):
        assert len(out.collect()) == nasty.count()


def test_empty_tables(spark, empty, labels):
    for out in runs(spark, empty, labels.limit(0)):
        assert out.count() == 0


def test_quality_and_toxicity_learn(spark):
    good = [(i, prose(i, 60), 1, 0) for i in range(120)]
    bad = [(i, re.sub(" ", "!! ", prose(i, 60)).upper(), 0, 0) for i in range(120, 240)]
    toxic = [(i, prose(i, 40) + " grumblefoot " + prose(i + 999, 20), 1, 1) for i in range(240, 330)]
    frame = spark.createDataFrame(good + bad + toxic, "doc_id long, text string, quality int, toxic int")
    usable = lambda c: ~held_out(c, 3, 1)
    rows = quality.score(frame, quality.train(frame, frame.select("doc_id", "quality"), usable)).where(held_out(F.col("doc_id"), 3, 1)).collect()
    assert all((r["score"] >= 0.5) == (r["quality"] == 1) for r in rows)
    rows = toxicity.score(frame, toxicity.train(frame, frame.select("doc_id", "toxic"), usable)).where(held_out(F.col("doc_id"), 3, 1)).collect()
    assert np.mean([(r["score"] >= 0.3) == (r["toxic"] == 1) for r in rows]) > 0.95


def test_languages(spark):
    other = "le la les de des et un une dans pour que qui sur avec est pas".split()
    frame = spark.createDataFrame([(i, prose(i, 30, WORDS if i % 2 else other), "en" if i % 2 else "fr") for i in range(200)] + [(900, "123 !!", "en"), (901, None, "en")], "doc_id long, text string, lang string")
    rows = langid.predict(frame, langid.train(frame, lambda c: ~held_out(c, 3, 1))).collect()
    assert all(r["lang_pred"] == ("und" if r["doc_id"] >= 900 else r["lang"]) for r in rows)


def test_pieces_equal_the_library():
    import sentencepiece

    with open(tokenizer_path(), "rb") as f:
        model = pieces.PieceModel(f.read(), chunks=50, pairs=500)
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    rng = random.Random(4)
    signs = "  \n\tabcdehinorstTHE_.,'\"()<>/\\0123456789éßñ▁日本語한😀\x00$#%!;:=+-{}[]²"
    texts = ["", " ", "<s></s>", "a" * 5000, " " * 3000, prose(1, 500)] + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    for text in texts:
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert model.encode(text) == ids
        assert model.decode(ids) == library.decode(ids)


def true_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def test_hashes_of_words_and_shingles(monkeypatch):
    text = "A b\tÄ  c\n" * 50 + prose(5, 300)
    assert len(set(word_hashes("A a").tolist())) == 1 and len(word_hashes(None)) == 0
    assert len(shingle_hashes(text)) == len(true_shingles(text))
    whole = word_hashes(text)
    monkeypatch.setattr("strandline.llm._common.BLOCK_BYTES", 40)
    assert (word_hashes(text) == whole).all()


def test_fingerprints_estimate():
    a, b = prose(1, 3000), prose(1, 2000) + " " + prose(7, 1000)
    x, y = fingerprint.sketch(a), fingerprint.sketch(b)
    s, t = true_shingles(a), true_shingles(b)
    assert abs(fingerprint.resemblance(x, y) - len(s & t) / len(s | t)) < 0.15
    assert abs(fingerprint.containment(x, y) - len(s & t) / len(s)) < 0.2
    assert abs(fingerprint.distinct(x) / len(s) - 1) < 0.3
    words = a.split()
    parts = [fingerprint.pack(fingerprint.sketch(" ".join(p))) for p in (words[:1504], words[1500:])]
    assert fingerprint.merge(*parts) == fingerprint.pack(x)


def test_fingerprints_of_edited_texts(spark):
    texts = [(i * 3, prose(i, 20 + i)) for i in range(40)] + [(200, None), (201, "")]
    rows = sorted(fingerprint.compare_with_next(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    assert [r["doc_id"] for r in rows] == [t[0] for t in texts]
    for i, r in enumerate(rows):
        text, after = (texts[j % len(texts)][1] or "" for j in (i, i + 1))
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == sha256(edited.encode()).hexdigest()
        assert r["edited_fingerprint"] == fingerprint.pack(fingerprint.sketch(edited))


@pytest.mark.parametrize("options", [{}, {"leaf": 6, "pivots": 3, "depth": 2, "block": 4, "wide_from": 1.5}, {"leaf": 6, "pivots": 2, "depth": 1, "block": 3, "wide_from": 99}])
def test_jaccard_classes_equal_brute_force(spark, options):
    rng, texts = random.Random(8), []
    for base in range(12):
        words = prose(base, 60).split()
        for _ in range(6):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(60)] = f"w{rng.randrange(99)}"
            texts.append(" ".join(copy))
    texts += ["a b", "a  B", "a b c", "", None, texts[0], texts[7]]
    sets = [true_shingles(t) for t in texts]
    up = list(range(len(texts)))
    find = lambda i: i if up[i] == i else find(up[i])
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    got = {r["doc_id"]: r for r in jaccard.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **options).collect()}
    assert all(got[i]["n_shingles"] == len(sets[i]) and got[i]["component_id"] == find(i) for i in range(len(texts)))


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>" + "x" * 200, "short", None, "<p>" + "é" * 90, "<p>" + "x" * 200, "short", "<p>" + "x" * 200]
    pages = spark.createDataFrame([(i, f"http://h/{i}" if i else None, h, 1) for i, h in enumerate(html)] + [(None, "u", html[0], 1)], "page_id long, url string, html string, digest int")
    warc.write_archive(pages, f"{tmp_path}/a")
    archive = warc.read_archive(spark, f"{tmp_path}/a")
    rows = {r["page_id"]: r for r in warc.report(archive).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in rows.items()} == {0: ("response", None), 1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 0), 5: ("response", None), 6: ("revisit", 0), None: ("revisit", 0)}
    assert all(rows[i]["payload_digest"] == sha256((h or "").encode()).hexdigest() and rows[i]["payload_bytes"] == len((h or "").encode()) for i, h in enumerate(html))
    seen = {}
    for r in warc.records(spark, f"{tmp_path}/a").collect():
        (fields, block), = warc.parse_records(bytes(r["record"]))
        page = re.fullmatch(r"<urn:x-page:(null|[0-9]+):[0-9]+>", fields["WARC-Record-ID"])[1]
        seen[page] = fields["WARC-Type"], fields.get("WARC-Refers-To"), block.split(b"\r\n\r\n", 1)[1], fields["WARC-Record-ID"]
    assert {p: (t, body) for p, (t, _, body, _) in seen.items()} == {"null" if k is None else str(k): (r["record_type"], (html[k] or "").encode() if r["record_type"] == "response" else b"") for k, r in rows.items()}
    assert all(ref == seen["0"][3] for t, ref, _, _ in seen.values() if t == "revisit") and len({i for *_, i in seen.values()}) == 8
    payloads = spark.read.parquet(f"{tmp_path}/a/payloads")
    assert payloads.count() == 2
    payloads.withColumn("payload", F.lit("wrong").cast("binary")).write.parquet(f"{tmp_path}/b/payloads")
    spark.read.parquet(f"{tmp_path}/a/headers").write.parquet(f"{tmp_path}/b/headers")
    with pytest.raises(Exception, match="damaged payload"):
        warc.report(warc.read_archive(spark, f"{tmp_path}/b")).collect()


def test_warc_repeated_ids_hot_payloads_and_empty_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "HOT", 3)
    body = "<p>" + "y" * 300
    rows = [(7, "http://h/\r\nWARC-Type: revisit", body), (7, "u", body), (7, "u", body), (7, "u", "<p>" + "z" * 300), *[(i, None, body) for i in range(8, 20)], (30, "u", "<p>" + "z" * 300), *[(i, "u", None) for i in range(40, 60)]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archive(pages, f"{tmp_path}/a")
    got = warc.read_archive(spark, f"{tmp_path}/a").collect()
    assert len(got) == len(rows) and len({r["record_id"] for r in got}) == len(rows)
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["page_id"] < 40) == sorted([(7, "response", None)] * 4 + [(i, "revisit", 7) for i in [*range(8, 20), 30]])
    assert sorted(bytes(r["payload"]).decode() for r in got if r["page_id"] == 7) == sorted(r[2] for r in rows[:4])
    assert any(r["target"] == "http://h/%0D%0AWARC-Type: revisit" for r in got)
    warc.write_archive(pages.limit(0), f"{tmp_path}/e")
    assert warc.report(warc.read_archive(spark, f"{tmp_path}/e")).count() == 0


def page(i, article):
    return f'<!DOCTYPE html><html><head><title>t{i}</title><style>p{{a:b}}</style><script>var x="</p>";</script></head><body><nav><ul><li><a href="/">n{i}</a></ul></nav><div class="cookie-notice">We use cookies {i}</div><div class="ad">buy {i}</div>{article}<aside class="sidebar">side {i}</aside><div id="comments"><p>nice {i}</p></div><form><input>go</form><footer>&copy; f{i}</footer></body></html>'


def test_main_text(spark):
    articles = [f"<article><h1>Title {i}&amp;</h1><p>One <b>bo</b>ld&nbsp;{i}<br>line\n two<p>Open {prose(i, 9)}</p></article>" for i in range(5)]
    rows = [(i, f"http://Host.example/{i}", page(i, a)) for i, a in enumerate(articles)]
    rows += [(10 + i, f"http://plain.example/{i}", page(i, f'<div class="story"><p>{prose(i, 30)}</p><p>{prose(i + 50, 30)}</p></div>')) for i in range(4)]
    rows += [(20, "http://x/", None), (21, None, ""), (22, "http://x/", "<div>" * 5000 + "deep" + "</div>" * 5000), (23, "bad", "<p unclosed <!-- no end")]
    got = {r["page_id"]: r for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["text"] == f"Title {i}& One bold {i} line two Open {prose(i, 9)}" for i in range(5))
    assert all(got[10 + i]["text"] == f"{prose(i, 30)} {prose(i + 50, 30)}" for i in range(4))
    assert got[20]["text"] == "" and got[21]["text"] == "" and got[22]["text"] == "deep" and all(r["n_chars"] == len(r["text"]) for r in got.values())


def texts_of(spark, pages):
    return {r["page_id"]: r["text"] for r in wrapper.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}


def test_main_text_keeps_what_stands_beside_the_body(spark):
    body = lambda i, n: f'<div class="page"><h1>Head {i}</h1><p class="lead">Lead {i}</p><div class="body"><p>{prose(i, n)}</p></div><div class="more"><p>More {i}</p></div></div>'
    got = texts_of(spark, [(i, "http://h.example/x", page(i, body(i, 900 if i < 12 else 6))) for i in range(14)])
    assert all(got[i] == f"Head {i} Lead {i} {prose(i, 900 if i < 12 else 6)} More {i}" for i in range(14))


def test_main_text_drops_template_lines_of_each_skeleton(spark):
    a = lambda i: f'<div class="story"><h1>A {i}</h1><p>Read more in our archive</p><p>{prose(i, 30)}</p></div>'
    b = lambda i: f'<section class="s"><h1>B {i}</h1><p>All rights <b>reserved</b> {"" if i == 30 else "here"}</p><p>{prose(i, 30)}</p></section>'
    rows = [(i, "http://hot.example/x", page(i, a(i) if i < 20 else b(i))) for i in range(40)]
    rows += [(40 + i, "http://hot.example/copy", rows[0][2]) for i in range(200)]
    got = texts_of(spark, rows)
    assert all(got[i] == f"A {i} {prose(i, 30)}" for i in range(20)) and got[239] == got[0]
    assert all(got[i] == f"B {i} {prose(i, 30)}" for i in range(20, 40) if i != 30) and got[30] == f"B 30 All rights reserved {prose(30, 30)}"


def test_main_text_drops_template_lines_inside_an_article(spark):
    a = lambda i: f"<main><article><h1>A {i}</h1><p>Read more in our archive</p><p>{prose(i, 30)}</p></article></main>"
    got = texts_of(spark, [(i, "http://notice.example/x", page(i, a(i))) for i in range(12)])
    assert all(got[i] == f"A {i} {prose(i, 30)}" for i in range(12))


def test_near_copies_of_a_text_are_no_template(spark):
    rows = [(i, "http://copies.example/x", page(i, f"<article><h1>Copy {i}</h1><p>{prose(1, 50)}</p></article>")) for i in range(12)]
    assert all(t == f"Copy {i} {prose(1, 50)}" for i, t in texts_of(spark, rows).items())


def test_only_the_wrapper_tells_template_from_slots(spark):
    """No article, no telling names or elements: without the other pages of the host everything is text."""

    def plain(i):
        link = "" if i % 4 else "<div><p>Seasonal greetings</p></div>"
        return f"<html><body><div><div>Home | About | Contact</div>{link}<div><h1>Head {i}</h1>" + "".join(f"<p>{prose(100 * i + k, 12)}</p>" for k in range(1 + i % 5)) + "<p>Sign up for our weekly letter</p></div><div>All rights reserved</div></div></body></html>"

    want = {i: " ".join([f"Head {i}", *[prose(100 * i + k, 12) for k in range(1 + i % 5)]]) for i in range(20)}
    got = texts_of(spark, [(i, "http://plain.example/x", plain(i)) for i in range(20)])
    assert all(got[i] == (want[i] if i % 4 else f"Seasonal greetings {want[i]}") for i in range(20))
    alone = texts_of(spark, [(i, f"http://h{i}.example/x", plain(i)) for i in range(20)])
    assert all(alone[i].startswith("Home | About | Contact") and alone[i].endswith("Sign up for our weekly letter All rights reserved") for i in range(20))


def test_names_that_only_look_like_furniture(spark):
    article = '<article><h1>T</h1><section class="search-algorithms"><p>Binary search</p></section><div class="related-work">Earlier papers</div><div class="article-header">Kicker</div><div class="related-posts">Other posts</div><div class="post-comments">First!</div><div class="ad-slot">Buy</div></article>'
    got = texts_of(spark, [(1, "http://a.example/x", page(1, article))])
    assert got[1] == "T Binary search Earlier papers Kicker"


def test_deep_and_wide_pages(spark):
    import time
    import tracemalloc

    deep = "<div>" * 205 + "<nav>MENU ITEM</nav><p>article text</p>" + "</div>" * 205
    deeper = "<div>" * 20_000 + "<nav>MENU ITEM</nav><p>article text</p>" + "</div></span>" * 20_000
    got = texts_of(spark, [(1, "http://a.example/x", deep), (2, "http://b.example/x", deeper)])
    assert got == {1: "article text", 2: "article text"}
    rng = random.Random(1)
    wide = ["<article>" + "".join(f"<{rng.choice(['p', 'div', 'pre'])}>{k} {j}</p>" if rng.random() < 0.9 else "<p>same</p>" for k in range(20_000)) + "</article>" for j in range(2)]
    tracemalloc.start()
    began = time.time()
    a, b = (wrapper.read(w)[1] for w in wide)
    assert len(align.line_keys(a, b)) == 20_000
    assert time.time() - began < 30 and tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()


def test_alignment_is_a_longest_common_subsequence(monkeypatch):
    monkeypatch.setattr(align, "TABLE_BITS", 60)
    rng = random.Random(2)
    for _ in range(400):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(0, 18))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        pairs = align.common(a, b)
        assert len(pairs) == best[-1][-1] and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_pages_nulls_repeats_and_empty_table(spark):
    rows = [(1, "http://h.example/x", page(1, "<article><p>one</p></article>"))] * 3 + [(None, None, None), (2, None, page(2, "<article><p>two</p></article>"))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("tree", F.lit(1)).withColumn("key", F.lit("k")).withColumn("texts", F.lit(None).cast("string"))
    got = sorted((r["page_id"] or 0, r["text"]) for r in wrapper.main_text(frame).collect())
    assert got == [(0, ""), (1, "one"), (1, "one"), (1, "one"), (2, "two")]
    assert wrapper.main_text(frame.limit(0)).count() == 0


def brute_windows(text, items):
    words = decontaminate.words_of(text)
    hit, found = set(), set()
    for item, t in items:
        w = decontaminate.words_of(t)
        n = min(8, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[k : k + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_CHARS, 60])
def test_decontamination(spark, block):
    items = [(i, prose(100 + i, 12)) for i in range(10)] + [(50, "Rare phrase"), (51, None), (52, "!!"), (9, prose(109, 12))]
    texts = [prose(i, 30) + " " + (prose(100 + i, 12).upper() if i < 8 else "") + (" rare, PHRASE " if i % 3 == 0 else "") + prose(i + 60, 20) for i in range(12)] + [None, "", prose(103, 12) + "\n" + prose(104, 12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_chars", F.lit(7).cast("long"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for r in decontaminate.report(docs, benchmark, block_chars=block).collect():
        n, hit, found = brute_windows(texts[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(found), len(found) >= 2)
        assert r["items_sha256"] == sha256(",".join(found).encode()).hexdigest()
    cleaned = {r["doc_id"]: r for r in decontaminate.clean(docs, benchmark, block_chars=block).collect()}
    for i, t in enumerate(texts):
        n, hit, found = brute_windows(t, items)
        assert (i in cleaned) == (len(found) < 2)
        if i in cleaned and not found:
            assert cleaned[i]["text"] == t and cleaned[i]["n_chars"] == 7
        elif i in cleaned:
            assert len(decontaminate.words_of(cleaned[i]["text"])) == n - hit


REGEX = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def holds(kind, m):
        d = re.sub("[^0-9]", "", m)
        luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    found = sorted((m.start(), i, m.end()) for i, k in enumerate(REGEX) for m in re.finditer(REGEX[k], text) if holds(k, m.group()))
    return ",".join(f"{list(REGEX)[k]}:{a}:{b}" for a, k, b in found)


def test_personal_data_equals_brute_force(spark):
    rng = random.Random(3)
    signs = "ab.@-_ 0123456789+() 1111é😀,"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 80))) for _ in range(600)]
    texts += ["a@b.c_d@e.f", "x@y@z.w", "1.2.3.4.5.6.7.8", "4111-1111 1111 1111", "0000255.1.1.1", "+1 (555) 123-4567", "a@b c@d.e@f.g.", "😀 4111111111111111 é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.report(docs).collect():
        want = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == sha256(want.encode()).hexdigest(), texts[r["doc_id"]]
        assert set(want.split(",")) <= set(r["spans"].split(","))
    for r in pii.redact(docs).collect():
        assert not re.search(REGEX["email"], r["text"] or "")


def test_patterns_find_unseen_forms(spark):
    cards = ["4111111111111111", "5500000000000004", "340000000000009", "30000000000004", "6011000000000004", "3530111333300000"]
    known = [(i, f"{prose(i, 5)} account number {c} holder {prose(i, 5)}") for i, c in enumerate(cards)]
    unseen = [(10, f"{prose(1, 5)} account number 1234567890123 holder {prose(2, 5)}"), (11, f"{prose(1, 5)} of about 99887766554 the")]
    got = {r["doc_id"]: r for r in pii.report(spark.createDataFrame(known + unseen, "doc_id long, text string"), confidence=0.7).collect()}
    assert got[10]["spans"].startswith("card:") and got[10]["n_card"] == 0 and got[11]["spans"] == ""


def test_patterns_at_the_ends_of_texts_and_beside_other_numbers(spark):
    cards = ["4111111111111111", "5500000000000004", "340000000000009", "30000000000004", "6011000000000004", "3530111333300000"]
    known = [(i, f"{prose(i, 5)} number {c} holder {prose(i, 5)}") for i, c in enumerate(cards)]
    unseen = [(10, f"{prose(1, 5)} number 1234567890123"), (11, "1234567890126 holder"), (12, "on 2024-01-05 number 1234567890129 2024-01-06 then")]
    got = {r["doc_id"]: r for r in pii.report(spark.createDataFrame(known + unseen, "doc_id long, text string"), confidence=0.6).collect()}
    assert all(got[i]["spans"].startswith("card:") and "," not in got[i]["spans"] for i in (10, 11, 12))


def test_found_instances_establish_patterns(spark):
    cards = ["4111111111111111", "5500000000000004", "340000000000009", "30000000000004", "6011000000000004", "3530111333300000"]
    rows = [(i, f"account {c} a{i}") for i, c in enumerate(cards)]
    new = [f"12345678901{i}" for i in range(20, 26)]
    rows += [(10 + i, f"account {v} b{i}") for i, v in enumerate(new[:2])] + [(20 + i, f"{'payee' if k else 'account'} {v} c{i}{k}") for i, v in enumerate(new[2:]) for k in (0, 1)]
    rows += [(40, "payee 987654321097 d"), (41, f"payee {new[0]} e"), (42, f"payee {new[1]} f")]
    got = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string"), support=4, confidence=0.4).collect()}
    assert got[40].startswith("card:")


def test_jaccard_regions_split_and_stay_exact():
    """One task's groups go through pivots, windows and regions, and give the classes of all pairs."""
    rng, seen = random.Random(3), []
    for case in range(40):
        sets, pool = {}, rng.choice([120, 400, 3000])
        for _ in range(rng.randint(1, 12)):
            base = [rng.randrange(pool) for _ in range(rng.randint(3, 60))]
            for _ in range(rng.randint(1, 25)):
                copy = {x if rng.random() < 0.93 else rng.randrange(pool) for x in base}
                sets[frozenset(copy)] = len(sets) if frozenset(copy) not in sets else sets[frozenset(copy)]
        rows = [(i, len(s), np.array(sorted(s), np.int64), i if case % 3 else i - i % 2) for s, i in sets.items()]
        up = list(range(len(rows)))
        find = lambda i: i if up[i] == i else find(up[i])  # noqa: B023, E731
        for i, a in enumerate(rows):
            for j, b in enumerate(rows[:i]):
                both = len(set(a[2].tolist()) & set(b[2].tolist()))
                if 100 * both >= 75 * (a[1] + b[1] - both) or a[3] == b[3]:
                    x, y = sorted((find(i), find(j)))
                    up[y] = x
        want = {i: find(i) for i in range(len(up)) if find(i) != i}
        assert {b: a for a, b in jaccard.join_region(rows, pivots=rng.choice([2, 5, 8]), small=rng.choice([2, 6, 12]), seen=seen)} == want
    assert len(seen) > 100 and any(parts > 1 for _, parts in seen)


def test_pii_learns_at_default_settings(spark):
    """Planted numbers of unseen form behind a context that seeds share are found, and no others; base spans stay."""
    rng = random.Random(12)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows = [f"{prose(i, 12)} phone: +49 {number(3)} {number(7)} {prose(i + 50, 9)}" for i in range(12)]
    planted = [f"{prose(i, 12)} phone: 0{number(3)}-{number(6)} {prose(i + 50, 9)}" for i in range(100, 110)]
    decoys = [f"{prose(i, 12)} order {number(10)} {prose(i + 50, 9)} page {number(3)}" for i in range(200, 220)]
    texts = rows + planted + decoys
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.report(frame).collect()}
    learnt = {i for i, r in got.items() if r["spans"] and sum(r[f"n_{k}"] for k in pii.KINDS) < len(r["spans"].split(","))}
    assert learnt == set(range(12, 22))
    for i in learnt:
        (kind, start, end), = [s.split(":") for s in got[i]["spans"].split(",")]
        assert kind == "phone" and re.fullmatch(r"0[0-9]{3}-[0-9]{6}", texts[i][int(start) : int(end)])
    clean = {r["doc_id"]: r["text"] for r in pii.redact(frame).collect()}
    assert all("[PHONE]" in clean[i] for i in range(22)) and all(clean[i] == texts[i] for i in range(22, 42))


def test_pii_in_a_long_dense_text(spark):
    """Many matches of all kinds in one text, overlapping ones too, in about linear time; spans and redaction equal a plain scan."""
    import time

    text = " ".join(f"u{i}@mail.example.com 10.0.{i % 256}.{i // 256 % 256} +1 (555) {i % 900 + 100}-12{i % 90 + 10} wörd 😀" for i in range(8000))
    began = time.time()
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.report(frame).first()
    assert time.time() - began < 60
    spans = [tuple(s.split(":")) for s in row["spans"].split(",")]
    want = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text)]
    want += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(?:\.[0-9]+){3}", text) if all(int(x) < 256 for x in m[0].split("."))]
    want += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    want.sort(key=lambda s: (s[1], pii.KINDS.index(s[0])))
    assert [(k, int(a), int(b)) for k, a, b in spans if k != "card"] == want and row["n_email"] == 8000
    out, at = [], 0
    for kind, a, b in ((k, int(a), int(b)) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    assert pii.redact(frame).first()["text"] == "".join([*out, text[at:]])
