"""Benchmark decontamination: a broadcast hash set of normalised test n-grams; token windows of the texts are scanned, hits verified, and spans or documents removed.

The benchmark is broadcast in blocks of at most ``block_chars`` characters, packed as arrays of about five bytes a character. One block is the common case. More blocks
scan the texts once each: a block is fetched when its turn comes, and the result is written to the shared folder before the next, so that neither the driver nor a worker
holds more than one, and the broadcast never outgrows its bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WordHashes, derive, materialise, mix

SIZE = 8
BLOCK_CHARS = 8_000_000
#: A-Z become a-z; ASCII signs that are no digits or letters become spaces.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bits of the table that tells most windows of a text from those of the benchmark before the search.
SIEVE = 22
#: Windows whose words and items are remembered at one time.
KNOWN = 50_000
_WORDS = WordHashes([c for c in range(256) if NORMAL[c] == 32])


def _normal(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, as UTF-8."""
    return _normal(text).split()


def _rolled(hashed: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` words."""
    n = max(len(hashed) - width + 1, 0)
    out = hashed[:n] + np.uint64(width)
    for i in range(1, width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashed[i : i + n]
    return mix(out)


class WindowSet:
    """The windows of a block of items: ``size`` consecutive words, or all words of a shorter item. Hash hits are verified word by word."""

    def __init__(self, items: list[tuple[str, str | None]], size: int = SIZE):
        self.names = [item for item, _ in items]
        texts, found, base = [], {}, 0
        for number, (_, text) in enumerate(items):
            data = _normal(text)
            starts, ends, hashed = _WORDS.placed(data)
            width = min(size, len(hashed))
            if width:
                n = len(hashed) - width + 1
                found.setdefault(width, []).append((_rolled(hashed, width), starts[:n] + base, ends[width - 1 :] + base, np.full(n, number, np.int32)))
            texts.append(data)
            base += len(data)
        self.text = b"".join(texts)
        self.windows = {}
        for width, parts in found.items():
            hashed, starts, ends, owners = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(hashed, kind="stable")
            sieve = np.zeros(1 << SIEVE, bool)
            sieve[hashed >> np.uint64(64 - SIEVE)] = True
            self.windows[width] = sieve, hashed[order], starts[order].astype(np.int64), ends[order].astype(np.int64), owners[order]
        self.known: dict[tuple[int, int], dict[bytes, frozenset[str]]] = {}

    def _owners(self, width: int, value: int) -> dict[bytes, frozenset[str]]:
        """For the windows of this hash: their words, and the items that hold them."""
        found = self.known.get((width, value))
        if found is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            _, hashed, starts, ends, owners = self.windows[width]
            low, high = (int(np.searchsorted(hashed, np.uint64(value), side)) for side in ("left", "right"))
            sets: dict[bytes, set[str]] = {}
            for s, e, owner in zip(starts[low:high].tolist(), ends[low:high].tolist(), owners[low:high].tolist(), strict=True):
                sets.setdefault(b" ".join(self.text[s:e].split()), set()).add(self.names[owner])
            found = self.known[width, value] = {words: frozenset(names) for words, names in sets.items()}
        return found

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """(number of words, united [start, end) word spans of the hits, items that occur)."""
        data = _normal(text)
        starts, ends, words = _WORDS.placed(data)
        items: set[str] = set()
        spans: list[tuple[int, int]] = []
        for width, (sieve, hashed, *_) in self.windows.items():
            rolled = _rolled(words, width)
            at = np.flatnonzero(sieve[rolled >> np.uint64(64 - SIEVE)])
            if not len(at):
                continue
            rolled = rolled[at]
            place = np.minimum(np.searchsorted(hashed, rolled), len(hashed) - 1)
            hit = hashed[place] == rolled
            for i, value in zip(at[hit].tolist(), rolled[hit].tolist(), strict=True):
                owners = self._owners(width, value).get(b" ".join(data[starts[i] : ends[i + width - 1]].split()))
                if owners:
                    items |= owners
                    spans.append((i, i + width))
        return len(words), united(spans), items


def united(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _marked(benchmark: DataFrame, block_chars: int) -> Iterator[tuple[list[tuple[str, str]], bool]]:
    """The blocks, each with whether it is the last one."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text")
    held, size = [], 0
    for row in items.toLocalIterator():
        if held and size + len(row[1]) > block_chars:
            yield held, False
            held, size = [], 0
        held.append((row[0], row[1]))
        size += len(row[1])
    yield held, True


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of at most ``block_chars`` characters (an item longer than that is a block), each fetched when it is asked for. Items without id or text are left out."""
    return (held for held, _ in _marked(benchmark, block_chars))


FOUND = ["n_words", "word_starts", "word_ends", "items"]
SPANS = "n_words long, word_starts array<int>, word_ends array<int>, items array<string>"


def _scanned(documents: DataFrame, benchmark: DataFrame, keep: list[str], size: int, block_chars: int, out: str, finish) -> DataFrame:
    """The columns ``keep`` and what ``finish`` makes of a text, its number of words, its spans and its items, in the pass that scans the last block."""
    spark = documents.sparkSession
    rows, known = documents, False
    for block, last in _marked(benchmark, block_chars):
        shared = spark.sparkContext.broadcast(WindowSet(block, size))

        def make(shared=shared, known=known, last=last):
            windows = shared.value

            def run(texts, starts=None, ends=None, items=None):
                found = []
                for k, text in enumerate(texts):
                    n, spans, names = windows.scan(text)
                    if known:
                        spans, names = united([*spans, *zip(starts[k], ends[k], strict=True)]), names.union(items[k])
                    found.append(finish(text, n, spans, sorted(names)) if last else _spans(text, n, spans, sorted(names)))
                return list(zip(*found, strict=True))

            return run

        inputs = ["text", *FOUND[1:]] if known else ["text"]
        if last:
            return derive(rows, make, inputs, out, keep)
        rows = materialise(derive(rows, make, inputs, SPANS), "hits")
        known = True
    raise AssertionError("there is always a last block")


def _spans(text, n: int, spans: list[tuple[int, int]], items: list[str]) -> tuple:
    return n, [s for s, _ in spans], [e for _, e in spans], items


def hits(documents: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, size: int = SIZE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Adds n_words, word_starts and word_ends (the united hit spans, end exclusive) and items (sorted ids of items with an occurring window).

    Null and empty texts have no words and no hits; repeated rows give equal results; an empty benchmark gives no hits; extra columns stay, but for those of these names.
    """
    keep = documents.columns if keep is None else keep
    return _scanned(documents, benchmark, [c for c in keep if c not in FOUND], size, block_chars, SPANS, _spans)


def report(documents: DataFrame, benchmark: DataFrame, least_items: int = 2, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated): counts and digest of ``hits``; contaminated from ``least_items`` items."""
    found = hits(documents.select("doc_id", "text"), benchmark, keep=["doc_id"], **options)
    lengths = F.aggregate(F.zip_with("word_starts", "word_ends", lambda s, e: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_words", lengths.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("items") >= least_items).alias("contaminated"))


#: The same words in a text whose case is kept.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def clean(documents: DataFrame, benchmark: DataFrame, least_items: int = 2, **options) -> DataFrame:
    """Documents with ``least_items`` or more items go; from others the hit words go, with what stands between them. Other texts and all other columns stay as they are; n_chars, where there, follows the text.

    Null and empty texts stay, repeated rows are treated alike, and columns named as those of ``hits`` keep their values.
    """
    columns = documents.columns
    others = {c: f"c{i}" for i, c in enumerate(columns) if c != "text"}
    sent = documents.select(*[F.col(f"`{c}`").alias(p) for c, p in others.items()], "text")
    size, block_chars = options.get("size", SIZE), options.get("block_chars", BLOCK_CHARS)

    def cut(text, n, spans, items):
        if text is None or not spans:
            return text, len(items), False
        at = [m.span() for m in WORD.finditer(text)]
        parts, last = [], 0
        for s, e in spans:
            parts.append(text[last : at[s][0]])
            last = at[e - 1][1]
        return "".join([*parts, text[last:]]), len(items), True

    changed = _scanned(sent, benchmark, list(others.values()), size, block_chars, "text string, found int, cut boolean", cut).where(F.col("found") < least_items)
    values = {c: F.col(p) for c, p in others.items()} | {"text": F.col("text")}
    if "n_chars" in others:
        values["n_chars"] = F.when(F.col("cut"), F.length("text").cast(dict(documents.dtypes)["n_chars"])).otherwise(values["n_chars"])
    return changed.select(*[values[c].alias(c) for c in columns])
