"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..plans.lineage import filled, files, materialise, tables  # noqa: F401

#: Rows that a Python worker holds as Python objects at one time.
ROWS = 128
#: Rows of an Arrow batch at most: texts are long, and a batch is held by the executor and by the worker.
BATCH = 500
#: Bytes of an Arrow batch, from which it ends: packed rows and very long texts are far larger than a document.
BATCH_BYTES = 4 << 20


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])


def parse(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH rows, a lower setting stays; and to BATCH_BYTES bytes, where the session sets no number of bytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size, None) is None:
        spark.conf.set(size, str(BATCH_BYTES))


def _freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after the last, Arrow returns the memory that it keeps for more, as idle workers stay."""
    yield from batches
    pa.default_memory_pool().release_unused()


def derive(df: DataFrame, make: Callable[[], Callable], inputs: list[str], out: str, keep: list[str] | None = None, rows: int = ROWS) -> DataFrame:
    """Adds the columns ``out`` (DDL) that the function from ``make()`` computes from lists of the ``inputs``; ``keep`` (default: all) stay.

    ``make`` runs once a task. A new column replaces one of the same name. Columns travel under positional names, so clashing names do no harm.
    """
    small_batches(df.sparkSession)
    added = parse(out)
    keep = df.columns if keep is None else keep
    sent = list(dict.fromkeys([*inputs, *keep]))
    source = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(sent)])
    at, stay = [sent.index(c) for c in inputs], [sent.index(c) for c in keep if c not in added.names]
    schema = T.StructType([source.schema[i] for i in stay] + [T.StructField(f"n{i}", f.dataType) for i, f in enumerate(added)])
    types = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in _freed(batches):
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                new = compute(*[part.column(i).to_pylist() for i in at])
                old = [part.column(i).cast(types[k].type) for k, i in enumerate(stay)]
                yield pa.RecordBatch.from_arrays(old + [pa.array(v, t.type) for v, t in zip(new, list(types)[len(stay):], strict=True)], schema=types)

    return source.mapInArrow(run, schema).toDF(*[sent[i] for i in stay], *added.names)


def _size(value) -> int:
    """About the bytes of a value in an Arrow batch."""
    return 8 if value is None or isinstance(value, int | float) else len(value) if isinstance(value, bytes | str) else sum(map(_size, value)) + 8


def generate(df: DataFrame, make: Callable[[], Callable], out: str, rows: int = 1024) -> DataFrame:
    """Rows from the generator that ``make()`` returns: it takes an iterator over tuples of all columns of one partition and yields tuples.

    A batch ends at ``rows`` rows or BATCH_BYTES bytes.
    """
    small_batches(df.sparkSession)
    schema = parse(out)
    types = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tuples() -> Iterator[tuple]:
            for batch in _freed(batches):
                for start in range(0, batch.num_rows, ROWS):
                    yield from zip(*[c.to_pylist() for c in batch.slice(start, ROWS).columns], strict=True)

        held: list[tuple] = []
        size = 0
        for row in make()(tuples()):
            held.append(row)
            size += _size(row)
            if len(held) >= rows or size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*held, strict=True), types, strict=True)], schema=types)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*held, strict=True), types, strict=True)], schema=types)

    return df.mapInArrow(run, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of ``n`` hash partitions one integer that hashes to it, so that equal shares stay equal."""
    some = spark.range(0, 20 * n + 200, 1, 1).select(F.col("id").cast("int").alias("id"))
    found = {r[0]: r[1] for r in some.groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id")).collect()}
    return [found.get(i, i) for i in range(n)]


#: Bytes of features that a training sample may hold on the driver; and files that its some thousand rows go into.
SAMPLE_BYTES, SAMPLE_FILES = 48 << 20, 32


def sampled_features(sample: DataFrame, make: Callable[[], Callable], keep: list[str], max_bytes: int = SAMPLE_BYTES) -> list:
    """Rows (doc_id, the other columns ``keep``, at, x) of the documents in ``sample``, in ascending order of doc_id: sparse features by ``make()``, whole for every row.

    The sample is bounded in rows by its caller and in bytes here: documents count in the order of their id hashes, as long as all their features stay within
    ``max_bytes``. Rows with one id count as one document, the first of them in the order of their columns.
    """
    features = derive(sample, make, ["text"], "at binary, x binary", keep=["doc_id", *keep])
    one = features.groupBy("doc_id").agg(F.min(F.struct(*keep, "at", "x")).alias("r")).select("doc_id", "r.*")
    one = materialise(one.coalesce(SAMPLE_FILES), "sample")
    sizes = sorted((r[0], r[1], r[2]) for r in one.select(F.xxhash64("doc_id"), "doc_id", F.octet_length("at") + F.octet_length("x")).collect())
    wanted, held = [], 0
    for _, doc_id, size in sizes:
        held += size
        if held > max_bytes:
            break
        wanted.append((doc_id,))
    if len(wanted) < len(sizes):
        one = one.join(F.broadcast(sample.sparkSession.createDataFrame(wanted, "doc_id long")), "doc_id", "left_semi")
    return sorted(one.collect(), key=lambda r: r["doc_id"])


def sparse(rows: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, values) of rows of ``sampled_features``, as views of their bytes."""
    return [(np.frombuffer(r["at"], "<i4"), np.frombuffer(r["x"], "<f4")) for r in rows]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (fixed constants of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, bound: int = 60_000):
        super().__init__()
        self.bound = bound
        import xxhash

        self.digest = xxhash.xxh3_64_intdigest

    def __missing__(self, word):
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = self.digest(word)
        return value

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


SHINGLE = 5


#: Bytes of text that are hashed at one time, up to the next white space.
BLOCK_BYTES = 1 << 18


class WordHashes:
    """64-bit hashes of all words of a text at once: sums of random values of the bytes (A-Z as a-z) times powers of an odd number, from prefix sums. Words end at the bytes ``space``."""

    def __init__(self, space: tuple | list = (9, 10, 11, 12, 13, 32), factor: int = 0x9E3779B97F4A7C15):
        rng = np.random.default_rng(20240229)
        self.value = rng.integers(1, 2**64, 256, np.uint64)
        self.value[65:91] = self.value[97:123]
        self.space = np.zeros(256, bool)
        self.space[list(space)] = True
        self.value[self.space] = 0
        self.factor, self.inverse = np.uint64(factor), np.uint64(pow(factor, -1, 2**64))
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        n = max(n, 4096)
        self.up, self.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, x, np.uint64))]) for x in (self.factor, self.inverse))

    def of(self, data: bytes) -> np.ndarray:
        return self.placed(data)[2]

    def placed(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, hashes) of the words. Long texts are read in blocks, which end at the next end of a word."""
        if len(data) <= BLOCK_BYTES:
            return self._block(data)
        found, at = [], 0
        while at < len(data):
            end = at + BLOCK_BYTES
            while end < len(data):
                ahead = np.flatnonzero(self.space[np.frombuffer(data, np.uint8, min(1 << 16, len(data) - end), end)])
                if len(ahead):
                    end += int(ahead[0])
                    break
                end += 1 << 16
            starts, ends, hashed = self._block(data[at:end])
            found.append((starts + at, ends + at, hashed))
            at = end
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _block(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b = np.frombuffer(data, np.uint8)
        if len(b) >= len(self.up):
            self._powers(2 * len(b))
        inside = np.zeros(len(b) + 2, np.int8)
        inside[1:-1] = ~self.space[b]
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = turns[::2], turns[1::2]
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.value[b] * self.up[: len(b)], out=sums[1:])
        return starts, ends, mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


_WORDS = WordHashes()


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z taken as a-z, in order."""
    return _WORDS.of((text or "").encode("utf-8", "surrogatepass"))


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles of a text; fewer words are one shingle, no words none."""
    h = word_hashes(text)
    if not len(h):
        return h
    width = min(size, len(h))
    n = len(h) - width + 1
    out = h[:n] + np.uint64(width)
    for i in range(1, width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[i : i + n]
    out = mix(out)
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def held_out(doc_id, modulus: int, remainder: int):
    """True where crc32 of ``doc_id`` as text leaves ``remainder``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder
