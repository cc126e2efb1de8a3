"""N-gram Jaccard join: exact, in the metric space of Jaccard distance (1 - similarity), which obeys the triangle inequality.

Sets of word shingles are joined in regions:

1. Top regions have single shingles as pivots. Most documents share nothing, so they lie at distance 1 from any document pivot, and regions
   around documents would hold everything. A single shingle is a pivot that is nearer (1 - 1/n) to the sets that hold it than to others. A set is
   put into the regions of its rarest shingles: as a link needs overlap >= 0.75 n, two linked sets share one of the n - ceil(0.75 n) + 1 rarest
   of either. Shingles of one set only make no region. Regions with sets in common are one group.
2. In every group sets become pivots. A set goes home to the nearest one (its Voronoi region), and by the triangle inequality it is replicated to
   each region i before its home with d(i) <= d(home) + 2r, r being the link distance: then of two linked sets one is at home where the other is
   too. Regions are split again in the same way. Groups of at most ``LEAF`` sets are split within one task, down to ``SMALL`` sets; larger ones are
   first split on the cluster, at most ``DEPTH`` times.
3. A region that is small, or too dense for windows to separate, is joined exactly: each set outside the region's largest component meets the sets
   that share shingles with it. On the cluster, dense regions are joined in blocks.

Links within a component are not looked for. Equal sets are one set throughout. Intersections count 48-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import HUB, HUBS, components
from ._common import ROWS, arrow_schema, derive, even_keys, filled, files, generate, materialise, parse, partitions, shingle_hashes, small_batches

#: Similarity in hundredths from which documents link.
PERCENT = 75
LEAF, PIVOTS, DEPTH, BLOCK = 4000, 16, 3, 1000
#: Within a task, a region is split further from so many sets on, by so many pivots.
SMALL, INNER_PIVOTS = 12, 8
#: Entries of an inverted index that are brought together at one time.
HOLDERS = 1_000_000
#: Documents and shingles after which a blob is full; a number of a document in its blob has 16 bits.
BLOB_SETS, BLOB_SHINGLES = 2048, 500_000
#: Bytes of text whose shingles make one range of hashes; and entries of a range that are counted at one time.
RANGE_BYTES, STEP = 64 << 20, 400_000
#: Shingles that a leaf may hold in all; a split that puts a set into more regions than ``WIDE`` on average doesn't help, and blocks follow.
LEAF_SHINGLES, WIDE = 2_000_000, 4


def linked(both: int, a: int, b: int, percent: int = PERCENT) -> bool:
    return 100 * both >= percent * (a + b - both)


def needed(n: int, percent: int = PERCENT) -> int:
    """The least overlap of a set of ``n`` with any set that it links to."""
    return -(-percent * n // 100)


def _set_key(hashed: np.ndarray) -> bytes | None:
    import xxhash

    return xxhash.xxh3_128_digest(hashed.tobytes()) if len(hashed) else None


def _six(values: np.ndarray) -> np.ndarray:
    """48-bit values as 6 bytes each."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def _from_six(pieces: list[bytes]) -> np.ndarray:
    """The 48-bit values of all pieces one after the other."""
    raw = np.zeros((sum(map(len, pieces)) // 6, 8), np.uint8)
    at = 0
    for piece in pieces:
        end = at + len(piece) // 6
        raw[at:end, :6] = np.frombuffer(piece, np.uint8).reshape(-1, 6)
        at = end
    return raw.view("<u8").reshape(-1)


def _distinct(ranked: np.ndarray) -> np.ndarray:
    """Places in sorted values where a value begins."""
    return np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.empty(0, np.int64)


def _counts(documents: DataFrame) -> tuple[int, int]:
    """Rows, and bytes of all texts."""
    rows, held = documents.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    return rows, int(held or 0)


def _ranges(spark: SparkSession, held: int) -> int:
    """So many ranges of hashes that one holds about RANGE_BYTES of text's shingles; at least the session's shuffle partitions."""
    return max(partitions(spark), -(-held // RANGE_BYTES))


def _dealt(documents: DataFrame, n: int) -> DataFrame:
    """Shingle hashes by ``n`` ranges of the hash, one range a partition, packed by blobs of documents so that a shingle costs about 10 bytes however many ranges there are.

    Rows: (bucket, blob, shingles, counts, owners): sorted distinct 48-bit hashes of a blob's sets in one range, how many sets hold each, and the 16-bit numbers of
    these sets in the blob; and one row a blob with its documents' ids, text hashes, set sizes and set keys instead. In a blob equal sets send their shingles once, and a
    shingle of many sets is one entry. A blob is named by its content, so that a repeated task names it as before; rows of equal blobs are equal.
    """
    spark = documents.sparkSession
    small_batches(spark)
    keys = np.array(even_keys(spark, n), np.int32)
    edges = (np.arange(1, n, dtype=np.uint64) << np.uint64(48)) // np.uint64(n) if n > 1 else np.empty(0, np.uint64)
    schema = parse("bucket int, blob binary, shingles binary, counts binary, owners binary, ids array<long>, marks array<long>, sizes array<int>, set_keys array<binary>")
    types = arrow_schema(schema)

    def packed(ids: list, marks: list, sizes: list, set_keys: list, sets: dict[bytes, tuple[int, np.ndarray]], task: int, number: int) -> pa.RecordBatch:
        import xxhash

        blob = xxhash.xxh3_128_digest(repr((task, number, ids, marks)).encode() + b"".join(k or b"" for k in set_keys))
        hashed = np.concatenate([x for _, x in sets.values()]) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.array([i for i, _ in sets.values()], np.uint16), [len(x) for _, x in sets.values()]) if sets else np.empty(0, np.uint16)
        order = np.argsort(hashed, kind="stable")
        hashed, owner = hashed[order], owner[order].astype("<u2")
        first = _distinct(hashed)
        ends = np.append(first, len(hashed))
        hashed, counts = hashed[first], np.diff(ends).astype("<u2")
        cuts = np.searchsorted(np.searchsorted(edges, hashed, side="right"), np.arange(n + 1))
        filled = np.flatnonzero(np.diff(cuts)).tolist()
        rows = [(int(keys[i]), blob, _six(hashed[a:b]).tobytes(), counts[a:b].tobytes(), owner[ends[a] : ends[b]].tobytes(), None, None, None, None) for i in filled for a, b in [(int(cuts[i]), int(cuts[i + 1]))]]
        rows.append((int(keys[blob[0] % n]), blob, None, None, None, ids, marks, sizes, set_keys))
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, held = TaskContext.get().partitionId(), 0, 0
        ids, marks, sizes, set_keys, sets = [], [], [], [], {}
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                for doc_id, text, mark in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    full = shingle_hashes(text)
                    key = _set_key(full)
                    if key is not None and key not in sets:
                        short = full >> np.uint64(16)
                        sets[key] = len(ids), short[_distinct(short)]
                        held += len(full)
                    ids.append(doc_id)
                    marks.append(mark)
                    sizes.append(len(full))
                    set_keys.append(key)
                    if len(ids) >= BLOB_SETS or held >= BLOB_SHINGLES:
                        yield packed(ids, marks, sizes, set_keys, sets, task, number)
                        number, held = number + 1, 0
                        ids, marks, sizes, set_keys, sets = [], [], [], [], {}
        if ids:
            yield packed(ids, marks, sizes, set_keys, sets, task, number)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark")).mapInArrow(run, schema).repartition(n, "bucket")


def _before(piece: bytes, value: np.uint64) -> int:
    """How many of the sorted 48-bit values are below ``value``, by bisection of the bytes."""
    low, high = 0, len(piece) // 6
    while low < high:
        middle = (low + high) // 2
        if int.from_bytes(piece[6 * middle : 6 * middle + 6], "little") < value:
            low = middle + 1
        else:
            high = middle
    return low


def _counted(pieces: list[bytes], counts: list[np.ndarray]) -> Iterator[tuple[int, tuple]]:
    """For each piece that has entries: its number, its shingles that two or more sets hold, the counts of all its entries, which of them are shared, and the shared ones' frequencies."""
    ends = np.cumsum([len(p) // 6 for p in pieces]).tolist()
    shingle, count = _from_six(pieces), np.concatenate(counts)
    if not len(shingle):
        return
    order = np.argsort(shingle, kind="stable")  # the pieces are sorted, so this merges them
    first = _distinct(shingle[order])
    total = np.add.reduceat(count[order].astype(np.uint32), first)
    frequency = np.empty(len(shingle), np.uint32)
    frequency[order] = np.repeat(total, np.diff(np.append(first, len(shingle))))
    for i, (low, high) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
        if high > low:
            wanted = frequency[low:high] >= 2
            yield i, (shingle[low:high][wanted], count[low:high], wanted, frequency[low:high][wanted])


def _shared(dealt: DataFrame) -> DataFrame:
    """The rows of ``_dealt`` with only those shingles that two or more sets hold, and their frequencies. Copies of a set in other blobs count too, which at most keeps more.

    A task holds the distinct hashes of each blob in its range, packed, whose size ``_ranges`` sets by the measured bytes of text; a shingle of all sets is one entry a
    blob. It counts about STEP entries at a time, from the lowest on.
    """
    schema = parse("blob binary, shingles binary, counts binary, owners binary, frequencies binary, ids array<long>, marks array<long>, sizes array<int>, set_keys array<binary>")
    types = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, owners, counts, pieces = [], [], [], []
        for batch in batches:
            meta = batch.filter(batch.column("ids").is_valid())
            if meta.num_rows:
                none = pa.nulls(meta.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([meta.column("blob"), none, none, none, none, *(meta.column(c).cast(types.field(c).type) for c in ("ids", "marks", "sizes", "set_keys"))], schema=types)
            rest = batch.filter(batch.column("ids").is_null())
            blobs += rest.column("blob").to_pylist()
            owners += rest.column("owners").to_pylist()
            counts += rest.column("counts").to_pylist()
            pieces += rest.column("shingles").to_pylist()
        if not blobs:
            return
        steps = -(-sum(map(len, pieces)) // (6 * STEP))
        low = min(int(_from_six([p[:6]])[0]) for p in pieces)
        high = max(int(_from_six([p[-6:]])[0]) for p in pieces)
        cuts = np.array([low + (high - low + 1) * i // steps for i in range(1, steps)], np.uint64)
        begun, told = [0] * len(pieces), [0] * len(pieces)  # entries and owners of each piece that are done
        for step in range(steps):
            parts, counted = [], []
            for i, piece in enumerate(pieces):
                rest = piece[6 * begun[i] :]
                n = len(rest) // 6 if step == steps - 1 else _before(rest, cuts[step])
                parts.append(rest[: 6 * n])
                counted.append(np.frombuffer(counts[i], "<u2", n, 2 * begun[i]))
                begun[i] += n
            for i, values in _counted(parts, counted):
                shared, own, wanted, often = values
                who = np.frombuffer(owners[i], "<u2", int(own.sum()), 2 * told[i])
                told[i] += len(who)
                if wanted.any():
                    row = [blobs[i]], [_six(shared).tobytes()], [own[wanted].tobytes()], [who[np.repeat(wanted, own)].tobytes()], [often.astype("<u4").tobytes()], [None], [None], [None], [None]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(row, types, strict=True)], schema=types)
        pa.default_memory_pool().release_unused()

    return dealt.mapInArrow(run, schema)


def sets(documents: DataFrame, percent: int = PERCENT, held: int | None = None) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_key, shingles, anchors) of every document. Equal sets have equal keys, empty ones null.

    ``shingles`` (shared ones) and ``anchors`` (the rarest of these, whose regions the set joins; packed as 64-bit integers both) are null for a set that can't
    link to another: it has fewer shared shingles than a link needs, or its prefix of rare shingles has no shared one. ``held``: the bytes of all texts, where they are known.
    """
    n = _ranges(documents.sparkSession, _counts(documents)[1] if held is None else held)
    ordered = _shared(_dealt(documents, n)).repartition(n, "blob").sortWithinPartitions("blob")

    def make():
        def finished(meta, parts):
            ids, marks, sizes, keys = meta
            own: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            if parts:
                counts = np.frombuffer(b"".join(p[1] for p in parts), "<u2")
                shingle = np.repeat(_from_six([p[0] for p in parts]).astype(np.int64), counts)
                often = np.repeat(np.frombuffer(b"".join(p[3] for p in parts), "<u4"), counts)
                owner = np.frombuffer(b"".join(p[2] for p in parts), "<u2")
                parts.clear()
                order = np.lexsort((shingle, often, owner))
                owner, shingle = owner[order], shingle[order]
                cuts = np.append(_distinct(owner), len(owner)).tolist()
                own = {int(owner[a]): shingle[a:b] for a, b in zip(cuts, cuts[1:], strict=False)}
            for i, (doc_id, mark, n, key) in enumerate(zip(ids, marks, sizes, keys, strict=True)):
                mine, data, anchors = own.get(i), None, None
                if mine is not None and 100 * len(mine) >= percent * n:
                    take = (n - needed(n, percent) + 1) - (n - len(mine))
                    if take > 0:
                        data, anchors = np.sort(mine).astype("<i8").tobytes(), mine[:take].astype("<i8").tobytes()
                yield doc_id, mark, n, key, data, anchors

        def run(rows):
            at, meta, parts = None, None, []
            for blob, *part, ids, marks, sizes, keys in rows:
                if blob != at and meta is not None:
                    yield from finished(meta, parts)
                    meta, parts = None, []
                at = blob
                if ids is not None:
                    meta = ids, marks, sizes, keys
                else:
                    parts.append(part)
            if meta is not None:
                yield from finished(meta, parts)

        return run

    return generate(ordered, make, "doc_id long, text_hash long, n_shingles long, set_key binary, shingles binary, anchors binary")


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of sorted distinct values."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def windows(distance: np.ndarray, radius: float) -> list[np.ndarray]:
    """For each pivot (rows of ``distance``) the places of the sets in its region: those at home with it, their nearest pivot, and those that may link to one of these.

    Of linked sets x at home with i and y at home with j > i, d(y, i) <= d(x, i) + r <= d(x, j) + r <= d(y, j) + 2r: y is in the region of i too.
    """
    home = distance.argmin(axis=0)
    nearest = distance.min(axis=0)
    return [np.flatnonzero((home == i) | ((home > i) & (distance[i] <= nearest + 2 * radius + 1e-9))) for i in range(len(distance))]


class _Region:
    """Sets (key, n, shared shingles, label) of one task, as numbers over one another."""

    def __init__(self, sets: list[tuple], percent: int):
        self.keys = [s[0] for s in sets]
        self.sizes, self.percent = np.array([s[1] for s in sets]), percent
        self.lengths = np.array([len(s[2]) for s in sets])
        self.ends = np.cumsum(self.lengths)
        values, inverse, counts = np.unique(np.concatenate([s[2] for s in sets]), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.lengths)
        often = counts[inverse] > 1  # what one set alone holds is in no intersection
        self.value, self.owner = inverse[often].astype(np.int32), owner[often]
        self.lengths = np.bincount(self.owner, minlength=len(sets))
        self.ends = np.cumsum(self.lengths)
        self.mark = np.zeros(len(values), bool)
        self.forest = _Forest(len(sets))

    def own(self, i: int) -> np.ndarray:
        return self.value[self.ends[i] - self.lengths[i] : self.ends[i]]

    def roots(self, at: np.ndarray) -> np.ndarray:
        return np.array([self.forest.find(i) for i in at.tolist()])

    def entries(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, place in ``at``) of all shingles of the sets ``at``."""
        lengths = self.lengths[at]
        place = np.repeat(np.arange(len(at)), lengths)
        entry = np.arange(len(place)) + np.repeat(self.ends[at] - lengths - (np.cumsum(lengths) - lengths), lengths)
        return self.value[entry], place

    def overlaps(self, i: int, values: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        """Sizes of the intersections of set i with ``n`` sets, whose entries are given."""
        own = self.own(i)
        self.mark[own] = True
        both = np.bincount(place[self.mark[values]], minlength=n)
        self.mark[own] = False
        return both

    def linked(self, i: int, both: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 100 * both >= self.percent * (self.sizes[i] + self.sizes[at] - both)

    def voronoi(self, at: np.ndarray, pivots: int) -> list[np.ndarray]:
        """Links the sets ``at`` to pivots among them, each of which is the farthest from those before it, and returns the pivots' regions."""
        values, place = self.entries(at)
        rows, nearest, i = [], np.full(len(at), np.inf), 0
        while len(rows) < pivots and nearest[i] > 0:
            both = self.overlaps(int(at[i]), values, place, len(at))
            for j in at[self.linked(int(at[i]), both, at)].tolist():
                self.forest.join(int(at[i]), j)
            rows.append(1 - both / (self.sizes[at[i]] + self.sizes[at] - both))
            rows[-1][i] = 0.0  # shingles that nobody shares are left out of the count
            nearest = np.minimum(nearest, rows[-1])
            i = int(nearest.argmax())
        return [at[w] for w in windows(np.array(rows), 1 - self.percent / 100)]

    def compare(self, at: np.ndarray) -> None:
        """All links among the sets ``at``, but between such as are linked already: each set outside the largest component meets those that hold its shingles, by an inverted index."""
        roots = self.roots(at)
        names, number = np.unique(roots, return_inverse=True)
        others = np.flatnonzero(number != np.bincount(number).argmax())
        if len(others) * 4 >= len(at):
            values, place = self.entries(at)
            order = np.argsort(values, kind="stable")
            values, holder = values[order], place[order].astype(np.int32)
            for k in others.tolist():
                i, both = int(at[k]), np.zeros(len(at), np.int64)
                begins, ends = np.searchsorted(values, self.own(i), "left"), np.searchsorted(values, self.own(i), "right")
                cuts = np.cumsum(ends - begins) // HOLDERS  # so many entries are brought together at a time
                for part in np.split(np.arange(len(begins)), np.flatnonzero(np.diff(cuts)) + 1) if len(begins) else ():
                    both += np.bincount(np.concatenate([holder[a:b] for a, b in zip(begins[part].tolist(), ends[part].tolist(), strict=True)]), minlength=len(at))
                both[k] = 0
                for j in at[self.linked(i, both, at)].tolist():
                    self.forest.join(i, j)
        else:
            values, place = self.entries(at)
            for k in others.tolist():
                i = int(at[k])
                both = self.overlaps(i, values, place, len(at))
                for j in at[self.linked(i, both, at)].tolist():
                    self.forest.join(i, j)


def join_region(sets: list[tuple], percent: int = PERCENT, pivots: int = INNER_PIVOTS, small: int = SMALL, seen: list | None = None) -> Iterator[tuple]:
    """(a, b): for each set (key, n, shared shingles, label) that is linked to others, directly or by a chain, the smallest key of these; equal labels are linked already.

    Exact. The sets are split into Voronoi regions with windows, again and again, until a region is ``small``, linked throughout, or so dense that windows don't
    separate it; what is left is compared. ``seen`` takes (sets, regions) of each split.
    """
    sets, by_label = sorted(sets, key=lambda s: (s[1], s[0])), {}
    if len({s[3] for s in sets}) < 2:
        return
    region = _Region(sets, percent)
    for i, s in enumerate(sets):
        region.forest.join(i, by_label.setdefault(s[3], i))
    todo = [np.arange(len(sets))]
    while todo:
        at = todo.pop()
        if len(at) < 2 or len(np.unique(region.roots(at))) < 2:
            continue
        if len(at) <= small:
            region.compare(at)
            continue
        parts = region.voronoi(at, pivots)
        if seen is not None:
            seen.append((len(at), len(parts)))
        if max(map(len, parts)) > 0.8 * len(at) or sum(map(len, parts)) > WIDE * len(at):
            region.compare(at)
        else:
            todo += parts
    least: dict[int, object] = {}
    for i, s in enumerate(sets):
        root = region.forest.find(i)
        least[root] = min(least.get(root, s[0]), s[0])
    for i, s in enumerate(sets):
        if (first := least[region.forest.find(i)]) != s[0]:
            yield first, s[0]


def _leaves(members: DataFrame, by: list[str], percent: int) -> DataFrame:
    """(a, b): links within each region; ``members`` has the columns ``by``, node, n, shingles, label. A task streams through its sorted regions, one at a time."""
    width = len(by)
    ordered = members.select(*by, "node", "n", "shingles", "label").repartition(partitions(members.sparkSession), *by).sortWithinPartitions(*by)

    def make():
        def run(rows):
            at, held = None, {}
            for row in rows:
                if row[:width] != at:
                    yield from join_region(list(held.values()), percent)
                    at, held = row[:width], {}
                held[row[width]] = (row[width], row[width + 1], np.frombuffer(row[width + 2], "<i8"), row[width + 3])
            yield from join_region(list(held.values()), percent)

        return run

    return generate(ordered, make, "a long, b long")


def _split(big: DataFrame, level: int, percent: int, pivots: int) -> DataFrame:
    """Adds near (pivots that the set links to) and regions (of its home pivot and of those before it within the window)."""
    from pyspark.sql import Window

    draw = F.xxhash64("node", F.lit(level))
    rows = big.select("region", "node", draw.alias("draw"), F.pmod(draw, F.lit(64)).alias("salt"))
    for keys in (["region", "salt"], ["region"]):  # first in parts of a region, so that a large one isn't sorted in one task
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("draw", "node"))).where(F.col("r") <= pivots)
    chosen = rows.select("region", "node").join(big, ["region", "node"]).groupBy("region").agg(F.sort_array(F.collect_list(F.struct("node", "n", "shingles"))).alias("pivots"))
    radius = 1 - percent / 100

    def make():
        def run(nodes, sizes_, shingles, groups, regions):
            near, homes = [], []
            for node, n, data, group, region in zip(nodes, sizes_, shingles, groups, regions, strict=True):
                own = np.frombuffer(data, "<i8")
                both = [_overlap(own, np.frombuffer(p["shingles"], "<i8")) for p in group]
                near.append([p["node"] for p, o in zip(group, both, strict=True) if p["node"] != node and linked(o, n, p["n"], percent)])
                d = np.array([0.0 if p["node"] == node else 1 - o / (n + p["n"] - o) for p, o in zip(group, both, strict=True)])
                homes.append([f"{region}.{i}" for i, w in enumerate(windows(d[:, None], radius)) if len(w)])
            return [near, homes]

        return run

    joined = big.join(chosen, "region")
    return derive(joined, make, ["node", "n", "shingles", "pivots", "region"], "near array<long>, regions array<string>", keep=["region", "node", "n", "shingles"], rows=16)


def _blocks(wide: DataFrame, block: int) -> DataFrame:
    """The sets of dense regions in blocks that are joined each by itself: sets of a region's most frequent label are linked already, so each of them is in one block,
    where it meets all others of the region; these are in all blocks. With no frequent label, a set is in the blocks of all pairs of its part with others."""
    labels = wide.groupBy("region", "label").agg(F.count("*").alias("times"))
    most = labels.groupBy("region").agg(F.max(F.struct("times", "label")).alias("m")).select("region", F.col("m.label").alias("most"), F.col("m.times").alias("times"))
    parts = F.ceil(F.greatest(F.col("members") / block, F.col("held") / (LEAF_SHINGLES / 2))).cast("int")
    placed = wide.join(most, "region").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    one_sided = F.col("times") * 2 > F.col("members")
    there = F.when(one_sided & (F.col("label") == F.col("most")), F.array(F.struct("own", F.col("own").alias("other"))))
    there = there.when(one_sided, F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(i.alias("own"), i.alias("other"))))
    there = there.otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.least("own", i).alias("own"), F.greatest("own", i).alias("other"))))
    return placed.withColumn("x", F.explode(there)).select("region", F.col("x.own").alias("i"), F.col("x.other").alias("j"), "node", "n", "shingles", "label")


def links(found: DataFrame, percent: int = PERCENT, leaf: int = LEAF, pivots: int = PIVOTS, depth: int = DEPTH, block: int = BLOCK, wide_from: float = WIDE, most: tuple[int, int, int] | None = None) -> DataFrame:
    """(node, root): sets that are linked to others, directly or by a chain, with the smallest of these. ``found``: node (a number), n, shingles, anchors, a row a set;
    ``most``: how many rows, shingles and anchors it has at most, where that is known."""
    rows, shingles, anchors = most or (None, 0, None)
    groups = components(_stars(found.select("node", "anchors")), anchors)
    todo = materialise(found.join(groups, "node").select(F.hex("root").alias("region"), "node", "n", "shingles", F.col("node").alias("label")), "members", rows, 8 * shingles)
    whole, out = None, []  # links of whole groups, which are components as they are; of parts of groups
    held = F.sum(F.octet_length("shingles") / 8).cast("long")
    for level in range(depth + 1):
        counted = materialise(todo.groupBy("region").agg(F.count("*").alias("members"), held.alias("held")), "regions", rows if level == 0 else None)
        small = (F.col("members") <= leaf) & (F.col("held") <= LEAF_SHINGLES)
        large = counted.where(~small)
        done = large.isEmpty()
        leaves = _leaves(todo if done else todo.join(counted.where(small).select("region"), "region"), ["region"], percent)
        if whole is None:
            whole = leaves
        else:
            out.append(leaves)
        if done:
            break
        big = todo.join(large.select("region"), "region")
        split = materialise(_split(big.drop("label"), level, percent, pivots), "split")
        out.append(split.select(F.col("node").alias("a"), F.explode("near").alias("b")))
        known = components(reduce(DataFrame.unionAll, out))  # what is linked by now needs no more comparison
        labelled = split.join(known, "node", "left").withColumn("label", F.coalesce("root", "node"))
        wide = labelled.groupBy("region").agg((F.avg(F.size("regions")) > (0 if level == depth else wide_from)).alias("wide"), F.count("*").alias("members"), held.alias("held"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
        labelled = materialise(labelled.join(wide.drop("x", "y"), "region").select("region", "node", "n", "shingles", "label", "regions", "wide", "members", "held"), "labelled")
        out.append(_leaves(_blocks(labelled.where("wide"), block), ["region", "i", "j"], percent))
        narrow = labelled.where("NOT wide")
        if narrow.isEmpty():
            break
        deeper = narrow.select("node", "n", "shingles", "label", F.explode("regions").alias("region"))
        undecided = deeper.groupBy("region").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("region")
        todo = materialise(deeper.join(undecided, "region").select("region", "node", "n", "shingles", "label"), "members")
    whole = whole.select(F.col("b").alias("node"), F.col("a").alias("root"))
    whole = whole.unionAll(whole.select(F.col("root").alias("node"), "root").distinct())
    return whole.unionAll(components(reduce(DataFrame.unionAll, out))) if out else whole


def _stars(anchored: DataFrame) -> DataFrame:
    """(a, b): edges that join sets with an anchor in common, from (node, anchors). The anchors of a task are contracted there, so a set has one edge a task at most."""

    def spread():
        def run(rows):
            for node, data in rows:
                for anchor in np.frombuffer(data, "<i8").tolist():
                    yield anchor, node

        return run

    dealt = generate(anchored, spread, "anchor long, node long", rows=1 << 16).repartition(partitions(anchored.sparkSession), "anchor")

    def make():
        def run(rows):
            number: dict[int, int] = {}
            first: dict[int, int] = {}
            forest = _Forest(0)
            for anchor, node in rows:
                i = number.setdefault(node, len(number))
                if i == len(forest.up):
                    forest.up.append(i)
                forest.join(i, first.setdefault(anchor, i))
            nodes = list(number)
            for i, node in enumerate(nodes):
                if (root := forest.find(i)) != i:
                    yield nodes[root], node

        return run

    return generate(dealt, make, "a long, b long", rows=1 << 16)


def _numbered(all_sets: DataFrame) -> DataFrame:
    """Adds node, a 64-bit hash of set_key that no two keys share; null for the empty set."""
    for seed in range(100):
        numbered = all_sets.withColumn("node", F.when(F.col("set_key").isNotNull(), F.xxhash64("set_key", F.lit(seed))))
        keys = numbered.where("node IS NOT NULL").groupBy("node").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y"))
        if keys.where("x <> y").isEmpty():
            return numbered
    raise RuntimeError("no seed tells the keys apart")


def classes(documents: DataFrame, percent: int = PERCENT, held: int | None = None, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash, component) of every row: the size of its set, and the smallest doc_id that links reach from it, itself included;
    text_hash is xxhash64 of its text, component tells its class (null for an empty set).

    Null and empty texts have the empty set and are alone, as is a row with a null id unless rows with ids are linked to it. Repeated rows get equal results; extra
    columns are left out. ``documents`` should come straight from a table, so that a repeated task reads the same rows; write it first if it comes from a shuffle.
    """
    held = _counts(documents)[1] if held is None else held
    all_sets = _numbered(materialise(filled(sets(documents, percent, held), held), "sets"))
    rows, *most = all_sets.agg(F.count("*"), F.count("anchors"), F.sum(F.when(F.col("anchors").isNotNull(), F.col("n_shingles"))), F.sum(F.octet_length("anchors") / 8).cast("long")).first()
    most = tuple(n or 0 for n in most)
    found = all_sets.where("anchors IS NOT NULL").groupBy("node").agg(F.first("n_shingles").cast("int").alias("n"), F.first("shingles").alias("shingles"), F.first("anchors").alias("anchors"))
    firsts = all_sets.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"))
    joined = materialise(firsts.join(links(found, percent, most=most, **options), "node", "left").select("node", "first", "root"), "firsts", rows)
    least = materialise(joined.where("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("sets")), "least", rows)
    # classes of very many sets are told by broadcast: each has more than an even share of all sets, so there are at most HUBS of them
    hub = max(HUB, (least.agg(F.sum("sets")).first()[0] or 0) // HUBS)
    often = F.broadcast(least.where(F.col("sets") > hub).select("root", F.col("least").alias("often")))
    seldom = least.where(F.col("sets") <= hub).select(F.col("root").alias("r"), F.col("least").alias("seldom"))
    told = joined.join(often, "root", "left").join(seldom, F.when(F.col("often").isNull(), F.col("root")) == F.col("r"), "left")
    ends = told.select("node", F.coalesce("often", "seldom", "first").alias("reached"), F.coalesce("root", "node").alias("component"))
    whole = all_sets.select("doc_id", "n_shingles", "text_hash", "node").join(ends, "node", "left")
    return whole.select("doc_id", "n_shingles", F.coalesce("reached", "doc_id").alias("component_id"), "text_hash", "component").coalesce(files(rows))


def one_of_each(documents: DataFrame, percent: int = PERCENT, **options) -> DataFrame:
    """Of each class of linked documents the one with the smallest (doc_id, text_hash), nulls last; a document with the empty set is alone. All columns stay.

    Rows of one doc_id and one text are one document: the first in the order of their JSON stays. Rows that share a doc_id but not the text are told apart.
    They come in as few partitions as their texts fill, but two for each core at least.
    """
    rows, held = _counts(documents)
    found = materialise(classes(documents, percent, held, **options).select("doc_id", "text_hash", "component"), "classes", rows)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    linked = found.where(F.col("component").isNotNull()).groupBy("component").agg(F.min(order).alias("f"), F.count("*").alias("times")).select("f.doc_id", "f.text_hash", "times")
    alone = found.where(F.col("component").isNull()).groupBy("doc_id", "text_hash").agg(F.count("*").alias("times"))
    kept = materialise(linked.unionByName(alone).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "times"), "kept", rows)
    places = [f"c{i}" for i in range(len(documents.columns))]
    rows = documents.select(F.col("doc_id").cast("long").alias("row_id"), F.xxhash64("text").alias("row_hash"), *[F.col(f"`{c}`").alias(p) for c, p in zip(documents.columns, places, strict=True)])
    same = F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_hash") == F.col("hash"))
    single = rows.join(kept.where("times = 1"), same, "left_semi").select(*places)
    several = rows.join(kept.where("times > 1").select("id", "hash"), same)  # a class of one row has no repeated rows
    whole = F.struct(*places)
    first = several.groupBy("id", "hash").agg(F.min_by(whole, F.to_json(whole)).alias("r")).select("r.*")
    return filled(single.unionAll(first).toDF(*documents.columns), held)
