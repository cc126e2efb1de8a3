"""Personal data by bootstrapped contextual extraction, with DataFrame operations only.

Seed entities (email, ip, card and phone numbers found by fixed patterns) induce lexical patterns: the words left and right of them. Patterns and
instances form a graph that Spark scores in rounds: a pattern is as good as the share of a kind among all known instances that it surrounds and those words
there that can't be of the kind, an instance as likely as its patterns together (noisy or). Instances of unseen form that confident patterns surround become spans too, and support patterns as seeds do, until no round finds a new one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise

#: The kinds in their order. Runs that could be scanned again from each of their signs are entered at their start or where
#: the last match ended, and repeats are possessive, which finds the same matches in linear time and constant stack.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts that don't match this cheap test are passed over.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "other": "[0-9@]"}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: A word with a digit or an at sign: what an identifier of unseen form looks like.
OTHER = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Characters that are looked at for the words on either side.
NEAR = 48
#: A pattern counts from so many different instances on, seeds or found ones, and from this share of a kind among what is known of all that it surrounds.
SUPPORT, CONFIDENCE = 5, 0.8

#: Code points of a block of text from which pieces are cut.
TEXT_BLOCK = 4096
PIECES = "array<struct<from:int,to:int,name:string>>"
SPAN = "array<struct<value:string,start:int,end:int,left:string,right:string>>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn test."""
    n = F.length(digits)
    at = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")  # noqa: E731  i: place from the right, from 0
    one = lambda i: F.when(i % 2 == 0, at(i)).otherwise(at(i) * 2 - F.when(at(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + one(i)) % 10 == 0


def _holds(kind: str, m: Column) -> Column:
    """The test that a match of the kind's pattern must pass."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    digits = _digits(m)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.length(m) >= 6


def _numbered(number: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"))


def _of(number: int):
    return lambda s: s["kind"] == number


#: Elements that a scan brings together at a time, so that its time grows in proportion to the array for all but huge ones.
CHUNK = 64


def _scan(n: Column, state: Column, step, out: str) -> Column:
    """The outputs of ``step`` for i = 0 to n - 1, in order: it takes the state (a struct) and i, and returns (new state, array of outputs); ``out`` is that array's type.

    Arrays in SQL are copied when they grow, so outputs are gathered in chunks first.
    """

    def one(acc: Column, i: Column) -> Column:
        now, found = step(acc["s"], i)
        return F.struct(now.alias("s"), F.concat(acc["out"], found).alias("out"))

    def chunk(acc: Column, at: Column) -> Column:
        inner = F.aggregate(F.sequence(at, F.least(at + CHUNK, n) - 1), F.struct(acc["s"].alias("s"), F.array().cast(out).alias("out")), one)
        return F.get(F.transform(F.array(inner), lambda r: F.struct(r["s"].alias("s"), F.concat(acc["out"], F.array(r["out"])).alias("out"))), F.lit(0))

    first = F.struct(state.alias("s"), F.array().cast(f"array<{out}>").alias("out"))
    whole = F.aggregate(F.sequence(F.lit(0), n - 1, F.lit(CHUNK)), first, chunk, lambda acc: F.flatten(acc["out"]))
    return F.when(n > 0, whole).otherwise(F.array().cast(out))


def _placed(kind: str, values: Column, gaps: Column) -> Column:
    """From matches of a kind and the texts between them: structs (value, start, end, left, right) of those that pass its test, in code points, end exclusive; the words on either side in lower case, "" for none.

    The words are those of the text, so they may be matches themselves.
    """
    first = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, NEAR)
    last = lambda c: F.right(F.coalesce(c, F.lit("")), F.lit(NEAR))
    short = lambda i: F.length(F.get(gaps, i)) < NEAR

    def step(state: Column, i: Column) -> tuple[Column, Column]:
        value, start = F.get(values, i), state["at"] + F.length(F.get(gaps, i))
        before = F.concat(F.when(short(i) & (i > 0), F.concat(last(F.get(gaps, i - 1)), last(F.get(values, i - 1)))).otherwise(F.lit("")), last(F.get(gaps, i)))
        after = F.concat(first(F.get(gaps, i + 1)), F.when(short(i + 1), F.concat(first(F.get(values, i + 1)), first(F.get(gaps, i + 2)))).otherwise(F.lit("")))
        left = F.lower(F.regexp_extract(last(before), r"(?<!\S)(\S+)\s*$", 1))
        right = F.lower(F.regexp_extract(first(after), r"^[^\w\s]*\s*(\S+)", 1))
        one = F.struct(value.alias("value"), start.alias("start"), (start + F.length(value)).alias("end"), left.alias("left"), right.alias("right"))
        return F.struct((start + F.length(value)).alias("at")), F.when(_holds(kind, value), F.array(one)).otherwise(F.array().cast(SPAN))

    return _scan(F.size(values), F.struct(F.lit(0).alias("at")), step, SPAN)


def _meets(spans: str, s: Column) -> Column:
    """Whether the span ``s`` overlaps one of the spans in a column, which are in order and apart: by bisection, the last that starts before the end of ``s``."""
    n = F.size(spans)

    def halve(a: Column, _) -> Column:
        middle = F.floor((a["low"] + a["high"]) / 2).cast("int")
        before = (a["low"] < a["high"]) & (F.get(F.col(spans), middle)["start"] < s["end"])
        return F.struct(F.when(before, middle + 1).otherwise(a["low"]).alias("low"), F.when(before, a["high"]).otherwise(F.least(a["high"], middle)).alias("high"))

    halvings = F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int"))
    last = F.aggregate(halvings, F.struct(F.lit(0).alias("low"), n.alias("high")), halve, lambda a: F.get(F.col(spans), a["low"] - 1)["end"])
    return F.when(n > 0, F.coalesce(last > s["start"], F.lit(False))).otherwise(False)


def find(documents: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, and for each kind a column of spans that the fixed patterns find, and ``other``: words with a digit or an at sign that meet none of them.

    Null and empty texts have none of either. The time is in proportion to the text and its matches (times their logarithm), as a text may hold many.
    """
    patterns = PATTERNS | {"other": OTHER}
    text = F.coalesce(F.col("text"), F.lit(""))
    held = documents.select(*[F.col(f"`{c}`") for c in keep], text.alias("__text"))
    nothing = F.array().cast("array<string>")
    for kind, pattern in patterns.items():
        there = F.col("__text").rlike(NEEDS[kind])
        held = held.withColumns({
            f"__v_{kind}": F.when(there, F.regexp_extract_all("__text", F.lit(pattern), F.lit(0))).otherwise(nothing),
            f"__g_{kind}": F.when(there, F.split("__text", pattern, -1)).otherwise(nothing),
        })
    tested = held.select(*[F.col(f"`{c}`") for c in keep], *[_placed(k, F.col(f"__v_{k}"), F.col(f"__g_{k}")).alias(k) for k in patterns])
    free = lambda s: reduce(lambda a, b: a & b, [~_meets(k, s) for k in KINDS])
    return tested.withColumn("other", F.filter("other", free))


def _may_be(kind: str, value: Column) -> Column:
    """Whether an unseen form could be of the kind at all."""
    if kind == "email":
        return value.contains("@")
    return (F.length(_digits(value)) >= 7) & ~value.rlike("[A-Za-z]")


def discover(found: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int | None = None, most: int | None = None) -> DataFrame:
    """(doc_id, text_hash, kind, start, end): further spans that confident patterns tell. ``found``: doc_id, text_hash and the columns of ``find``, materialised; ``rounds``: None for as many as find new ones; ``most``: how many occurrences there are, where that is known.

    Occurrences are first counted per pattern and value, so a frequent pattern costs no more than its different values.
    """
    one = lambda kind: found.select("doc_id", "text_hash", F.explode(kind).alias("s")).select("doc_id", "text_hash", F.lit(kind).alias("kind"), "s.value", "s.start", "s.end", "s.left", "s.right")
    occurrences = reduce(DataFrame.unionAll, [one(k) for k in (*KINDS, "other")])
    there = lambda *sides: F.when(reduce(lambda a, b: a & b, [F.col(c) != "" for c in ("left", "right") if c in sides]), F.concat_ws("\n", *[c if c in sides else F.lit("") for c in ("left", "right")]))
    context = F.array_compact(F.array(there("left"), there("left", "right"), there("right")))
    graph = occurrences.select("kind", "value", F.explode(context).alias("pattern")).groupBy("pattern", "kind", "value").agg(F.lit(1.0).alias("w"))
    graph = materialise(graph, "pii-graph", None if most is None else 3 * most)
    seeds = graph.where("kind <> 'other'")
    candidates = graph.where("kind = 'other'").select("pattern", "value")
    never = F.array(*[F.sum(F.when(~_may_be(k, F.col("value")), 1).otherwise(0)) for k in KINDS])
    against = candidates.groupBy("pattern").agg(never.alias("never"))  # what a pattern surrounds that can't be of a kind; other candidates are no evidence either way
    accepted, done = None, 0
    while rounds is None or done < rounds:
        instances = seeds.select("pattern", "kind", "w")
        if accepted is not None:
            instances = instances.unionAll(candidates.join(accepted, "value").select("pattern", "kind", F.col("score").alias("w")))
        mass = instances.groupBy("pattern", "kind").agg(F.sum("w").alias("mass"), F.count("*").alias("seeds"))
        known = mass.groupBy("pattern").agg(F.sum("mass").alias("known"))
        judged = mass.where(F.col("seeds") >= support).join(known, "pattern").join(against, "pattern", "left")
        number = reduce(lambda a, k: a.when(F.col("kind") == KINDS[k], F.get("never", F.lit(k))), range(len(KINDS)), F.when(F.lit(False), F.lit(0).cast("long")))
        n = F.col("known") + F.coalesce(number, F.lit(0))
        good = judged.withColumn("trust", F.least(F.col("mass") / n, F.lit(0.99))).where(F.col("trust") >= confidence)
        scored = candidates.join(good.select("pattern", "kind", "trust"), "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("trust"))))).alias("score"))
        fits = reduce(lambda a, k: a.when(F.col("kind") == k, _may_be(k, F.col("value"))), KINDS, F.when(F.lit(False), F.lit(False)))
        ranked = scored.where(fits & (F.col("score") >= confidence)).groupBy("value").agg(F.max(F.struct("score", "kind")).alias("best")).select("value", "best.kind", "best.score")
        new = materialise(ranked if accepted is None else ranked.join(accepted, "value", "left_anti"), "pii-accepted")
        done += 1
        if accepted is not None and new.isEmpty():
            break
        accepted = new if accepted is None else accepted.unionAll(new)
        if new.isEmpty():
            break
    return one("other").drop("kind").join(accepted, "value").select("doc_id", "text_hash", "kind", "start", "end").distinct()


def _base(kinds: list[str]) -> Column:
    """The base spans of the columns of ``find``: structs (start, kind, end) in ascending order."""
    return F.sort_array(F.concat(*[F.transform(k, _numbered(i)) for i, k in enumerate(kinds)]))


def _learnt(documents: DataFrame, **options) -> tuple[DataFrame, DataFrame | None]:
    """(what the fixed patterns find, further spans by row or None for none). The texts are scanned once; what was found, without them, is written to the shared folder."""
    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    times = reduce(lambda a, b: a + b, [F.size(k).cast("long") for k in (*KINDS, "other")])
    found = materialise(find(rows, ["doc_id", "text_hash"]).withColumn("times", times), "pii-found")
    added = discover(found, most=found.agg(F.sum("times")).first()[0] or 0, **options)
    if added.isEmpty():
        return found, None
    number = reduce(lambda a, k: a.when(F.col("kind") == KINDS[k], F.lit(k)), range(len(KINDS)), F.when(F.lit(False), F.lit(0)))
    return found, added.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.collect_list(F.struct("start", number.alias("kind"), "end")).alias("added"))


def _with_spans(rows: DataFrame, added: DataFrame | None) -> DataFrame:
    """Adds spans: the column base and, where there are any, the added ones of the same doc_id and text_hash."""
    if added is None:
        return rows.withColumn("spans", F.col("base"))
    joined = rows.join(added, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    return joined.withColumn("spans", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "added")))).drop("d", "h", "added")


def extract(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, text_hash, base, spans) of every row: arrays of structs (start, kind, end), kind by its place in KINDS, in ascending order.

    ``base`` is what the fixed patterns find, ``spans`` that and what the learnt patterns add. Null and empty texts have none; repeated rows have equal spans.
    """
    found, added = _learnt(documents, **options)
    return _with_spans(found.select("doc_id", "text_hash", _base(list(KINDS)).alias("base")), added)


def written(spans: str) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of the base spans, and all spans written out."""
    got = extract(documents, **options)
    counts = [F.size(F.filter("base", _of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return got.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


def redact(documents: DataFrame, **options) -> DataFrame:
    """The documents with each span, overlapping ones together, replaced by its kind in brackets, such as [EMAIL]. Texts without spans and all other columns stay; n_chars, where there, follows the text.

    Null and empty texts stay as they are, repeated rows are treated alike. Base spans are found again beside the text, so texts meet in a shuffle only those spans that learnt patterns add, if there are any.
    """
    columns = documents.columns
    _, added = _learnt(documents, **options)
    sent = documents.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(columns)], "doc_id", "text", F.xxhash64("text").alias("text_hash"))
    placed = find(sent, sent.columns)
    joined = _with_spans(placed.select(*sent.columns, _base(list(KINDS)).alias("base")), added)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def fresh(state: Column, i: Column) -> tuple[Column, Column]:
        s = F.get(F.col("spans"), i)
        one = F.struct(state["at"].alias("from"), s["start"].alias("to"), F.get(names, s["kind"]).alias("name"))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at")), F.when(s["start"] >= state["at"], F.array(one)).otherwise(F.array().cast(PIECES))

    def kept(start: Column, end: Column) -> Column:
        """The text between two places, from blocks, as a place in a long text is found by reading on from its start."""
        part = lambda k: F.substring(F.get(F.col("blocks"), k), F.greatest(start - k * TEXT_BLOCK, F.lit(0)) + 1, F.least(end - k * TEXT_BLOCK, F.lit(TEXT_BLOCK)) - F.greatest(start - k * TEXT_BLOCK, F.lit(0)))
        numbers = F.sequence(F.floor(start / TEXT_BLOCK).cast("int"), F.floor((end - 1) / TEXT_BLOCK).cast("int"))
        return F.when(end > start, F.array_join(F.transform(numbers, part), "")).otherwise(F.lit(""))

    # an overlapping span after the first goes with it, so its end is where the next piece begins
    blocks = F.transform(F.sequence(F.lit(0), F.length("text"), F.lit(TEXT_BLOCK)), lambda i: F.substring(F.col("text"), i + 1, F.lit(TEXT_BLOCK)))
    joined = joined.withColumn("blocks", F.when(F.size("spans") > 0, blocks)).withColumn("pieces", F.when(F.size("spans") > 0, _scan(F.size("spans"), F.struct(F.lit(0).alias("at")), fresh, PIECES)))
    last = F.aggregate("spans", F.lit(0), lambda a, s: F.greatest(a, s["end"]))
    clean = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(kept(p["from"], p["to"]), p["name"])), ""), kept(last, F.length("text")))
    there = F.size("spans") > 0
    values = {c: F.col(f"__c{i}") for i, c in enumerate(columns)}
    values["text"] = F.when(there, clean).otherwise(F.col("text"))
    if "n_chars" in columns:
        values["n_chars"] = F.when(there, F.length(values["text"]).cast(dict(documents.dtypes)["n_chars"])).otherwise(values["n_chars"])
    return joined.select(*[v.alias(c) for c, v in values.items()])
