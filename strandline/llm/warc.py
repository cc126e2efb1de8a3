"""Content-addressed WARC archive.

Payload bytes are stored once, under their SHA-256 digest; exact record headers are stored separately; original records come back by joining both.
Every payload that is read is digested again and compared with its key, and so is its length. What a reader knows of a record it takes from the
record's own bytes.

A record's block is an HTTP response: for a response its header and the payload, for a revisit its header alone. Payloads below ``LEAST`` bytes are
never replaced by a revisit; they are shorter than their record header and stay beside it, so neither writing nor reading joins on the few digests
(such as that of no bytes) that a large share of all rows may have.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialise, partitions

#: Payloads shorter than this many bytes are never replaced by a revisit.
LEAST = 100
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http;msgtype=response"
#: Rows of a digest from which it is hot, at least; and how many hot digests there may be, which bounds what is broadcast.
HOT, HOTS = 256, 10_000


def _line(name: str, value) -> F.Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _with_firsts(rows: DataFrame, least: int) -> DataFrame:
    """Adds first, the struct (page_id, number) of the record that others of equal payload refer to; null where no other record has that payload, or it is below ``least`` bytes.

    Only digests of two or more rows meet the rows, and those of very many rows by broadcast, so that no task reads all rows of one.
    """
    large = rows.where(F.col("payload_bytes") >= least)
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "number")  # nulls last
    firsts = large.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("times")).where("times > 1")
    firsts = materialise(firsts.select("digest", F.struct("first.page_id", "first.number").alias("first"), "times"), "warc-firsts")
    total = firsts.agg(F.sum("times")).first()[0] or 0
    hot = max(HOT, total // HOTS)
    often = F.broadcast(firsts.where(F.col("times") > hot).select("digest", F.col("first").alias("often")))
    seldom = firsts.where(F.col("times") <= hot).select(F.col("digest").alias("d"), F.col("first").alias("seldom"))
    marked = rows.join(often, "digest", "left")
    alone = F.col("often").isNull() & (F.col("payload_bytes") >= least)
    # rows that need no partner get a key of their own kind, so that they are dealt evenly
    key = F.when(alone, F.col("digest")).otherwise(F.concat(F.lit("-"), F.col("number").cast("string")))
    joined = marked.withColumn("key", key).join(seldom, F.col("key") == F.col("d"), "left")
    return joined.withColumn("first", F.coalesce("often", "seldom")).drop("often", "seldom", "key", "d")


def describe(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", least: int = LEAST) -> DataFrame:
    """(digest, header, http, small) for each row, without other payloads: the record header and the HTTP header as they are written, and the payload where it is below ``least`` bytes.

    Of records with equal payloads of ``least`` bytes or more, the smallest page_id (nulls last) is the response, and so are its own repeated rows; others revisit
    it. A null html is an empty payload, a null url an empty target; line ends in a url are percent-encoded. Every record has an id of its own, which names its
    page_id. An empty table gives no records; extra columns are left out.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes"), payload.alias("payload"))
    rows = rows.withColumn("small", F.when(F.col("payload_bytes") < least, F.col("payload"))).drop("payload").withColumn("number", F.monotonically_increasing_id())
    joined = _with_firsts(materialise(rows, "warc-rows"), least)  # written, so that a record's number is the same wherever it is named
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    identity = lambda page, number: F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), number.cast("string"), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), _line("Content-Type", F.lit("text/html; charset=utf-8")), _line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    size = F.octet_length("http") + F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("payload_bytes"))
    header = F.concat(
        F.lit(f"{VERSION}\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", identity(F.col("page_id"), F.col("number"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", identity(F.col("first.page_id"), F.col("first.number"))), _line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        _line("Content-Type", F.lit(HTTP)),
        _line("Content-Length", size.cast("string")),
        F.lit("\r\n"),
    )
    return joined.withColumn("http", http).select("digest", header.alias("header"), "http", "small", revisit.alias("bare"))


def write_archive(pages: DataFrame, path: str, **options) -> None:
    """Writes ``path``/headers (a row for each record, by ``describe``) and ``path``/payloads (a row for each distinct payload that headers don't hold: digest, payload).

    Null html and url, repeated rows and empty tables are as in ``describe``. Repeated payloads meet per task before the shuffle; one digest's row count doesn't matter, as partial aggregation leaves one a task.
    """
    describe(pages, **options).write.mode("overwrite").parquet(f"{path}/headers")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    store = pages.select(payload.alias("payload")).where(F.octet_length("payload") >= options.get("least", LEAST)).select(F.sha2("payload", 256).alias("digest"), "payload")
    (store.groupBy("digest").agg(F.first("payload").alias("payload")).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record): the bytes of each WARC record, put together from the headers and the stored payloads. Raises where a payload is missing or doesn't match its digest."""
    headers = spark.read.parquet(f"{path}/headers")
    stored = spark.read.parquet(f"{path}/payloads").withColumn("stored", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")))
    # a payload is wanted by its response alone, once but for repeated rows; records without one are dealt evenly
    wanted = ~F.col("bare") & F.col("small").isNull()
    missing = F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("binary")
    whole = headers.where(wanted).join(stored.select("digest", "stored"), "digest", "left").select("header", "http", F.when(F.col("stored").isNull(), missing).otherwise(F.col("stored")).alias("payload"))
    rest = headers.where(~wanted).select("header", "http", F.coalesce("small", F.lit("").cast("binary")).alias("payload"))
    end = F.lit("\r\n\r\n").cast("binary")
    return whole.unionAll(rest).select(F.concat(F.col("header").cast("binary"), F.col("http").cast("binary"), F.col("payload"), end).alias("record"))


def _field(header, name: str):
    return F.regexp_extract(header, rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)


def read_records(records: DataFrame) -> DataFrame:
    """(page_id, record_type, refers_to, digest, payload_bytes, payload, target, record_id) from the bytes of WARC records of this archive's kind.

    payload_bytes is the full payload's length, for a revisit too, whose payload is null. Raises where a record is malformed, or its payload doesn't match its digest or length.
    """
    text, blank = F.col("record").cast("string"), "\r\n\r\n"
    header = F.substring_index(text, blank, 1)
    cut = records.select("record", header.alias("header"))
    cut = cut.select("record", "header", F.octet_length("header").alias("head"), _field(F.col("header"), "Content-Length").cast("int").alias("size"))
    block = F.substring("record", F.col("head") + 5, F.col("size"))
    sound = F.col("header").startswith("WARC/") & (F.octet_length("record") == F.col("head") + F.col("size") + 8) & (F.right(text, F.lit(4)) == blank)
    blocks = cut.select("header", F.when(F.coalesce(sound, F.lit(False)), block).otherwise(F.raise_error(F.lit("malformed WARC record")).cast("binary")).alias("block"))
    http = F.substring_index(F.col("block").cast("string"), blank, 1)
    parts = blocks.select("header", "block", http.alias("http"))
    kind = _field(F.col("header"), "WARC-Type")
    told = parts.select(
        _field(F.col("header"), "WARC-Record-ID").alias("record_id"), kind.alias("record_type"), _field(F.col("header"), "WARC-Refers-To").alias("target_id"),
        _field(F.col("header"), "WARC-Target-URI").alias("target"), F.regexp_extract(_field(F.col("header"), "WARC-Payload-Digest"), "^sha256:([0-9a-f]{64})$", 1).alias("digest"),
        _field(F.col("http"), "Content-Length").cast("long").alias("payload_bytes"), F.when(kind == "response", F.substring("block", F.octet_length("http") + 5, F.octet_length("block"))).alias("payload"),
    )
    right = (F.col("record_type") == "revisit") | ((F.sha2("payload", 256) == F.col("digest")) & (F.octet_length("payload") == F.col("payload_bytes")))
    page = lambda c: F.regexp_extract(c, "^<urn:x-page:(-?[0-9]+):", 1)
    known = lambda c: F.when(page(c) != "", page(c).cast("long"))
    checked = told.withColumn("digest", F.when(F.coalesce(right, F.lit(False)), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.col("record_id")))))
    return checked.select(known(F.col("record_id")).alias("page_id"), "record_type", known(F.col("target_id")).alias("refers_to"), "digest", "payload_bytes", "payload", "target", "record_id")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The columns of ``read_records`` for every record of the archive."""
    return read_records(records(spark, path))


def parse_records(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record in the bytes of a WARC file. Raises ValueError on malformed bytes."""
    found, at = [], 0
    while at < len(data):
        cut = data.find(b"\r\n\r\n", at)
        if cut < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(re.findall(r"([^:\r\n]+): ?([^\r\n]*)", data[at:cut].decode("utf-8").split("\r\n", 1)[1]))
        size = int(fields["Content-Length"])
        block = data[cut + 4 : cut + 4 + size]
        if len(block) != size or data[cut + 4 + size : cut + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut off")
        found.append((fields, block))
        at = cut + 8 + size
    return found


def export(spark: SparkSession, path: str, target: str) -> None:
    """Writes the records as one Parquet row each, dealt evenly over the session's shuffle partitions."""
    records(spark, path).repartition(partitions(spark)).write.mode("overwrite").parquet(target)


def report(archive: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records that were read back: all of it is read from the records' bytes."""
    return archive.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")
