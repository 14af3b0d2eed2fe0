"""Content-addressed archive of web records.

A payload is stored once, under its SHA-256 address; the exact header of every
record is stored apart. Records are rebuilt by joining headers to payloads on the
address, after the payload bytes read back have been hashed again and found to
match. Records of equal payloads of at least ``least`` bytes: the one with the
largest id is the response and the others are revisits that refer to it.

A payload that a third of all pages share is grouped by digest with partial sums,
so its rows never meet; payload bytes are shuffled once, by page id, and only the
chosen ones are written.

Defined results: a NULL page has an empty payload; a NULL URL leaves out the
target header; control characters in a URL are percent-encoded in the header. Of
rows without an id, all are responses where no row of the payload has an id.
Repeated rows with the largest id are all responses; their payload is stored once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .store import string_or_empty

# The base32 alphabet and the revisit profile of the format.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADER_END = "\r\n\r\n"
HEADER, PAYLOAD = "page_id long, header binary", "address string, payload binary"


def base32_of_hex(digest: Column) -> Column:
    """A hexadecimal SHA-1 as base32: five bytes are eight letters."""
    out = []
    for part in range(4):
        number = F.conv(F.substring(digest, 1 + 10 * part, 10), 16, 10).cast("long")
        for k in range(7, -1, -1):
            letter = F.shiftright(number, 5 * k).bitwiseAND(F.lit(31)).cast("int")
            out.append(F.lit(BASE32).substr(letter + 1, F.lit(1)))
    return F.concat(*out)


def _header(date: str) -> Column:
    """The header block of a record, as text; ``__type``, ``__id`` and so on are
    columns of the record."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")))
    none = F.lit("")
    revisit = F.col("record_type") == "revisit"
    url = F.expr(r"regexp_replace(regexp_replace(__url, '\\r', '%0D'), '\\n', '%0A')")
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        F.coalesce(line("WARC-Record-ID", name(F.col("page_id"))), none),
        F.coalesce(line("WARC-Target-URI", url), none),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Content-Address", F.concat(F.lit("sha256:"), F.col("address"))),
        F.coalesce(line("WARC-Refers-To", name(F.col("refers_to"))), none),
        F.coalesce(line("WARC-Profile", F.when(revisit, F.lit(PROFILE))), none),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
    )


@dataclass
class Archive:
    """Paths of the two tables of an archive."""

    headers: str
    payloads: str

    def records(self, spark: SparkSession) -> DataFrame:
        """Fields of every record, read from its header bytes."""
        head = F.col("header").cast("string")
        take = lambda name, pattern="(.*)": F.regexp_extract(head, rf"\r\n{name}: {pattern}\r\n", 1)
        number = lambda name: F.nullif(take(name, "<urn:page:(-?[0-9]+)>"), F.lit("")).cast("long")
        return spark.read.schema(HEADER).parquet(self.headers).select(
            number("WARC-Record-ID").alias("page_id"),
            take("WARC-Type").alias("record_type"),
            number("WARC-Refers-To").alias("refers_to"),
            take("X-Content-Address", "sha256:([0-9a-f]+)").alias("address"),
            take("WARC-Payload-Digest", "sha1:([A-Z2-7]+)").alias("header_digest"),
            take("Content-Length", "([0-9]+)").cast("long").alias("block_bytes"),
            "header",
        )

    def reconstruct(self, spark: SparkSession, payloads_of: str = "true") -> DataFrame:
        """Every record with its exact bytes: header, content block (the payload of a
        response, nothing for a revisit) and the two line ends that close a record. Only
        records for which ``payloads_of`` holds meet their payload. One payload row meets
        its records; a payload of many records is a skewed join, which adaptive execution
        splits."""
        payloads = spark.read.schema(PAYLOAD).parquet(self.payloads)
        out = self.records(spark).filter(payloads_of).join(payloads, "address", "left")
        block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
        return out.withColumn("record", F.concat("header", block, F.lit(HEADER_END.encode())))

    def checked(self, spark: SparkSession) -> DataFrame:
        """What the rebuilt records say of each page: ``page_id``, ``payload_bytes``,
        ``payload_digest``, ``record_type``, ``refers_to``. A response is rebuilt to its
        last byte, and its block is cut out again by the header's length; a block that is
        missing, of another length, or that hashes neither to its address nor to the
        digest of its header ends the read. A revisit is rebuilt without a block and
        takes length and digest from the response to its payload."""
        built = self.reconstruct(spark, "record_type = 'response'").select("page_id", "refers_to", "address", "header_digest", "block_bytes", "header", "record")
        body = F.substring(F.col("record"), F.octet_length("header") + 1, F.col("block_bytes").cast("int"))
        built = built.withColumn("body", body)
        whole = (
            (F.octet_length("record") == F.octet_length("header") + F.col("block_bytes") + len(HEADER_END))
            & (F.sha2("body", 256) == F.col("address"))
            & (base32_of_hex(F.sha1("body")) == F.col("header_digest"))
        )
        damaged = F.raise_error(F.concat(F.lit("damaged record of payload "), F.col("address")))
        good = F.when(F.coalesce(whole, F.lit(False)), F.col("header_digest")).otherwise(damaged)
        responses = built.select("page_id", "address", F.col("block_bytes").alias("payload_bytes"), good.alias("payload_digest"), F.lit("response").alias("record_type"), "refers_to")
        facts = responses.groupBy("address").agg(F.max("payload_bytes").alias("n"), F.max("payload_digest").alias("known"))
        again = self.records(spark).filter("record_type = 'revisit'")
        again = again.withColumn("record", F.concat("header", F.lit(HEADER_END.encode()))).join(facts, "address", "left")
        same = (F.col("known") == F.col("header_digest")) & (F.col("block_bytes") == 0)
        same = same & (F.octet_length("record") == F.octet_length("header") + len(HEADER_END))
        known = F.when(F.coalesce(same, F.lit(False)), F.col("known")).otherwise(damaged)
        revisits = again.select("page_id", F.col("n").alias("payload_bytes"), known.alias("payload_digest"), "record_type", "refers_to")
        return responses.drop("address").unionByName(revisits)


def write_archive(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0,
    date: str = "2024-01-01T00:00:00Z", folder: str | None = None,
) -> Archive:
    """Write the records of ``pages`` to a new archive in the shared folder."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "archive")
    payload = F.encode(string_or_empty(pages, html), "UTF-8")
    base = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("__url"), payload.alias("payload"))
    facts = base.select(
        "page_id",
        "__url",
        F.sha2("payload", 256).alias("address"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_of_hex(F.sha1("payload")).alias("payload_digest"),
    )
    groups = facts.groupBy("address").agg(F.max("page_id").alias("__response"))
    refers = (F.col("payload_bytes") >= least) & (F.col("__response").isNotNull()) & ~F.col("page_id").eqNullSafe(F.col("__response"))
    heads = (
        facts.join(groups, "address")
        .withColumn("record_type", F.when(refers, F.lit("revisit")).otherwise(F.lit("response")))
        .withColumn("refers_to", F.when(refers, F.col("__response")))
    )
    archive = Archive(f"{folder}/headers", f"{folder}/payloads")
    heads.select("page_id", F.encode(_header(date), "UTF-8").alias("header")).write.option("compression", "zstd").parquet(archive.headers)
    # payload rows meet their group by page id, and stay there to drop repeated rows
    chosen = groups.select(F.col("address").alias("__address"), F.col("__response").alias("page_id"))
    held = base.join(chosen.filter("page_id is not null"), "page_id")
    held = held.withColumn("address", F.sha2("payload", 256)).filter("address = __address")
    held = held.select("page_id", "address", "payload").dropDuplicates(["page_id", "address"])
    lost = base.filter("page_id is null").withColumn("address", F.sha2("payload", 256))
    lost = lost.join(chosen.filter("page_id is null").select(F.col("__address").alias("address")), "address", "left_semi")
    held = held.select("address", "payload").union(lost.select("address", "payload").dropDuplicates(["address"]))
    held.write.option("compression", "zstd").parquet(archive.payloads)
    return archive


def archived_pages(pages: DataFrame, **options) -> DataFrame:
    """Write an archive of ``pages``, rebuild every record from it and return what they
    say of each page."""
    return write_archive(pages, **options).checked(pages.sparkSession)


def archive_sql(least: int = 0) -> str:
    """The same facts in SQL."""
    letters = " || ".join(
        f"substr('{BASE32}', (((('0x' || substr(h, {1 + 10 * p}, 10))::bigint) >> {5 * k}) & 31)::integer + 1, 1)"
        for p in range(4)
        for k in range(7, -1, -1)
    )
    return f"""
    with p as (select page_id, coalesce(html, '') as t, sha1(coalesce(html, '')) as h from pages),
    q as (select page_id, strlen(t)::bigint as payload_bytes, {letters} as payload_digest,
                 max(page_id) over (partition by t) as top from p)
    select page_id, payload_bytes, payload_digest,
           case when payload_bytes >= {least} and page_id <> top then 'revisit' else 'response' end as record_type,
           case when payload_bytes >= {least} and page_id <> top then top end as refers_to
    from q"""
