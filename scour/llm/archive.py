"""WARC: an archive that stores equal payloads once.

Payload bytes are kept in one table under their SHA-256, record headers in another, exactly as they
are in the record. Joining both gives the records back, byte by byte. Of the records with equal
payloads, the one with the smallest key is a response and the others revisit it.

Defined cases: a null body is an empty payload, and empty payloads are equal to each other. Records
that share the smallest key of their payload are all responses. A null key is a revisit if some
record with that payload has a key, else a response. A null URL leaves out its header line, line
breaks in a URL are percent-encoded. Very long bodies are stored whole. An empty table gives an empty
archive. Other columns of the pages are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scour.sources.staging import scratch_path

# Digits of base 32 as Spark writes numbers, and as RFC 4648 does.
NUMBER_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# Fixed value: the profile of revisit records in WARC 1.1.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

END = "\r\n"


@dataclass(frozen=True)
class Archive:
    """Folders of the two tables of an archive."""

    headers: str
    payloads: str


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32; five hexadecimal digits are four of base 32."""
    digest = F.sha1(payload)
    digits = [
        F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)
    ]
    return F.translate(F.concat(*digits), NUMBER_DIGITS, BASE32_DIGITS)


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def _record_id(key: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">"))


def write_archive(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    body: str = "html",
    date: str = "1970-01-01T00:00:00Z",
    folder: str | None = None,
) -> Archive:
    """Write headers and payloads below `folder`, by default a fresh one in the shared folder.

    A digest that stands for different payloads ends the job.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    archive = Archive(f"{folder}/headers", f"{folder}/payloads")
    captured = pages.select(
        F.col(key).alias("key"),
        F.col(url).alias("url"),
        F.encode(F.coalesce(F.col(body), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    check = F.xxhash64("payload")
    stored = (
        captured.groupBy("digest")
        .agg(
            F.min("key").alias("first_key"),
            F.first("payload").alias("payload"),
            F.min(check).alias("low"),
            F.max(check).alias("high"),
        )
        .withColumn(
            "payload",
            F.when(F.col("low") == F.col("high"), F.col("payload")).otherwise(
                F.raise_error(F.lit("Different payloads with one digest")).cast("binary")
            ),
        )
        .select(
            "digest",
            "first_key",
            F.length("payload").cast("long").alias("payload_bytes"),
            base32_sha1(F.col("payload")).alias("payload_digest"),
            "payload",
        )
    )
    stored.write.parquet(archive.payloads)
    known = pages.sparkSession.read.parquet(archive.payloads).drop("payload")
    joined = captured.select("key", "url", "digest").join(known, "digest")
    responds = F.col("first_key").isNull() | F.col("key").eqNullSafe(F.col("first_key"))
    target = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}"),
        _line("Content-Length", F.col("payload_bytes").cast("string")),
        F.lit(END),
    )
    block_bytes = F.length(http) + F.when(responds, F.col("payload_bytes")).otherwise(0)
    header = F.concat(
        F.lit(f"WARC/1.1{END}"),
        _line("WARC-Type", F.when(responds, F.lit("response")).otherwise(F.lit("revisit"))),
        _line("WARC-Record-ID", _record_id(F.col("key"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", target),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("WARC-Refers-To", F.when(~responds, _record_id(F.col("first_key")))),
        _line("WARC-Profile", F.when(~responds, F.lit(REVISIT_PROFILE))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block_bytes.cast("string")),
        F.lit(END),
        http,
    )
    joined.select("key", "digest", header.alias("header")).write.parquet(archive.headers)
    return archive


def read_payloads(spark: SparkSession, archive: Archive) -> DataFrame:
    """digest and payload; a payload that does not have its digest ends the job."""
    return spark.read.parquet(archive.payloads).select(
        "digest",
        F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload"))
        .otherwise(F.raise_error(F.lit("A stored payload is damaged")).cast("binary"))
        .alias("payload"),
    )


def _field(name: str, value: str) -> Column:
    """The value of a line of the WARC header, null without that line."""
    found = F.regexp_extract("header", rf"\r\n{name}: {value}\r\n", 1)
    return F.when(found != "", found)


def parse_records(records: DataFrame) -> DataFrame:
    """What whole records (key, record) say of themselves, and the size and SHA-1 of their payload.

    The payload is what follows the two headers, up to the two line breaks that end the record. A
    record whose length, or a response whose payload, is not what its header says ends the job.
    """
    text = F.col("record").cast("string")
    start = F.length(F.encode(F.substring_index(text, END + END, 1), "UTF-8"))
    split = records.select(
        "key",
        "record",
        F.substring_index(text, END + END, 2).alias("header"),
        (F.length("record") - start - 4 * len(END)).alias("block_bytes"),
    ).withColumn("header_bytes", F.octet_length("header"))
    parsed = split.select(
        "key",
        F.expr(
            f"substring(record, header_bytes + {2 * len(END) + 1}, "
            f"octet_length(record) - header_bytes - {4 * len(END)})"
        ).alias("payload"),
        "block_bytes",
        _field("WARC-Type", "([a-z]+)").alias("record_type"),
        _field("WARC-Refers-To", "<urn:page:([^>]+)>").alias("refers_to"),
        _field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)").alias("payload_digest"),
        # The line of the WARC header is followed by an empty line, that of the HTTP header ends it.
        F.regexp_extract("header", r"\r\nContent-Length: (\d+)\r\n\r\n", 1).cast("long").alias("said_block"),
        F.regexp_extract("header", r"\r\nContent-Length: (\d+)$", 1).cast("long").alias("payload_bytes"),
    )
    whole = F.when(F.col("record_type") == "revisit", F.length("payload") == 0).otherwise(
        (F.length("payload") == F.col("payload_bytes"))
        & (base32_sha1(F.col("payload")) == F.col("payload_digest"))
    )
    sound = F.coalesce(whole & (F.col("block_bytes") == F.col("said_block")), F.lit(False))
    return parsed.select(
        "key",
        F.when(sound, F.col("payload_bytes"))
        .otherwise(F.raise_error(F.lit("A record differs from its header")).cast("long"))
        .alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
    )


def read_captures(spark: SparkSession, archive: Archive) -> DataFrame:
    """What each record of the archive says of itself, read from the rebuilt records.

    A revisit takes size and digest of its payload from the response it refers to, one row a
    payload; one without such a response ends the job.
    """
    captures = parse_records(read_records(spark, archive))
    responses = captures.where("record_type = 'response'")
    known = responses.select(
        F.coalesce(F.col("key").cast("string"), F.lit("")).alias("refers_to"),
        "payload_digest",
        F.col("payload_bytes").alias("known_bytes"),
    ).distinct()
    revisits = (
        captures.where("record_type = 'revisit'")
        .join(known, ["refers_to", "payload_digest"], "left")
        .select(
            "key",
            F.when(F.col("known_bytes") == F.col("payload_bytes"), F.col("known_bytes"))
            .otherwise(F.raise_error(F.lit("A revisit without its response")).cast("long"))
            .alias("payload_bytes"),
            "payload_digest",
            "record_type",
            "refers_to",
        )
    )
    return responses.unionByName(revisits)


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """key and record: the whole records, each response with its payload."""
    headers = spark.read.parquet(archive.headers).withColumn(
        "__response", _field("WARC-Type", "([a-z]+)") == "response"
    )
    end = F.encode(F.lit(END + END), "UTF-8")
    header = F.encode("header", "UTF-8")
    with_payload = (
        headers.where("__response")
        .join(read_payloads(spark, archive), "digest")
        .select("key", F.concat(header, F.col("payload"), end).alias("record"))
    )
    without = headers.where(~F.col("__response")).select(
        "key", F.concat(header, end).alias("record")
    )
    return with_payload.unionByName(without)
