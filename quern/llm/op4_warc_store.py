"""A content-addressed WARC archive.

Two tables hold an archive. ``payloads`` has each distinct payload once, under its SHA-256, with the
largest id among the pages that have it. ``records`` has every record's exact header bytes and the
digest of its payload. Reading joins the two; a payload whose bytes no longer give its digest raises
an error instead of a record.

Defined results: null html is an empty payload, a null url leaves out the target line; of equal
payloads the page with the largest id is the response (null ids count least) and the others revisit
it; rows that repeat that id with the same payload are each the response; CR and LF in a url are
percent-encoded, so that a header stays whole; a very long payload is stored and read whole; an empty
table gives an empty archive; other columns are not read, so their names may be any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import named, shared_folder

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2026-01-01T00:00:00Z"


def base32(digest: Column) -> Column:
    """Base 32 of a hex SHA-1 (40 digits give 32 letters, without padding)."""
    letters = []
    for k in range(0, 40, 5):
        value = F.conv(F.substring(digest, k + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def _bytes(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def write_archive(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", body: str = "html", date: str = DATE) -> None:
    """Writes the tables ``payloads`` and ``records`` below ``folder``."""
    spark = pages.sparkSession
    rows = pages.select(named(key).alias("id"), named(url).alias("url"), _bytes(named(body)).alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    payloads = rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.max("id").alias("keeper"), F.min(F.length("payload")).alias("least"), F.max(F.length("payload")).alias("most"))
    whole = F.when(F.col("least") != F.col("most"), F.raise_error(F.lit("two payloads share a digest"))).otherwise(F.col("payload"))
    payloads.select("digest", whole.alias("payload"), "keeper").write.mode("overwrite").parquet(f"{folder}/payloads")

    keepers = spark.read.parquet(f"{folder}/payloads").select("digest", "keeper")
    heads = rows.select("id", "url", "digest", F.length("payload").alias("n"), base32(F.sha1("payload")).alias("sha1")).join(keepers, "digest")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    first = F.col("id").eqNullSafe(F.col("keeper"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    target = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    length = F.length(http) + F.when(first, F.col("n")).otherwise(0)
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(first, "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("id")),
        F.lit(f"\r\nWARC-Date: {date}"), F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), target), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.when(first, "").otherwise(F.concat(F.lit("\r\nWARC-Refers-To: "), name(F.col("keeper")), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"), http,
    )
    heads.select(header.cast("binary").alias("header"), "digest").write.mode("overwrite").parquet(f"{folder}/records")


def verified(spark: SparkSession, folder: str) -> DataFrame:
    """digest, payload of the archive; bytes that do not give their digest raise an error."""
    intact = F.unhex(F.sha2("payload", 256)) == F.col("digest")
    return spark.read.parquet(f"{folder}/payloads").select("digest", F.when(intact, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload is damaged"))).alias("payload"))


def header_field(header: Column, name: str) -> Column:
    """The value of a header line, null if there is none."""
    found = F.regexp_extract(F.decode(header, "UTF-8"), rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """record: the whole bytes of every WARC record; payload: what it stores or revisits."""
    records = spark.read.parquet(f"{folder}/records").join(verified(spark, folder), "digest")
    end = F.lit("\r\n\r\n").cast("binary")
    body = F.when(header_field(F.col("header"), "WARC-Type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    return records.select(F.concat("header", body, end).alias("record"), "header", "payload")


def _past_head(block: Column) -> Column:
    """What follows the first empty line of some bytes."""
    head = F.octet_length(F.substring_index(block.cast("string"), "\r\n\r\n", 1))
    return F.substring(block, head + 5, F.octet_length(block))


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, from the bytes of the rebuilt records; a revisit has the payload that it revisits."""
    records = read_records(spark, folder).select("record", "payload", F.substring_index(F.col("record").cast("string"), "\r\n\r\n", 1).cast("binary").alias("head"))
    field = lambda name: header_field(F.col("head"), name)
    number = lambda name: F.regexp_extract(F.coalesce(field(name), F.lit("")), r"urn:page:(-?\d+)>", 1).try_cast("long")
    block = F.substring(_past_head(F.col("record")), F.lit(1), field("Content-Length").cast("int"))
    own = F.when(field("WARC-Type") == "response", _past_head(block)).otherwise(F.col("payload"))
    records = records.select(
        number("WARC-Record-ID").alias("page_id"), own.alias("own"), field("WARC-Payload-Digest").alias("digest"), field("WARC-Type").alias("record_type"), number("WARC-Refers-To").alias("refers_to"),
    )
    found = base32(F.sha1("own"))
    same = F.when(F.col("digest") == F.concat(F.lit("sha1:"), found), found)
    return records.select(
        "page_id", F.octet_length("own").cast("long").alias("payload_bytes"), F.coalesce(same, F.raise_error(F.lit("a header and its payload differ"))).alias("payload_digest"), "record_type", "refers_to",
    )


def op4_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_index(spark, folder)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS keeper FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1)::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM d
"""

QUERIES = {"op4_warc_store": op4_warc_store}
ORACLE_SQL = {"op4_warc_store": SQL}
