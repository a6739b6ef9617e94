"""A content-addressed archive of WARC records.

Records are kept in two tables of the shared folder: ``headers`` has the exact header bytes of every
record, ``payloads`` has the bytes of each different payload once, under their SHA-256 digest. The digest
is verified: rows that share one must agree in length and SHA-1 too, and what is read back is hashed again.
``restore`` joins the two and gives back the records.

Of the pages with equal payloads of at least ``least`` bytes, those with the largest page_id are response
records and the others revisit it; smaller payloads are responses only. A null html counts as empty, a null
page_id as smaller than any other, a null url as ``urn:page:``; repeated rows stay records of their own, with a record id of their own (the
page's, to which all but the first one add the place of the row). Line ends and spaces in urls are percent-encoded. Other columns, whatever their
names, are not archived; an empty table makes an empty archive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomseek.llm import common

#: Fixed values of RFC 4648 and of WARC 1.1.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


@dataclass
class Archive:
    headers: DataFrame
    payloads: DataFrame


def base32_sha1(data: Column) -> Column:
    """The bare upper-case base32 form of the SHA-1 digest: 32 times five bits, each within two hex digits."""
    digits = F.sha1(data)
    value = lambda at: F.position(F.substring(digits, at + 1, 1), F.lit("0123456789abcdef")) - 1
    chars = []
    for j in range(32):
        two = value(5 * j // 4) * 16 + value(5 * j // 4 + 1)
        chars.append(F.lit(BASE32).substr(F.shiftright(two, 3 - 5 * j % 4).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*chars)


def header(kind: Column, page_id: Column, again: Column, url: Column, sha1: Column, n_bytes: Column, refers_to: Column) -> Column:
    """The header block of a record, ended by an empty line."""
    clean = F.replace(F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(" "), F.lit("%20"))
    urn = lambda x: F.concat(F.lit("<urn:page:"), F.coalesce(x.cast("string"), F.lit("")), F.lit(">"))
    revisit = kind == "revisit"
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), F.coalesce(F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit("#"), again, F.lit(">")), urn(page_id))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(clean, F.lit("urn:page:"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), sha1),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn(refers_to))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(n_bytes.cast("string"))),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"))


def write_archive(pages: DataFrame, least: int = 0) -> Archive:
    """Archives one record for each row of pages (page_id, url, html)."""
    pages = common.located(pages)
    data = F.coalesce(pages["html"], F.lit("")).cast("binary")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), F.struct(common.FILE, common.PLACE).alias("place"), data.alias("payload")).withColumns({"digest": F.sha2("payload", 256), "n_bytes": F.length("payload").cast("long"), "sha1": F.sha1("payload")})
    agree = (F.min("n_bytes") == F.max("n_bytes")) & (F.min("sha1") == F.max("sha1"))
    payloads = common.staged(
        rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.max("page_id").alias("holder"), F.first("n_bytes").alias("n_bytes"), agree.alias("agree")).withColumn("payload", F.when(F.col("agree"), F.col("payload")).otherwise(F.raise_error(F.lit("different payloads have one digest")).cast("binary"))).drop("agree"),
        "warc-payloads",
    )
    # A page is narrow without its payload, and the hot digests of the left side can be split.
    repeated = common.staged(rows.groupBy("page_id").agg(F.min("place").alias("lead"), F.count("*").alias("n")).where("n > 1").select(F.col("page_id").alias("of"), "lead"), "warc-repeated")
    narrow = rows.select("page_id", "url", "place", "digest", base32_sha1(F.col("payload")).alias("sha1")).join(repeated, F.col("page_id").eqNullSafe(F.col("of")), "left")
    again = F.when(F.col("place") != F.col("lead"), F.concat_ws(".", F.col(f"place.{common.FILE}").cast("string"), F.col(f"place.{common.PLACE}").cast("string")))
    joined = narrow.select("page_id", "url", "digest", "sha1", again.alias("again")).join(payloads.select("digest", "holder", "n_bytes"), "digest")
    kind = F.when((F.col("n_bytes") < least) | F.col("page_id").eqNullSafe(F.col("holder")), "response").otherwise("revisit")
    refers = F.when(kind == "revisit", F.col("holder"))
    headers = joined.select("page_id", "digest", header(kind, F.col("page_id"), F.col("again"), F.col("url"), F.col("sha1"), F.col("n_bytes"), refers).cast("binary").alias("header"))
    return Archive(common.staged(headers, "warc-headers"), payloads.select("digest", "payload"))


def restore(archive: Archive) -> DataFrame:
    """Every record again: page_id, header, payload (of revisits too, from the record they refer to) and record, the bytes as a WARC file has them."""
    joined = archive.headers.join(archive.payloads, "digest")
    sound = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not have its digest")).cast("binary"))
    own = F.when(F.decode("header", "UTF-8").contains("\r\nWARC-Type: revisit\r\n"), F.lit("").cast("binary")).otherwise(F.col("payload"))
    return joined.withColumn("payload", sound).select("page_id", "header", "payload", F.concat(F.col("header"), own, F.lit("\r\n\r\n").cast("binary")).alias("record"))


def op4(spark, sf_dir: str) -> DataFrame:
    """All pages archived and read back: what the stored headers and payloads say."""
    records = restore(write_archive(common.table(spark, sf_dir, "pages")))
    text = F.decode("header", "UTF-8")
    refers = F.regexp_extract(text, r"\r\nWARC-Refers-To: <urn:page:(-?\d+)>\r\n", 1)
    return records.select(
        "page_id",
        F.length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        F.regexp_extract(text, r"\r\nWARC-Type: (\w+)\r\n", 1).alias("record_type"),
        F.when(refers != "", refers.cast("long")).alias("refers_to"),
    )


SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS holder
  FROM pages
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('{BASE32}', CAST(((((strpos('0123456789abcdef', substr(h, (5 * j) // 4 + 1, 1)) - 1) * 16
    + strpos('0123456789abcdef', substr(h, (5 * j) // 4 + 2, 1)) - 1) // CAST(pow(2, 3 - (5 * j) % 4) AS BIGINT)) % 32) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = holder THEN NULL ELSE holder END AS refers_to
FROM p
"""
