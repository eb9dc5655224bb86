"""A content-addressed WARC archive in two Parquet tables.

``records`` keeps one exact WARC header for each page, with the address of its payload; ``payloads`` keeps the bytes of each
address once. The address is the payload's SHA-256; the header names the SHA-1 that WARC readers expect, so two payloads of one
SHA-1 are two payloads here. Of records with equal payloads the one with the smallest page_id is a response, the others
revisit it. Reading joins headers and payloads back to whole records, parses the headers and verifies each payload against
its address and its header's digest and length.

Frequent payloads: the smallest page of a digest is a map-side aggregate, and digests that occur more than once are joined
under SALTS sub-keys, so that no key holds a task. Where they are few, Spark broadcasts them and payloads do not move.

A null html is an empty payload, a null url an empty target; line breaks in a url, which would end its header line, are read
back as one space. Rows that share page_id and payload are the same record seen
again: each gets the same record type. A null page_id comes before all others and is written as ``null``. An empty table
gives empty archives. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir
from .groups import kept

SALTS = 32
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CRLF = "\r\n"


def base32(digits: Column) -> Column:
    """Upper-case base32 of 40 hex digits: they are four times ten digits, and ten hex digits are eight base32 ones."""
    out = []
    for k in range(4):
        number = F.conv(F.substring(digits, 10 * k + 1, 10), 16, 10).cast("bigint")
        out += [F.substring(F.lit(_BASE32), F.shiftright(number, 35 - 5 * i).bitwiseAND(31).cast("int") + 1, 1) for i in range(8)]
    return F.concat(*out)


def _header(row: dict[str, Column]) -> Column:
    """The exact header block, without the empty line that ends it."""
    revisit = row["revisit"]
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
             F.concat(F.lit("WARC-Record-ID: <urn:page:"), row["page"], F.lit(">")),
             F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(row["url"], r"[\r\n]+", " ")),
             F.concat(F.lit("WARC-Payload-Digest: sha1:"), row["digest"]),
             F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), row["refers_to"], F.lit(">"))),
             F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
             F.concat(F.lit("WARC-Payload-Length: "), row["bytes"].cast("string")),
             F.concat(F.lit("Content-Length: "), F.when(revisit, "0").otherwise(row["bytes"].cast("string")))]
    return F.encode(F.concat_ws(_CRLF, *lines), "UTF-8")


def _named(page: Column) -> Column:
    return F.coalesce(page.cast("string"), F.lit("null"))


def _salted(rows: DataFrame, table: DataFrame, salt_of: str, how: str = "left") -> DataFrame:
    """Join on digest, with each digest of ``table`` under SALTS keys."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(salt_of), F.lit(SALTS)))
    table = table.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return rows.join(table, ["digest", "salt"], how).drop("salt")


def write_archive(pages: DataFrame, folder: str, min_bytes: int = 0) -> None:
    """Write ``records`` and ``payloads`` below ``folder``; needs page_id, url and html.

    Payloads below ``min_bytes`` are always responses; their bytes are stored once all the same.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
                        payload.alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("bigint").alias("bytes"))
    # addresses of several rows: their smallest page (null first)
    often = (rows.groupBy("digest").agg(
        F.min("page_id").alias("first"), F.max(F.col("page_id").isNull().cast("int")).alias("unnamed"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select("digest", F.when(F.col("unnamed") == 0, F.col("first")).alias("first"), F.lit(True).alias("shared")))
    often = kept(often, "payloads-met-often")
    marked = _salted(rows, often, "page_id")
    again = F.col("shared").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    header = _header({"revisit": again & (F.col("bytes") >= min_bytes), "page": _named(F.col("page_id")), "url": F.col("url"),
                      "digest": base32(F.sha1("payload")), "refers_to": _named(F.col("first")), "bytes": F.col("bytes")})
    marked.select("digest", header.alias("header")).write.parquet(f"{folder}/records")
    once = marked.filter("shared IS NULL").select("digest", "payload")
    if not often.isEmpty():
        shared = marked.filter(F.col("shared") & ~again).select("digest", "payload").dropDuplicates(["digest"])
        once = once.unionByName(shared)
    once.write.parquet(f"{folder}/payloads")


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract(F.decode("header", "UTF-8"), rf"(?m)^{name}: (.*?)\r?$", 1), F.lit(""))


def _page(name: str) -> Column:
    return F.regexp_extract(_field(name), "<urn:page:(.*)>", 1).try_cast("bigint")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Whole records and what they say. Length and digest of a response are taken from its payload and held against its
    header, those of a revisit from its header; a payload that does not fit stops the read."""
    records = spark.read.parquet(f"{folder}/records").select(
        "header", _field("WARC-Type").alias("record_type"), _page("WARC-Record-ID").alias("page_id"),
        F.coalesce(_field("WARC-Target-URI"), F.lit("")).alias("url"),
        "digest", F.regexp_extract(_field("WARC-Payload-Digest"), "sha1:(.*)", 1).alias("told_digest"),
        _field("WARC-Payload-Length").cast("bigint").alias("told_bytes"), _page("WARC-Refers-To").alias("refers_to"))
    payloads = spark.read.parquet(f"{folder}/payloads")
    response = F.col("record_type") == "response"
    answers = (records.filter(response).join(payloads, "digest", "left")
               .withColumns({"found": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("bigint")}))
    fits = (F.col("found") == F.col("digest")) & (F.col("payload_bytes") == F.col("told_bytes"))
    found = base32(F.sha1("payload"))
    answers = answers.withColumn("payload_digest", F.when(fits, found)).withColumn(
        "payload_digest", F.when(F.col("payload_digest") == F.col("told_digest"), F.col("payload_digest"))
        .otherwise(F.raise_error(F.lit("a payload does not fit its record"))))
    visits = records.filter(~response).select(
        "*", F.col("told_bytes").alias("payload_bytes"), F.col("told_digest").alias("payload_digest"), F.lit(b"").alias("payload"))
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to",
               F.concat("header", F.lit(b"\r\n\r\n"), "payload", F.lit(b"\r\n\r\n")).alias("record")]
    return answers.select(*columns).unionByName(visits.select(*columns))


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url and html of every record, revisits included."""
    records = spark.read.parquet(f"{folder}/records").select(
        _page("WARC-Record-ID").alias("page_id"), F.coalesce(_field("WARC-Target-URI"), F.lit("")).alias("url"),
        "digest")
    joined = _salted(records, spark.read.parquet(f"{folder}/payloads"), "page_id")
    return joined.select("page_id", "url", F.decode("payload", "UTF-8").alias("html"))


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write an archive into the shared folder and read its records back."""
    spark = pages.sparkSession
    folder = scratch_dir(spark, "warc")
    write_archive(pages, folder, min_bytes)
    return read_records(spark, folder)
