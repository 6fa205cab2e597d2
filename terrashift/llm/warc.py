"""WARC archives that hold each payload once.

An archive is two Parquet tables under one path. ``blobs`` is content-addressed: one row for each
distinct payload under its SHA-256. ``records`` keeps the exact header bytes of every record and the
digest of its payload. A record is rebuilt by joining the two. Each blob is verified against its
address when it is read and each record against its own header, and what doesn't fit stops the read
with an error. Both joins deal the records of a frequent payload to several tasks.

Defined results: a null payload is the empty payload; of records with equal payloads those with the
smallest id are responses and all others revisits (null ids come after all others; repeated rows of
the smallest id are all responses); a null url gives an empty target; CR and LF in a url are
percent-encoded so that they can't end a header line; an empty table gives an empty archive. Other
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrashift.llm.common import dealt_join

_CRLF = "\r\n"
_BASE32_FROM, _BASE32_TO = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: four base32 digits for each five hex digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), _BASE32_FROM, _BASE32_TO)


def _header(kind: Column) -> Column:
    """The WARC header of a record and the HTTP header of its block, byte for byte as they are kept."""
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(_CRLF * 2),
    )
    target = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    ident = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.concat(F.lit(f"WARC-Profile: {_REVISIT_PROFILE}{_CRLF}WARC-Refers-To: "), ident("first_id"), F.lit(_CRLF))
    length = F.octet_length(http) + F.when(kind == "response", F.col("payload_bytes")).otherwise(F.lit(0))
    return F.concat(
        F.lit(f"WARC/1.1{_CRLF}WARC-Type: "), kind,
        F.lit(f"{_CRLF}WARC-Record-ID: "), ident("page_id"),
        F.lit(f"{_CRLF}WARC-Target-URI: "), target,
        F.lit(f"{_CRLF}WARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit(_CRLF),
        F.when(kind == "revisit", revisit).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response" + _CRLF + "Content-Length: "), length.cast("string"),
        F.lit(_CRLF * 2), http,
    )


def write_archive(pages: DataFrame, path: str, payload: str = "html", url: str = "url", page_id: str = "page_id", revisit_from: int = 0) -> None:
    """Write one record for each row of ``pages`` to the archive at ``path``.

    Payloads of fewer than ``revisit_from`` bytes are stored once too, but all their records are responses.

    Payloads are combined by digest before the shuffle, so a payload with a third of all pages moves
    once per map task; the records that join the digests hold no payload.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    spark = pages.sparkSession
    blobs = rows.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n_records"), F.first("payload").alias("payload"))
    blobs.write.option("compression", "zstd").parquet(f"{path}/blobs")
    firsts = spark.read.parquet(f"{path}/blobs").select("digest", "first_id", "n_records")
    slim = rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    own = F.col("page_id").eqNullSafe(F.col("first_id")) | (F.col("payload_bytes") < revisit_from)
    kind = F.when(own, "response").otherwise("revisit")
    dealt_join(slim, firsts, "digest", "n_records", "page_id").select("digest", _header(kind).cast("binary").alias("header")).write.option("compression", "zstd").parquet(f"{path}/records")


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """(digest, n_records, payload), every payload checked against its address."""
    blobs = spark.read.parquet(f"{path}/blobs").select("digest", "n_records", "payload")
    bad = F.unhex(F.sha2("payload", 256)) != F.col("digest")
    return blobs.withColumn("payload", F.when(bad, F.raise_error(F.lit("a stored payload doesn't fit its digest")).cast("binary")).otherwise(F.col("payload")))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(digest, header, page_id, url, record_type, stated_digest, stated_length, refers_to), parsed from the exact header bytes."""
    text = F.decode("header", "UTF-8")
    field = lambda name, pattern: F.regexp_extract(text, rf"\r\n{name}: {pattern}\r\n", 1)
    ident = lambda name: field(name, r"<urn:page:([^>]*)>")
    return spark.read.parquet(f"{path}/records").select(
        "digest", "header",
        ident("WARC-Record-ID").try_cast("long").alias("page_id"),
        field("WARC-Target-URI", r"([^\r]*)").alias("url"),
        field("WARC-Type", "([a-z]+)").alias("record_type"),
        field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)").alias("stated_digest"),
        field("Content-Length", "([0-9]+)").try_cast("long").alias("stated_length"),
        ident("WARC-Refers-To").try_cast("long").alias("refers_to"),
    )


def _or_stop(ok: Column, value: Column, problem: str, kind: str) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(problem)).cast(kind))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Each record rebuilt: (page_id, url, record_type, refers_to, header, payload, record, stated_digest).

    ``record`` is the whole record as it stands in a WARC file; that of a revisit ends after its
    header block, while ``payload`` is the full payload for it too. The block that follows the WARC
    header must be as long as that header states.
    """
    whole = dealt_join(read_headers(spark, path), read_blobs(spark, path), "digest", "n_records", "header")
    end = F.lit(_CRLF * 2).cast("binary")
    record = F.when(F.col("record_type") == "response", F.concat("header", "payload", end)).otherwise(F.concat("header", end))
    begin = F.instr(F.decode("header", "ISO-8859-1"), _CRLF * 2) + 3
    fits = F.octet_length("record") - begin - 4 == F.col("stated_length")
    checked = _or_stop(fits, F.col("record"), "a record is not as long as its header states", "binary")
    return whole.withColumn("record", record).select("page_id", "url", "record_type", "refers_to", "header", "payload", checked.alias("record"), "stated_digest")


def archive_index(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record, rebuilt from the archive.

    Length and digest are taken from what was rebuilt: of a response from the bytes between its header
    and its end, of a revisit from the payload that it refers to. A header that states another digest
    stops the read.
    """
    size = F.octet_length("record") - F.octet_length("header") - 4
    inside = F.substring(F.col("record"), F.octet_length("header") + 1, size)
    body = F.when(F.col("record_type") == "response", inside).otherwise(F.col("payload"))
    rebuilt = read_records(spark, path).withColumn("body", body)
    digest = base32_sha1(F.col("body"))
    checked = _or_stop(F.col("stated_digest") == F.col("digest"), F.col("digest"), "a header states another payload digest", "string")
    return rebuilt.withColumn("digest", digest).select("page_id", F.octet_length("body").cast("long").alias("payload_bytes"), checked.alias("payload_digest"), "record_type", "refers_to")
