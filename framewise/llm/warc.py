"""A content-addressed WARC archive (DataFrame functions only).

``write_archive`` makes two tables in a folder: ``payloads`` holds each different payload once, under its SHA-256; ``records`` holds for each
page the exact bytes of its WARC and HTTP headers, and the digest. Payloads are told apart by their bytes as well as their digest, so two that
share a digest would be an error, not a loss. ``read_archive`` checks every stored payload against its digest, parses the headers again and
joins both; ``original_records`` gives the bytes of each record as it was, header and payload.

Of records with equal payloads of at least ``LEAST`` bytes, the one with the smallest id is a response and the others are revisits of it;
smaller payloads are always responses.

Defined cases: a null payload counts as empty; a null URL gives no target line, an empty one an empty line, and line ends in one are escaped, so they can't begin
another header; a null id is written as such and never smallest, and if all of a payload's ids are null all are responses; rows that repeat an id are written each, and all that carry the
smallest id of their payload are responses; very long payloads are stored once like any other; an empty table gives an empty archive; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, saved

LEAST = 100
DATE = "2024-01-01T00:00:00Z"
#: Says that %0D, %0A and %25 in the target stand for a line end or a percent sign.
_MARK = "X-Target-Escaped: yes\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = DATE) -> None:
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    # copies are combined in the tasks before they are sent
    held = rows.groupBy("digest", "payload").agg(F.min("page_id").alias("first_id"))
    payloads = saved(held.withColumn("n", F.octet_length("payload")), "payloads", f"{path}/payloads")
    clash = F.raise_error(F.concat(F.lit("different payloads have the digest "), F.col("digest"))).cast("int")
    owners = payloads.groupBy("digest").agg(F.min("first_id").alias("first_id"), F.max("n").alias("n"), F.count(F.lit(1)).alias("k"))
    owners = owners.withColumn("n", F.when(F.col("k") > 1, clash).otherwise(F.col("n"))).drop("k")
    revisit = (F.col("n") >= LEAST) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.length(http) + F.when(revisit, 0).otherwise(F.col("n"))
    # a line end inside a URL would end its header line
    broken = F.col("url").rlike("[\r\n]")
    escaped = F.replace(F.replace(F.replace(F.col("url"), F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNull(), "").otherwise(F.concat(F.when(broken, _MARK).otherwise(""), _line("WARC-Target-URI", F.when(broken, escaped).otherwise(F.col("url"))))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", _record_id(F.col("first_id"))), _line("WARC-Profile", F.lit(_PROFILE)))).otherwise(""),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block.cast("string")),
        F.lit("\r\n"),
        http,
    )
    records = rows.select("page_id", "url", "digest").join(owners, "digest").select("page_id", "digest", F.encode(header, "UTF-8").alias("header"))
    saved(records, "records", f"{path}/records")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """The payloads, each checked against its digest."""
    held = spark.read.parquet(f"{path}/payloads")
    good = F.sha2("payload", 256) == F.col("digest")
    return held.select(F.when(good, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("payload doesn't match its digest "), F.col("digest")))).alias("digest"), "payload")


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    text = F.decode("header", "UTF-8")
    line = lambda name, value: F.nullif(F.regexp_extract(text, rf"\r\n{name}: {value}\r\n", 1), F.lit(""))
    target = r"\r\nWARC-Target-URI: ([^\r\n]*)\r\n"
    url = F.regexp_extract(text, target, 1)
    plain = F.replace(F.replace(F.replace(url, F.lit("%0D"), F.lit("\r")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))
    return spark.read.parquet(f"{path}/records").select(
        line("WARC-Record-ID", "<urn:x-page:(-?[0-9]+)>").cast("long").alias("page_id"),
        F.when(text.rlike(target), F.when(text.contains(f"\r\n{_MARK}"), plain).otherwise(url)).alias("url"),
        line("WARC-Payload-Digest", "sha256:([0-9a-f]{64})").alias("digest"),
        line("WARC-Type", "([a-z]+)").alias("record_type"),
        line("WARC-Refers-To", "<urn:x-page:(-?[0-9]+)>").cast("long").alias("refers_to"),
        "header",
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Per record: ``page_id, payload_bytes, payload_digest, record_type, refers_to, url``."""
    sizes = _stored(spark, path).select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"))
    return _parsed(spark, path).join(sizes, "digest").select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to", "url"
    )


def original_records(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, record, payload``: the record's bytes as written to a WARC file, and its full payload, also for revisits."""
    empty = F.lit("").cast("binary")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(empty)
    return _parsed(spark, path).join(_stored(spark, path), "digest").select(
        "page_id", F.concat("header", body, F.lit("\r\n\r\n").cast("binary")).alias("record"), "payload"
    )


def archived(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to a new archive in the shared folder and read it back."""
    path = new_path(pages.sparkSession, "warc")
    write_archive(pages, path)
    return read_archive(pages.sparkSession, path)
