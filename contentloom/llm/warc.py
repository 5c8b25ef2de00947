"""WARC archive that stores each payload once, by content.

An archive is a folder with two tables. ``payloads`` holds each distinct payload under the
SHA-256 of its bytes. ``records`` holds one row for each archived page: the exact bytes of the
WARC header and of the HTTP header of its record, and the digest of its payload. Original
records are the join of both. Payloads are verified as they are read: a stored payload whose
bytes do not give its digest is never returned, and its records come back without a payload.

Of records with equal payloads of ``least_revisit`` bytes or more, that of the smallest page id is
the ``response`` and the others are ``revisit`` records, without a payload of their own but
referring to it. Smaller payloads are always responses. Payloads are the UTF-8 bytes of the
pages' text.

A digest may own a third of all pages. Copies are first reduced within a task, then by digest;
pages are ranked by narrow rows only, and hot digests are spread over salts in the joins.

Defined cases: a null text is the empty payload. A null URL has no target line. Of rows that
repeat the smallest page id and its payload, the first by URL (then any one of equal rows) is
the response, the others revisit it. A null page id is larger than any other; its record id is
``none``. Other columns are not read. An empty table gives an empty archive.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from contentloom.operators.skew import skew_join
from contentloom.session import stage

EOL = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEADER = EOL.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "", ""])


@dataclass
class Archive:
    spark: SparkSession
    folder: str

    def payloads(self) -> DataFrame:
        """Stored payloads with the digest and size of the bytes as they are now."""
        stored = self.spark.read.schema("digest string, payload binary").parquet(f"{self.folder}/payloads")
        return stored.withColumn("verified", F.sha2("payload", 256) == F.col("digest")).withColumn(
            "stored_bytes", F.octet_length("payload").cast("long")
        )

    def records(self) -> DataFrame:
        return self.spark.read.schema("digest string, warc_header string, http_header string").parquet(
            f"{self.folder}/records"
        )


def _header(lines: list[Column]) -> Column:
    """Lines that are not null, each ended, and the empty line that ends a header."""
    return F.concat(F.concat_ws(EOL, *lines), F.lit(EOL + EOL))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def _record_id(page: Column, copy: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), copy.cast("string"), F.lit(">"))


def write_archive(
    pages: DataFrame, archive: Archive, date: str = "1970-01-01T00:00:00Z", least_revisit: int = 100
) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html)."""
    source = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    source.groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{archive.folder}/payloads")

    narrow = source.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("bytes"))
    rows = stage(narrow.groupBy("page_id", "url", "digest", "bytes").agg(F.count("*").alias("n")), "pages-by-digest")
    place = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url")
    firsts = rows.where(F.col("bytes") >= least_revisit).groupBy("digest").agg(F.min(place).alias("first"))
    met = skew_join(rows, firsts, "digest", "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    original = (
        F.col("first").isNull()
        | (F.col("first.page_id").eqNullSafe(F.col("page_id")) & F.col("first.url").eqNullSafe(F.col("url")) & (F.col("copy") == 1))
    )
    # An address must not break the header's lines.
    uri = F.regexp_replace("url", r"(?U)\s+", "%20")
    kind = F.when(original, "response").otherwise("revisit")
    length = F.lit(len(HTTP_HEADER)) + F.when(original, F.col("bytes")).otherwise(0)
    header = _header(
        [
            F.lit("WARC/1.1"),
            _line("WARC-Type", kind),
            _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("copy"))),
            _line("WARC-Date", F.lit(date)),
            _line("WARC-Target-URI", uri),
            _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            F.when(~original, _line("WARC-Refers-To", _record_id(F.col("first.page_id"), F.lit(1)))),
            F.when(~original, _line("WARC-Profile", F.lit(REVISIT_PROFILE))),
            _line("Content-Type", F.lit("application/http; msgtype=response")),
            _line("Content-Length", length.cast("string")),
        ]
    )
    records = met.select("digest", header.alias("warc_header"), F.lit(HTTP_HEADER).alias("http_header"))
    records.write.parquet(f"{archive.folder}/records")


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("warc_header", rf"(?m)^{name}: (.*)$", 1), F.lit(""))


def read_records(archive: Archive) -> DataFrame:
    """The original records: their headers, what the headers say, and the verified payload.

    ``payload`` is the page's whole payload; a record as written to a file holds it only if
    its type is ``response``. Columns that are not asked for are not moved through the join.
    """
    stored = archive.payloads().where("verified").select("digest", "payload", "stored_bytes")
    joined = skew_join(archive.records(), stored, "digest", "left")
    page = F.regexp_extract(_field("WARC-Record-ID"), r"^<urn:page:(-?\d+):", 1)
    refers = F.regexp_extract(_field("WARC-Refers-To"), r"^<urn:page:(-?\d+):", 1)
    return joined.select(
        F.nullif(page, F.lit("")).cast("long").alias("page_id"),
        _field("WARC-Target-URI").alias("target_uri"),
        _field("WARC-Type").alias("record_type"),
        F.regexp_extract(_field("WARC-Payload-Digest"), "^sha256:([0-9a-f]{64})$", 1).alias("payload_digest"),
        F.col("stored_bytes").alias("payload_bytes"),
        F.nullif(refers, F.lit("")).cast("long").alias("refers_to"),
        "warc_header",
        "http_header",
        "payload",
    )


def export_files(archive: Archive, folder: str) -> None:
    """Write the records as plain WARC files, a file for each task."""
    records = read_records(archive)
    body = F.when(F.col("record_type") == "response", F.decode("payload", "UTF-8")).otherwise("")
    block = F.concat("warc_header", "http_header", body)
    # A record ends with two line ends, which are the separator of these lines.
    records.select(block).write.option("lineSep", EOL + EOL).text(folder)
