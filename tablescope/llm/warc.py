"""WARC archives in which records with equal payloads are kept once and revisited."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.session import scratch_path

from .common import written

#: Fixed by the format: the profile of a revisit with an identical payload, and the end of a record.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
#: Fixed by RFC 4648: digits of base 32, beside those of radix 32 as ``conv`` writes them.
BASE32, RADIX32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base-32 SHA-1 of a binary column: 160 bits are eight groups of 20 bits, so no padding."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), RADIX32, BASE32)


def _record_id(key: Column, digest: Column) -> Column:
    """A record id made of key and digest alone, so that a task run again writes the same record."""
    h = F.md5(F.concat_ws(" ", F.lit("record"), key.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ((F.lit("-"),) if i > 1 else ()) + (F.substring(h, i, n),)], F.lit(">"))


def write_archives(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0,
    when: str = "2024-01-01T00:00:00Z", records_per_file: int = 4000,
) -> None:
    """Write one record per page below ``path``: gzip files of at most ``records_per_file`` records.

    Headers alone (digest, key, length) are shuffled by digest: the smallest key of each digest is
    found by sums made before they move, and each other header of at least ``least_bytes`` bytes is
    joined with it. The few that come out say which pages are revisits; pages then meet them on
    their own key, so payloads never gather by digest. A revisit has fresh headers that name the
    response and no payload; smaller pages are all full responses.

    A null payload counts as empty. A null key is never the smallest: such a page revisits one
    with a key, if there is one, else it is a response. Rows with one key and one payload are
    records of one type and id. An empty table writes no record.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    headed = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), body.alias("_body")).select(
        "*", F.octet_length("_body").cast("bigint").alias("_bytes"), base32_sha1(F.col("_body")).alias("_digest")
    )
    heads = written(headed.select("_key", "_bytes", "_digest").where(F.col("_bytes") >= least_bytes), "warc-heads")
    shared = heads.groupBy("_digest").agg(F.min("_key").alias("_original"), F.count(F.lit(1)).alias("_n")).where("_n > 1 AND _original IS NOT NULL").drop("_n")
    again = heads.join(shared, "_digest").where("NOT (_key <=> _original)").select(F.col("_key").alias("_r_key"), F.col("_digest").alias("_r_digest"), "_original").distinct()
    joined = headed.join(again, F.col("_key").eqNullSafe(F.col("_r_key")) & (F.col("_digest") == F.col("_r_digest")), "left")
    revisit = F.col("_original").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_bytes").cast("string"), F.lit(END))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    block = F.when(revisit, F.octet_length(http)).otherwise(F.octet_length(http) + F.col("_bytes"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("_key"), F.col("_digest"))),
        line("WARC-Date", F.lit(when)),
        line("WARC-Target-URI", F.coalesce(F.regexp_replace("_url", r"[\r\n]", "%0A"), F.lit("about:blank"))),
        F.coalesce(line("WARC-Source-Key", F.col("_key").cast("string")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", _record_id(F.col("_original"), F.col("_digest"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block.cast("string")),
        F.lit("\r\n"),
    )
    record = F.concat(head, http, F.when(revisit, F.lit("")).otherwise(F.col("_body").cast("string")))
    # The record separator of the text writer is the end of a WARC record, so each file is an archive.
    joined.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)


def _inflated(data: bytes) -> Iterator[bytes]:
    """The unpacked bytes of a gzip file, a few megabytes at a time."""
    import zlib

    while data:
        unzip = zlib.decompressobj(31)
        while data and not unzip.eof:
            yield unzip.decompress(data, 1 << 22)
            data = unzip.unconsumed_tail
        data = unzip.unused_data if unzip.eof else b""


def _records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, found by the lengths that the headers state; one record is held at a time."""
    data, at = b"", 0

    def reach(what) -> int:
        """Read on until ``what`` finds its place in the data."""
        nonlocal data, at
        while (place := what()) < 0:
            more = next(chunks, None)
            if more is None:
                raise ValueError("the archive ends inside a record")
            data, at = data[at:] + more, 0
        return place

    for chunk in chunks:
        data, at = data[at:] + chunk, 0
        while at < len(data):
            split = reach(lambda: data.find(b"\r\n\r\n", at)) - at
            version, *lines = data[at : at + split].decode("utf-8").split("\r\n")
            if version != "WARC/1.1":
                raise ValueError("no record where one should begin")
            headers = dict(x.split(": ", 1) for x in lines)
            length = split + 4 + int(headers["Content-Length"])
            reach(lambda: 0 if len(data) - at >= length + 4 else -1)
            if data[at + length : at + length + 4] != b"\r\n\r\n":
                raise ValueError("a record does not end where its length says")
            yield headers, data[at + split + 4 : at + length]
            at += length + 4


def read_archives(spark, path: str) -> DataFrame:
    """One row per record: key (text), id, type, digest, payload length, id referred to, and whether a response's payload fits its digest.

    An archive is read by one task, which holds its packed bytes and one record. A record written
    without a key has a null key; archives without records give no rows.
    """

    def parse(batches: Iterator) -> Iterator:
        import base64
        import hashlib

        import pyarrow as pa

        names = ["source_key", "record_id", "record_type", "payload_digest", "payload_bytes", "refers_to_id", "digest_fits"]
        kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.bool_()]
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for headers, block in _records(_inflated(data.as_py())):
                    split = block.index(b"\r\n\r\n") + 4
                    length = next(int(x[15:]) for x in block[:split].split(b"\r\n") if x.startswith(b"Content-Length:"))
                    digest, payload = headers["WARC-Payload-Digest"].removeprefix("sha1:"), block[split:]
                    full = headers["WARC-Type"] == "response"
                    fits = not full or (base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest and len(payload) == length)
                    rows.append((headers.get("WARC-Source-Key"), headers["WARC-Record-ID"], headers["WARC-Type"], digest, length, headers.get("WARC-Refers-To"), fits))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)

    schema = "source_key string, record_id string, record_type string, payload_digest string, payload_bytes bigint, refers_to_id string, digest_fits boolean"
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parse, schema)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Add ``refers_to_key``, the key of the response that a revisit names; null for responses and for names that are not there."""
    responses = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("source_key").alias("refers_to_key"))
    responses = responses.dropDuplicates(["refers_to_id"])
    named = records.where("refers_to_id IS NOT NULL").select("refers_to_id").distinct()
    return records.join(responses.join(named, "refers_to_id", "left_semi"), "refers_to_id", "left")


def fresh_folder(spark) -> str:
    return scratch_path(spark, "warc-" + uuid.uuid4().hex[:8])
