import base64
import hashlib

from tablescope.llm import warc


def brute(pages, least):
    first = {}
    for key, html in pages:
        body = (html or "").encode()
        first[body] = min(first.get(body, key), key)
    out = []
    for key, html in pages:
        body = (html or "").encode()
        revisit = len(body) >= least and first[body] != key
        out.append((str(key), len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", str(first[body]) if revisit else None, True))
    return sorted(out)


def run(spark, rows, least):
    pages = spark.createDataFrame([(k, f"http://x/{k}\r\nX: 1" if k % 2 else None, h, "z") for k, h in rows], "page_id bigint, url string, html string, _digest string")
    path = warc.fresh_folder(spark)
    warc.write_archives(pages, path, least_bytes=least, records_per_file=3)
    got = warc.resolve_revisits(warc.read_archives(spark, path))
    return sorted((r.source_key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to_key, r.digest_fits) for r in got.collect())


def test_round_trip(spark):
    rows = [(9, "<p>é</p>"), (2, "<p>é</p>"), (5, None), (3, ""), (4, "a\r\n\r\nWARC/1.1\r\n\r\nb\r\n\r\n"), (7, "x" * 200000), (1, "x" * 200000), (8, "y"), (6, "y"), (11, "\x00\n")]
    for least in (0, 3):
        assert run(spark, rows, least) == brute(rows, least)


def test_nulls_and_repeated_rows(spark):
    pages = spark.createDataFrame([(None, None, "a"), (None, "u", "b"), (3, "u", "a"), (3, "u", "a"), (5, "u", "a"), (3, "u", "c")], "page_id bigint, url string, html string")
    path = warc.fresh_folder(spark)
    warc.write_archives(pages, path)
    got = warc.resolve_revisits(warc.read_archives(spark, path)).collect()
    assert sorted((str(r.source_key), r.record_type, str(r.refers_to_key), r.payload_bytes) for r in got) == [
        ("3", "response", "None", 1), ("3", "response", "None", 1), ("3", "response", "None", 1), ("5", "revisit", "3", 1),
        ("None", "response", "None", 1), ("None", "revisit", "3", 1),
    ]


def test_no_pages(spark):
    assert run(spark, [(1, "a")], 0) == brute([(1, "a")], 0)
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    path = warc.fresh_folder(spark)
    warc.write_archives(empty, path)
    assert warc.resolve_revisits(warc.read_archives(spark, path)).collect() == []
