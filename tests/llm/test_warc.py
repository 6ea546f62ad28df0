import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from folio.llm import warc
from folio.llm.common import shared_folder, shared_path

SCHEMA = "page_id long, url string, html string"


def want(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        keep = first.get(h or "", i)
        again = i is not None and i != keep
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", keep if again else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


@pytest.mark.parametrize("segment,chunk", [(40, 7), (200, 64), (warc.SEGMENT, warc.CHUNK)])
def test_round_trip(spark, segment, chunk):
    rng = random.Random(6)
    signs = ["é", "😀", "\r\n", "\r\n\r\n", "0\r\n\r\n", "WARC/1.1\r\n", "<p>", "x" * 50, "\n", "\x85", " "]
    html = [None, "", *("".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(60)), "z" * 50_000]
    rows = [(100 - i, f"http://h/{i}\r\nx", h) for i, h in enumerate(html)] + [(1000 + i, None, html[7]) for i in range(80)] + [(None, "u", "a"), (5, "u", html[7]), (5, "u", html[7])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("clash")).repartition(4)
    got = warc.round_trip(df, segment, chunk)
    assert rows_of(got) == want(rows)
    bodies = {r.page_id: r.payload.decode() for r in got.where("record_type = 'response'").collect()}
    assert all(bodies[i] == (h or "") for i, _, h in rows if i in bodies)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_segments_must_add_up(spark):
    folder = f"{shared_folder(spark)}/broken"
    head = "WARC/1.1\r\nWARC-Type: {}\r\nWARC-Record-ID: <urn:page:1:a>\r\n{}Content-Length: 3\r\n\r\nabc"
    rows = [(head.format("response", "WARC-Segment-Number: 1\r\n"),), (head.format("continuation", "WARC-Segment-Origin-ID: <urn:page:1:a>\r\nWARC-Segment-Number: 2\r\nWARC-Segment-Total-Length: 7\r\n"),)]
    spark.createDataFrame(rows, "value string").coalesce(1).write.option("lineSep", warc.END).text(folder)
    with pytest.raises(Exception, match="segments of 6 bytes, 7 announced"):
        warc.read(spark, folder).collect()


def independent(raw: bytes):
    """A plain reader of unzipped archives: headers and block of each record, by its length alone."""
    at, out = 0, []
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at)
        version, *lines = raw[at:stop].decode().split("\r\n")
        assert version == "WARC/1.1"
        headers = dict(x.split(": ", 1) for x in lines)
        end = stop + 4 + int(headers["Content-Length"])
        out.append((headers, raw[stop + 4 : end]))
        assert raw[end : end + 4] == b"\r\n\r\n"
        at = end + 4
    return out


def test_an_independent_reader_resolves_revisits_and_segments(spark):
    rows = [(i, "u", f"<p>{'same é ' * 40}</p>") for i in range(30)] + [(100 + i, "u", f"{i} " * 300) for i in range(5)]
    folder = shared_path(spark, "plain")
    warc.write(spark.createDataFrame(rows, SCHEMA), folder, segment=200, chunk=50, file_bytes=2000)
    files = spark.read.format("binaryFile").load(folder).collect()
    assert len(files) > 1
    records = [r for f in files for r in independent(gzip.decompress(bytes(f.content)))]
    ids = [h["WARC-Record-ID"] for h, _ in records]
    assert len({*ids}) == len(ids)
    by_id = {h["WARC-Record-ID"]: h for h, _ in records}
    revisits = [h for h, _ in records if h["WARC-Type"] == "revisit"]
    assert len(revisits) == 29
    for h in revisits:
        met = by_id[h["WARC-Refers-To"]]
        assert met["WARC-Type"] == "response" and met["WARC-Payload-Digest"] == h["WARC-Payload-Digest"]
    more = [h for h, _ in records if h["WARC-Type"] == "continuation"]
    assert more and all(by_id[h["WARC-Segment-Origin-ID"]]["WARC-Segment-Number"] == "1" for h in more)


def test_ids_keep_their_type(spark):
    rows = [("b:2 +%", "u", "x"), ("a/é>1", None, "x"), ("c", "u", "y" * 90), (None, "u", "z"), ("", "u", "x")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id string, url string, html string"), 30, 9).collect()
    assert sorted(((r.page_id or "", r.record_type, r.refers_to) for r in got), key=str) == sorted([("b:2 +%", "revisit", ""), ("a/é>1", "revisit", ""), ("c", "response", None), ("", "response", None), ("", "response", None)], key=str)


def test_a_revisit_of_nothing_is_refused(spark):
    folder = f"{shared_folder(spark)}/dangling"
    block = "HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\n"
    one = f"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:page:2:X>\r\nWARC-Refers-To: <urn:page:1:X>\r\nWARC-Payload-Digest: sha1:X\r\nContent-Length: {len(block)}\r\n\r\n{block}"
    spark.createDataFrame([(one,)], "value string").coalesce(1).write.option("lineSep", warc.END).text(folder)
    with pytest.raises(ValueError, match="urn:page:1:X, which is not there"):
        warc.read(spark, folder)


def test_archives_are_read_in_small_steps(monkeypatch):
    monkeypatch.setattr(warc, "STEP", 7)
    raw = b"".join(warc._record({"WARC-Type": "response", "X": "é" * n}, "b\r\n" * n).encode() + b"\r\n\r\n" for n in range(40))
    zipped = gzip.compress(raw[:1000]) + gzip.compress(raw[1000:])
    assert b"".join(warc.unzipped(zipped)) == raw == b"".join(warc.unzipped(raw))
    assert [len(b) for _, b in warc.records_of(warc.unzipped(zipped))] == [3 * n for n in range(40)]
    with pytest.raises(ValueError, match="cut short"):
        list(warc.unzipped(zipped[:-12]))
    with pytest.raises(ValueError, match="longer or shorter"):
        list(warc.records_of(iter([raw[:-2]])))


def test_chunked_framing():
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    assert warc.payload(head + b"3\r\nabc\r\nA;x=y\r\n0123456789\r\n0\r\n\r\n") == b"abc0123456789"
    assert warc.payload(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain"
    with pytest.raises(ValueError, match="cut short"):
        warc.payload(head + b"9\r\nabc\r\n0\r\n\r\n")
