"""WARC archives: writing with revisit records and segments, and reading with segment reassembly.

A record's block is an HTTP response whose body is in chunked transfer framing.
Blocks over `segment` bytes are cut: the first record keeps the response's
headers, continuation records name it in WARC-Segment-Origin-ID and number
themselves, and the last one gives the total length.  Archives are gzip text
files written by Spark's own text writer (records end in two line ends, which
is its line separator), so attempts, retries and stores are Spark's business.

Reading takes each archive file in one task, as a stream, once: whole records
are decoded at once; segments are grouped by origin, put in the order of their
numbers, checked against the total length and then decoded.  A revisit must
refer to a response that is there and has its digest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import attach, partitions, shared_path, written

SEGMENT, CHUNK = 16_384, 4_096
#: Bytes of html for each archive file, as far as rows can be dealt.
FILE_BYTES = 16 << 20
#: Records of one archive file; what a partition holds beyond them goes to further files.
RECORDS = 4_096
#: Bytes that are unzipped at a time, and of blocks in a batch.
STEP, HELD = 1 << 20, 4 << 20
END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORDS = "record string, page string, origin string, number int, total long, kind string, refers string, digest string, payload_bytes long, body binary"
_SCHEMA = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in _RECORDS.split(", "))])


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """No line end may enter a header."""
    return "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in value)


def _cuts(text: str, size: int) -> list[str]:
    """Parts of at most `size` bytes (or one character), cut between characters."""
    raw = text.encode()
    out, at = [], 0
    while at < len(raw):
        end = min(at + size, len(raw))
        while end < len(raw) and end > at + 1 and raw[end] & 0xC0 == 0x80:
            end -= 1
        while end < len(raw) and raw[end] & 0xC0 == 0x80:  # a size under one character
            end += 1
        out.append(raw[at:end].decode())
        at = end
    return out


def _record(headers: dict[str, str], block: str) -> str:
    """A record without the two line ends after it."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block.encode())}\r\n\r\n{block}"


def _record_id(page: str | None, digest: str, nth: int) -> str:
    """Identifier of a page's record: rows that repeat page and payload are numbered."""
    return f"urn:page:{quote(page or '', safe='')}:{digest}" + (f":{nth}" if nth > 1 else "")


def _written_records(segment: int, chunk: int):
    """Rows (page, url, html, refers_to, nth) to records."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                body = row["html"] or ""
                size, digest = len(body.encode()), sha1(body.encode())
                own = f"<{_record_id(row['page'], digest, row['nth'])}>"
                headers = {"WARC-Type": "response", "WARC-Record-ID": own, "WARC-Date": "2024-01-01T00:00:00Z", "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{digest}"}
                if row["url"]:
                    headers["WARC-Target-URI"] = _clean(row["url"])
                if row["refers_to"] is not None:  # equal payloads have one digest, so the response's identifier is known
                    headers |= {"WARC-Type": "revisit", "WARC-Profile": _PROFILE, "WARC-Refers-To": f"<{_record_id(row['refers_to'], digest, 1)}>"}
                    out.append(_record(headers, f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"))
                    continue
                framed = "".join(f"{len(p.encode()):x}\r\n{p}\r\n" for p in _cuts(body, chunk)) + "0\r\n\r\n"
                parts = _cuts(f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n{framed}", segment)
                if len(parts) == 1:
                    out.append(_record(headers, parts[0]))
                    continue
                out.append(_record(headers | {"WARC-Segment-Number": "1"}, parts[0]))
                for k, part in enumerate(parts[1:], 2):
                    more = {"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": headers["WARC-Date"], "WARC-Segment-Origin-ID": own, "WARC-Segment-Number": str(k)}
                    if k == len(parts):
                        more["WARC-Segment-Total-Length"] = str(sum(len(p.encode()) for p in parts))
                    out.append(_record(more, part))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    return make


def with_revisits(pages: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """page, url, html, refers_to, nth: of equal payloads all refer to the smallest page_id, which itself refers to nothing.

    Payloads are equal if their SHA-256 and length are.  Rows that repeat the
    smallest page_id, or have none, are responses.  nth numbers the rows that
    repeat page_id and payload.  A payload may be that of any number of pages.
    """
    body = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", "html", F.unhex(F.sha2(body, 256)).alias("key"), F.octet_length(body).alias("size"))
    groups = written(keyed.groupBy("key", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")), "payloads")
    size = groups.agg(F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0))).first()[0]
    found = attach(keyed.select("page_id", "key", "size"), groups.where("n > 1"), ["key", "size"], F.col("page_id"), "n")
    refers = found.where(F.col("page_id") != F.col("first")).select("key", "page_id", F.col("first").cast("string").alias("refers_to")).distinct()
    dealt = keyed.drop("size").repartition(partitions(pages, size, file_bytes), "key", "page_id")  # the one shuffle of html
    nth = F.row_number().over(Window.partitionBy("key", "page_id").orderBy("url"))
    return dealt.join(refers, ["key", "page_id"], "left").select(F.col("page_id").cast("string").alias("page"), "url", "html", "refers_to", nth.alias("nth"))


def write(pages: DataFrame, folder: str, segment: int = SEGMENT, chunk: int = CHUNK, file_bytes: int = FILE_BYTES) -> None:
    """Write a record for each row of pages (page_id, url, html) as gzip archives into a new folder.

    A null html is an empty payload, a null url has no target header.  page_id
    may be of any type that can be cast to a string and back.
    """
    records = with_revisits(pages, file_bytes).mapInArrow(_written_records(segment, chunk), "value string")
    most = max(RECORDS, file_bytes // segment)  # a record has `segment` bytes at most, so a partition beyond its bytes makes several files
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", most).text(folder)


def unzipped(raw: bytes) -> Iterator[bytes]:
    """The content of a gzip file of any number of members, or of a plain file, in steps."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    while raw:
        one = zlib.decompressobj(31)
        while not one.eof:
            part = one.decompress(raw, STEP)
            raw = one.unconsumed_tail
            if not part and not raw and not one.eof:
                raise ValueError("the archive is cut short")
            yield part
        raw = one.unused_data


def records_of(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive, which comes in parts of any size."""
    held, gone = bytearray(), 0
    parts = iter(parts)

    def more(size: int) -> bool:
        while len(held) < size:
            part = next(parts, None)
            if part is None:
                return False
            held.extend(part)
        return True

    while more(1):
        seen = 0
        while (stop := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not more(seen + 1):
                raise ValueError(f"the headers at byte {gone} do not end")
        lines = held[:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins at byte {gone}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        end = stop + 4 + int(headers["content-length"])
        if not more(end + 4) or held[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {gone} is longer or shorter than it says")
        yield headers, bytes(held[stop + 4 : end])
        gone += end + 4
        del held[: end + 4]


def payload(block: bytes) -> bytes:
    """Body of an HTTP response, without chunked framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(body[line + 2 : line + 2 + size])
        if len(out[-1]) != size or body[line + 2 + size : line + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at = line + 4 + size


def _opened(kind: str, digest: str | None, block: bytes, name: str) -> tuple[int, bytes | None]:
    """Size and payload of a record's whole block; the payload of a revisit is not there."""
    if kind == "revisit":
        size = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]+)", block)
        return int(size[1]) if size else 0, None
    body = payload(block)
    if digest is not None and sha1(body) != digest:
        raise ValueError(f"{name}: the payload does not have the digest announced")
    return len(body), body


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of archives: whole ones opened, with their payload as body; of segments, the body is the block."""
    for batch in batches:
        for content in batch.column(0):
            rows, held = [], 0
            for h, block in records_of(unzipped(content.as_py())):
                own = h["warc-record-id"].strip("<>")
                row = {"record": own, "origin": h.get("warc-segment-origin-id", own).strip("<>"), "kind": h["warc-type"]}
                names = row["origin"].split(":")
                row["page"] = unquote(names[2]) or None if names[:2] == ["urn", "page"] else None
                row["refers"] = h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None
                row["digest"] = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                if "warc-segment-number" in h:
                    row["number"] = int(h["warc-segment-number"])
                    row["total"] = int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None
                    row["body"] = block
                else:
                    row["payload_bytes"], row["body"] = _opened(row["kind"], row["digest"], block, own)
                rows.append(row)
                held += len(block)
                if held > HELD:
                    yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with blocks, in order, to rows with payload_bytes and body."""
    schema = pa.schema([_SCHEMA.field(n) for n in ("record", "page", "kind", "refers", "digest", "payload_bytes", "body")])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            block = b"".join(r.pop("blocks"))
            total = r.pop("total")
            if total != len(block):
                raise ValueError(f"{r['record']}: segments of {len(block)} bytes, {total} announced")
            r["payload_bytes"], r["body"] = _opened(r["kind"], r["digest"], block, r["record"])
            out.append(r)
        yield pa.RecordBatch.from_pylist(out, schema)


def read(spark, folder: str, id_type: str = "bigint") -> DataFrame:
    """One row per page record: page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null of revisits).

    A record that is cut short, segments that do not add up to their total
    length, payloads without the digest announced, and revisits of a record
    that is not there raise an error.  page_id and refers_to are cast to id_type.
    """
    files = spark.read.format("binaryFile").load(folder).select("content")
    records = written(files.mapInArrow(_parsed, _RECORDS), "records")
    columns = ["record", "page", "kind", "refers", "digest", "payload_bytes", "body"]
    whole = records.where("number is null").select(columns)
    joined = records.where("number is not null").groupBy(F.col("origin").alias("record")).agg(
        F.max("page").alias("page"),
        F.max(F.when(F.col("number") == 1, F.col("kind"))).alias("kind"),
        F.max("refers").alias("refers"),
        F.max("digest").alias("digest"),
        F.max("total").alias("total"),
        F.array_sort(F.collect_list(F.struct("number", "body"))).alias("parts"),
    )
    blocks = joined.withColumn("blocks", F.col("parts.body")).drop("parts")
    found = whole.unionByName(blocks.mapInArrow(_joined, "record string, page string, kind string, refers string, digest string, payload_bytes long, body binary"))
    asked = records.where("kind = 'revisit'").select(F.col("refers").alias("record"), "digest").distinct()
    there = records.where("kind = 'response'").select("record", "digest")
    lost = asked.join(there, ["record", "digest"], "left_anti").first()
    if lost is not None:
        raise ValueError(f"a revisit refers to {lost.record}, which is not there")
    page = F.regexp_replace(F.element_at(F.split("refers", ":"), 3), r"\+", "%2B")
    return found.select(
        F.col("page").cast(id_type).alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.url_decode(page).cast(id_type).alias("refers_to"),
        F.col("body").alias("payload"),
    )


def round_trip(pages: DataFrame, segment: int = SEGMENT, chunk: int = CHUNK, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write pages as archives in the shared folder and read them back."""
    folder = shared_path(pages.sparkSession, "warc")
    write(pages, folder, segment, chunk, file_bytes)
    return read(pages.sparkSession, folder, pages.schema["page_id"].dataType.simpleString())
