"""Personal data: exact patterns of four kinds, and a conditional random field that adds what the patterns miss.

Candidate places are found on a whole slice of texts at once: a pattern's match
lies within a run of the bytes that it can hold, so only such runs are matched.
The field reads the words near any word that holds a digit or an at-sign.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import crf
from folio.llm import textscan as ts

KINDS = crf.KINDS
#: Words on either side of a candidate that the field reads with it.
REACH = 6
SEQUENCES = 2000

_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(rb"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a match always begins where digits begin
_CARD = re.compile(rb"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_AT_WORDS = re.compile(rb"[\[(](?:at|AT|At)[\])]|(?<![^ ])(?:at|AT|At)(?= [^ ]{1,64} (?:dot|DOT|Dot) )")


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_ALNUM = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_MAIL_BYTES, _LOCAL, _NUMBER_BYTES, _DIGITS = _class(_ALNUM + b"._%+-@"), _class(_ALNUM + b"._%+-"), _class(b"0123456789 ().+-"), _class(b"0123456789")


def _runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of marked bytes; runs end with their text."""
    edge = np.zeros(len(mask) + 1, bool)
    edge[offsets[offsets <= len(mask)]] = True
    before = np.concatenate([[False], mask[:-1]])
    after = np.concatenate([mask[1:], [False]])
    start = np.flatnonzero(mask & (~before | edge[:-1]))
    end = np.flatnonzero(mask & (~after | edge[1:])) + 1
    return start, end


def emails(run: bytes) -> Iterator[tuple[int, int]]:
    """Leftmost matches in a run: a match holds one at-sign, and begins where its local part's bytes begin."""
    done = at = 0
    while (at := run.find(b"@", at)) >= 0:
        start = at
        while start > done and _LOCAL[run[start - 1]]:
            start -= 1
        if start < at and (m := _DOMAIN.match(run, at + 1)):
            yield start, m.end()
            done = m.end()
        at += 1


def numbers(run: bytes) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of addresses, cards and phone numbers in a run."""
    if run.count(b".") >= 3:
        for m in _IP.finditer(run):
            if all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in m[0].split(b".")):
                yield 1, *m.span()
    for m in _CARD.finditer(run):
        if m.end() - m.start() >= 14:
            digits = re.sub(rb"[^0-9]", b"", m[0])
            if 14 <= len(digits) <= 19 and crf.luhn(digits.decode()):
                yield 2, *m.span()
    if b"+" in run:
        for m in _PHONE.finditer(run):
            if 10 <= len(re.sub(rb"[^0-9]", b"", m[0])) <= 15:
                yield 3, *m.span()


def base_spans(data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each text: (start, kind, end) in bytes of the slice, sorted."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    raw = data.tobytes()

    def within(mask: np.ndarray, need: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
        start, end = _runs(mask, offsets)
        count = np.concatenate([[0], np.cumsum(need)])
        keep = count[end] - count[start] >= least
        start, end = start[keep], end[keep]
        doc = np.searchsorted(offsets, start, side="right") - 1
        return zip(doc.tolist(), start.tolist(), end.tolist(), strict=True)

    for d, a, b in within(_MAIL_BYTES[data], data == 64, 1):
        out[d] += [(a + x, 0, a + y) for x, y in emails(raw[a:b])]
    for d, a, b in within(_NUMBER_BYTES[data], _DIGITS[data], 4):
        out[d] += [(a + x, k, a + y) for k, x, y in numbers(raw[a:b])]
    for spans in out:
        spans.sort()
    return out


def _sequences(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(text, word starts, word ends): runs of words near candidates."""
    w = ts.words(data, offsets, ts.SPACE_WORDS, False)
    if not len(w.hash):
        return []
    cue = np.concatenate([[0], np.cumsum(_DIGITS[data] | (data == 64))])
    mark = cue[w.end] > cue[w.start]
    raw = data.tobytes()
    for m in _AT_WORDS.finditer(raw):
        mark[np.searchsorted(w.start, m.start(), side="right") - 1] = True
    n = len(mark)
    at = np.flatnonzero(mark)
    doc = np.searchsorted(w.first, at, side="right") - 1
    lo, hi = np.maximum(at - REACH, w.first[doc]), np.minimum(at + REACH + 1, w.first[doc + 1])
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, lo, 1)
    np.add.at(cover, hi, -1)
    inside = np.cumsum(cover)[:-1] > 0
    start, end = _runs(inside, w.first)
    doc = np.searchsorted(w.first, start, side="right") - 1
    return [(int(d), w.start[a:b], w.end[a:b]) for d, a, b in zip(doc, start, end, strict=True)]


def field_spans(data: np.ndarray, offsets: np.ndarray, field: crf.Field) -> list[list[tuple[int, int, int]]]:
    """What the field finds, in bytes of the slice, without the punctuation at its edges."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    raw = data.tobytes()
    found = _sequences(data, offsets)
    for k in range(0, len(found), SEQUENCES):
        some = found[k : k + SEQUENCES]
        words = [[raw[a:b].decode() for a, b in zip(s.tolist(), e.tolist(), strict=True)] for _, s, e in some]
        for (d, s, e), path in zip(some, field.decode(words), strict=True):
            i = 0
            while i < len(path):
                if path[i] == 0:
                    i += 1
                    continue
                kind, j = (path[i] - 1) // 2, i + 1
                while j < len(path) and path[j] == 2 * kind + 2:
                    j += 1
                a, b = int(s[i]), int(e[j - 1])
                text = raw[a:b]
                a += len(text) - len(text.lstrip(crf._EDGE.encode()))
                b -= len(text) - len(text.rstrip(crf._EDGE.encode()))
                if a < b:
                    out[d].append((a, int(kind), b))
                i = j
    return out


def apart(new: list[tuple[int, int, int]], known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans (start, kind, end) of new that overlap none of known, which are in the order of their starts."""
    begins = [a for a, _, _ in known]
    reach = [*accumulate((b for _, _, b in known), max)]  # those of different kinds may overlap
    return [x for x in new if not (k := bisect_left(begins, x[2])) or reach[k - 1] <= x[0]]


def _found(field: crf.Field):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in ts.slices(batch.column(1), 1 << 20):
                base = base_spans(s.data, s.offsets)
                more = field_spans(s.data, s.offsets, field)
                point = np.concatenate([[0], np.cumsum((s.data & 0xC0) != 0x80)])
                spans, own = [], []
                for d, (known, new) in enumerate(zip(base, more, strict=True)):
                    zero = point[s.offsets[d]]
                    new = apart(new, known)
                    rows = sorted([(*x, True) for x in known] + [(*x, False) for x in new])
                    spans.append([{"kind": KINDS[k], "start": int(point[a] - zero), "end": int(point[b] - zero), "base": own} for a, k, b, own in rows])
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.hi - s.lo), pa.array(spans, kind)], ["doc_id", "found"])

    return find


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, found array<struct<kind, start, end, base>> by start, then kind; offsets in code points.

    base: found by the patterns.  The field's spans that overlap those are left
    out.  A null or empty text has none.  Rows are read alone: repeated rows,
    null doc_ids and further columns change nothing.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_found(crf.trained()), f"doc_id {kind}, found array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans of each kind), base_sha256, spans, n_found (all spans)."""
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("found", lambda x: x["base"])
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"), F.size("found").cast("long").alias("n_found"))
