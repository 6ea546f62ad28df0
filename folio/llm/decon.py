"""Benchmark decontamination by winnowing.

Of every WINDOW consecutive k-grams the one with the smallest hash is kept, in
documents and items alike, so that any shared span of SPAN = k + WINDOW - 1
words shares a kept fingerprint.  Documents' fingerprints are joined with those
of the items; around each hit, the windows of SPAN words that hold it are
compared with the items' windows word by word, and what they cover together is
the hit's maximal span.  Items of fewer than SPAN words are one window as a
whole: all grams of their length are looked up.

Items whose words number at most BROADCAST_WORDS go to every executor as sorted
arrays, and the documents are scanned once, without a shuffle; larger item
tables take the same steps as joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import textscan as ts
from folio.llm.common import attach, written

K, WINDOW = 5, 6
SPAN = K + WINDOW - 1
#: About 28 bytes a word in each worker: 14 MB.
BROADCAST_WORDS = 500_000
NOTHING = hashlib.sha256(b"").hexdigest()


def kept(h: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Positions of the grams that are smallest in some window of WINDOW grams of one document (ties: all)."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.flatnonzero(inside)
    h = np.where(inside, h, np.uint64(0xFFFFFFFFFFFFFFFF))
    low = h[:n].copy()
    for i in range(1, WINDOW):
        np.minimum(low, h[i : i + n], out=low)
    out = np.zeros(len(h), bool)
    for i in range(WINDOW):
        out[i : i + n] |= h[i : i + n] == low
    return np.flatnonzero(out & inside)


def fingerprints(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the winnowed k-grams."""
    g = ts.grams(h, K)
    at = kept(g, ts.gram_mask(first, len(h), K))
    return at, g[at]


def around(at: np.ndarray, first: np.ndarray, total: int) -> np.ndarray:
    """Starts of the windows of SPAN words, each within one document, that hold a k-gram at one of these positions."""
    starts = np.unique((at[:, None] - np.arange(SPAN - K + 1)).ravel())
    starts = starts[(starts >= 0) & (starts <= total - SPAN)]
    return starts[ts.gram_mask(first, total, SPAN)[starts]] if len(starts) else starts


def _words_of(column: pa.Array) -> Iterator[tuple[ts.Slice, ts.Words]]:
    for s in ts.slices(column):
        yield s, ts.words(s.data, s.offsets, ts.ALNUM_WORDS, True)


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s, w in _words_of(batch.column(1)):
            own = [w.hash[a:b].tobytes() for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.hi - s.lo), pa.array(own, pa.binary()), pa.array(np.diff(w.first), pa.int64())], ["item_id", "words", "n"])


class Windows(NamedTuple):
    """The items' windows of one length: sorted hashes, where each one's words are in flat, and the ids that have it."""

    length: int
    hashes: np.ndarray
    place: np.ndarray
    flat: np.ndarray
    begin: np.ndarray
    owners: np.ndarray

    @classmethod
    def of(cls, words: list[np.ndarray], owner: list[int], length: int) -> Windows:
        flat = np.concatenate(words)
        first = np.concatenate([[0], np.cumsum([len(x) for x in words])])
        at = np.flatnonzero(ts.gram_mask(first, len(flat), length))
        h = ts.grams(flat, length)[at]
        own = np.array(owner)[np.searchsorted(first, at, side="right") - 1]
        order = np.lexsort((own, h))
        h, own, at = h[order], own[order], at[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
        h, own, at = h[fresh], own[fresh], at[fresh]
        head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return cls(length, h[head], at[head].astype(np.int32), flat, np.append(head, len(h)).astype(np.int32), own.astype(np.int32))

    def hits(self, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of windows that start there, those that are an item's: start and number of the item's window."""
        h = ts.grams_at(words, starts, self.length)
        which = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        same = np.flatnonzero(self.hashes[which] == h)
        starts, which = starts[same], which[same]
        steps = np.arange(self.length)
        sure = (words[starts[:, None] + steps] == self.flat[self.place[which][:, None] + steps]).all(axis=1)
        return starts[sure], which[sure]


class Items:
    """Windows of a set of items, and what documents share with them."""

    def __init__(self, items: list[tuple[str, bytes]]) -> None:
        self.ids = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.ids)}
        rows = [(number[i], np.frombuffer(w, np.uint64)) for i, w in items if len(w)]
        self.prints = np.zeros(0, np.uint64)
        self.kinds = []
        for m in sorted({min(SPAN, len(w)) for _, w in rows}):
            own = [(k, w) for k, w in rows if len(w) == m or len(w) > m == SPAN]
            self.kinds.append(Windows.of([w for _, w in own], [k for k, _ in own], m))
            if m == SPAN:
                flat = self.kinds[-1].flat
                self.prints = np.unique(fingerprints(flat, np.concatenate([[0], np.cumsum([len(w) for _, w in own])]))[1])

    def candidates(self, w: ts.Words, kind: Windows) -> np.ndarray:
        """Starts of the windows that may be an item's: those around shared fingerprints, or all of a short length."""
        if kind.length < SPAN:
            return np.flatnonzero(ts.gram_mask(w.first, len(w.hash), kind.length))
        at, h = fingerprints(w.hash, w.first)
        if not len(at):
            return at
        near = self.prints[np.minimum(np.searchsorted(self.prints, h), len(self.prints) - 1)] == h
        return around(at[near], w.first, len(w.hash))

    def hits(self, w: ts.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words of a slice are hit; and pairs (document, number of the id), sorted."""
        hit = np.zeros(len(w.hash) + 1, np.int64)
        docs, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for kind in self.kinds:
            starts = self.candidates(w, kind)
            if not len(starts):
                continue
            starts, which = kind.hits(w.hash, starts)
            np.add.at(hit, starts, 1)
            np.add.at(hit, starts + kind.length, -1)
            doc, which = np.unique(np.stack([np.searchsorted(w.first, starts, side="right") - 1, which]), axis=1)
            size = kind.begin[which + 1] - kind.begin[which]
            docs.append(np.repeat(doc, size))
            ids.append(kind.owners[np.arange(size.sum()) + np.repeat(kind.begin[which] - (np.cumsum(size) - size), size)])
        pairs = np.unique(np.stack([np.concatenate(docs), np.concatenate(ids)]), axis=1)
        return np.cumsum(hit)[:-1] > 0, pairs[0], pairs[1]


def _scan(items: Items):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(items.ids, pa.string())
        for batch in batches:
            for s, w in _words_of(batch.column(1)):
                hit, doc, item = items.hits(w)
                total = np.concatenate([[0], np.cumsum(hit)])
                n = s.hi - s.lo
                ids = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), names.take(pa.array(item, pa.int64())))
                columns = [batch.column(0).slice(s.lo, n), pa.array(np.diff(w.first), pa.int64()), pa.array(total[w.first[1:]] - total[w.first[:-1]], pa.int64()), ids]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "items"])

    return scan


def contamination(docs: DataFrame, items: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated.

    A null or empty text has no words and is not contaminated; a null or empty
    item occurs nowhere; equal items under one id count once, under several ids
    each.  Items without an id are one item: it counts in n_items, is a null at
    the head of items, and adds nothing to the digest.  Rows that repeat a
    doc_id, or have none, are judged each by their own text.  Empty tables are
    allowed on either side; further columns are ignored.
    """
    known = written(items.select(F.coalesce(F.concat(F.lit("="), F.col("item_id").cast("string")), F.lit("")).alias("item_id"), "text").mapInArrow(_item_words, "item_id string, words binary, n long").where("n > 0"), "items")
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    body = docs.select("doc_id", "text")
    if total <= broadcast_words:
        index = Items([(r.item_id, bytes(r.words)) for r in known.select("item_id", "words").collect()])
        scan = _scan(index)
        out = body.mapInArrow(scan, f"{_ddl(docs)}, n_words long, n_hit long, items array<string>")
    else:
        out = _joined(body, known)
    out = out.withColumn("items", F.transform("items", lambda x: F.when(x != "", F.substr(x, F.lit(2)))))  # keys are "=" and the id, "" without one
    digest = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _ddl(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"


_WINDOW = "length int, hash long, words binary"


def _windows(ids: pa.Array, h: np.ndarray, starts: np.ndarray, length: int) -> pa.RecordBatch:
    """Rows (id, start, length, hash, words) of windows: the words are compared as they are."""
    words = h[starts[:, None] + np.arange(length)]
    raw = pa.Array.from_buffers(pa.binary(8 * length), len(starts), [None, pa.py_buffer(np.ascontiguousarray(words))]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([ids, pa.array(starts, pa.int64()), pa.array(np.full(len(starts), length), pa.int32()), ts.as_long(ts.grams_at(h, starts, length)), raw], ["id", "start", "length", "hash", "words"])


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, words in enumerate(batch.column(1)):
            h = np.frombuffer(words.as_py(), np.uint64)
            m = min(SPAN, len(h))
            starts = np.arange(len(h) - m + 1)
            yield _windows(batch.column(0).take(pa.array(np.full(len(starts), i))), h, starts, m)


def _item_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in batch.column(0):
            h = np.frombuffer(words.as_py(), np.uint64)
            _, prints = fingerprints(h, np.array([0, len(h)]))
            yield pa.RecordBatch.from_arrays([ts.as_long(np.unique(prints))], ["print"])


def _doc_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct fingerprint of a document, with its positions there."""
    for batch in batches:
        for s, w in _words_of(batch.column(1)):
            at, h = fingerprints(w.hash, w.first)
            doc = np.searchsorted(w.first, at, side="right") - 1
            order = np.lexsort((h, doc))
            at, h, doc = at[order] - w.first[doc[order]], h[order], doc[order]
            head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
            places = pa.ListArray.from_arrays(pa.array(np.append(head, len(h)).astype(np.int32)), pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(s.lo + doc[head], pa.int64())), ts.as_long(h[head]), places], ["row", "print", "places"])


def _doc_windows(lengths: list[int]):
    """Rows (row, text, places): the windows around the places, and all those of the short lengths."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, w in _words_of(batch.column(1)):
                places = batch.column(2).slice(s.lo, s.hi - s.lo).to_pylist()
                at = np.array(sorted({int(w.first[d]) + p for d, own in enumerate(places) for p in own or ()}), np.int64)
                for m in [*lengths, SPAN]:
                    starts = around(at, w.first, len(w.hash)) if m == SPAN else np.flatnonzero(ts.gram_mask(w.first, len(w.hash), m))
                    if len(starts):
                        doc = s.lo + np.searchsorted(w.first, starts, side="right") - 1
                        yield _windows(batch.column(0).take(pa.array(doc, pa.int64())), w.hash, starts, m)

    return windows


def _joined(body: DataFrame, known: DataFrame) -> DataFrame:
    """The same by joins: fingerprints, then the windows around shared ones, then the items of shared windows."""
    lengths = sorted(r.n for r in known.where(F.col("n") < SPAN).select("n").distinct().collect())  # fewer than SPAN values
    rows = written(body.withColumn("row", F.monotonically_increasing_id()), "rows")
    texts = rows.select("row", "text")
    prints = known.where(F.col("n") >= SPAN).select("words").mapInArrow(_item_prints, "print long").distinct()
    ours = written(texts.mapInArrow(_doc_prints, "row long, print long, places array<long>"), "prints")
    shared = written(ours.groupBy("print").agg(F.count(F.lit(1)).alias("times")).join(prints, "print"), "shared")
    near = attach(ours, shared, ["print"], F.col("row"), "times").where("times is not null")
    placed = texts.join(near.groupBy("row").agg(F.flatten(F.collect_list("places")).alias("places")), "row", "left" if lengths else "inner")
    theirs = written(known.select("item_id", "words").mapInArrow(_item_windows, f"item_id string, start long, {_WINDOW}").groupBy("length", "hash", "words").agg(F.collect_set("item_id").alias("ids")), "windows")
    found = written(placed.select("row", "text", "places").mapInArrow(_doc_windows(lengths), f"row long, start long, {_WINDOW}"), "candidates")
    key = ["length", "hash", "words"]
    common = written(found.groupBy(*key).agg(F.count(F.lit(1)).alias("times")).join(theirs.select(*key), key), "common")
    hits = written(attach(found, common, key, F.col("row"), "times").where("times is not null").select("row", "start", *key), "hits")
    covered = hits.select("row", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("at")).distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    pairs = hits.select("row", *key).distinct()
    owners = written(pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("times")).join(theirs, key), "owners")
    ids = attach(pairs, owners, key, F.col("row"), "times").groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items"))
    count = texts.mapInArrow(_counted, "row long, n_words long")
    out = rows.select("row", "doc_id").join(count, "row").join(covered, "row", "left").join(ids, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s, w in _words_of(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.hi - s.lo), pa.array(np.diff(w.first), pa.int64())], ["row", "n_words"])
