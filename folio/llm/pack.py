"""Packing along a space-filling curve.

A document's words are hashed into a count vector, which a fixed random
projection takes to DIMS dimensions; its place on the Hilbert curve through
that space is its key.  Documents are dealt to tasks by ranges of the key and
sorted; the token totals of the ranges (one number each) give every range its
place in one long stream, so tasks cut sequences independently of each other.
The stream is cut at every `size` tokens; what is left at its end is cut at
powers of two, so no sequence needs padding.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import textscan as ts
from folio.llm.bpe import default_path
from folio.llm.common import written

SIZE, END = 4096, 2
DIMS, BITS, BUCKETS, TIE_BITS = 4, 11, 256, 19
#: Tokens of one task, as far as documents allow, and ranges of the key for each task: tasks with several small ranges are more even.
RANGE_TOKENS, RANGES_EACH = 4_000_000, 8
#: Most ranges: their bounds and totals (two numbers each, 0.3 MB) are known to the driver and every task.  Beyond it a task,
#: which reads its sorted rows as a stream, gets more rows.
RANGES = 20_000
#: Pieces whose bytes and ids a worker keeps: about 30 MB, and as much again for a moment when it learns more.
KNOWN_PIECES = 600_000
#: New pieces that are sorted among themselves before they join the others.
RECENT_PIECES = 30_000
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)


def _classes() -> np.ndarray:
    table = np.full(256, _OTHER, np.uint8)
    table[[0x20, *range(0x09, 0x0E)]] = _SPACE
    table[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = _LETTER
    table[48:58] = _DIGIT
    return table


_CLASS = _classes()


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of points (rows) with unsigned coordinates of so many bits."""
    x = points.astype(np.uint64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):  # undo the curve's rotations and reflections, from the highest bit down
        q, below = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(n):
            on = (x[i] & q) > 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & below)
            x[0] = np.where(on, x[0] ^ below, x[0] ^ swap)
            x[i] ^= swap if i else np.uint64(0)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] & np.uint64(1 << b)) > 0, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return key


def curve_keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents given as word hashes; a document without words lies in the middle."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    counts = np.bincount(doc * BUCKETS + (hashes >> np.uint64(56)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
    vector = np.log1p(counts)
    vector -= vector.mean(axis=1, keepdims=True)
    length = np.linalg.norm(vector, axis=1, keepdims=True)
    axes = np.random.default_rng(7).standard_normal((BUCKETS, DIMS))
    at = vector / np.where(length > 0, length, 1) @ axes
    top = (1 << BITS) - 1
    return hilbert(np.clip((at + 3) / 6 * top, 0, top).astype(np.uint64))


def _gather(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... counts[0] of them, then those of begin[1], and so on."""
    total = np.concatenate([[0], np.cumsum(counts)])
    kind = np.int32 if total[-1] < 1 << 31 and (not len(begin) or begin.max() < 1 << 31) else np.int64
    out = np.repeat((begin - total[:-1]).astype(kind), counts)
    out += np.arange(total[-1], dtype=kind)
    return out


def _sorted(flat: np.ndarray, counts: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists, one after the other in flat, in another order; and where each begins."""
    begin = np.concatenate([[0], np.cumsum(counts)])
    return flat[_gather(begin[order], counts[order])], np.concatenate([[0], np.cumsum(counts[order])])


class Pieces(NamedTuple):
    """Pieces in the order of their keys: ids and how many each has, bytes and how many each has."""

    keys: np.ndarray
    flat: np.ndarray
    count: np.ndarray
    text: np.ndarray
    size: np.ndarray


_NOTHING = Pieces(np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.int64))


def _with(known: Pieces, new: Pieces) -> Pieces:
    keys, flat, count, text, size = (np.concatenate(x) for x in zip(known, new, strict=True))
    order = np.argsort(keys, kind="stable")
    return Pieces(keys[order], _sorted(flat, count, order)[0], count[order], _sorted(text, size, order)[0], size[order])


class Encoder:
    """Ids of texts by the library, which is asked once for each of the pieces that a worker remembers."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a piece
        self.ends[[i for x, i in vocab.items() if x.endswith("</w>")]] = True
        self.old = self.recent = _NOTHING
        self._use()

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)

    def _learn(self, keys: np.ndarray, pieces: list[str], forget: bool) -> None:
        """Pieces become recent ones.  Those become old from time to time, when very many old ones go."""
        model = self.library.model  # printable ASCII is what the steps before the model leave as it is
        lists = [[t.id for t in model.tokenize(p)] if p.isascii() and p.isprintable() else None for p in pieces]
        rest = [k for k, ids in enumerate(lists) if ids is None]
        if rest:
            ids = np.array(self.library.encode_batch_fast([[pieces[k] for k in rest]], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint16)
            parts = np.split(ids, np.flatnonzero(self.ends[ids]) + 1)
            assert len(parts) == len(rest) + 1, "every piece has one id that ends it"
            for k, part in zip(rest, parts, strict=False):
                lists[k] = part.tolist()
        count = np.array([len(x) for x in lists], np.int64)
        found = np.array([i for x in lists for i in x], np.uint16)
        raw = [p.encode() for p in pieces]
        sizes, own = np.array([len(p) for p in raw], np.int64), np.frombuffer(b"".join(raw), np.uint8)
        self.recent = _with(self.recent, Pieces(keys, found, count, own, sizes))
        if len(self.recent.keys) >= RECENT_PIECES:
            self.old = self.recent if forget and len(self.old.keys) >= KNOWN_PIECES else _with(self.old, self.recent)
            self.recent = _NOTHING
        self._use()

    def _use(self) -> None:
        """Where ids and bytes of all known pieces begin, the old ones first."""
        both = self.old, self.recent
        self.begin, self.letters = (np.concatenate([[0], np.cumsum(np.concatenate(x))]) for x in ([p.count for p in both], [p.size for p in both]))
        self.flat, self.text = (np.concatenate(x) for x in ([p.flat for p in both], [p.text for p in both]))

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key among the known pieces, -1 where it is none."""
        place, before = np.full(len(keys), -1, np.int64), 0
        for known in (self.old.keys, self.recent.keys):
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                place[hit] = at[hit] + before
            before += len(known)
        return place

    def _strangers(self, place: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Documents with a piece that differs from the known piece of its hash, byte by byte."""
        size, known = end - start, np.diff(self.letters)[place]
        alike = size == known
        at = np.cumsum(size[alike]) - size[alike]
        wrong = data[_gather(start[alike], size[alike])] != self.text[_gather(self.letters[place][alike], size[alike])]
        differ = ~alike
        if wrong.any():
            differ[np.flatnonzero(alike)] |= np.add.reduceat(wrong, at) > 0
        return np.unique(doc[differ])

    def slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Each document's ids, and its key on the curve."""
        n = len(offsets) - 1
        if not len(data):
            return [np.zeros(0, np.uint16)] * n, curve_keys(np.zeros(0, np.uint64), np.zeros(n + 1, np.int64))
        low = data.copy()
        low[(data >= 65) & (data <= 90)] += 32
        after = np.zeros(len(data), bool)
        after[1:] = data[:-1] == 0xC3
        low[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32  # upper case of the Latin-1 letters
        odd = (data > 0xC3) | (data == 0xC2) | (data == 39) | (after & ((data == 0x97) | (data == 0xB7)))
        odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)  # special tokens' strings
        odd_before = np.concatenate([[0], np.cumsum(odd)])
        plain = odd_before[offsets[1:]] == odd_before[offsets[:-1]]
        kind = _CLASS[low]
        new = np.ones(len(data), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        new[offsets[:-1][offsets[:-1] < len(data)]] = True
        start = np.flatnonzero(new)
        end = np.concatenate([start[1:], [len(data)]])
        real = kind[start] != _SPACE
        start, end = start[real], end[real]
        hashes = ts.span_hash(low, start, end)
        first = np.searchsorted(start, offsets)
        keys = curve_keys(hashes, first)
        if plain.any():
            own = np.repeat(plain, np.diff(first))
            every, at, back = np.unique(hashes[own], return_index=True, return_inverse=True)
            raw, forget = low.tobytes(), True
            while len(unknown := np.flatnonzero((known := self._find(every)) < 0)):
                where = np.flatnonzero(own)[at[unknown]]
                self._learn(every[unknown], [raw[a:b].decode() for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)], forget)
                forget = False  # what went is learned again, and stays for this slice
            place = known[back]
            plain[self._strangers(place, low, start[own], end[own], np.repeat(np.arange(n), np.diff(first))[own])] = False
            counts = np.diff(self.begin)[place]
            flat = self.flat[_gather(self.begin[place], counts)]
            total = np.concatenate([[0], np.cumsum(counts)])
            upto = total[np.concatenate([[0], np.cumsum(own)])[first]]
        out = []
        for i in range(n):
            if plain[i]:
                out.append(flat[upto[i] : upto[i + 1]])
            else:
                out.append(self.ids(data[offsets[i] : offsets[i + 1]].tobytes().decode()))
        return out, keys


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
    return Encoder(path)


def _encoded(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for s in ts.slices(batch.column(1), 1 << 19):
                ids, keys = own.slice(s.data, s.offsets)
                tie = batch.column(2).slice(s.lo, s.hi - s.lo).to_numpy().view(np.uint64) >> np.uint64(64 - TIE_BITS)
                keys = (keys << np.uint64(TIE_BITS)) | tie
                raw = [np.append(x, np.uint16(END)).tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.hi - s.lo), ts.as_long(keys), pa.array([len(x) // 2 for x in raw], pa.int64()), pa.array(raw, pa.binary())], ["doc_id", "key", "n", "ids"])

    return encode


class Stream:
    """Where sequences lie in a stream of so many tokens."""

    def __init__(self, total: int, size: int = SIZE) -> None:
        self.size, self.full = size, total // size * size
        rest = total - self.full
        self.tail = [self.full]
        while rest:
            part = 1 << (rest.bit_length() - 1)
            self.tail.append(self.tail[-1] + part)
            rest -= part

    def pieces(self, start: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the document, length, sequence, offset there) of the document that begins at `start`."""
        at, end = start, start + n
        while at < end:
            if at < self.full:
                number = at // self.size
                begin, stop = number * self.size, (number + 1) * self.size
            else:
                k = bisect.bisect_right(self.tail, at) - 1
                number, begin, stop = self.full // self.size + k, self.tail[k], self.tail[k + 1]
            stop = min(stop, end)
            yield at - start, stop - at, number, at - begin
            at = stop


def _cut(base: list[int], stream: Stream):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = None, 0
        for batch in batches:
            rows: list[tuple] = []
            which: list[int] = []
            for i, (p, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if p != part:
                    part, at = p, base[p]
                ids = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint16).astype("<u4")
                for start, length, number, offset in stream.pieces(at, n):
                    rows.append((start, length, ids[start : start + length].tobytes(), n, number, offset))
                    which.append(i)
                at += n
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(which, pa.int64())), *columns], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return cut


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its ids and END; a null or empty text is END alone.  Rows that
    repeat a doc_id, or have none, are packed each.  Equal keys are told apart by
    a hash of row content and doc_id, so copies of one text spread over several
    ranges.  An empty table gives no pieces.  Further columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    body = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("tie"))
    rows = written(body.mapInArrow(_encoded(path or default_path()), f"doc_id {kind}, key long, n long, ids binary"), "tokens")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // range_tokens))
    ranges = min(parts * RANGES_EACH, RANGES)
    parts = min(parts, ranges)
    bounds = sorted({int(x) for x in rows.stat.approxQuantile("key", [k / ranges for k in range(1, ranges)], 0.2 / ranges)}) if total else []  # at most RANGES
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def part_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, key.to_numpy(), side="right").astype(np.int32))

    placed = rows.withColumn("part", part_of("key"))
    sums = {r.part: r.total for r in placed.groupBy("part").agg(F.sum("n").alias("total")).collect()}  # a number for each range
    base, at = [], 0
    for p in range(len(bounds) + 1):
        base.append(at)
        at += sums.get(p, 0)
    sorted_rows = placed.select("part", "doc_id", "n", "ids", "key").repartition(parts, "part").sortWithinPartitions("part", "key", "doc_id")
    return sorted_rows.drop("key").mapInArrow(_cut(base, Stream(total, size)), f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
