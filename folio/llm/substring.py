"""Substring dedup with suffix automata of reference shards.

A window of SPAN words belongs to the reference shard of its minimiser, the
k-gram of smallest hash in it, so equal windows meet in one shard.  Runs of
neighbouring windows with one minimiser travel as one passage of text.  A shard
streams its passages in the order of documents through the suffix automaton of
what it has seen: matching statistics of SPAN or more mark windows that start
earlier somewhere else, and only what is new is added.  Words are compared as
they are.  Windows whose hash is alone in the shard have no match and are left
out before.

Shards are as many as the text is long, so a shard's size does not grow with
the input.  k-grams that occur very often are counted first; they are nobody's
minimiser, and a window that holds no others goes to a shard by all its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import textscan as ts
from folio.llm.common import MOST_PARTITIONS, named, numbered, written

SPAN, K = 20, 3
#: k-grams of a window, and so the most windows of one passage.
HELD = SPAN - K + 1
#: A k-gram is frequent from so many occurrences on; with very many words the bound rises, so that at most FREQUENT are
#: listed (a broadcast of 8 MB).  Any list gives the same result: it only deals the work.
HOT, FREQUENT = 10_000, 1_000_000
#: k-grams that a task gathers before it counts them, and counters that it keeps.
COUNTED, COUNTERS = 1 << 20, 1 << 21
#: Bytes of text for each group of shards (a group's passages come to about three times that), and words of one shard.
GROUP_BYTES, SHARD_WORDS = 4 << 20, 200_000
#: Frequent windows that a task remembers, to send only the first ones.
REMEMBERED = 50_000
SLICE_BYTES = 4 << 20
NO_ID = np.iinfo(np.int64).max
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


class Automaton:
    """Suffix automaton of the passages added so far."""

    def __init__(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.breaks = 0

    def _grow(self, last: int, sign: int) -> int:
        step, link, size = self.step, self.link, self.size
        new = len(step)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        at = last
        while at >= 0 and sign not in step[at]:
            step[at][sign] = new
            at = link[at]
        if at >= 0:
            to = step[at][sign]
            if size[to] == size[at] + 1:
                link[new] = to
            else:
                copy = len(step)
                step.append(dict(step[to]))
                link.append(link[to])
                size.append(size[at] + 1)
                while at >= 0 and step[at].get(sign) == to:
                    step[at][sign] = copy
                    at = link[at]
                link[to] = link[new] = copy
        return new

    def add(self, words: list[int]) -> list[int]:
        """Add a passage; for each word, the longest stretch that ends there and occurred before (in this passage too)."""
        self.breaks -= 1
        last = self._grow(self._last if self.breaks < -1 else 0, self.breaks)  # a sign of its own parts it from the one before
        out = []
        for w in words:
            last = self._grow(last, w)
            out.append(self.size[self.link[last]])
        self._last = last
        return out

    def stream(self, words: list[int]) -> list[int]:
        """Matching statistics: for each word, the longest stretch that ends there and occurs in the automaton."""
        step, link, size = self.step, self.link, self.size
        at = length = 0
        out = []
        for w in words:
            to = step[at].get(w)
            while to is None and at:
                at = link[at]
                length = size[at]
                to = step[at].get(w)
            if to is not None:
                at, length = to, length + 1
            out.append(length)
        return out


def repeats(passages: list[list[int]], span: int = SPAN) -> list[list[int]]:
    """For each passage, in the order in which they come, its windows of `span` words that occur earlier: their starts."""
    seen = Automaton()
    out = []
    for words in passages:
        found = [e - span + 1 for e, n in enumerate(seen.stream(words)) if n >= span]
        known = {*found}
        fresh = [s for s in range(len(words) - span + 1) if s not in known]
        lo = 0
        for k in range(1, len(fresh) + 1):  # runs of new windows
            if k == len(fresh) or fresh[k] != fresh[k - 1] + 1:
                a, b = fresh[lo], fresh[k - 1] + span
                found += [a + e - span + 1 for e, n in enumerate(seen.add(words[a:b])) if n >= span]
                lo = k
        out.append(sorted(found))
    return out


def _slice_words(column: pa.Array) -> Iterator[tuple[ts.Slice, ts.Words]]:
    for s in ts.slices(column, SLICE_BYTES):
        yield s, ts.words(s.data, s.offsets, ts.SPACE_WORDS, False)


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """Smallest of every n values in a row."""
    size = len(values) - n + 1
    if size <= 0:
        return np.zeros(0, values.dtype)
    low = values[:size].copy()
    for i in range(1, n):
        np.minimum(low, values[i : i + size], out=low)
    return low


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k-grams that occur more than once in the task's text, by a summary of COUNTERS counters.

    Counts of all stretches are merged before any is dropped (Misra and Gries):
    where there are too many, the largest that has no counter left is taken off
    all.  So no count is more than words / COUNTERS too low, in a task and in
    the sum of all tasks: half of the bound on frequent k-grams at most.
    """
    held: list[np.ndarray] = []
    keys, counts, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        new, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        every, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
        total = np.zeros(len(every), np.int64)
        total[at[: len(keys)]] = counts
        total[at[len(keys) :]] += n
        if len(every) > COUNTERS:
            total -= np.partition(total, len(total) - COUNTERS - 1)[len(total) - COUNTERS - 1]
        return every[total > 0], total[total > 0]

    for batch in batches:
        for _, w in _slice_words(batch.column(0)):
            held.append(ts.grams(w.hash, K)[ts.gram_mask(w.first, len(w.hash), K)])
            size += len(held[-1])
            if size >= COUNTED:
                keys, counts = merged()
                size = 0
    if held:
        keys, counts = merged()
    yield pa.RecordBatch.from_arrays([ts.as_long(keys[counts > 1]), pa.array(counts[counts > 1])], ["gram", "n"])


_ROW = "kind int, shard int, n int, places binary, words binary"
#: What is known of each passage: document, text, first window, number of windows, bytes, part of the group.
_PLACES = (("doc", np.int64), ("text", np.int64), ("start", np.int32), ("count", np.uint8), ("bytes", np.int32), ("part", np.uint8))


def _row(kind: int, shard: int, columns: list[np.ndarray], words: bytes, pack: zstandard.ZstdCompressor) -> pa.RecordBatch:
    raw = b"".join(x.astype(t).tobytes() for x, (_, t) in zip(columns, _PLACES, strict=True))
    values = ((kind, pa.int32()), (shard, pa.int32()), (len(columns[0]), pa.int32()), (pack.compress(raw), pa.binary()), (pack.compress(words), pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in values], [x.split()[0] for x in _ROW.split(", ")])


def _places(rows: pa.Table, which: np.ndarray, unpack: zstandard.ZstdDecompressor) -> list[np.ndarray]:
    """The columns of _PLACES of these rows, one after the other."""
    out: list[list[np.ndarray]] = [[] for _ in _PLACES]
    for i in which.tolist():
        n, raw, at = rows.column("n")[i].as_py(), unpack.decompress(rows.column("places")[i].as_py()), 0
        for column, (_, t) in zip(out, _PLACES, strict=True):
            column.append(np.frombuffer(raw, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(x) for x in out]


def _keys(w: ts.Words, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, key and whether it holds frequent k-grams alone, for each window of a slice."""
    n = max(len(w.hash) - SPAN + 1, 0)
    grams = ts.grams(w.hash, K)
    if len(frequent) and len(grams):
        grams[frequent[np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)] == grams] = _NEVER
    start = np.flatnonzero(ts.gram_mask(w.first, len(w.hash), SPAN))
    key = _least(grams, HELD)[:n][start]
    single = key == _NEVER
    key[single] = ts.grams_at(w.hash, start[single], SPAN)
    return start, key, single


def _passages(frequent, groups: int):
    """Runs of windows with one minimiser, packed for their shards (kind 0); those known to be repeats already (kind 1)."""

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = frequent.value
        met: dict[int, tuple[int, int]] = {}  # frequent windows of this task: where one was sent from
        pack = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            texts = batch.column(1).to_numpy()
            for s, w in _slice_words(batch.column(2)):
                start, key, single = _keys(w, listed)
                if not len(start):
                    continue
                doc = np.searchsorted(w.first, start, side="right") - 1
                new = np.ones(len(start), bool)
                new[1:] = (start[1:] != start[:-1] + 1) | (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | single[1:] | single[:-1]
                head = np.flatnonzero(new)
                new |= (np.arange(len(start)) - np.repeat(head, np.diff(np.append(head, len(start))))) % HELD == 0
                head = np.flatnonzero(new)
                count = np.diff(np.append(head, len(start)))
                start, key, doc, single = start[head], key[head], doc[head], single[head]
                own, text, begin = ids[s.lo + doc], texts[s.lo + doc], start - w.first[doc]
                # of equal passages of the slice, the first is sent
                one, two = ts.grams_at(w.hash, start, SPAN), ts.grams_at(w.hash, start + count - 1, SPAN)
                order = np.lexsort((text, begin, own, count, two, one, key))
                again = np.zeros(len(order), bool)
                again[1:] = np.all([x[order][1:] == x[order][:-1] for x in (key, one, two, count)], axis=0)
                first, later = order[~again], order[again]
                here = np.flatnonzero(~again)[np.cumsum(~again)[again] - 1]
                moved = (own[later] != own[order[here]]) | (begin[later] != begin[order[here]])
                other = ~moved & (text[later] != text[order[here]])
                first = np.concatenate([first, later[other]])  # another text under the id is a passage of its own
                later = later[moved]  # a row that repeats a document is that document
                known = []
                for i in first[single[first]].tolist():
                    at, place = int(key[i]), (int(own[i]), int(begin[i]))
                    if at in met and met[at] < place:
                        known.append(i)
                    elif len(met) < REMEMBERED:
                        met[at] = place
                if known:
                    later = np.concatenate([later, known])
                    first = first[~np.isin(first, known)]
                a, b = w.start[start], w.end[start + count + SPAN - 2]
                part = key & np.uint64(0xFF)
                columns = [own, text, begin, count, b - a, part]
                if len(later):
                    yield _row(1, int(text[later[0]]) % groups, [x[later] for x in columns], b"", pack)
                shard = ((key >> np.uint64(20)) % np.uint64(groups)).astype(np.int64)
                first = first[np.lexsort((begin[first], own[first], shard[first]))]
                shard = shard[first]
                cuts = np.flatnonzero(np.diff(shard, prepend=-1))
                for lo, hi in zip(cuts, [*cuts[1:], len(first)], strict=True):
                    which = first[lo:hi]
                    size = b[which] - a[which]
                    at = np.arange(size.sum()) + np.repeat(a[which] - (np.cumsum(size) - size), size)
                    yield _row(0, int(shard[lo]), [x[which] for x in columns], s.data[at].tobytes(), pack)

    return passages


def _repeated(h: np.ndarray) -> np.ndarray:
    """True for the values that occur more than once."""
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _judge(data: np.ndarray, ends: np.ndarray, doc: np.ndarray, text: np.ndarray, start: np.ndarray, part: np.ndarray, shard_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of passages that occur earlier: number of the passage, and place of the window there."""
    w = ts.words(data, np.concatenate([[0], ends]), ts.SPACE_WORDS, False)
    at = np.flatnonzero(ts.gram_mask(w.first, len(w.hash), SPAN))
    at = at[_repeated(ts.grams_at(w.hash, at, SPAN))]
    if not len(at):
        return at, at
    owner = np.searchsorted(w.first, at, side="right") - 1
    bits = min(8, max(0, int(len(at) // shard_words).bit_length()))
    shards = part.astype(np.int64)[owner] >> (8 - bits)
    place = at - w.first[owner]
    order = np.lexsort((place, owner, text[owner], start[owner], doc[owner], shards))
    at, owner, shards, place = at[order], owner[order], shards[order], place[order]
    cuts = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(owner, prepend=-1) != 0))  # runs of windows
    raw = data.tobytes()
    which, where = [], []
    number: dict[bytes, int] = {}
    runs: list[list[int]] = []
    begins: list[int] = []

    def ask() -> None:
        for found, i in zip(repeats(runs), begins, strict=True):
            which.extend([owner[i]] * len(found))
            where.extend(place[i] + k for k in found)
        runs.clear()
        begins.clear()

    last = None
    for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=True):
        if begins and shards[i] != shards[begins[0]]:
            ask()
            number.clear()
            last = None
        same = (doc[owner[i]], start[owner[i]] + place[i], text[owner[i]], j - i)
        if same != last:  # one place of one document is asked once, even if its row is repeated
            a, b = int(at[i]), int(at[j - 1]) + SPAN
            runs.append([number.setdefault(raw[x:y], len(number)) for x, y in zip(w.start[a:b].tolist(), w.end[a:b].tolist(), strict=True)])
            begins.append(i)
        last = same
    if begins:
        ask()
    return np.array(which, np.int64), np.array(where, np.int64)


def _judged(shard_words: int):
    """Repeats in a group of shards, one shard after the other: rows (doc, text, start, size)."""

    def judged(rows: pa.Table) -> pa.Table:
        schema = pa.schema([("doc", pa.int64()), ("text", pa.int64()), ("start", pa.int32()), ("size", pa.int32())])
        kind = rows.column("kind").to_numpy()
        unpack = zstandard.ZstdDecompressor()
        out = []
        known, asked = np.flatnonzero(kind == 1), np.flatnonzero(kind == 0)
        if len(known):
            doc, text, start, count, *_ = _places(rows, known, unpack)
            out.append([doc, text, start, count.astype(np.int32)])
        if len(asked):
            doc, text, start, _, size, part = _places(rows, asked, unpack)
            data = np.frombuffer(b"".join(unpack.decompress(rows.column("words")[int(i)].as_py()) for i in asked), np.uint8)
            which, at = _judge(data, np.cumsum(size.astype(np.int64)), doc, text, start, part, shard_words)
            if len(which):
                order = np.lexsort((at, which))
                which, at = which[order], at[order]
                runs = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (at[1:] != at[:-1] + 1)]))
                length = np.diff(np.append(runs, len(which))).astype(np.int32)
                which, at = which[runs], at[runs]
                out.append([doc[which], text[which], (start[which] + at).astype(np.int32), length])
        if not out:
            return schema.empty_table()
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=schema)

    return judged


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, spans): words without those that a span of windows covers."""
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        spans = batch.column(2)
        size, removed, kept = [], [], []
        for i, raw in enumerate(texts):
            words = (raw or b"").split()  # by the six ASCII spaces
            gone = 0
            if spans[i].is_valid and len(spans[i]):
                pairs = spans[i].values.to_numpy().reshape(-1, 2)
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, pairs[:, 0], 1)
                np.add.at(cover, pairs[:, 0] + pairs[:, 1] + SPAN - 1, -1)
                stay = np.flatnonzero(np.cumsum(cover)[:-1] == 0)
                gone = len(words) - len(stay)
                words = [words[k] for k in stay]
            size.append(len(words) + gone)
            removed.append(gone)
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def repeated_spans(docs: DataFrame, hot: int = HOT, group_bytes: int = GROUP_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc, text, spans of documents that hold repeated windows: spans are (first start, number of windows) in turn.

    docs: doc_id long, text_key long (a hash of the text), text.
    """
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(1, -(-size // group_bytes))
    grams = written(docs.select("text").mapInArrow(_counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    total = grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = grams.where(F.col("n") >= max(hot, -(-total // FREQUENT))).select("gram").toArrow()  # at most FREQUENT of them
    listed = spark.sparkContext.broadcast(np.sort(frequent.column("gram").to_numpy().view(np.uint64)))
    rows = docs.mapInArrow(_passages(listed, groups), _ROW)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(groups, MOST_PARTITIONS))  # a task takes its groups one by one
    found = rows.repartition(parts, "shard").groupBy("shard").applyInArrow(_judged(shard_words), "doc long, text long, start int, size int")
    return found.groupBy(F.col("doc").alias("doc_key"), F.col("text").alias("text_key")).agg(F.flatten(F.collect_list(F.array("start", "size"))).alias("spans"))


def without_repeats(docs: DataFrame, hot: int = HOT, group_bytes: int = GROUP_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_text (kept words, joined by one space).

    A word goes if a window of SPAN words that covers it also starts earlier:
    in a document of smaller doc_id, or in the same one further ahead.  Windows
    are judged on the input.  A null text has no words.  Rows without a doc_id
    come after all others and are one document; rows that repeat a doc_id and
    its text are one document, of which no row is earlier than another.  Of
    different texts under one doc_id, windows at the same place go by text_key.
    doc_id may be of any type with an order; further columns are ignored.
    """
    docs, ids = numbered(docs.select("doc_id", "text"))
    body = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    spans = repeated_spans(body, hot, group_bytes, shard_words)
    keyed = body.withColumn("doc_key", F.coalesce("doc_id", F.lit(int(NO_ID))))
    joined = keyed.join(spans, ["doc_key", "text_key"], "left").select("doc_id", "text", "spans")
    return named(joined.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_text string"), ids, "doc_id")


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
