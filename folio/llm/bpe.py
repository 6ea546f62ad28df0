"""Token counts by heap-and-linked-list byte-pair merging.

A piece of text starts as one symbol for each UTF-8 byte.  A heap holds the
mergeable adjacent pairs by (rank, position), a linked list the symbols; the
lowest pair is popped and merged until none is left.  A piece's count is its
bytes minus its merges; no identifiers are made.  Pieces repeat, so each task
keeps a bounded table of the counts of short ones.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2048
CACHED_PIECES, CACHED_BYTES = 400_000, 48
_SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Characters whose letter, digit or other class the plain pattern below knows.
_PLAIN = re.compile("[\\x00-\\x7f\\xc0-\\u02c1]*\\Z")
_LETTER = "a-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u02c1"
_PLAIN_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^{_LETTER}0-9{_SPACE}]+")
_ANY_PIECE = regex.compile(f"'s|'t|'re|'ve|'m|'ll|'d|\\p{{L}}+|\\p{{N}}|[^{_SPACE}\\p{{L}}\\p{{N}}]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in own}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class Merges:
    """Ranks of one vocabulary file, and the counts of pieces under them."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pair = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        letters = byte_symbols()
        self.inner = [vocab.get(x) for x in letters]
        self.last = [vocab.get(x + end) for x in letters]
        special = [x["content"] for x in spec["added_tokens"] if x["special"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known: dict[str, int] = {}

    def merged(self, raw: bytes) -> int:
        """Symbols left of a piece: bytes that have a symbol, minus merges."""
        sym = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        sym = [s for s in sym if s is not None]
        n = left = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = self.pair
        heap = [(p[0], i, p[1]) for i in range(n - 1) if (p := pair.get((sym[i], sym[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new = heapq.heappop(heap)
            j = after[i]
            if sym[i] is None or j >= n or (p := pair.get((sym[i], sym[j]))) is None or p[1] != new:
                continue  # one of the two has been merged since
            sym[i], sym[j] = new, None
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if p := pair.get((new, sym[k])):
                    heapq.heappush(heap, (p[0], i, p[1]))
            if (h := before[i]) >= 0 and (p := pair.get((sym[h], new))):
                heapq.heappush(heap, (p[0], h, p[1]))
        return left

    def piece(self, piece: str) -> int:
        raw = piece.encode()
        count = self.merged(raw)
        if len(raw) <= CACHED_BYTES:
            if len(self.known) >= CACHED_PIECES:
                self.known.clear()
            self.known[piece] = count
        return count

    def count(self, text: str) -> int:
        """Tokens of a text; strings of special tokens count as one each, as the library's default has it."""
        if self.special and "<|" in text and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self._plain, parts))
        return self._plain(text)

    def _plain(self, text: str) -> int:
        known, total = self.known, 0
        for piece in pieces(text):
            n = known.get(piece)
            total += self.piece(piece) if n is None else n
        return total


def pieces(text: str) -> list[str]:
    """Normal form C, lower case of each character alone, then words, digits and runs of other signs."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma
    text = text.lower()
    return (_PLAIN_PIECE if _PLAIN.match(text) and not ("\xd7" in text or "\xf7" in text) else _ANY_PIECE).findall(text)


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    """One for each worker process."""
    return Merges(path)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text is empty, and an empty text has no tokens.  Rows are counted
    alone: ties, repeated rows, null doc_ids and further columns change nothing.
    path: the vocabulary file, which every executor has.
    """
    path = path or default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merges(path)
        for batch in batches:
            n = [own.count(t) if t else 0 for x in batch.column(1) for t in (x.as_py(),)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    body = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = body.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
