import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folio.llm import bpe, pack
from tests.conftest import DATA

SIGNS = [*"abcdefgh thein'sS.,!?0123\n\t éÈßÀÏİΣςσ日本語²½Ⅷ🙂́ \x1c\x85 ªµº×÷_<|>", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'re", "'ll", "the ", "Été "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


def texts(n=1500):
    rng = random.Random(5)
    out = [None, "", " ", "a" * 70_000, "<|endoftext|>" * 3, "x'", "Σ", "é" * 99]
    return out + ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_counts_match_the_library(spark, library):
    data = list(enumerate(texts()))
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in bpe.token_counts(df).collect()}
    for i, t in data:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 2048), t


def test_a_long_piece_is_merged_in_order(library):
    for raw in ("a" * 5000 + "th" * 3000, "qwertzuiopasdfgh" * 700):
        assert bpe.merges(bpe.default_path()).count(raw) == len(library.encode(raw, add_special_tokens=False).ids)


def test_counts_of_an_empty_table(spark):
    assert bpe.token_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_hilbert_curve_steps_to_neighbours():
    side = 8
    points = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    keys = pack.hilbert(points, 3)
    assert sorted(keys.tolist()) == list(range(side**3))
    steps = np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def check_pieces(rows, docs, library, size):
    """Every id in one piece, sequences gapless and full, ids as the library has them."""
    want = [[*library.encode(t or "", add_special_tokens=False).ids, pack.END] for _, t in docs]
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.start, r.length, bytes(r.ids), r.doc_tokens))
    for (i, _), ids in zip(docs, want, strict=True):
        at, raw = 0, b""
        for start, length, part, n in sorted(by_doc[i]):
            assert start == at and length == len(part) // 4 and n == len(ids)
            at += length
            raw += part
        assert np.frombuffer(raw, "<u4").tolist() == ids
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size and (at == size or at & (at - 1) == 0)
    assert sorted(sequences) == list(range(len(sequences)))


@pytest.mark.parametrize("size", [64, 4096])
def test_packing_matches_the_library(spark, library, size):
    docs = list(enumerate(texts(400) + ["same text again"] * 50))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit("clash")).repartition(5)
    check_pieces(pack.pack(df, size=size, range_tokens=1000).collect(), docs, library, size)


def test_packing_puts_copies_together(spark, library):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows = pack.pack(spark.createDataFrame(docs, "doc_id long, text string")).withColumn("crc", F.crc32("ids")).collect()
    check_pieces(rows, docs, library, 4096)
    assert all(r.crc == zlib.crc32(bytes(r.ids)) for r in rows)


def test_packing_edges(spark):
    assert pack.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = pack.pack(spark.createDataFrame([(None, None), (None, ""), (1, None), (1, None)], "doc_id long, text string")).collect()
    assert sorted((r.sequence_id, r.offset, r.length) for r in got) == [(0, 0, 1), (0, 1, 1), (0, 2, 1), (0, 3, 1)]


def test_encoder_forgets_and_learns_again(library, monkeypatch):
    monkeypatch.setattr(pack, "KNOWN_PIECES", 5)
    monkeypatch.setattr(pack, "RECENT_PIECES", 3)
    own = pack.Encoder(bpe.default_path())
    for t in ("the cat sat on the mat", "dogs and cats and birds", "the cat again", "one two three four five six seven", "the"):
        raw = np.frombuffer(t.encode(), np.uint8)
        ids, _ = own.slice(raw, np.array([0, len(raw)]))
        assert ids[0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_pieces_of_one_hash_are_told_apart(spark, library, monkeypatch):
    """Pieces are known by a hash, but their bytes decide."""
    monkeypatch.setattr(pack.ts, "span_hash", lambda data, start, end, seed=0: np.full(len(start), 7, np.uint64))
    own = pack.Encoder(bpe.default_path())
    for t in ("cat", "cat dog", "dog dog", "a bc a", "cat"):
        raw = np.frombuffer(t.encode(), np.uint8)
        ids, _ = own.slice(raw, np.array([0, len(raw)]))
        assert ids[0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_words_that_a_power_sum_cannot_tell_apart(spark, library):
    word = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    docs = [(1, word), (2, word.translate({97: 98, 98: 97})), (3, f"{word} {word}")]
    check_pieces(pack.pack(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs, library, 4096)


def test_few_ranges_hold_everything(spark, library, monkeypatch):
    monkeypatch.setattr(pack, "RANGES", 3)
    docs = list(enumerate(texts(300)))
    check_pieces(pack.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), range_tokens=500).collect(), docs, library, 4096)


def test_counts_of_repeated_rows_and_null_ids(spark):
    rows = bpe.token_counts(spark.createDataFrame([(1, "the cat"), (1, "the cat"), (None, "the cat"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 0), (0, 2), (1, 2), (1, 2)]
