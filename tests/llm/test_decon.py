import hashlib
import random

import pytest
from pyspark.sql import functions as F

from folio.llm import decon
from tests.conftest import DATA
from tests.llm import brute

COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def cases():
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(60)]
    pick = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(pick(n))) for k, n in enumerate([9, 10, 11, 15, 40, 1, 3, 3])] + [(50, None), (51, "--"), (52, "aa " * 14), (53, "É x1 ß " * 5)]
    docs = [(1, None), (2, ""), (3, "a-b"), (4, "aa " * 40), (5, "É x1-ß " * 9)]
    for k in range(40):
        words = pick(rng.randrange(0, 60))
        own = (items[rng.randrange(8)][1] or "").split()
        lo = rng.randrange(len(own))
        own = own[lo : lo + rng.randrange(1, 30)]
        at = rng.randrange(len(words) + 1)
        docs.append((10 + k, "; ".join(words[:at] + own + words[at:]).upper()))
    return docs, items


@pytest.mark.parametrize("bound", [decon.BROADCAST_WORDS, 0])
def test_matches_brute_force(spark, bound):
    docs, items = cases()
    got = decon.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), bound)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == brute.contamination(docs, items)


def test_on_the_small_table(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    items = spark.read.parquet(f"{DATA}/sf0.001/benchmark.parquet")
    got = sorted(tuple(r[c] for c in COLUMNS) for r in decon.contamination(docs, items).collect())
    want = brute.contamination([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got == want and any(r[-1] for r in got)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, item_id long, text string")
    one = spark.createDataFrame([(1, 1, "a b")], "doc_id long, item_id long, text string")
    assert decon.contamination(none, one).collect() == []
    got = decon.contamination(one, none).collect()
    assert [(r.n_words, r.n_hit, r.items_sha256) for r in got] == [(2, 0, decon.NOTHING)]


@pytest.mark.parametrize("bound", [decon.BROADCAST_WORDS, 0])
def test_items_without_an_id(spark, bound):
    a, b, c = (" ".join(f"{x}{k}" for k in range(12)) for x in "abc")
    docs = spark.createDataFrame([(1, a), (2, f"{a} {b}"), (3, f"{a} {c}"), (4, "z"), (5, b)], "doc_id long, text string")
    items = spark.createDataFrame([(None, a), (None, c), ("b", b), ("", "z")], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r["items"], r.items_sha256, r.contaminated) for r in decon.contamination(docs, items, bound).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {1: (12, 1, [None], sha(""), True), 2: (24, 2, [None, "b"], sha("b"), True), 3: (24, 1, [None], sha(""), True), 4: (1, 1, [""], sha(""), True), 5: (12, 1, ["b"], sha("b"), True)}


@pytest.mark.parametrize("bound", [decon.BROADCAST_WORDS, 0])
def test_edges(spark, bound):
    word = "".join("ab"[i.bit_count() & 1] for i in range(1024))  # a sum of powers cannot tell it from its mirror image
    mirror = word.translate({97: 98, 98: 97})
    long = " ".join(f"q{k}" for k in range(90_000))
    items = [(1, word), (2, " ".join(f"q{k}" for k in range(70_000, 70_012))), (3, " ".join("abcdefghij"))] + [(100 + k, f"the common words of all items are these ten here x{k}") for k in range(80)]
    docs = [(1, mirror), (None, word), (2, long), (2, "nothing"), (2, long), (None, None), (3, "the common words of all items are these ten here and then the common words of all items are these ten here")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("words", F.lit("clash"))
    got = decon.contamination(frame, spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(0)), bound)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str) == sorted(brute_rows(docs, items), key=str)


def brute_rows(docs, items):
    return [brute.contamination([d], items)[0] for d in docs]
