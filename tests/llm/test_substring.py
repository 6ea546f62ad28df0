import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.llm import substring
from folio.llm import textscan as ts
from tests.conftest import DATA
from tests.llm.brute import WORDS

SCHEMA = "doc_id long, text string"


def brute(docs):
    """Rows that repeat a doc_id have the same text here."""
    first, words = {}, {}
    for i, t in docs:
        words[i] = WORDS.findall(t or "")
    for i in sorted(words):
        w = words[i]
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s : s + 20]), (i, s))
    out = []
    for i, _ in docs:
        w, gone = words[i], set()
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] < (i, s):
                gone |= {*range(s, s + 20)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def cases():
    rng = random.Random(9)
    vocab = [f"w{k}é" for k in range(300)]
    pick = lambda n: [rng.choice(vocab) for _ in range(n)]
    base, shared = pick(150), pick(25)
    docs = [None, "", " ", " ".join(pick(19)), " ".join(pick(20)), "a " * 90, "a b " * 60, " ".join(base * 2), "x" * 9000]
    docs += [" ".join(base), "\t".join(base), " ".join(base).upper(), " ".join(base[:19]), " ".join(base[5:25]), " ".join(base[7:27] + ["z"] + base[7:27])]
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        lo = rng.randrange(len(w) - 10)
        docs.append(" ".join(pick(rng.randrange(30)) + w[lo : lo + rng.randrange(10, 80)] + pick(rng.randrange(30))))
    docs += [" ".join(pick(rng.randrange(40)) + shared + pick(rng.randrange(40))) for _ in range(60)]
    return [(k * 37 % 1009, t) for k, t in enumerate(docs)]


def rows(df):
    return sorted(tuple(r) for r in substring.digest(df).collect())


@pytest.mark.parametrize("hot", [3, substring.HOT])
@pytest.mark.parametrize("parts", [1, 6])
def test_matches_brute_force(spark, hot, parts):
    docs = cases()
    df = spark.createDataFrame(docs, SCHEMA).withColumn("spans", F.lit("clash")).withColumn("shard", F.lit(1)).repartition(parts)
    assert rows(substring.without_repeats(df, hot)) == brute(docs)


@pytest.mark.parametrize("hot", [3, substring.HOT])
def test_groups_and_shards_of_any_size(spark, hot):
    docs = cases()
    got = substring.without_repeats(spark.createDataFrame(docs, SCHEMA).repartition(3), hot, group_bytes=2000, shard_words=50)
    assert rows(got) == brute(docs)


def test_frequent_windows_of_a_task_are_sent_once(spark, monkeypatch):
    monkeypatch.setattr(substring, "SLICE_BYTES", 200)
    docs = cases()
    assert rows(substring.without_repeats(spark.createDataFrame(docs, SCHEMA).coalesce(1), 2)) == brute(docs)


def test_words_that_a_power_sum_cannot_tell_apart(spark):
    word = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    docs = [(1, " ".join([*"cdefghijklmnopqrstu", word, *"vwx"])), (2, " ".join([*"cdefghijklmnopqrstu", word.translate({97: 98, 98: 97}), *"vwx"]))]
    assert rows(substring.without_repeats(spark.createDataFrame(docs, SCHEMA))) == brute(docs)


def test_on_the_small_table(spark):
    df = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text")
    docs = [tuple(r) for r in df.collect()]
    got = rows(substring.without_repeats(df))
    assert got == brute(docs) and sum(r[2] for r in got) > 100


def test_edges(spark):
    assert substring.without_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
    text = " ".join(f"k{i}" for i in range(30))
    got = substring.without_repeats(spark.createDataFrame([(None, text), (4, text), (4, text), (2, None)], SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == [(0, 30, 30), (2, 0, 0), (4, 30, 0), (4, 30, 0)]


def test_automaton_finds_every_repeat():
    rng = random.Random(1)
    for _ in range(60):
        passages = [[rng.randrange(3) for _ in range(rng.randrange(4, 30))] for _ in range(6)]
        seen, want = set(), []
        for p in passages:
            hits = []
            for s in range(len(p) - 3):
                if tuple(p[s : s + 4]) in seen:
                    hits.append(s)
                seen.add(tuple(p[s : s + 4]))
            want.append(hits)
        assert substring.repeats(passages, 4) == want


@pytest.mark.parametrize("key", [None, 7])
def test_texts_that_share_an_id_do_not_depend_on_slices(spark, key):
    shared = " ".join(f"s{k}" for k in range(25))
    docs = [(1, f"{shared} one"), (key, f"{shared} two {' '.join(f'b{k}' for k in range(30))}"), (key, f"{shared} three {' '.join(f'c{k}' for k in range(30))}")]
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1)
    for df in (frame(docs), frame(docs[:1]).union(frame(docs[1:])), frame(docs[:2]).union(frame(docs[2:]))):
        assert sorted((r.n_words, r.n_removed) for r in substring.without_repeats(df).collect()) == [(26, 0), (56, 25), (56, 25)]


def test_ids_of_any_type_with_an_order(spark):
    docs = [(f"id {i:05d}", t) for i, t in cases()]
    assert rows(substring.without_repeats(spark.createDataFrame(docs, "doc_id string, text string"), 3)) == brute(docs)


def test_a_gram_that_every_stretch_holds_once_is_counted(monkeypatch):
    monkeypatch.setattr(substring, "COUNTED", 60)
    monkeypatch.setattr(substring, "COUNTERS", 90)
    texts = [" ".join(f"u{k}_{j}" for j in range(60)) + " so it goes" for k in range(50)]
    batches = [pa.record_batch([pa.array([t])], ["text"]) for t in texts]
    found = {}
    for b in substring._counted(iter(batches)):
        found |= dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    s = next(ts.slices(pa.array(["so it goes"])))
    gram = int(ts.grams(ts.words(s.data, s.offsets, ts.SPACE_WORDS, False).hash, 3).view("int64")[0])
    total = sum(len(t.split()) - 2 for t in texts)
    assert 50 - total / 90 <= found[gram] <= 50 and found[gram] > 1 and len(found) <= 90
