import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.llm import common, exact, near
from folio.llm import textscan as ts
from folio.llm.graph import components
from tests.conftest import DATA
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def rows(df, columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def tricky():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    out = [None, "", " ", "\t\n", "a", "A", "a b c d", "a  b c\td", "A b c d e", "x" * 50_000, " a", "é ß ñ 😀 ü", "É ß ñ 😀 ü", "é ß ñ 😀 ü"]
    out += [" ".join(base)] * 3 + ["  ".join(base).upper()]
    for k in range(24):  # a chain of small edits and some far ones
        w = list(base)
        for _ in range(k):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    out += [" ".join(rng.choice(words) for _ in range(n)) for n in (4, 5, 6, 19, 20, 21, 3000)]
    return [(i * 7 % 1009, t) for i, t in enumerate(out)]


def test_words_match_the_pattern():
    texts = ["", "ab  CD\te", "x", "", "é\x0bü 😀", " lead", "trail "]
    s = next(ts.slices(pa.array(texts)))
    w = ts.words(s.data, s.offsets, ts.SPACE_WORDS, True)
    got = [[bytes(s.data[a:b]).decode() for a, b in zip(w.start[lo:hi], w.end[lo:hi])] for lo, hi in zip(w.first[:-1], w.first[1:])]
    assert got == [brute.WORDS.findall(t) for t in texts]
    assert len({*w.hash.tolist()}) == len({x.translate(brute.FOLD) for t in texts for x in brute.WORDS.findall(t)})


def mirrored(n):
    """Two words of n letters that differ in each: sums of powers of any odd base over them are equal."""
    word = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return word, word.translate({97: 98, 98: 97})


def test_hashes_are_not_fooled_by_patterns(spark):
    for n in (2, 8, 16, 1024, 4096):
        s = next(ts.slices(pa.array([" ".join(mirrored(n))])))
        for seed in (0, 1):
            w = ts.words(s.data, s.offsets, ts.SPACE_WORDS, True, seed)
            assert w.hash[0] != w.hash[1]
    x, y = mirrored(1024)
    many = [" ".join({"a": "on", "b": "off"}[c] for c in z) for z in mirrored(16)]
    data = [(1, x), (2, y), (3, f"{x} q r s"), (4, f"{y} q r s"), (5, many[0]), (6, many[1])]
    got = near.near_groups(spark.createDataFrame(data, SCHEMA))
    assert rows(got, ["doc_id", "n_shingles", "component_id", "kept"]) == brute.near(data)


def test_slices_cover_every_row():
    column = pa.array(["a" * n for n in (0, 5, 3_000_000, 1, 0)] + [None])
    got = [(s.lo, s.hi, len(s.data)) for s in ts.slices(column)]
    assert [g[0] for g in got] == [0] + [g[1] for g in got[:-1]] and got[-1][1] == 6
    assert sum(g[2] for g in got) == 3_000_006
    assert list(ts.slices(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("weak", [False, True])
def test_exact_matches_brute_force(spark, weak):
    data = tricky()
    df = spark.createDataFrame(data, SCHEMA).withColumn("key", F.lit(1)).withColumn("keep_id", F.lit("clash"))
    extra = {"key": lambda x: F.length(x).cast("long") % 3} if weak else {}
    got = exact.exact_groups(df, capacity=3, **extra)
    assert rows(got, ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]) == brute.exact(data)


def test_exact_edges(spark):
    assert exact.exact_groups(spark.createDataFrame([], SCHEMA)).collect() == []
    got = exact.exact_groups(spark.createDataFrame([(None, "a"), (3, "a"), (3, "a"), (None, "b")], SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == [(0, 0, 1, True), (0, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True)]


def test_exact_judges_each_row_by_its_own_text(spark):
    data = [(1, "a b"), (5, "a b"), (5, "zzz"), (9, "zzz"), (9, "zzz"), (None, None), (None, "")]
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(spark.createDataFrame(data, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, 2, True), (5, 1, 2, False), (5, 5, 3, True), (9, 5, 3, False), (9, 5, 3, False), (None, None, 2, True), (None, None, 2, True)], key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_a_large_group_is_salted(spark, monkeypatch, weak):
    monkeypatch.setattr(exact, "ROWS_PER_SALT", 5)
    data = tricky() + [(2000 + i, "same text") for i in range(300)] + [(5000 + i, "other  text") for i in range(70)]
    extra = {"key": lambda x: F.length(x).cast("long") % 3} if weak else {}
    got = exact.exact_groups(spark.createDataFrame(data, SCHEMA).repartition(7), capacity=8, **extra)
    assert rows(got, ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]) == brute.exact(data)


def test_groups_come_from_the_index(spark, monkeypatch):
    """A directory with two buckets for each cell gives every group twice."""
    docs = spark.createDataFrame([(i, "one text") for i in range(40)], SCHEMA)
    assert {r.group_size for r in exact.exact_groups(docs).collect()} == {40}
    real = exact.directory
    twice = lambda cells, *a: (d := real(cells, *a)).union(d.withColumn("bucket", F.col("bucket") + 1))
    monkeypatch.setattr(exact, "directory", twice)
    got = exact.exact_groups(docs).collect()
    assert len(got) == 80 and {r.group_size for r in got} == {40}


def test_directory_doubles_where_a_bucket_is_overfull(spark):
    cells = spark.createDataFrame([(0, 9), (1, 1), (7, 2)], "cell long, entries long")
    got = sorted(tuple(r) for r in exact.directory(cells, 3, 4).collect())
    assert got == [(0, 0, 3), (1, 1, 3), (7, 4, 1)]
    assert sorted(tuple(r) for r in exact.directory(cells, 3, 4, 2).collect()) == [(0, 0, 3), (1, 1, 3), (7, 6, 2)]
    assert sorted(tuple(r) for r in exact.directory(cells, 3, 99).collect()) == [(0, 0, 0), (1, 0, 0), (7, 0, 0)]
    assert exact.directory(cells.where("false"), 4, 5).collect() == []


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 1500).astype(np.uint64)
    x, y = np.sort(pool[:1000]), np.sort(pool[200:1200])  # 800 of 1200
    sig = near.superminhash(np.concatenate([x, y]), np.array([0, 1000, 2000]))
    assert abs((sig[0] == sig[1]).mean() - 2 / 3) < 0.15
    alone = near.superminhash(x, np.array([0, 1000]))
    assert (alone[0] == sig[0]).all()
    tiny = near.superminhash(x[:2], np.array([0, 2, 2]))
    assert np.isfinite(tiny[0]).all() and np.isinf(tiny[1]).all()


def test_near_matches_brute_force(spark):
    data = tricky()
    got = near.near_groups(spark.createDataFrame(data, SCHEMA).withColumn("rep", F.lit("clash")))
    assert rows(got, ["doc_id", "n_shingles", "component_id", "kept"]) == brute.near(data)


def test_near_on_the_small_table(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text")
    data = [tuple(r) for r in docs.collect()]
    assert rows(near.near_groups(docs), ["doc_id", "n_shingles", "component_id", "kept"]) == brute.near(data)


def test_near_edges(spark):
    assert near.near_groups(spark.createDataFrame([], SCHEMA)).collect() == []
    got = near.near_groups(spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]


def test_near_rows_that_repeat_an_id(spark):
    x, y = " ".join(f"x{k}" for k in range(30)), " ".join(f"y{k}" for k in range(40))
    got = near.near_groups(spark.createDataFrame([(1, x), (7, x), (7, y), (9, y), (7, None), (7, "")], SCHEMA)).collect()
    by_id = {i: {r.component_id for r in got if r.doc_id == i} for i in (1, 7, 9)}
    assert sorted(r.n_shingles for r in got if r.doc_id == 7) == [0, 0, 26, 36]
    assert len(by_id[7]) == 1 and by_id[1] == {1} and by_id[9] in ({9}, {7}) and by_id[7] in ({1}, {7})


def test_near_hubs_and_copies_of_any_number(spark, monkeypatch):
    """Blocks of members, broadcast hot keys and the rarest shingles' join, all with bounds of a few rows."""
    monkeypatch.setattr(near, "HUB_MEMBERS", 3)
    monkeypatch.setattr(near, "BLOCK", 4)
    monkeypatch.setattr(near.attach, "__defaults__", (4,))
    data = tricky() + [(3000 + k, "a b c d e f g h i j") for k in range(40)]
    got = near.near_groups(spark.createDataFrame(data, SCHEMA).repartition(5))
    assert rows(got, ["doc_id", "n_shingles", "component_id", "kept"]) == brute.near(data)


@pytest.mark.parametrize("one_task", [0, 10_000])
def test_components(spark, one_task):
    pairs = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21)] + [(100 + i, 101 + i) for i in range(60)]
    got = components(spark.createDataFrame(pairs, "x long, y long").repartition(5), "x", "y", one_task)
    want = {n: 1 for n in (1, 2, 3, 7, 8, 9)} | {20: 20, 21: 20} | {100 + i: 100 for i in range(61)}
    assert {r.node: r.component for r in got.collect()} == want


def test_ids_of_any_type_with_an_order(spark):
    docs = [(i, t) for i, t in tricky() if i % 3]
    name = lambda i: f"id {i:05d}"
    got = near.near_groups(spark.createDataFrame([(name(i), t, 1) for i, t in docs], "doc_id string, text string, number int"))
    want = [(name(i), n, name(c), k) for i, n, c, k in brute.near(docs)]
    assert rows(got, ["doc_id", "n_shingles", "component_id", "kept"]) == sorted(want)


def test_a_very_long_text_is_hashed_in_stretches(monkeypatch):
    rng = random.Random(6)
    text = "  ".join(rng.choice(["Alpha", "é", "b" * 30]) + str(rng.randrange(500)) for _ in range(20_000)) + "\n" + "x" * 5000
    data = np.frombuffer(text.encode(), np.uint8)
    offsets = np.array([0, len(data)])
    want = near.shingle_sets(data, offsets)
    signature = near.superminhash(want[0], want[1])
    monkeypatch.setattr(near, "STRETCH", 1000)
    monkeypatch.setattr(near, "RANKED", 777)
    got = near.shingle_sets(data, offsets)
    assert all((x == y).all() for x, y in zip(got, want))
    assert (near.superminhash(got[0], got[1]) == signature).all()
    pair = next(ts.slices(pa.array([text[:9000], "", "a b", text[9000:30_000]])))
    h, first, _ = near.shingle_sets(pair.data, pair.offsets)
    own = [near.superminhash(h[a:b], np.array([0, b - a]))[0] for a, b in zip(first[:-1], first[1:])]
    assert (near.superminhash(h, first) == np.stack(own)).all()


def test_partitions_are_bounded(spark):
    docs = spark.range(1)
    assert common.partitions(docs, 100 << 40, 16 << 20) == common.MOST_PARTITIONS
    assert common.partitions(docs, 100, 16 << 20) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_very_long_equal_texts_of_a_salted_key(spark):
    long = "lorem ipsum " * 100_000
    docs = [(i, long + " " * (i % 3)) for i in range(40)] + [(100 + i, "x") for i in range(700)] + [(900, long + "y")]
    got = exact.exact_groups(spark.createDataFrame(docs, SCHEMA), key=lambda body: F.lit(5).cast("long"))
    assert rows(got, ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]) == brute.exact(docs)
