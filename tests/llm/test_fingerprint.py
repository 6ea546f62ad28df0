import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from folio.llm import fingerprint as fp
from tests.conftest import DATA
from tests.llm import brute

MASK = (1 << 64) - 1


def hashed(words):
    h = 42
    for w in words:
        h = xxhash.xxh64(w.encode(), seed=h).intdigest()
    return h


def codes(text):
    """Bin by bin: least hash, probing, low byte."""
    words = brute.WORDS.findall((text or "").translate(brute.FOLD))
    if not words:
        return []
    hashes = [hashed(words[i : i + 5]) for i in range(max(1, len(words) - 4))]
    least = {}
    for h in hashes:
        h = h & ~3 & MASK | 1
        b = ((h >> 56) + 128) % 256  # bins are in the order of signed numbers
        least[b] = min(least.get(b, MASK), h)
    out = []
    for b in range(256):
        start, step = fp._ORDERS[b]
        at = b if b in least else next(c for t in range(256) if (c := (start + step * t) % 256) in least)
        out.append(least[at] >> 2 & 255)
    return out


def like(a, b):
    if not a or not b:
        return float(a == b)
    same = sum(x == y for x, y in zip(a, b, strict=True)) / 256
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


def expected(rows):
    key = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest())
    order = sorted({key(r): (r[0], r[1] or "") for r in rows}.items())
    of = {}
    for k, (own, (i, text)) in enumerate(order):
        following = order[(k + 1) % len(order)][1][1]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + following[:quarter]
        a, b, c = codes(text), codes(edited), codes(following)
        of[own] = (i, len(text), hashlib.sha256(edited.encode()).hexdigest(), bytes(a).hex(), bytes(b).hex(), round(like(a, b), 9), round(like(a, c), 9))
    return sorted((of[key(r)] for r in rows), key=str)


def got(df):
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in df.select(*columns).collect()), key=str)


def tricky():
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["Alpha", "é", "😀x", "beta,", "c" * 40]) + str(rng.randrange(60)) for _ in range(n))
    rows = [(3, say(2000)), (1, say(30)), (2, ""), (4, None), (6, "one"), (5, "a b c d"), (8, "A  b\tC d\x0be"), (9, " \n "), (7, "a b c d e f"), (None, say(9)), (None, None), (3, say(5)), (11, say(200))]
    return rows + [rows[0], rows[2], rows[11]] + [(20 + i, rows[12][1]) for i in range(6)]


def test_equals_brute_force(spark):
    rows = tricky()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fingerprint string, copies int")
    assert got(fp.edited_fingerprints(docs)) == expected(rows)


def test_string_ids_alone_and_none(spark):
    rows = [("b", "x y z"), ("a", "p q"), ("10", "r")]
    assert got(fp.edited_fingerprints(spark.createDataFrame(rows, "doc_id string, text string"))) == expected(rows)
    one = got(fp.edited_fingerprints(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")))
    assert one == expected([(1, "a b c d e f g h")])
    assert got(fp.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_many_equal_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(fp, "COPIES_IN_TASK", 7)
    rows = [(1, "so it goes and goes")] * 50 + [(2, "on")] * 3 + [(3, "and off")] * 8
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(fp.edited_fingerprints(docs)) == expected(rows)


def test_likeness_is_near_the_true_one(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    found = {r.doc_id: r for r in fp.edited_fingerprints(docs).collect()}
    assert len(found) == len(rows)
    ids = sorted(rows)
    off = []
    for k, i in enumerate(ids):
        text, following = rows[i], rows[ids[(k + 1) % len(ids)]]
        n = len(text) // 4
        sets = []
        for t in (text, text[: len(text) - n] + following[:n], following):
            w = brute.WORDS.findall(t.translate(brute.FOLD))
            sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
        for other, near in ((sets[1], found[i].near_edited), (sets[2], found[i].near_next)):
            off.append(near - (len(sets[0] & other) / len(sets[0] | other) if sets[0] | other else 1.0))
    assert abs(sum(off) / len(off)) < 0.005
    assert sum(x * x for x in off) / len(off) < 0.03**2
    assert max(map(abs, off)) < 0.16


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    plan = fp.edited_fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("text", ["", " ", "a", "A", "a b c d e"])
def test_one_text(spark, text):
    code = spark.range(1).select(fp.codes(F.lit(text)).alias("c")).first().c
    assert [x + 128 for x in code] == codes(text)
