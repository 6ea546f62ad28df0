import math
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from folio.llm import quality
from folio.llm import textscan as ts
from tests.conftest import DATA


def fold(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet")
    rows = {r.doc_id: r for r in quality.quality_scores(docs.withColumn("y", F.lit("clash")), labels).collect()}
    assert len(rows) == docs.count() and all(r.held_out == fold(i) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    held = [(r.quality, rows[r.doc_id].predicted) for r in labels.collect() if fold(r.doc_id)]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > 0.95
    assert sum(b for a, b in held if a == 1) / sum(a for a, _ in held) > 0.97


def test_held_out_labels_are_never_learned(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/sf0.001/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda l: {r.doc_id: round(r.score, 9) for r in quality.quality_scores(docs, l).collect()}
    assert score(labels) == score(flipped)


def test_edges(spark):
    schema = "doc_id long, text string"
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.quality_scores(spark.createDataFrame([(1, None), (None, ""), (2, "x " * 9000)], schema), none).collect()
    assert [(r.score, r.predicted) for r in got] == [(0.5, 1)] * 3
    assert quality.quality_scores(spark.createDataFrame([], schema), none).collect() == []
    rng = random.Random(0)
    docs = [(i, None if i % 50 == 0 else " ".join(rng.choice(["Good", "words", "here."]) if i % 2 else rng.choice(["###", "||", "x"]) for _ in range(20))) for i in range(400)]
    labels = [(i, i % 2) for i, _ in docs] + [(7, 5), (9, None), (99_999, 1)]
    rows = quality.quality_scores(spark.createDataFrame(docs, schema), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    right = [r.predicted == r.doc_id % 2 for r in rows if r.held_out and r.doc_id % 50]
    assert len(right) > 40 and all(right)


def test_density_by_definition():
    rng = np.random.default_rng(3)
    d = len(quality.FEATURES)
    x = [rng.normal(k, 1 + k, (300, d)) for k in (0, 1)]
    moments = np.stack([np.concatenate([[len(o)], o.sum(axis=0), (o.T @ o).ravel()]) for o in x])
    model = quality.fit(moments)
    common = sum(np.cov(o.T, bias=True) * len(o) for o in x) / 600
    log = []
    point = rng.normal(0.5, 1, (5, d))
    for o in x:
        cov = (1 - quality.POOLED - quality.UNIT) * np.cov(o.T, bias=True) + quality.POOLED * common
        cov += (quality.UNIT * np.trace(cov) / d + 1e-6) * np.eye(d)
        gap = point - o.mean(axis=0)
        log.append(-0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.score(point), 1 / (1 + np.exp(log[0] - log[1])))


def test_features_count_what_they_say():
    s = next(ts.slices(pa.array(["Aa bb bb 12 !!", "", "É"])))
    x = quality.features(s.data, s.offsets)
    at = quality.FEATURES.index
    assert np.isclose(x[0, at("words")], np.log1p(5)) and x[1, at("words")] == 0
    assert np.isclose(x[0, at("echo")], np.log(1.5 / 4.5 + 1e-3)) and np.isclose(x[0, at("bare")], np.log(1.5 / 4.5 + 1e-3))
    assert x[2, at("upper")] > 0 > x[0, at("upper")]


def plain_features(text):
    """The statistics of a text, counted word by word."""
    letter = lambda c: c.isascii() and c.isalpha() or ord(c) > 127
    sign = lambda c: c.isascii() and not c.isalnum() and c not in " \t\n\x0b\x0c\r"
    words = [w.decode() for w in text.encode().split()]
    letters, digits, signs = sum(map(letter, text)), sum(c.isascii() and c.isdigit() for c in text), sum(map(sign, text))
    upper = sum("A" <= c <= "Z" or "\xc0" <= c <= "\xde" for c in text)
    full = letters + digits + signs
    odds = lambda part, whole: math.log((part + 0.5) / (max(whole - part, 0) + 0.5) + 1e-3)
    n = len(words)
    return [
        math.log1p(n),
        odds(upper, letters),
        odds(signs, full),
        odds(digits, full),
        math.log((full + 1) / (n + 1)),
        odds(sum(a == b for a, b in zip(words, words[1:])), n),
        math.log1p(len({*words})) - 0.85 * math.log1p(n),
        odds(sum(not any(letter(c) or c.isdigit() for c in w) for w in words), n),
        odds(sum(sign(w[-1]) for w in words), n),
        math.log((n + 1) / (text.count("\n") + 1)),
        odds(sum(w[-1] in ".!?" for w in words), n),
    ]


def test_scores_of_a_whole_table_match_brute_force(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()]
    docs = [(i, t.encode("latin-1", "ignore").decode("latin-1")) for i, t in docs] + [(10_000, "")]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/sf0.001/labels.parquet").collect()}
    x = np.array([plain_features(t) for _, t in docs])
    y = np.array([-1 if fold(i) else labels.get(i, -1) for i, _ in docs])
    common = sum(np.cov(x[y == k].T, bias=True) * (y == k).sum() for k in (0, 1)) / (y >= 0).sum()
    log = []
    for k in (0, 1):
        cov = (1 - quality.POOLED - quality.UNIT) * np.cov(x[y == k].T, bias=True) + quality.POOLED * common
        cov += (quality.UNIT * np.trace(cov) / x.shape[1] + 1e-6) * np.eye(x.shape[1])
        gap = x - x[y == k].mean(axis=0)
        log.append(-0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap) - 0.5 * np.linalg.slogdet(cov)[1] + np.log((y == k).sum()))
    want = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.quality_scores(frame, spark.read.parquet(f"{DATA}/sf0.001/labels.parquet")).collect()}
    assert np.allclose([got[i] for i, _ in docs], want, atol=1e-6)
