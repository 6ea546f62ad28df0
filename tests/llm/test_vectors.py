import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import vectors
from tests.conftest import DATA

SCHEMA = "vec_id long, embedding array<float>, label int, vec string, n long"


def brute(rows, parts=4, entries=256, rounds=4):
    """Plain integers, one vector at a time."""
    kept = [(i, label, [math.floor(1024 * float(np.float32(x))) for x in e]) for i, e, label in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    if not kept:
        return []
    width = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    book = [[cut(v, p) for _, _, v in first] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((gap(cut(v, p), e), k) for k, e in enumerate(book[p]))
    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for _, _, v in kept:
                of.setdefault(near(v, p)[1], []).append(cut(v, p))
            for k, members in of.items():
                book[p][k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for p in book for e in p for x in e).encode()).hexdigest()
    out, by = [], {}
    for i, label, v in kept:
        found = [near(v, p) for p in range(parts)]
        out.append([i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label])
        by[label] = by.get(label, 0) + out[-1][2]
    return sorted(((i, c, e, by[label], digest) for i, c, e, label in out), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, e, label, "x", 1) for i, e, label in rows], SCHEMA)


def test_equals_plain_integers(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, -0.25, rng.gauss(0, 0.1), -0.0004]) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(400)]
    rows += [(7, rows[7][1], 1), (7, [0.5] * 8, None), (None, [0.1] * 8, 1), (901, None, 1), (902, [None] * 8, 1), (903, [math.nan] * 8, 2), (904, [math.inf] + [0.0] * 7, 2), (905, [0.0] * 7 + [-math.inf], 2)]
    rows += [(2000 + i, [0.125] * 8, 9) for i in range(300)]
    rng.shuffle(rows)
    assert got(vectors.vector_codes(frame(spark, rows))) == brute(rows)


def test_few_and_none(spark):
    rows = [(5, [0.1, -0.2, 0.3, 0.4], None), (2, [0.1, -0.2, 0.3, 0.4], None), (9, [1.0, 0.0, -1.0, -1e-9], 4)]
    assert got(vectors.vector_codes(frame(spark, rows))) == brute(rows)
    assert got(vectors.vector_codes(frame(spark, [(1, None, 1), (2, [math.nan] * 4, 1)]))) == []
    assert got(vectors.vector_codes(frame(spark, []))) == []
    assert [r[1] for r in got(vectors.vector_codes(frame(spark, [(1, [], 1)])))] == ["00000000"]


@pytest.mark.parametrize("rows", [[(1, [0.1] * 8, 1), (2, [0.1] * 4, 1)], [(1, [0.1] * 6, 1)], [(1, [1e30] * 4, 1)]])
def test_what_has_no_code_is_an_error(spark, rows):
    with pytest.raises(ValueError):
        vectors.vector_codes(frame(spark, rows))


def test_screening_keeps_every_nearest_entry():
    rng = np.random.default_rng(1)
    for scale in (3, 1000, vectors.LARGEST):
        x = rng.integers(-scale, scale + 1, (500, 16))
        entries = np.concatenate([rng.integers(-scale, scale + 1, (200, 16)), x[:28], x[:28] + rng.integers(-1, 2, (28, 16))])
        every = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        index, error = vectors.nearest(x, entries)
        assert (index == every.argmin(axis=1)).all() and (error == every.min(axis=1)).all()
        row, _ = vectors.screened(x, entries)
        assert scale == 3 or len(row) < 3 * len(x)  # most entries are ruled out


def test_whole_table(spark):
    table = spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").where("vec_id < 300")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    found = vectors.vector_codes(table)
    assert got(found) == brute(rows)
    assert found.select(F.countDistinct("codebooks_sha256")).first()[0] == 1
