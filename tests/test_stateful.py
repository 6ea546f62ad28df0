"""Streams with state, on any split into micro-batches, against their batch forms and plain Python."""

import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folio.streaming import stateful as st
from tests.test_streams import drained

SCHEMA = "event_id long, user_id long, ts timestamp, cost long, kind string, text string"


@pytest.fixture(autouse=True)
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    st.rocksdb(spark)
    yield
    spark.conf.unset(key)


def made(spark, seed=1, n=240, users=5):
    rng = random.Random(seed)
    at, rows = 1_700_000_000, []
    for k in range(n):
        at += rng.choice([0, 1, 3, 9, 40])
        rows.append((k, rng.randrange(users), at, rng.choice([1, 2, 5, 30]), rng.choice([st.PART] * 5 + [st.TOOL, st.FINAL]), f"<{k}>"))
    return spark.createDataFrame(rows, "event_id long, user_id long, at long, cost long, kind string, text string").select("event_id", "user_id", F.timestamp_seconds("at").alias("ts"), "cost", "kind", "text")


def stream(spark, rows, folder, sizes):
    """The rows in files of these sizes, one file a micro-batch."""
    lo = 0
    for k, size in enumerate(sizes):
        part = rows.where((F.col("event_id") >= lo) & (F.col("event_id") < lo + size)).coalesce(1)
        part.write.parquet(f"{folder}/x{k}")
        for f in sorted(Path(f"{folder}/x{k}").glob("*.parquet")):
            shutil.move(f, f"{folder}/{k:04d}.parquet")
        lo += size
        shutil.rmtree(f"{folder}/x{k}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


SPLITS = [[240], [1, 119, 3, 117], [60] * 4]


@pytest.mark.parametrize("k", range(3))
def test_budgets_on_any_split(spark, tmp_path, k):
    rows = made(spark)
    got = drained(st.budgeted(stream(spark, rows, tmp_path, SPLITS[k]), 3, 40, 60), f"budget{k}")
    own, want = {}, []
    for r in sorted(rows.collect(), key=lambda r: (r.ts, r.event_id)):
        now = int(r.ts.timestamp()) * 1_000_000
        begin, n, used = own.get(r.user_id, (None, 0, 0))
        if begin is None or now - begin >= 60_000_000:
            begin, n, used = now, 0, 0
        fits = n + 1 <= 3 and used + r.cost <= 40
        own[r.user_id] = (begin, n + fits, used + r.cost * fits)
        want.append((r.event_id, r.user_id, begin, fits))
    key = lambda df: sorted(tuple(r) for r in df.select("event_id", "user_id", "begin", "accepted").collect())
    assert key(got) == sorted(want) == key(st.budgeted(rows, 3, 40, 60))
    assert 0 < sum(x[3] for x in want) < len(want)


@pytest.mark.parametrize("k", range(3))
def test_gate_on_any_split(spark, tmp_path, k):
    rows = made(spark, 2)
    got = drained(st.gated(stream(spark, rows, tmp_path, SPLITS[k])), f"gate{k}")
    held, want = {}, []
    for r in sorted(rows.collect(), key=lambda r: (r.ts, r.event_id)):
        parts = held.setdefault(r.user_id, [])
        if r.kind == st.PART:
            parts.append(r.text)
            continue
        if r.kind == st.FINAL and parts:
            want.append((r.event_id, r.user_id, "".join(parts)))
        parts.clear()
    key = lambda df: sorted(tuple(r) for r in df.select("event_id", "user_id", "text").collect())
    assert key(got) == sorted(want) == key(st.gated(rows)) and want


def test_the_watermark_alone_ends_a_session(spark, tmp_path):
    at = lambda s: 1_700_000_000 + s
    rows = [(0, 1, at(0)), (1, 1, at(10)), (2, 2, at(20)), (3, 2, at(1000)), (4, 3, at(1001)), (5, 3, at(1002)), (6, 3, at(1003)), (7, 3, at(1004)), (8, 4, at(5000)), (9, 4, at(5001))]
    frame = spark.createDataFrame(rows, "event_id long, user_id long, at long").select("event_id", "user_id", F.timestamp_seconds("at").alias("ts"), F.lit(1).cast("long").alias("cost"), F.lit("part").alias("kind"), F.lit("").alias("text"))
    got = drained(st.timed_sessions(stream(spark, frame, tmp_path, [3, 5, 1, 1]), steps=3, seconds=600), "timed")
    found = sorted(((r.user_id, r.event_id if r.event_id is not None else -1, r.steps, r.state) for r in got.collect()))
    want = [(1, 0, 1, "goes on"), (1, 1, 2, "goes on"), (1, -1, 2, "time")]  # nothing more comes of user 1
    want += [(2, 2, 1, "goes on"), (2, -1, 1, "time"), (2, 3, 1, "goes on"), (2, -1, 1, "time")]
    want += [(3, 4, 1, "goes on"), (3, 5, 2, "goes on"), (3, 6, 3, "steps"), (3, 7, 1, "goes on"), (3, -1, 1, "time")]
    want += [(4, 8, 1, "goes on"), (4, 9, 2, "goes on")]
    assert found == sorted(want)
