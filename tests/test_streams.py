"""Stream operators on real streams, held against their batch twins or plain Python."""

import pytest
from pyspark.sql import functions as F

from folio.sources.tables import table
from folio.streaming import events as ev
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"


def drained(stream, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return stream.sparkSession.sql(f"SELECT * FROM {name}")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "in")
    rows = table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 300).parquet(path)
    return path


def batch(spark, folder):
    return spark.read.schema(ev.EVENT).parquet(folder)


def test_tumbling_windows_match_the_batch(spark, folder):
    got = drained(ev.tumbling(ev.read_events(spark, folder, 10), "1 hour"), "tumbling", "complete")
    want = ev.tumbling(batch(spark, folder), "1 hour")
    key = lambda df: sorted((str(r.start), r.user_id, r.n) for r in df.collect())
    assert key(got) == key(want)


def test_watermark_closes_windows_in_append_mode(spark, folder):
    got = drained(ev.sliding(ev.read_events(spark, folder)), "sliding")
    want = {(str(r.start), r.event_type): r.n for r in ev.sliding(batch(spark, folder)).collect()}
    rows = got.collect()
    assert rows and all(want[str(r.start), r.event_type] >= r.n for r in rows)


def test_messages_count_once(spark, tmp_path):
    rows = table(spark, SF, "events").where("event_id < 50").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.union(rows).coalesce(1).write.parquet(f"{tmp_path}/in")
    assert drained(ev.once(ev.read_events(spark, f"{tmp_path}/in")), "once").count() == rows.count()


def test_limiter_counts_accepted_events_alone(spark, folder):
    got = {r.event_id: r.accepted for r in drained(ev.limited(ev.read_events(spark, folder, 10), 3, 86_400), "limited").collect()}
    taken, want = {}, {}
    for r in sorted(batch(spark, folder).collect(), key=lambda r: (r.ts, r.event_id)):
        own = [t for t in taken.get(r.user_id, []) if (r.ts - t).total_seconds() < 86_400]
        want[r.event_id] = len(own) < 3
        taken[r.user_id] = own + [r.ts] if want[r.event_id] else own
    assert got == want and not all(want.values())


def test_token_bucket(spark, folder):
    got = {r.event_id: r.accepted for r in drained(ev.bucketed(ev.read_events(spark, folder, 10), 2.0, 1 / 86_400), "bucketed").collect()}
    left, last, want = {}, {}, {}
    for r in sorted(batch(spark, folder).collect(), key=lambda r: (r.ts, r.event_id)):
        u = r.user_id
        have = min(2.0, left.get(u, 2.0) + ((r.ts - last[u]).total_seconds() / 86_400 if u in last else 0))
        want[r.event_id] = have >= 1
        left[u], last[u] = have - (have >= 1), r.ts
    assert got == want and not all(want.values())
