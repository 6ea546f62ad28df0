"""Event streams: windows, watermarks, idempotency, rate limits and token buckets as Structured Streaming operators.

Every operator takes any DataFrame, streaming or not, unless it says otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """A stream over a folder of Parquet files that grows."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files).parquet(folder)


def tumbling(events: DataFrame, size: str = "60 seconds", late: str = "1 hour") -> DataFrame:
    """Requests and their sum of values for each user and window; later ones than the watermark are left out."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    g = marked.groupBy(F.window("ts", size), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("tokens"))
    return g.select(F.col("window.start").alias("start"), "user_id", "n", "tokens")


def sliding(events: DataFrame, size: str = "1 hour", step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    g = marked.groupBy(F.window("ts", size, step), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    g = marked.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each message once, however often it is delivered within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def attempts(events: DataFrame, seconds: int = 3600) -> DataFrame:
    """Batch: how many of a user's events lie in the window that ends with each; its far edge does not count."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(micros).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("in_window", F.count(F.lit(1)).over(w))


class SlidingLimit(NamedTuple):
    """A sliding window's limit: at most `most` accepted events in `seconds`, whose far edge does not count."""

    most: int
    seconds: float

    def verdict(self, taken: list[int], at: int) -> tuple[list[int], int, bool]:
        """Times accepted so far, how many of them the window before `at` holds, and whether one more is accepted."""
        taken = [t for t in taken if t > at - self.seconds * 1_000_000]
        held, accepted = len(taken), len(taken) < self.most
        return ([*taken, at] if accepted else taken), held, accepted


class Bucket(NamedTuple):
    """A token bucket: an event takes one token, `refill` tokens come back each second, up to `capacity`."""

    capacity: float
    refill: float

    def verdict(self, left: float, last: int | None, at: int) -> tuple[float, bool]:
        left = min(self.capacity, left + (0 if last is None else max(0, at - last) / 1e6 * self.refill))
        return (left - 1, True) if left >= 1 else (left, False)


def _micros(rows: pd.DataFrame) -> list[int]:
    return rows["ts"].astype("datetime64[us]").astype("int64").tolist()


def _in_order(events: DataFrame) -> DataFrame:
    """A user's events side by side and in order: folds over them hold the state of one user, however many events there are."""
    return events.select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts")).repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")


def accepted(events: DataFrame, most: int = 100, seconds: int = 3600) -> DataFrame:
    """Batch: event_id, user_id, in_window (accepted events in the window before), accepted.  Refused events do not count."""
    limit = SlidingLimit(most, seconds)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, taken = None, []
        for rows in batches:
            held, verdicts = [], []
            for own, at in zip(rows["user_id"].tolist(), _micros(rows), strict=True):
                if own != user:
                    user, taken = own, []
                taken, n, ok = limit.verdict(taken, at)
                held.append(n)
                verdicts.append(ok)
            yield pd.DataFrame({"event_id": rows["event_id"], "user_id": rows["user_id"], "in_window": held, "accepted": verdicts})

    return _in_order(events).mapInPandas(fold, "event_id long, user_id long, in_window long, accepted boolean")


def taken_tokens(events: DataFrame, capacity: float = 10.0, refill: float = 1.0) -> DataFrame:
    """Batch: event_id, user_id, accepted, by a token bucket for each user."""
    bucket = Bucket(capacity, refill)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, left, last = None, capacity, None
        for rows in batches:
            verdicts = []
            for own, at in zip(rows["user_id"].tolist(), _micros(rows), strict=True):
                if own != user:
                    user, left, last = own, capacity, None
                left, ok = bucket.verdict(left, last, at)
                last = at
                verdicts.append(ok)
            yield pd.DataFrame({"event_id": rows["event_id"], "user_id": rows["user_id"], "accepted": verdicts})

    return _in_order(events).mapInPandas(fold, "event_id long, user_id long, accepted boolean")


def _by_user(events: DataFrame, step, schema: str, state: str, late: str) -> DataFrame:
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return marked.groupBy("user_id").applyInPandasWithState(step, schema, state, "append", GroupStateTimeout.EventTimeTimeout)


def _keep(state: GroupState, value: tuple, last: int, seconds: float) -> None:
    """State goes once the watermark has passed the time after which it says nothing."""
    state.update(value)
    state.setTimeoutTimestamp(max(int(last / 1000 + seconds * 1000) + 1, state.getCurrentWatermarkMs() + 1))


def limited(events: DataFrame, most: int = 100, seconds: int = 3600, late: str = "1 hour") -> DataFrame:
    """Stream: accepted or refused, by the number of accepted events in the window before each; refused ones do not count.

    A user's state is dropped when the watermark has passed the window after the last event.
    """
    limit = SlidingLimit(most, seconds)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        taken = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        verdicts = []
        for at in _micros(rows):
            taken, _, ok = limit.verdict(taken, at)
            verdicts.append(ok)
        _keep(state, (taken,), at, seconds)
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "accepted": verdicts})

    return _by_user(events, step, "event_id long, user_id long, accepted boolean", "taken array<long>", late)


def bucketed(events: DataFrame, capacity: float = 10.0, refill: float = 1.0, late: str = "1 hour") -> DataFrame:
    """Stream: a token bucket for each user.  State is dropped when the bucket is sure to be full again."""
    bucket = Bucket(capacity, refill)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        left, last = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        verdicts = []
        for at in _micros(rows):
            left, ok = bucket.verdict(left, last, at)
            last = at
            verdicts.append(ok)
        _keep(state, (float(left), int(last)), last, capacity / refill)
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "accepted": verdicts})

    return _by_user(events, step, "event_id long, user_id long, accepted boolean", "left double, last long", late)


def bounded(events: DataFrame, iterations: int = 15, seconds: int = 600) -> DataFrame:
    """Batch: for each event, its number in its user's session, the seconds since the session began, and whether the session may go on."""
    w = Window.partitionBy("user_id", "session").orderBy("ts", "event_id")
    gone = (F.unix_micros(F.col("ts").cast("timestamp")) - F.min(F.unix_micros(F.col("ts").cast("timestamp"))).over(w)) / 1_000_000
    marked = events.withColumn("step", F.row_number().over(w)).withColumn("elapsed", gone)
    return marked.withColumn("goes_on", (F.col("step") < iterations) & (F.col("elapsed") < seconds))


def progress(events: DataFrame) -> DataFrame:
    """Batch: events whose value is above all that came before for their user."""
    before = F.max("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("value") > F.col("_before"))).drop("_before")


def gauge(events: DataFrame, opened: str = "signup", closed: str = "error") -> DataFrame:
    """Batch: sessions open after each event, never under zero.

    A running sum S with a floor is S minus the smallest value that S or 0 has had.
    """
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    change = F.when(F.col("event_type") == opened, 1).when(F.col("event_type") == closed, -1).otherwise(0)
    summed = events.withColumn("_sum", F.sum(change).over(w))
    return summed.withColumn("open", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(w))).drop("_sum")


def final_text(deltas: DataFrame) -> DataFrame:
    """Batch: what a session's buffered parts add up to; parts before its last tool call (an error here) are thrown away."""
    w = Window.partitionBy("user_id")
    last = F.coalesce(F.max(F.when(F.col("event_type") == "error", F.struct("ts", "event_id"))).over(w), F.struct(F.lit("1970-01-01").cast("timestamp").alias("ts"), F.lit(-1).cast("long").alias("event_id")))
    kept = deltas.withColumn("_cut", last).where(F.struct("ts", "event_id") > F.col("_cut"))
    g = kept.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("x"))
    return g.select("user_id", F.array_join(F.col("x.event_type"), " ").alias("text"))


def typed(events: DataFrame) -> DataFrame:
    """event_id, kind, and the fields of its kind: an interaction's target, a failure's code; streaming or not."""
    kind = F.when(F.col("event_type").isin("click", "view"), "interaction").when(F.col("event_type") == "error", "failure").otherwise("other")
    rows = events.select("event_id", kind.alias("kind"), F.from_json("props", "k bigint")["k"].alias("k"), "value")
    return rows.select("event_id", "kind", F.when(F.col("kind") == "interaction", F.col("k")).alias("target"), F.when(F.col("kind") == "failure", F.round("value", 2)).alias("code"))
