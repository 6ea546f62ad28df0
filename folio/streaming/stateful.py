"""Streams with a state of their own for each user: budgets in windows that begin with the first request, the gate of answer
parts, and sessions that end without input.

Each has a batch form.  The gate and the sessions keep their state in RocksDB (see rocksdb()).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MICROS = 1_000_000


def rocksdb(spark: SparkSession) -> None:
    """State with lists and timers needs this store; to be set before such a stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Budget:
    """So many requests and tokens in a window, which begins with the first request after the one before has ended."""

    def __init__(self, requests: int, tokens: int, seconds: float) -> None:
        self.requests, self.tokens, self.span = requests, tokens, int(seconds * MICROS)

    def spend(self, at: np.ndarray, cost: np.ndarray, state: tuple[int, int, int] | None) -> tuple[np.ndarray, np.ndarray, tuple[int, int, int] | None]:
        """Window's begin and whether it is accepted, for each request in the order of time; state: begin, requests, tokens.

        A refused request spends nothing, so a cheaper one after it may fit.
        Windows are found by search, and in each as many steps are taken as
        requests are accepted.
        """
        begin, accepted = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        i = 0
        while i < len(at):
            if state is None or at[i] - state[0] >= self.span:
                state = int(at[i]), 0, 0
            start, n, used = state
            j = int(np.searchsorted(at, start + self.span))
            begin[i:j] = start
            p = i
            while p < j and n < self.requests:
                fits = np.flatnonzero(cost[p:j] <= self.tokens - used)
                if not len(fits):
                    break
                p += int(fits[0])
                accepted[p] = True
                n, used, p = n + 1, used + int(cost[p]), p + 1
            state, i = (start, n, used), j
        return begin, accepted, state


def _times(rows: pd.DataFrame) -> np.ndarray:
    return rows["ts"].astype("datetime64[us]").astype("int64").to_numpy()


_SPENT = "event_id long, user_id long, begin long, accepted boolean"


def _spent(rows: pd.DataFrame, user: int, begin: np.ndarray, accepted: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"event_id": rows["event_id"].to_numpy(), "user_id": user, "begin": begin, "accepted": accepted})


def budgeted(events: DataFrame, requests: int, tokens: int, seconds: float = 60, late: str = "1 hour") -> DataFrame:
    """event_id, user_id, begin (of its window, microseconds), accepted of events (event_id, user_id, ts, cost).

    Batch: a user's events lie side by side in order and come in batches, so a
    user may have any number.  Stream: a micro-batch goes on where the one
    before stopped, and the state goes when the watermark has passed the window.
    """
    budget = Budget(requests, tokens, seconds)
    own = events.select("event_id", "user_id", "ts", F.col("cost").cast("long").alias("cost"))
    if events.isStreaming:
        return own.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(_step(budget), _SPENT, "begin long, n long, used long", "append", GroupStateTimeout.EventTimeTimeout)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, state = None, None
        for rows in batches:
            for key, part in rows.groupby("user_id", sort=False):
                state = state if key == user else None
                user = key
                begin, accepted, state = budget.spend(_times(part), part["cost"].to_numpy(), state)
                yield _spent(part, key, begin, accepted)

    ordered = own.withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")
    return ordered.mapInPandas(fold, _SPENT)


def _step(budget: Budget):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        begin, accepted, held = budget.spend(_times(rows), rows["cost"].to_numpy(), held)
        state.update(held)
        state.setTimeoutTimestamp(max((held[0] + budget.span) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield _spent(rows, key[0], begin, accepted)

    return step


#: Kinds of the gate's rows: a part of an answer, a tool call that proves the parts before it no answer, and an answer's end.
PART, TOOL, FINAL = "part", "tool", "final"


class _Gate(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getListState("parts", "text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        fresh: list[str] = []  # parts of this micro-batch
        for event, kind, text in zip(events["event_id"], events["kind"], events["text"], strict=True):
            if kind == PART:
                fresh.append(text)
                continue
            if kind == FINAL:
                held = [x[0] for x in self.parts.get()] if self.parts.exists() else []
                if held or fresh:
                    out.append((int(event), key[0], "".join([*held, *fresh])))
            self.parts.clear()
            fresh = []
        if fresh:
            self.parts.appendList([(x,) for x in fresh])
        yield pd.DataFrame(out, columns=["event_id", "user_id", "text"])

    def close(self) -> None:
        pass


def gated(events: DataFrame) -> DataFrame:
    """event_id (of the final row), user_id, text: answers whose end has come, from rows (event_id, user_id, ts, kind, text).

    Parts are held until an end puts them out in order; a tool call throws them
    away.  An end without parts says nothing.  As a stream, parts wait in a list
    state over any number of micro-batches.
    """
    own = events.select("event_id", "user_id", "ts", "kind", F.coalesce("text", F.lit("")).alias("text"))
    if events.isStreaming:
        return own.groupBy("user_id").transformWithStateInPandas(_Gate(), "event_id long, user_id long, text string", "append", "none")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    run = F.coalesce(F.sum((F.col("kind") != PART).cast("int")).over(order), F.lit(0))
    runs = own.withColumn("run", run).groupBy("user_id", "run").agg(
        F.max(F.when(F.col("kind") == FINAL, F.col("event_id"))).alias("event_id"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == PART, F.struct("ts", "event_id", "text")))).alias("parts"),
    )
    return runs.where("event_id IS NOT NULL AND size(parts) > 0").select("event_id", "user_id", F.array_join(F.col("parts.text"), "").alias("text"))


class _Session(StatefulProcessor):
    def __init__(self, steps: int, seconds: int) -> None:
        self.steps, self.millis = steps, seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "begin long, steps long")

    def _end(self) -> None:
        begin, _ = self.open.get()
        self.handle.deleteTimer(begin + self.millis)
        self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        for event, at in sorted(zip(*(x for part in [pd.concat(list(rows))] for x in (part["event_id"], part["ts"])), strict=True), key=lambda x: (x[1], x[0])):
            millis = int(at.value // 1_000_000)
            if self.open.exists() and millis - self.open.get()[0] >= self.millis:
                out.append((key[0], None, self.open.get()[1], "time"))
                self._end()
            begin, steps = self.open.get() if self.open.exists() else (millis, 0)
            if not steps:
                self.handle.registerTimer(begin + self.millis)
            self.open.update((begin, steps + 1))
            out.append((key[0], int(event), steps + 1, "steps" if steps + 1 >= self.steps else "goes on"))
            if steps + 1 >= self.steps:
                self._end()
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        if self.open.exists() and self.open.get()[0] + self.millis == expiredTimerInfo.getExpiryTimeInMs():
            out.append((key[0], None, self.open.get()[1], "time"))
            self.open.clear()
        yield self._frame(out)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["user_id", "event_id", "steps", "state"])
        return out.astype({"user_id": "int64", "event_id": "Int64", "steps": "int64"})

    def close(self) -> None:
        pass


def timed_sessions(events: DataFrame, steps: int = 15, seconds: int = 600, late: str = "1 minute") -> DataFrame:
    """Stream: user_id, event_id, steps, state of each event of a user's sessions, and of each end that time makes (no event_id).

    A session ends with its last step ("steps"), or when so many seconds have
    passed since it began ("time"): at the user's next event after that, or when
    the watermark has passed them, without any.  The next event begins another.
    """
    marked = events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return marked.groupBy("user_id").transformWithStateInPandas(_Session(steps, seconds), "user_id long, event_id long, steps long, state string", "append", "eventTime")
