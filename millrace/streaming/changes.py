"""Change feed: composite cursor, tombstones, replay by Structured Streaming, login windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from millrace.functions import vocab as V
from millrace.operators.collect import login_step
from millrace.operators.dedupe import running


def page_after(feed: DataFrame, at: Column | None = None, after_id: Column | None = None, limit: int = V.SYNC_PAGE, *, time: str = "updated_at", id_col: str = "id") -> DataFrame:
    """The next page after a cursor: strictly after (time, id), or from a time on when no id
    is given; in cursor order, at most a clamped number of rows."""
    rows = feed
    if at is not None and after_id is not None:
        rows = feed.where((F.col(time) > at) | ((F.col(time) == at) & (F.col(id_col) > after_id)))
    elif at is not None:
        rows = feed.where(F.col(time) >= at)
    return rows.orderBy(time, id_col).limit(min(max(limit, 1), V.SYNC_PAGE))


def latest(feed: DataFrame, key: str, time: str, id_col: str) -> DataFrame:
    """The last change of each key; a partial aggregate, so hot keys don't meet in a task."""
    others = [c for c in feed.columns if c != key]
    best = feed.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(time, id_col)).alias("r"))
    return best.select(key, "r.*")


def apply_changes(table: DataFrame, feed: DataFrame, key: str, time: str, id_col: str, gone: Column) -> DataFrame:
    """Table after a feed: last change of each key, without the keys whose last is a tombstone."""
    last = latest(feed.withColumn("__gone", gone), key, time, id_col)
    kept = table.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where(~F.col("__gone")).select(*table.columns))


def follow(stream: DataFrame, checkpoint: str, fold: Callable[[DataFrame, int], None]):
    """Run a file stream of changes to its end, batch by batch, exactly once by checkpoint."""
    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "15 minutes") -> DataFrame:
    """Streaming counts of failed events by user and tumbling window, closed by watermark."""
    failed = events.where(F.col("event_type") == "error").withWatermark(time, late)
    return failed.groupBy(F.window(time, width), "user_id").agg(F.count(F.lit(1)).alias("failures")).select("user_id", F.col("window.start").alias("window_start"), "failures", (F.col("failures") >= V.LOGIN_FAILURES).alias("locked"))


class LoginStates(StatefulProcessor):
    """Login states of one account: failures and locks, and sessions that end by a timer.

    The state of an account is its failures, window and lock, and its live session. Clearing
    timers drop the failures when window and lock are over, so idle accounts keep no state."""

    def __init__(self, failures: int, minutes: int, hours: int) -> None:
        self.failures, self.span, self.life = failures, timedelta(minutes=minutes), timedelta(hours=hours)

    def init(self, handle) -> None:
        self.handle = handle
        self.tries = handle.getValueState("tries", "failed int, opened timestamp, locked timestamp")
        self.live = handle.getValueState("live", "id bigint, expires_at timestamp")

    def _ended(self, account, at) -> Iterator[pd.DataFrame]:
        """The live session, if it is over at a moment."""
        if self.live.exists():
            own, expires = self.live.get()
            if expires <= at:
                self.live.clear()
                yield self._row(account, own, expires, "expired")

    @staticmethod
    def _row(account, own, at, result) -> pd.DataFrame:
        return pd.DataFrame({"account": [account], "id": [own], "at": [at], "result": [result]})

    def _wake(self, at) -> None:
        self.handle.registerTimer(int(at.timestamp() * 1000) + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts", "id"])
        state = self.tries.get() if self.tries.exists() else (0, None, None)
        for at, own, ok in zip(frame["ts"], frame["id"].tolist(), frame["ok"].tolist(), strict=True):
            at = at.to_pydatetime()
            yield from self._ended(key[0], at)
            state, result = login_step(state, at, ok, self.failures, self.span)
            if result == "session":
                if self.live.exists():
                    yield self._row(key[0], self.live.get()[0], at, "replaced")
                self.live.update((own, at + self.life))
                self._wake(at + self.life)
            elif result == "failed":
                self._wake((state[2] or state[1]) + self.span)
            yield self._row(key[0], own, at, result)
        if state[0]:
            self.tries.update(state)
        else:
            self.tries.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000)
        yield from self._ended(key[0], at)
        if self.tries.exists():
            _, opened, locked = self.tries.get()
            if (locked is None or locked <= at) and opened < at - self.span:
                self.tries.clear()

    def close(self) -> None:
        pass


def follow_logins(attempts: DataFrame, *, failures: int = V.LOGIN_FAILURES, minutes: int = V.LOGIN_WINDOW_MINUTES, hours: int = V.SESSION_HOURS, late: str = "10 minutes") -> DataFrame:
    """Streaming form of the login states: attempts (account, ts, id, ok) with ``result``
    locked, failed or session, and sessions that have expired or been replaced.

    Needs the RocksDB state store, which holds states and timers beyond memory."""
    kind = attempts.schema["account"].dataType.simpleString()
    keyed = attempts.select("account", F.col("ts").cast("timestamp").alias("ts"), F.col("id").cast("bigint").alias("id"), F.coalesce("ok", F.lit(False)).alias("ok")).withWatermark("ts", late).groupBy("account")
    return keyed.transformWithStateInPandas(LoginStates(failures, minutes, hours), f"account {kind}, id bigint, at timestamp, result string", "Append", "EventTime")


def run_queue(queue: DataFrame, *, max_attempts: int = 3) -> DataFrame:
    """Resume a run: what was running is pending again, until its attempts are used up."""
    spent = F.col("attempts") >= max_attempts
    return queue.withColumn("status", F.when((F.col("status") == "running") & spent, "error").when(F.col("status") == "running", "pending").otherwise(F.col("status")))


def claim(queue: DataFrame, n: int) -> DataFrame:
    """The queue with its next ``n`` pending items of each run set to running; a run with most
    of the queue is scanned by many tasks."""
    pending = F.col("status") == "pending"
    counted = running(queue, ["run_id"], ["id"], {"__nth": F.when(pending, 1).otherwise(0)}).withColumn("__take", F.coalesce(pending & (F.col("__nth") <= n), F.lit(False)))
    return counted.withColumn("attempts", F.col("attempts") + F.col("__take").cast("int")).withColumn("status", F.when(F.col("__take"), "running").otherwise(F.col("status"))).drop("__take", "__nth")
