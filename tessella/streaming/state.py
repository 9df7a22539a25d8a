"""Streaming forms of the per-key folds: limiter, lockout and jobs, with state that expires.

Times are event times.  Keys are held in buckets, dealt by a hash.  A timer
drops a key's state once the watermark has passed the last moment at which it
could matter, so what is held follows the keys that are alive; an initial
state carries on where a batch or another stream ended.  Within a batch the
events of a key are taken in order.  Rows
that come later than the watermark allows, which starts at 0, are left out by
the engine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """The state store that timers need, for the queries that start within; those that start anew have so many partitions of it, without a number as many as the session shuffles to."""
    wanted = {STORE: ROCKS} | ({PARTITIONS: str(partitions)} if partitions else {})
    old = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in old.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _after(moment: float) -> int:
    """The first millisecond after a moment in seconds."""
    return math.floor(moment * 1000) + 1


class _Expiring(StatefulProcessor):
    """A bucket of keys: one row for each key that is held, whose last column is when it ends, and one timer, for the first of them to end.

    A call of Spark's into Python costs milliseconds and each access to the
    state a message, so both are made once a bucket and not once a key.
    """

    schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("held", self.schema)

    def held(self) -> dict[str, tuple]:
        """The columns after the key of each key that is held."""
        return {row[0]: tuple(row[1:]) for row in self.rows.get()}

    def keep(self, held: dict[str, tuple], fired: int | None = None) -> None:
        """Holds these keys in place of what was held, each until the watermark has passed its end (seconds); a timer that fired goes by itself."""
        for timer in list(self.handle.listTimers()):
            if timer != fired:
                self.handle.deleteTimer(timer)
        if held:
            self.rows.put([(key, *value) for key, value in held.items()])
            self.handle.registerTimer(min(_after(value[-1]) for value in held.values()))
        else:
            self.rows.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        held, fired = self.held(), expiredTimerInfo.getExpiryTimeInMs()
        now = max(fired, timerValues.getCurrentWatermarkInMs() - 1)
        gone = [k for k, value in held.items() if _after(value[-1]) <= now]
        for k in gone:
            del held[k]
        self.keep(held, fired)
        return self.ended(gone)

    def ended(self, keys: list[str]) -> Iterator[pd.DataFrame]:
        """What is told of keys that are dropped."""
        return iter(())

    def close(self) -> None:
        pass


def _in_order(rows: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple]:
    """The rows of a bucket, of whatever key, in order."""
    ordered = pd.concat(list(rows)).sort_values(["t", "item"], kind="stable")
    return zip(*[ordered[c].tolist() for c in columns])


class _Limiter(_Expiring):
    schema = "key string, open array<double>, ends double"

    def __init__(self, limit: int, window: float) -> None:
        self.limit, self.window = limit, window

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N803
        held = self.held()
        for name, t in initialState[["key", "t"]].sort_values("t").itertuples(index=False):
            times = sorted([*held.get(name, ((),))[0], float(t)])
            held[name] = (times, times[-1] + self.window)
        self.keep(held)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        held, out = self.held(), []
        for name, t, item in _in_order(rows, "key", "t", "item"):
            times = [x for x in held[name][0] if x >= t - self.window] if name in held else []
            allowed = len(times) < self.limit
            wait = 0 if allowed else max(1, int(self.window - (t - times[0])) + 1)
            times += [t] * allowed
            held[name] = (times, times[-1] + self.window)
            out.append((name, item, allowed, self.limit - len(times), wait))
        self.keep(held)
        yield pd.DataFrame(out, columns=["key", "item", "allowed", "remaining", "retry_after"])


class _Lockout(_Expiring):
    schema = "key string, open array<double>, until double, ends double"

    def __init__(self, most: int, window: float, lockout: float) -> None:
        self.most, self.window, self.lockout = most, window, lockout

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        held, out = self.held(), []
        for name, t, item, failed in _in_order(rows, "key", "t", "item", "failed"):
            failures, until, _ = held.get(name, ([], -math.inf, -math.inf))
            locked = until > t
            sets = False
            if not locked:
                failures = [*[x for x in failures if x >= t - self.window], t] if failed else []
                sets = len(failures) >= self.most if failed else False
            if sets:
                failures, until = [], t + self.lockout
            out.append((name, item, locked, sets, max(1, int(until - t)) if locked else max(1, int(self.lockout)) if sets else 0))
            held[name] = (failures, until, max([until] + [x + self.window for x in failures[-1:]]))
        self.keep({name: value for name, value in held.items() if value[-1] > -math.inf})
        yield pd.DataFrame(out, columns=["key", "item", "locked", "sets_lock", "wait"])


class _Jobs(_Expiring):
    schema = "job string, status string, t double, ends double"

    def __init__(self, ttl: float) -> None:
        self.ttl = ttl

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        held = self.held()
        latest = {job: (str(status), t) for job, t, status in _in_order(rows, "job", "t", "status")}
        for job, (status, t) in latest.items():
            if job not in held or held[job][1] <= t:
                held[job] = (status, t, t + self.ttl)
        self.keep(held)
        yield pd.DataFrame([(job, held[job][0]) for job in latest], columns=["job", "status"])

    def ended(self, keys: list[str]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([(job, "reclaimed") for job in keys], columns=["job", "status"])


#: Buckets of a stream's keys.  What is held of a bucket is read and written whole, so that it should be some hundreds of keys.
BUCKETS = 4096


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("_bucket")


def _timed(events: DataFrame, late: str, *columns: Column | str) -> DataFrame:
    return events.select(*columns, F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("_at")).withWatermark("_at", late)


def limited(events: DataFrame, *, limit: int, window: float, late: str = "10 minutes", initial: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """allowed, remaining and retry_after of each event (key string, t double seconds, item long); limit at least 1.

    State per key is the times still inside the window, at most ``limit`` of
    them.  ``initial`` (key, t) has the hits that were allowed before.
    ``buckets`` stays as it is while a checkpoint is used.
    """
    timed = _timed(events, late, "key", "t", "item", _bucket("key", buckets)).groupBy("_bucket")
    return timed.transformWithStateInPandas(_Limiter(limit, window), "key string, item long, allowed boolean, remaining long, retry_after long", "append", "EventTime", initial.select("key", "t", _bucket("key", buckets)).groupBy("_bucket") if initial is not None else None)


def locked(events: DataFrame, *, max_failures: int, window: float, lockout: float, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """locked, sets_lock and wait of each attempt (key string, t double seconds, item long, failed boolean)."""
    timed = _timed(events, late, "key", "t", "item", F.coalesce("failed", F.lit(False)).alias("failed"), _bucket("key", buckets)).groupBy("_bucket")
    return timed.transformWithStateInPandas(_Lockout(max_failures, window, lockout), "key string, item long, locked boolean, sets_lock boolean, wait long", "append", "EventTime")


def job_states(events: DataFrame, *, ttl: float = 3600.0, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """The latest status of each job (job string, t double seconds, item long, status string); once the watermark has passed ``ttl`` seconds without a change it is ``reclaimed``."""
    timed = _timed(events, late, "job", "t", "item", "status", _bucket("job", buckets)).groupBy("_bucket")
    return timed.transformWithStateInPandas(_Jobs(ttl), "job string, status string", "update", "EventTime")


def counted_in_windows(events: DataFrame, *, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events of each type in tumbling windows with a bound on lateness (ts timestamp, event_type, value)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v")).select(F.col("w.start").alias("start"), "event_type", "n", "v")
