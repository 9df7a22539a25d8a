"""Ordered folds over events per key: sliding-window limiter, lockout, job state.

A denied hit is not recorded, so these are left folds and no window counts.
The state of a fold is only what is inside the window.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.operators.folds import ordered_fold


#: A slice of time holds so many horizons; its rows and their neighbours meet in one task.
SLICE_HORIZONS = 8


def _stretches(rows: DataFrame, *, key: str, item: str, window: float, horizon: float, most: int) -> DataFrame:
    """rows (_t, _bad) with _count, _open, _folded and _part: a busy key cut into stretches that need not know of each other.

    _count is how many bad rows lie within ``window`` up to the row.  As a limit
    only ever refuses some of them, a row is settled where no row of the
    ``horizon`` before it counts more than ``most``; others are _open.  Only
    open rows and those within a horizon before them have to be folded
    (_folded), and a fold starts anew after a gap of a horizon.  All of this is
    found in slices of time that see their neighbours' rows, so what meets in a
    task is a few horizons of a key and never its whole past.
    """
    width, reach = max(SLICE_HORIZONS * horizon, 1.0), horizon * 1.001
    slices = F.sequence(F.floor((F.col("_t") - reach) / width), F.floor((F.col("_t") + 3 * reach) / width))
    near = rows.withColumn("_own", F.floor(F.col("_t") / width)).withColumn("_slice", F.explode(slices))
    ordered = Window.partitionBy(key, "_slice").orderBy("_t", item)
    upto, before = ordered.rowsBetween(Window.unboundedPreceding, 0), ordered.rowsBetween(Window.unboundedPreceding, -1)
    # each row also asks, a window earlier, how many bad rows came before; so no row reads a window's rows again
    asked = near.withColumn("_probe", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("_at", F.when(F.col("_probe"), F.col("_t") - window).otherwise(F.col("_t")))
    told = Window.partitionBy(key, "_slice").orderBy("_at", F.desc("_probe"), "_t", item).rowsBetween(Window.unboundedPreceding, 0)
    summed = asked.withColumn("_sum", F.sum(F.when(F.col("_probe"), 0).otherwise(F.col("_bad").cast("long"))).over(told))
    pair = Window.partitionBy(key, "_slice").orderBy("_t", item, F.desc("_probe")).rowsBetween(Window.unboundedPreceding, 0)
    seen = summed.withColumn("_count", F.col("_sum") - F.last(F.when(F.col("_probe"), F.col("_sum")), ignorenulls=True).over(pair)).where("NOT _probe").drop("_probe", "_at")
    seen = seen.withColumn("_over", F.col("_bad") & (F.col("_count") > most))
    peers = Window.partitionBy(key, "_slice").orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(key, "_slice").orderBy(F.desc("_t")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = seen.withColumn("_open", F.coalesce(F.max(F.when(F.col("_over"), F.col("_t"))).over(peers) >= F.col("_t") - horizon, F.lit(False)))
    seen = seen.withColumn("_folded", F.coalesce(F.min(F.when(F.col("_open"), F.col("_t"))).over(ahead) <= F.col("_t") + horizon, F.lit(False)))
    last = F.last(F.when(F.col("_folded"), F.col("_t")), ignorenulls=True).over(before)
    starts = F.when(F.col("_folded") & F.coalesce(last < F.col("_t") - horizon, F.lit(True)), F.col("_t"))
    own = seen.withColumn("_start", starts).where("_slice = _own").withColumn("_latest", F.max("_start").over(upto))
    # the last start of an earlier slice, from one row a slice
    ends = own.groupBy(F.col(key).alias("_key"), F.col("_own").alias("_at")).agg(F.max("_start").alias("_end"))
    carried = ends.withColumn("_carry", F.max("_end").over(Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))).drop("_end")
    joined = own.join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_own") == F.col("_at")), "left")
    part = F.when(F.col("_folded"), F.coalesce("_latest", "_carry")).otherwise(F.col("_own").cast("double"))
    return joined.select(*rows.columns, "_count", "_open", "_folded", part.alias("_part"))


def rate_limit(events: DataFrame, *, key: str, time: str, item: str, limit: int, window: float, spread: bool = False) -> DataFrame:
    """allowed, remaining and retry_after of each event, in the order of (time, item) per key.

    A hit that is exactly ``window`` old still counts.  ``retry_after`` is the
    whole seconds left and one more.  A limit of 0 or less allows all, with -1
    remaining.  ``time`` is in seconds.  ``spread`` is for keys with more hits
    than one task should read: the same rows, found stretch by stretch; only a
    stretch in which a key keeps passing its limit stays in one task.
    """
    if limit <= 0:
        return events.select(key, item, F.lit(True).alias("allowed"), F.lit(-1).cast("long").alias("remaining"), F.lit(0).cast("long").alias("retry_after"))

    def fresh():
        hits: deque[float] = deque()

        def step(t: float, count: int | None = None, unsure: bool = True) -> tuple[bool, int, int]:
            while hits and hits[0] < t - window:
                hits.popleft()
            if len(hits) >= limit:
                return False, 0, max(1, int(window - (t - hits[0])) + 1)
            hits.append(t)
            return True, limit - (len(hits) if unsure else count), 0

        return step

    rows, adds = events.select(key, item, F.col(time).cast("double").alias("_t")), "allowed boolean, remaining long, retry_after long"
    if not spread:
        return ordered_fold(rows, key=(key,), order=("_t", item), reads=("_t",), fresh=fresh, adds=adds).drop("_t")
    cut = _stretches(rows.withColumn("_bad", F.lit(True)), key=key, item=item, window=float(window), horizon=float(window), most=limit)
    return ordered_fold(cut.drop("_bad"), key=(key, "_folded", "_part"), order=("_t", item), reads=("_t", "_count", "_open"), fresh=fresh, adds=adds).select(key, item, "allowed", "remaining", "retry_after")


def lockouts(events: DataFrame, *, key: str, time: str, item: str, failed: str, max_failures: int, window: float, lockout: float, spread: bool = False) -> DataFrame:
    """Whether each attempt met a lock, whether it set one, and the whole seconds to wait, at least 1 where locked.

    Reaching ``max_failures`` within the window sets a lock and clears the
    window; a locked attempt changes nothing; a success clears the window.
    ``spread`` is for keys with more attempts than one task should read, as in
    ``rate_limit``.
    """

    def fresh():
        failures: deque[float] = deque()
        until = [-math.inf]

        def step(t: float, bad: bool) -> tuple[bool, bool, int]:
            if until[0] > t:
                return True, False, max(1, int(until[0] - t))
            if not bad:
                failures.clear()
                return False, False, 0
            while failures and failures[0] < t - window:
                failures.popleft()
            failures.append(t)
            if len(failures) < max_failures:
                return False, False, 0
            failures.clear()
            until[0] = t + lockout
            return False, True, max(1, int(lockout))

        return step

    rows = events.select(key, item, F.col(time).cast("double").alias("_t"), F.coalesce(F.col(failed), F.lit(False)).alias("_bad"))
    parts = (key,)
    if spread:
        rows = _stretches(rows, key=key, item=item, window=float(window), horizon=float(max(window, lockout)), most=max_failures - 1)
        parts = (key, "_folded", "_part")
    return ordered_fold(rows, key=parts, order=("_t", item), reads=("_t", "_bad"), fresh=fresh, adds="locked boolean, sets_lock boolean, wait long").select(key, item, "locked", "sets_lock", "wait")


def client_key(forwarded: Column, host: Column) -> Column:
    """The first forwarded address, ``unknown`` if that is blank; without any the host, else ``unknown``."""
    first = F.trim(F.get(F.split(forwarded, ","), F.lit(0)))
    return F.when(forwarded != "", F.when(first != "", first).otherwise("unknown")).when(host != "", host).otherwise("unknown")


# ---------------------------------------------------------------- jobs

TERMINAL = ("done", "error")
PUBLIC_RESULT = ("pages", "tables", "text_blocks", "images", "lines", "warnings", "files", "batch", "engine", "bytes")


def latest_state(events: DataFrame, *, key: str, time: str, order: str, fields: tuple[str, ...]) -> DataFrame:
    """Of each field the last value that is not null, by (time, order): a last write wins merge."""
    at = F.struct(F.col(time), F.col(order))
    return events.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields], F.min(time).alias("created_at"), F.max(time).alias("updated_at"))


def job_changes(actions: DataFrame) -> DataFrame:
    """What each action does to its job, as fields to merge: status, progress, message, error, output_path, downloaded_at.

    Actions are create, start, finish (with an output_path), fail (with an
    error) and download, in the columns action, at, error and output_path; null
    leaves a field as it is, and an empty output_path is one that was removed.
    """
    a = F.col("action")
    by = lambda **values: F.coalesce(*[F.when(a == k, F.lit(v)) for k, v in values.items()])
    return actions.withColumns({
        "status": by(create="queued", start="running", finish="done", fail="error"),
        "progress": by(create=0.0, start=0.05, finish=1.0, fail=1.0),
        "message": by(create="", start="running", finish="done", fail="error", download="downloaded"),
        "error": F.when(a == "fail", F.coalesce(F.nullif(F.col("error"), F.lit("")), F.lit("error"))),
        "output_path": F.when(a == "finish", F.col("output_path")).when(a.isin("fail", "download"), ""),
        "downloaded_at": F.when(a == "download", F.col("at")),
    })


def has_result(status: Column, output_path: Column, downloaded_at: Column) -> Column:
    """Whether a job's file can be fetched: it is done, and its file was not fetched before."""
    return F.coalesce((status == "done") & (output_path != "") & downloaded_at.isNull(), F.lit(False))


def reclaimable(now: Column, *, idle: int = 3600, downloaded: int = 30) -> Column:
    """Ended jobs downloaded a while ago, or untouched for long."""
    ended = F.col("status").isin(*TERMINAL)
    fetched = F.coalesce(F.col("downloaded_at") + F.make_dt_interval(secs=F.lit(downloaded)) <= now, F.lit(False))
    return ended & (fetched | (F.col("updated_at") + F.make_dt_interval(secs=F.lit(idle)) < now))


def public_result(result: Column, keys: tuple[str, ...] = PUBLIC_RESULT) -> Column:
    return F.map_filter(result, lambda k, _: k.isin(*keys))


def top_recent_jobs(jobs: DataFrame, *, user: str, job: str, time: str, now: Column, ttl: int = 7200, most: int = 12) -> DataFrame:
    """Each user's newest jobs that are no older than ``ttl`` seconds."""
    fresh = jobs.where(F.col(time) >= now - F.make_dt_interval(secs=F.lit(ttl)))
    rank = F.row_number().over(Window.partitionBy(user).orderBy(F.desc(time), job))
    return fresh.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)
