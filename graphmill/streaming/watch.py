"""When to sync changed files, as one stateful stream: changes wait for quiet, refused syncs are tried again ever later, and who is refused too often is given up."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from graphmill.sources.code import language_of
from graphmill.sources.tree import DEFAULT_RULES, ruled_out
from graphmill.store import shared
from graphmill.streaming.sync import backoff

#: Rows of the stream; times in microseconds.
_ROWS = "path string, action string, at long, failures int, first_seen long, last_seen long, changes long"
#: The store of states that timers need.
_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Waiting(NamedTuple):
    """What is known of a file; times in microseconds. started: of the sync under way; due: of the next; timer: when (ms) the state is looked at next."""

    first: int | None = None
    last: int | None = None
    changes: int = 0
    due: int | None = None
    started: int | None = None
    failures: int = 0
    degraded: bool = False
    timer: int | None = None


#: With the events that wait, so that a path is one value of the store: each call to it is a round trip.
_STATE = "first long, last long, changes long, due long, started long, failures int, degraded boolean, timer long, ats array<long>, whats array<string>"


def fired(s: Waiting, path: str, upto: int) -> tuple[Waiting, list[tuple]]:
    """The state after a sync that was due by then has begun, and its row."""
    if s.due is None or s.due > upto:
        return s, []
    return s._replace(due=None, started=s.due), [(path, "sync", s.due, s.failures, s.first, s.last, s.changes)]


def advanced(s: Waiting, path: str, at: int, what: str, debounce_ms: int, most_ms: int, give_up: int) -> tuple[Waiting, list[tuple]]:
    """The state after an event, and the rows that it gives.

    changed: the file waits for so much quiet, unless its sync is under way, which a change outlives. Ends of a sync, ignored where none is under way:
    synced clears what was seen before it began; failed tries again after the usual wait; locked (another writer holds the index) after a
    wait that doubles, and more than give_up of them in a row give the file up for good.
    """
    s, out = fired(s, path, at)
    if s.degraded:
        return s, out
    again = at + 1000 * debounce_ms
    if what == "changed":
        s = s._replace(first=at if s.first is None else s.first, last=at, changes=s.changes + 1)
        return (s if s.started is not None else s._replace(due=again)), out
    if s.started is None:
        return s, out
    if what == "synced":
        fresh = s.last <= s.started
        s = s._replace(first=None, last=None, changes=0, failures=0) if fresh else s._replace(due=again, failures=0)
    elif what == "failed":
        s = s._replace(due=again, failures=0)
    elif what == "locked":
        s = s._replace(failures=s.failures + 1)
        wait = backoff(s.failures, debounce_ms, most_ms, give_up)
        if wait is None:
            return s._replace(started=None, degraded=True), [*out, (path, "degraded", at, s.failures, s.first, s.last, s.changes)]
        s = s._replace(due=at + 1000 * wait)
    else:
        return s, out
    return s._replace(started=None), out


class Watcher(StatefulProcessor):
    """Of each path: events that the watermark has not passed wait in its state, so that they are met in the order of their times whatever batch
    brought them; one timer a path, at the first of them or at the next sync."""

    def __init__(self, debounce_ms: int, most_ms: int, give_up: int):
        self.rules = (debounce_ms, most_ms, give_up)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("waiting", _STATE)

    def _settle(self, path: str, s: Waiting, events: list[tuple], mark_ms: int) -> Iterator[Row]:
        """Meet what the watermark has passed, keep the rest, and set the timer."""
        mark, out = 1000 * mark_ms, []
        events = sorted(events)
        for at, what in events:
            if at > mark:
                break
            s, rows = advanced(s, path, at, what, *self.rules)
            out += rows
        s, rows = fired(s, path, mark)
        out += rows
        kept = [e for e in events if e[0] > mark]
        times = [e[0] for e in kept[:1]] + ([s.due] if s.due is not None else [])
        timer = -(-min(times) // 1000) if times else None
        if timer != s.timer:
            if s.timer is not None and s.timer > mark_ms:
                self.handle.deleteTimer(s.timer)
            if timer is not None:
                self.handle.registerTimer(timer)
        self.state.update((*s._replace(timer=timer), [e[0] for e in kept], [e[1] for e in kept]))
        row = Row("path", "action", "at", "failures", "first_seen", "last_seen", "changes")
        yield from (row(*r) for r in out)

    def _known(self) -> tuple[Waiting, list[tuple]]:
        held = self.state.get()
        return (Waiting(), []) if held is None else (Waiting(*held[:-2]), list(zip(*held[-2:])))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        s, events = self._known()
        events += [(r["at_us"], r["what"]) for r in rows]
        yield from self._settle(key[0], s, events, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        s, events = self._known()
        gone = s._replace(timer=None) if s.timer is not None and s.timer <= expiredTimerInfo.getExpiryTimeInMs() else s
        yield from self._settle(key[0], gone, events, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def is_watched(path: Column, rules: Sequence[str] = DEFAULT_RULES) -> Column:
    """Whether a change of a path counts: below the root, of a known language, and not ignored (rules as in ignore files; those of the built-in folders
    are always there). Null counts as no."""
    lines = (*DEFAULT_RULES, *(r for r in rules if r not in DEFAULT_RULES))

    def run(paths: pd.Series) -> pd.Series:
        folders = lambda p: ("/".join(p.split("/")[:i]) for i in range(1, p.count("/") + 1))
        return pd.Series([bool(p) and not (ruled_out(p, False, lines) or any(ruled_out(f, True, lines) for f in folders(p))) for p in paths], dtype=bool)

    inside = path.isNotNull() & ~path.isin("", ".") & ~path.startswith("..")
    return F.coalesce(inside & (language_of(path) != "unknown"), F.lit(False)) & F.pandas_udf(run, "boolean")(path)


def due_syncs(events: DataFrame, late: str, debounce_ms: int = 2000, most_ms: int = 30_000, give_up: int = 5) -> DataFrame:
    """path, action (sync or degraded), at, failures, first_seen, last_seen, changes, from a stream of path, ts (timestamp), what (changed, synced, failed or locked).

    A row comes once the watermark, `late` behind the newest event, has passed its time; later events are dropped. Events of one time go by `what`. Rows with a null
    in any column are left out, as are other columns. The state of a path is some numbers and its events of the last `late`.
    """
    clean = events.where("path is not null and ts is not null and what is not null").select(F.col("path").cast("string").alias("path"), "ts", "what", F.unix_micros("ts").alias("at_us"))
    by = clean.withWatermark("ts", late).groupBy("path")
    # Rows, not frames: a path gives few, and a frame of its own would cost more than all else that is done for it.
    found = by.transformWithState(Watcher(debounce_ms, most_ms, give_up), outputStructType=_ROWS, outputMode="append", timeMode="eventTime")
    return found.select(*(F.timestamp_micros(c).alias(c) if c in ("at", "first_seen", "last_seen") else F.col(c) for c in found.columns))


def follow(due: DataFrame, name: str, apply: Callable[[DataFrame, int], None]) -> None:
    """Run the stream over all that its source holds now; each micro-batch goes to apply(rows, number), which may be called again for a number after a
    failure and so must be idempotent. State is kept in the cluster's shared folder under `name`: a later call goes on from there."""
    spark = due.sparkSession
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        sink = due.writeStream.outputMode("append").foreachBatch(apply).option("checkpointLocation", f"{shared(spark)}/graphmill-{name}/state")
        query = sink.trigger(availableNow=True).start()
    finally:
        spark.conf.set(_STORE, before)
    query.awaitTermination()


def followed(due: DataFrame, name: str) -> DataFrame:
    """All rows that the stream gives now, as a table in the shared folder; a batch that is run again writes its rows over those of its first run."""
    folder = f"{shared(due.sparkSession)}/graphmill-{name}/rows"
    due.sparkSession.createDataFrame([], due.schema).write.mode("overwrite").parquet(f"{folder}/batch=none")
    follow(due, name, lambda rows, number: rows.write.mode("overwrite").parquet(f"{folder}/batch={number}"))
    return due.sparkSession.read.schema(due.schema).parquet(f"{folder}/batch=*")
