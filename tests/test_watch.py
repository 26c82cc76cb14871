"""When changed files are synced: the stream against a plain loop over all events in order, whatever batches they come in."""

import random
import uuid
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from graphmill.store import shared
from graphmill.streaming import sync, watch

START = datetime(2024, 1, 1)
US = timedelta(microseconds=1)


def plain(events, mark):
    """Rows of each path's events up to mark, by a loop with its own state."""
    out = []
    for path in sorted({e[0] for e in events}):
        seen, due, running, failures, dead = [], None, None, 0, False
        todo = sorted((t, w) for p, t, w in events if p == path and t <= mark)
        for t, w in [*todo, (mark, "end")]:
            if due is not None and due <= t:
                out.append((path, "sync", due, failures, seen[0], seen[-1], len(seen)))
                running, due = due, None
            if dead or w == "end":
                continue
            if w == "changed":
                seen.append(t)
                due = due if running else t + timedelta(seconds=2)
            elif running and w != "other":
                if w == "locked":
                    failures += 1
                    if failures > 5:
                        dead, due = True, None
                        out.append((path, "degraded", t, failures, seen[0], seen[-1], len(seen)))
                    else:
                        due = t + timedelta(seconds=min(30, 2 ** failures))
                else:
                    failures = 0
                    if w == "failed" or seen[-1] > running:
                        due = t + timedelta(seconds=2)
                    else:
                        seen = []
                running = None
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_stream(spark, seed, tmp_path):
    rng = random.Random(seed)
    events, at = [], START
    for _ in range(700):
        at += timedelta(milliseconds=rng.choice([1, 300, 900, 2500]), microseconds=rng.randrange(1000))
        what = rng.choice(["changed", "changed", "locked", "locked", "synced", "failed", "other"])
        events.append((rng.choice("abcde") if rng.random() < 0.7 else "hot", at, "locked" if what != "changed" and seed and rng.random() < 0.6 else what))
    events += events[:5]  # repeated rows
    end = max(t for _, t, _ in events)
    # Within 40 s events come in any order; a file is a batch.
    mixed = sorted(events, key=lambda e: e[1] + timedelta(seconds=rng.uniform(0, 40)))
    name, folder = f"watch_{uuid.uuid4().hex}", str(tmp_path / "feed")
    (tmp_path / "feed").mkdir()
    schema = "path string, ts timestamp, what string, at_us int"
    got = {}

    def keep(rows, number):
        got[number] = [tuple(r)[:2] + (r["at"], r["failures"], r["first_seen"], r["last_seen"], r["changes"]) for r in rows.collect()]

    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    for i in range(5):
        part = mixed[i * len(mixed) // 5 : (i + 1) * len(mixed) // 5]
        rows_ = [(*e, 0) for e in part] + ([("late", START - timedelta(hours=1), "changed", 0)] if i == 4 else []) + [(None, at, "changed", 0), ("a", at, None, 0)]
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(folder)
        if i in (1, 4):  # stopped and started again
            watch.follow(watch.due_syncs(feed, "60 seconds"), name, keep)
    mark = end - timedelta(seconds=60)
    mark -= timedelta(microseconds=mark.microsecond % 1000)
    want = plain(events, mark)
    assert sorted(r for rs in got.values() for r in rs) == want
    assert len(want) > 20 and (not seed or "degraded" in {r[1] for r in want})


def test_a_path_is_one_value_of_the_store():
    """Every call to the store is a round trip, and every frame costs more than a row."""
    calls, held = [], {}

    class Store:
        def get(self):
            calls.append("get")
            return held.get("p")

        def update(self, value):
            calls.append("update")
            held["p"] = value

    handle = SimpleNamespace(getValueState=lambda *_: Store(), registerTimer=lambda ms: calls.append(f"timer {ms}"), deleteTimer=lambda ms: calls.append(f"no timer {ms}"))
    mark = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    w = watch.Watcher(2000, 30_000, 5)
    w.init(handle)
    events = [Row(at_us=1000 * ms, what=what) for ms, what in ((70, "changed"), (50, "changed"), (9000, "changed"))]
    assert not list(w.handleInputRows(("p",), iter(events), mark(0))) and calls == ["get", "timer 50", "update"]
    calls.clear()
    got = list(w.handleExpiredTimer(("p",), mark(3000), SimpleNamespace(getExpiryTimeInMs=lambda: 50)))
    assert got == [Row(path="p", action="sync", at=2_070_000, failures=0, first_seen=50_000, last_seen=70_000, changes=2)]
    assert calls == ["get", "timer 9000", "update"] and held["p"][-2:] == ([9_000_000], ["changed"])


def test_backoff():
    assert [sync.backoff(n) for n in range(8)] == [2000, 2000, 4000, 8000, 16000, 30000, None, None]


def test_which_changes_count(spark):
    paths = {"src/a.py": True, "node_modules/x/a.js": False, "src/dist/a.ts": False, "README": False, "": False, ".": False, "../a.py": False, None: False, "gen/a.py": False, "src/gen.py": True, "A.PY": True}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r[0]: r[1] for r in df.select("path", watch.is_watched(F.col("path"), ("gen/",))).collect()} == paths


def test_changes_of_a_batch_are_reconciled(spark):
    """Size and time first, then content, of the files of a batch only; what is handed on holds them."""
    index = spark.createDataFrame([("a", "1", 10, 5.5), ("b", "1", 10, 5.5), ("c", "1", 10, 5.5), ("z", "1", 1, 1.0)], "path string, hash string, size long, modified_at double")
    disk = spark.createDataFrame([("a", "2", 10, 7.0), ("b", "1", 10, 5.9), ("c", "1", 11, 5.5), ("d", "9", 3, 1.0)], "path string, hash string, size long, modified_at double")
    assert sorted(r[0] for r in sync.candidates(disk, index).collect()) == ["a", "c", "d"]
    handed = {}
    sync.on_each_batch(lambda: index, lambda changes, n: handed.update({n: sorted(map(tuple, changes.collect()))}))(disk.select("path", "hash").union(spark.createDataFrame([("z", None)], "path string, hash string")), 3)
    assert handed == {3: [("a", "modified"), ("d", "added"), ("z", "removed")]}
