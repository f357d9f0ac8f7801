"""Live sessions over several micro-batches: passes, late pairs, settings and resets."""

import itertools
import os
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from redactory.functions.io import shared_path
from redactory.streaming.sessions import CEILING, QUIET, LiveSession, live_sessions

#: The watermark begins at 0, and what is not later than it is late.
START = 100_000
SCHEMA = "session long, ms long, seq long, kind string, name string, value string, extra string"


def run(spark, tmp_path, batches):
    """Results by session, with each list of events arriving as a micro-batch of its own; times begin at START."""
    folder, seq = tmp_path / f"in{random.random()}", 0
    folder.mkdir()
    for i, events in enumerate(batches):
        rows = [(s, START + ms, seq + j, kind, name, value, "x") for j, (s, ms, kind, name, value) in enumerate(events)]
        seq += len(rows)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(folder / f"b{i}"))
        for part in (folder / f"b{i}").glob("*.parquet"):
            os.utime(part, (1_000_000_000 + i, 1_000_000_000 + i))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
    out, seen = shared_path(spark, "test"), []
    results = live_sessions(stream.withColumn("ts", F.timestamp_millis("ms")))

    def write(batch, number):
        rows = [tuple(r) for r in batch.collect()]
        seen.append(len(rows))
        write.rows += rows

    write.rows = []
    results.writeStream.option("checkpointLocation", f"{out}/c").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) >= len(batches)
    by = {}
    for session, at, kind, name, value in write.rows:
        by.setdefault(session, []).append((at - START, kind, name, value))
    return {s: sorted(rows, key=lambda r: r[0]) for s, rows in by.items()}


def passes(rows):
    return [at for at, kind, _, _ in rows if kind == "pass"]


def passes_by_hand(times):
    """Of changes at these times, the first of which is a pair; those that are due after the last change of all are left out."""
    out, last, due = [], -CEILING, None
    for now in times:
        if due is not None and due <= now:
            out.append(due)
            last, due = due, None
        if now - last >= CEILING:
            out.append(now)
            last, due = now, None
        else:
            due = now + min(QUIET, CEILING - (now - last))
    return out, due


PAIR = ("pair", "F1", "R1")


def test_a_burst_gives_one_pass_and_a_long_one_a_pass_each_ceiling(spark, tmp_path):
    t = 10_000
    burst = [(1, t, *PAIR)] + [(1, t + 700 + 20 * i, "answer", "a", f"F1 {i}") for i in range(5)]
    # the first change after a long time is restored at once, the rest of the burst once, after the pause
    long_one = [(2, t, *PAIR)] + [(2, t + 50 * i, "answer", "b", f"F1 {i}") for i in range(1, 41)]
    later = [(3, t + 20_000, *PAIR)]
    got = run(spark, tmp_path, [burst[:3] + long_one[:17], burst[3:] + long_one[17:], later])
    assert passes(got[1]) == [t, t + 700, t + 700 + 80 + QUIET]
    assert passes(got[2]) == [t, t + 600, t + 1200, t + 1800, t + 2000 + QUIET]
    assert [v for _, k, _, v in got[1] if k == "shown"] == ["R1 0", "R1 4"]
    assert [v for _, k, _, v in got[2] if k == "shown"] == ["R1 11", "R1 23", "R1 35", "R1 40"]


def test_passes_of_random_changes_equal_a_fold(spark, tmp_path):
    rng = random.Random(5)
    times = {s: sorted(rng.sample(range(5000), 40)) for s in range(4)}
    events = sorted((s, t, *(PAIR if t == ts[0] else ("answer", "a", str(t)))) for s, ts in times.items() for t in ts)
    events.sort(key=lambda e: e[1])
    end = (99, 60_000, *PAIR)
    got = run(spark, tmp_path, [events[:50], events[50:90], events[90:], [end]])
    for s, ts in times.items():
        want, due = passes_by_hand(ts)
        assert passes(got[s]) == want + ([due] if due else [])


def test_a_pair_that_comes_late_restores_what_was_said_before(spark, tmp_path):
    first = [(1, 0, *PAIR), (1, 10, "answer", "a", "F1 and F2, not F21"), (1, 20, "answer", "b", "nothing")]
    got = run(spark, tmp_path, [first, [(1, 5000, "pair", "F2", "R2")], [(2, 9000, *PAIR)]])
    assert [(n, v) for _, k, n, v in got[1] if k == "shown"] == [("a", "R1 and F2, not F21"), ("b", "nothing"), ("a", "R1 and R2, not F21")]
    assert [(k, n) for _, k, n, _ in got[1] if k == "unmask"] == [("unmask", "F1"), ("unmask", "F2")]


def test_a_setting_changes_between_batches(spark, tmp_path):
    say = lambda t, i: (1, t, "message", "p", str(i))
    batches = [[say(0, 1)], [(1, 1000, "setting", "auto_restore", "false"), say(1001, 2)], [say(2000, 3), (1, 2001, "setting", "auto_restore", "true"), (1, 2002, "setting", "theme", "false"), say(2003, 4)]]
    batches += [[(1, 3000, "setting", "enabled", "false"), say(3001, 5), (1, 3002, None, None, None)]]
    assert [v for _, k, _, v in run(spark, tmp_path, batches)[1] if k == "message"] == ["1", "4"]
    off = [[(1, 0, "setting", "auto_restore", "false"), (1, 1, *PAIR), (1, 2, "answer", "a", "F1")], [(1, 5000, "setting", "auto_restore", "true")], [(2, 9000, *PAIR)]]
    got = run(spark, tmp_path, off)[1]
    assert [(n, v) for _, k, n, v in got if k == "shown"] == [("a", "F1"), ("a", "R1")] and [k for _, k, _, _ in got if k in ("pending", "unmask")] == ["pending"]


def test_a_reset_lets_announcements_come_again(spark, tmp_path):
    said = [(1, 0, "say", "x", None), (1, 1, "say", "x", None), (2, 2, "say", "x", None)]
    got = run(spark, tmp_path, [said, [(1, 10, "say", "x", None), (1, 11, "reset", None, None), (1, 12, "say", "x", None)], [(1, 13, "say", "x", None), (1, 14, "say", "y", None)]])
    assert [(at, n) for at, k, n, _ in got[1] if k == "say"] == [(0, "x"), (12, "x"), (14, "y")] and len(got[2]) == 1
    view = [[(1, 0, *PAIR), (1, 1, "answer", "a", "F1")], [(1, 2000, "reset", "", ""), (1, 2001, "answer", "c", "F1 again")], [(2, 9000, *PAIR)]]
    assert [(k, n) for _, k, n, _ in run(spark, tmp_path, view)[1] if k in ("unmask", "shown")] == [("unmask", "F1"), ("shown", "a"), ("unmask", "F1"), ("shown", "c")]


class CountedStore:
    """A state variable or handle that counts its calls."""

    def __init__(self, calls=None):
        self.calls, self.kept = [] if calls is None else calls, []

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name in ("getValueState", "getListState", "getMapState"):
                return CountedStore(self.calls)
            if name in ("update", "clear"):
                self.kept = [*args]
            if name == "appendValue":
                self.kept.append(args[0])
            return {"exists": bool(self.kept), "get": iter(self.kept) if self.kept and isinstance(self.kept[0][0], str) else (self.kept or [None])[0]}.get(name)

        return call


def test_a_batch_asks_the_store_a_few_times_however_many_its_events():
    store = CountedStore()
    session = LiveSession()
    session.init(store)
    told = []
    for batch in range(3):
        del store.calls[:]
        rows = [Row(us=1000 * (START + 5000 * batch + i), seq=i, kind="answer" if i % 3 else "pair", name=f"{batch}.{i}" if i % 3 else f"F{i % 4}", value=f"see F{i % 4}" if i % 3 else f"R{i % 4}") for i in range(1500)]
        told += session.handleInputRows((1,), iter(rows), None)
        assert len(store.calls) < 20
    shown = [r for r in told if r.kind == "shown"]
    assert len({r.name for r in shown}) > 2000 and {r.value for r in shown} >= {f"see R{i}" for i in range(4)}
    assert sorted(r.name for r in told if r.kind == "unmask") == ["F0", "F1", "F2", "F3"]


def test_events_that_tie_in_time_and_number_give_the_same_rows_in_any_arrival():
    tied = [("pair", "F1", "R1"), ("answer", "a", "F1"), ("answer", "a", "F1 again"), ("reset", None, None), (None, None, None)]
    later = [Row(us=1000 * (START + 300), seq=9, kind="answer", name="b", value="F1")]
    told = set()
    for some in itertools.permutations(tied):
        session = LiveSession()
        session.init(CountedStore())
        rows = [Row(us=1000 * START, seq=1, kind=kind, name=name, value=value) for kind, name, value in some]
        told.add(tuple(map(tuple, session.handleInputRows((1,), iter(rows + later), None))))
    assert len(told) == 1
