"""A live session as a stateful stream: settings, a growing mapping, debounced restoring, announcements and resets.

Events (session, ts, seq, kind, name, value) of a session are folded in order of time:

* ``pair``: name is a stand-in, value its real value; the mapping grows while the stream runs.
* ``setting``: name is ``enabled`` or ``auto_restore`` (both on at first), value 'true' or 'false'.
* ``answer``: name is an answer, value its text as it stands now; the text may change again and again.
* ``message``: a message that passes while the session is enabled and restores by itself.
* ``say``: an announcement of name, made if it has not been made since the last reset.
* ``reset``: another view has come up: announcements are forgotten, and the answers of the old view too.

Answers and pairs ask for a pass over the answers. It comes ``QUIET`` after the last of them, but never later than
``CEILING`` after the pass before, so a long burst is restored as it goes; there is none while the session is off or has
no pairs. A pass restores what has changed, or everything if a pair or a setting has, so an answer that came before its pair
is restored late. It announces what it finds for the first time: as ``unmask``, or as ``pending`` while restoring is off.

Time is event time: a timer fires when the watermark has passed it, so a rerun gives the same rows. An event older than
its session's clock counts as happening now; one older than the watermark is late and left out, so ``delay`` is how late
events may come. A session without events for ``IDLE`` is dropped, with its mapping. State is
kept by session: a session is one key, as its events have an order, and the state store may spill it to disk.

Results are rows (session, at, kind, name, value) with kind pass, shown, unmask, pending, message or say. Null kinds are
ignored, a null name or value is an empty text, an unknown setting changes nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

QUIET, CEILING, IDLE = 180, 600, 60 * 24 * 3600 * 1000
#: Changes that an entry of the state holds.
CHUNK = 1000
RESULT = "session long, at long, kind string, name string, value string"
_CLOCK = "clock long, last_pass long, due long, enabled boolean, auto_restore boolean, stale boolean, idle long, n_pairs long, n_answers long, n_announced long"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Log:
    """A session's dict as a list of its changes, of which the last of a name counts: one call reads it, one writes a batch's changes.

    An entry of the list is JSON of up to ``CHUNK`` changes, as the store takes entries one by one.
    It is written anew when more than half of it is outdated. ``n`` is how many changes the store holds; with none it is not read.
    """

    def __init__(self, state) -> None:
        self.state = state

    def begin(self, n: int) -> None:
        self.n, self.forget = n, False
        self.rows, self.unsaved = ({} if not n else None), {}

    def read(self) -> dict:
        if self.rows is None:
            self.rows = {name: tuple(row) for (changes,) in self.state.get() for name, row in json.loads(changes)} | self.unsaved
        return self.rows

    def put(self, name: str, *row) -> None:
        self.unsaved[name] = row
        if self.rows is not None:
            self.rows[name] = row

    def clear(self) -> None:
        self.rows, self.unsaved, self.forget = {}, {}, True

    def save(self) -> int:
        anew = self.rows is not None and self.n + len(self.unsaved) > 2 * len(self.rows) + CHUNK
        if (self.forget or anew) and self.n:
            self.state.clear()
            self.n = 0
        rows = list((self.rows if anew else self.unsaved).items())
        for i in range(0, len(rows), CHUNK):
            self.state.appendValue((json.dumps(rows[i : i + CHUNK]),))
        return self.n + len(rows)


class LiveSession(StatefulProcessor):
    """What a batch needs of a session's state is read once, folded in memory and written once at the batch's end."""

    def init(self, handle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", _CLOCK)
        # pairs: real; answers: text, shown, changed; announced: at
        self.pairs = _Log(handle.getListState("pairs", "changes string"))
        self.answers = _Log(handle.getListState("answers", "changes string"))
        self.announced = _Log(handle.getListState("announced", "changes string"))
        self.logs = (self.pairs, self.answers, self.announced)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self._begin(key[0])
        # no time and no number come last; what ties in both goes by what it is, not by arrival, which differs from run to run
        for us, _, kind, name, value in sorted(((r.us, r.seq, r.kind, r.name, r.value) for r in rows), key=lambda e: (e[0] is None, e[0], e[1] is None, e[1], *(x or "" for x in e[2:]))):
            now = self.now if us is None else max(us // 1000, self.now)
            if self.due is not None and self.due <= now:  # its timer has not fired yet, but it comes before this event
                self._pass(self.due)
            self.now = now
            self._event(kind, name or "", value or "")
        self.idle = self.now + IDLE
        yield from self._end()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._begin(key[0])
        at = expiredTimerInfo.getExpiryTimeInMs()
        if at == self.due:
            self.now = max(self.now, at)
            self._pass(at)
        if at == self.idle:
            for state in (self.clock, *(log.state for log in self.logs)):
                state.clear()
            return
        yield from self._end()

    def _begin(self, session: int) -> None:
        state = self.clock.get() if self.clock.exists() else (0, -CEILING, None, True, True, False, None, 0, 0, 0)
        self.session, self.out, self.any_fake, self.changed = session, [], None, None
        self.now, self.last_pass, self.due, self.enabled, self.auto_restore, self.stale, self.idle, *sizes = state
        self.timers = {"due": self.due, "idle": self.idle}
        for log, n in zip(self.logs, sizes):
            log.begin(n)

    def _end(self) -> list[Row]:
        sizes = [log.save() for log in self.logs]
        for which, before in self.timers.items():
            at = getattr(self, which)
            if before != at:
                if before is not None:
                    self.handle.deleteTimer(before)
                if at is not None:
                    self.handle.registerTimer(at)
        self.clock.update((self.now, self.last_pass, self.due, self.enabled, self.auto_restore, self.stale, self.idle, *sizes))
        return self.out

    def _tell(self, at: int, kind: str, name: str = "", value: str = "") -> None:
        self.out.append(Row(session=self.session, at=at, kind=kind, name=name, value=value))

    def _event(self, kind: str | None, name: str, value: str) -> None:
        if kind == "pair" and name:
            if self.pairs.read().get(name) != (value,):  # a pair that is known as it is changes nothing that is shown
                self.pairs.put(name, value)
                self.stale, self.any_fake = True, None
            self._ask()
        elif kind == "answer":
            shown = self.answers.read()[name][1] if name in self.answers.read() else None
            self.answers.put(name, value, shown, True)
            if self.changed is not None:
                self.changed.add(name)
            self._ask()
        elif kind == "setting" and name in ("enabled", "auto_restore"):
            if getattr(self, name) != (value != "false"):
                setattr(self, name, value != "false")
                self.stale = True
                self._ask()
        elif kind == "message" and self.enabled and self.auto_restore:
            self._tell(self.now, "message", name, value)
        elif kind == "say":
            self._announce(self.now, "say", name)
        elif kind == "reset":
            self.announced.clear()
            self.answers.clear()
            self.changed = set()

    def _ask(self) -> None:
        """A pass at once if the last one is long ago, else after a pause."""
        if not self.enabled or not (self.pairs.n or self.pairs.unsaved):
            return
        since = self.now - self.last_pass
        if since >= CEILING:
            self._pass(self.now)
        else:
            self.due = self.now + min(QUIET, CEILING - since)

    def _announce(self, at: int, kind: str, name: str) -> None:
        if name not in self.announced.read():
            self.announced.put(name, at)
            self._tell(at, kind, name)

    def _pass(self, at: int) -> None:
        self.due, self.last_pass = None, at
        self._tell(at, "pass")
        real, answers = self.pairs.read(), self.answers.read()
        if self.any_fake is None:
            self.any_fake = re.compile("(?<![A-Za-z0-9])(?:" + "|".join(map(re.escape, sorted(real, key=lambda f: (-len(f), f)))) + ")(?![A-Za-z0-9])")
        if self.changed is None:
            self.changed = {name for name, (_, _, changed) in answers.items() if changed}
        for name in sorted(answers if self.stale else self.changed):
            text, shown, changed = answers[name]
            for fake in dict.fromkeys(self.any_fake.findall(text)):
                self._announce(at, "unmask" if self.auto_restore else "pending", fake)
            now_shown = self.any_fake.sub(lambda m: real[m[0]][0], text) if self.auto_restore else text
            if now_shown != shown:
                self._tell(at, "shown", name, now_shown)
            if changed or now_shown != shown:
                self.answers.put(name, text, now_shown, False)
        self.changed = set()
        self.stale = False


def with_state_store(spark: SparkSession) -> SparkSession:
    """Keyed state with timers needs the store that keeps it on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    return spark


def live_sessions(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """The stream of results of a stream of events (session, ts, seq, kind, name, value); more columns are ignored."""
    with_state_store(events.sparkSession)
    timed = events.select("session", "ts", "seq", "kind", "name", "value").withWatermark("ts", delay)
    keyed = timed.withColumn("us", F.unix_micros("ts")).groupBy("session")
    return keyed.transformWithState(LiveSession(), RESULT, "append", "eventTime")


def scaled_events(events: DataFrame, kinds: str, slower: int = 200_000) -> DataFrame:
    """The events table as session events: times so much closer that bursts arise; kinds is SQL for named struct<kind, name, value>."""
    at = F.expr(f"timestamp_millis(unix_millis(CAST(ts AS timestamp)) div {slower})")
    return events.select(F.col("user_id").alias("session"), at.alias("ts"), F.col("event_id").alias("seq"), F.expr(kinds).alias("e")).where("e IS NOT NULL").select("session", "ts", "seq", "e.*")
