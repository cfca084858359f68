"""The case state machine and the time-outs as stateful processors, one row per case after each micro-batch.

For stores that want such rows as they come (``transformWithStateInPandas``). They call Python for each case, so the registered
streams are those of ``lifecycle``, which run in the JVM. This module imports nothing of its own package: its classes travel to the
workers by value, so a worker need not have the package installed.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType, TimestampType

if __name__ in sys.modules:
    register_pickle_by_value(sys.modules[__name__])

# The path of a case, its failed state and the reason of a time-out. They are
# the same as those of the batch operators; a test compares them.
PATH = ("queued", "retrieving", "analyzing", "doc_analysis", "complete")
FAILED = "error"
TERMINAL = ("complete", FAILED)
TIMEOUT = "TIMEOUT"


def _struct(strings: str = "", longs: str = "", times: str = "") -> StructType:
    """Schema built without a session, since state is set up on the workers."""
    fields = [(n, StringType()) for n in strings.split()] + [(n, LongType()) for n in longs.split()]
    fields += [(n, TimestampType()) for n in times.split()]
    return StructType([StructField(n, t) for n, t in fields])


SETTLED = _struct(longs="state accepted events")
BUCKET = _struct(longs="bucket")
ENTRIES = _struct("entries")
LEADS = _struct("leads", "events")
EVENT = _struct("status", "at_us event_id")
OUTPUT = _struct("case_id status failed_stage", "accepted dropped")
REAPED = _struct("case_id status failed_stage error_reason", times="since").add("live", BooleanType())
SHOWN = _struct("failed_stage", "at_us")
START = _struct(longs="at_us")


def micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


class Waiting(StatefulProcessor):
    """Keeps the rows of a key that the watermark has not passed, since earlier ones may still come."""

    schema = EVENT

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)

    def held(self) -> list[tuple]:
        return [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []

    def hold(self, rows: list[tuple]) -> None:
        if rows:
            self.waiting.put(rows)
        else:
            self.waiting.clear()

    def wake(self, ms: int | None) -> None:
        """One timer for the key, or none."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if ms is not None:
            self.handle.registerTimer(ms)

    def close(self) -> None:
        pass


def transition_map(events: list[tuple]) -> list[list[int]]:
    """For each active state, where events (status, time, id) in any order lead a case that comes in with it, and how many are accepted.

    States are their places on the path; beyond that, failed from that place.
    """
    leads = [[i, 0] for i in range(len(PATH) - 1)]
    for to, _, _ in sorted(events, key=lambda e: e[1:]):
        step = PATH.index(to) if to in PATH else 0
        for lead in leads:
            if lead[0] < len(PATH) - 1 and (to == FAILED or step == lead[0] + 1):
                lead[:] = [len(PATH) + lead[0] if to == FAILED else step, lead[1] + 1]
    return leads


def follow(state: int, accepted: int, leads: list[list[int]]) -> tuple[int, int]:
    """Where a map leads from a state, and how many events are accepted by then."""
    if state >= len(PATH) - 1:
        return state, accepted
    to, taken = leads[state]
    return to, accepted + taken


class GuardedTransitions(StatefulProcessor):
    """Keeps the state of one case and a transition map for each time bucket that the watermark has not passed.

    A micro-batch reads and folds only the events of the buckets it has rows for; the other buckets' maps are composed as they are.
    Buckets behind the watermark are applied for good and forgotten. Every row put out counts the waiting buckets too, so the last
    one is what the batch operator gives, however the events were cut into micro-batches; only rows behind the watermark are lost.
    """

    def __init__(self, bucket_minutes: int = 60):
        self.width_us = bucket_minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", SETTLED)
        self.events = handle.getMapState("events", BUCKET, ENTRIES)
        self.maps = handle.getMapState("maps", BUCKET, LEADS)

    def _learn(self, fresh: list[tuple]) -> None:
        touched: dict[int, list[tuple]] = {}
        for e in fresh:
            touched.setdefault(e[1] // self.width_us, []).append(e)
        for bucket, rows in touched.items():
            key = (bucket,)
            held = json.loads(self.events.getValue(key)[0]) if self.events.containsKey(key) else []
            rows = [tuple(e) for e in held] + rows
            self.events.updateValue(key, (json.dumps(rows),))
            self.maps.updateValue(key, (json.dumps(transition_map(rows)), len(rows)))

    def _settle(self, watermark_ms: int) -> tuple[tuple, list[tuple]]:
        """The state behind the watermark, and the buckets (number, map, events) that wait, in order."""
        state, accepted, events = self.settled.get() if self.settled.exists() else (0, 0, 0)
        waiting = []
        for key, (leads, n) in sorted((tuple(k), tuple(v)) for k, v in self.maps.iterator()):
            if (key[0] + 1) * self.width_us // 1000 <= watermark_ms:
                state, accepted = follow(state, accepted, json.loads(leads))
                events += n
                self.maps.removeKey(key)
                self.events.removeKey(key)
            else:
                waiting.append((key[0], json.loads(leads), n))
        self.settled.update((state, accepted, events))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if waiting:
            self.handle.registerTimer((waiting[-1][0] + 1) * self.width_us // 1000 + 1)
        return (state, accepted, events), waiting

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._learn([r for c in rows for r in zip(c["to_status"].tolist(), micros(c["ts"]), c["event_id"].tolist(), strict=True)])
        (state, accepted, events), waiting = self._settle(timerValues.getCurrentWatermarkInMs())
        for _, leads, n in waiting:
            state, accepted = follow(state, accepted, leads)
            events += n
        failed = state >= len(PATH)
        out = {"case_id": [key[0]], "status": [FAILED if failed else PATH[state]], "failed_stage": [PATH[state - len(PATH)] if failed else None]}
        yield pd.DataFrame(out | {"accepted": [accepted], "dropped": [events - accepted]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._settle(timerValues.getCurrentWatermarkInMs())
        return iter(())

    def close(self) -> None:
        pass


class Reaper(Waiting):
    """Times a case out if no end lies within the limit of its first event.

    That is put out once the newest event lies more than ``settle_minutes`` past the limit, as the rows so far imply it,
    and decided once the watermark, ``delay_ms`` behind the newest event, has passed the limit. Until then a late event may
    change it: a time-out that no longer holds is put out once more with ``live`` false.
    A decided case is remembered for ``keep_minutes`` of event time, so what it says later does not start it anew.
    """

    def __init__(self, minutes: int, keep_minutes: int, delay_ms: int = 0, settle_minutes: int = 1):
        self.limit_us = minutes * 60_000_000
        self.keep_ms = keep_minutes * 60_000
        self.early_ms = max(delay_ms - settle_minutes * 60_000, 0)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.decided = handle.getValueState("decided", START)
        self.shown = handle.getValueState("shown", SHOWN)

    def _settle(self, key, events: list[tuple], watermark_ms: int) -> Iterator[pd.DataFrame]:
        first = min(e[1] for e in events)
        # An earlier first event would only move the limit back.
        events = sorted((e for e in events if e[1] <= first + self.limit_us), key=lambda e: e[1:])
        limit_ms = (first + self.limit_us) // 1000
        due_ms = limit_ms - self.early_ms
        out = None
        if watermark_ms > due_ms and not any(e[0] in TERMINAL for e in events):
            out = (events[-1][0], first)
        shown = tuple(self.shown.get()) if self.shown.exists() else None
        rows = []
        if shown and (not out or out[1] != shown[1]):
            rows.append((key[0], None, None, None, pd.Timestamp(shown[1], unit="us"), False))
        if out and out != shown:
            rows.append((key[0], FAILED, out[0], TIMEOUT, pd.Timestamp(first, unit="us"), True))
        if watermark_ms > limit_ms:
            self.hold([])
            self.shown.clear()
            self.decided.update((first,))
            self.wake(limit_ms + self.keep_ms)
        else:
            self.hold(events)
            if out:
                self.shown.update(out)
            else:
                self.shown.clear()
            self.wake(limit_ms if watermark_ms > due_ms else due_ms)
        if rows:
            yield pd.DataFrame(rows, columns=REAPED.names)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [r for c in rows for r in zip(c["to_status"].tolist(), micros(c["ts"]), c["event_id"].tolist(), strict=True)]
        if not self.decided.exists():
            yield from self._settle(key, self.held() + fresh, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.decided.exists():
            self.decided.clear()
            return
        yield from self._settle(key, self.held(), timerValues.getCurrentWatermarkInMs())
