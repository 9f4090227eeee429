"""Streams that remember the first call of a key for a while: turns of a conversation, and calls that must not run twice.

The first call of a key opens a span; calls within ``ttl`` of that opening belong to it, a later one opens the next.
Calls wait in the state until the watermark has passed them and are judged in the order of their time, so what comes
out depends on neither the order of arrival nor the cut into batches.  Calls behind the watermark are dropped by the
engine.  A span's state goes with its own timer once it has expired.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Calls of a key that wait in one value; those of a key with more wait in slices of time.
FEW = 1000
#: Calls of a key that are held at once before they are put into its slices.
HELD = 10_000
_CALLS = "calls array<struct<us:long,call_id:long,tool:string,copies:int>>"
Calls = dict[tuple[int, int], tuple[str, int]]


def _told(found: Any) -> Calls:
    return {(us, call): (tool, copies) for us, call, tool, copies in found or ()}


def _rows(calls: Calls) -> list[tuple[int, int, str, int]]:
    return [(*at, *told) for at, told in calls.items()]


def _add(calls: Calls, us: int, call: int, tool: str, copies: int = 1) -> None:
    calls[us, call] = (tool, copies + (calls[us, call][1] if (us, call) in calls else 0))


class FirstWithin(StatefulProcessor):
    """Tells every call the call that opened its span; ``ttl`` in microseconds.

    A key has one value: its span and the calls that wait.  Where more than ``FEW`` wait, they go to slices of time as
    long as a span, each with a timer, so that a timer reads one slice and never all that waits.
    """

    def __init__(self, ttl: int) -> None:
        self.ttl, self.few, self.held = ttl, FEW, HELD

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.one = handle.getValueState("one", f"opened long, call_id long, tool string, sliced boolean, {_CALLS}")
        self.slices = handle.getMapState("slices", "slice long", _CALLS)

    def _slice(self, ms: int) -> tuple[int]:
        return (ms // max(1, self.ttl // 1000),)

    def _waiting(self, place: tuple[int]) -> Calls:
        found = self.slices.getValue(place)
        return _told(found[0]) if found else {}

    def _cut(self, calls: Calls) -> None:
        """Puts calls into their slices."""
        parts: dict[tuple[int], Calls] = {}
        for (us, call), told in calls.items():
            parts.setdefault(self._slice(us // 1000), {})[us, call] = told
        for place, part in parts.items():
            kept = self._waiting(place)
            for at, told in part.items():
                _add(kept, *at, *told)
            self.slices.updateValue(place, (_rows(kept),))
            self.handle.registerTimer(min(part)[0] // 1000)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        found = self.one.get()
        *span, sliced, calls = found or (None, None, None, False, [])
        calls, first = _told(calls), None
        for row in rows:
            _add(calls, row.us, row.call_id, row.tool)
            first = row.us if first is None else min(first, row.us)
            if len(calls) > (self.held if sliced else self.few):
                self._cut(calls)
                calls, sliced = {}, True
        if sliced:
            self._cut(calls)
            calls = {}
        elif first is not None:
            self.handle.registerTimer(first // 1000)
        if not sliced or not (found and found[3]):
            self.one.update((*span, sliced, _rows(calls)))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        # nothing before the watermark can come any more: one timer serves all that has passed, of its slice if there are any
        passed = max(due, timerValues.getCurrentWatermarkInMs() - 1)
        found = self.one.get()
        if not found:
            return
        *span, sliced, calls = found
        place = self._slice(due)
        calls = self._waiting(place) if sliced else _told(calls)
        later, opened = {}, False
        for (at, call), (tool, copies) in sorted(calls.items()):
            if at // 1000 > passed:
                later[at, call] = (tool, copies)
                continue
            for _ in range(copies):
                opens = span[0] is None or at - span[0] > self.ttl
                if opens:
                    span, opened = [at, call, tool], True
                yield Row(key=key[0], us=at, call_id=call, tool=tool, opens=opens, first_call=span[1], first_tool=span[2])
        if later and len(later) < len(calls):
            self.handle.registerTimer(min(later)[0] // 1000)
        if sliced and len(later) < len(calls):
            self.slices.updateValue(place, (_rows(later),)) if later else self.slices.removeKey(place)
        if opened:
            self.handle.registerTimer((span[0] + self.ttl) // 1000 + 1)
        over = not opened and span[0] is not None and due * 1000 > span[0] + self.ttl
        if over and not later and not (sliced and self.slices.exists()):
            self.one.clear()
        elif opened or over or not sliced and len(later) < len(calls):
            self.one.update((*([None] * 3 if over else span), sliced, [] if sliced else _rows(later)))

    def close(self) -> None:
        pass


def _tool() -> Column:
    """The tool by an expression of the time, so that filters on it stay above the watermark."""
    return F.when(F.col("ts").isNotNull(), F.col("tool"))


def first_within(calls: DataFrame, key: Column, ttl: int) -> DataFrame:
    """key, us, call_id, tool, opens, first_call, first_tool of calls (call_id, ts, tool) in spans of ``ttl`` seconds.

    The calls have a watermark on ts; it is set before calls are filtered, so that all of them move it on.
    """
    keyed = calls.select(key.alias("key"), F.unix_micros("ts").alias("us"), "call_id", "tool", "ts")
    schema = "key string, us long, call_id long, tool string, opens boolean, first_call long, first_tool string"
    return keyed.groupBy("key").transformWithState(FirstWithin(ttl * 1_000_000), schema, "Append", "EventTime")


def turns(calls: DataFrame, tools: list[str], ttl: int = 1800, late: str = "10 minutes") -> DataFrame:
    """turn, us, call_id, tool, opens, first_tool: each retrieval with the first one of its turn.

    A turn lives ``ttl`` seconds from its first retrieval; a retrieval after that opens it anew.
    """
    found = first_within(calls.withWatermark("ts", late).where(_tool().isin(tools)), F.col("session").cast("string"), ttl)
    return found.select(F.col("key").alias("turn"), "us", "call_id", "tool", "opens", "first_tool")


def executed(calls: DataFrame, tools: list[str], window: int = 600, late: str = "10 minutes") -> DataFrame:
    """call_id, us, tool, runs: applying calls of ``tools`` with one payload run once in ``window`` seconds; others always.

    calls: call_id, ts, tool, mode, payload.  Only calls whose mode is ``apply`` are keyed, by tool and payload.
    """
    # a call without a tool is not guarded
    guarded = _tool().isin(tools) & (F.lower(F.trim(F.coalesce("mode", F.lit("dry_run")))) == F.when(F.col("ts").isNotNull(), "apply"))
    calls = calls.withWatermark("ts", late)
    key = F.concat_ws("|", "tool", F.sha1(F.col("payload").cast("binary")))
    told = first_within(calls.where(guarded), key, window).select("call_id", "us", "tool", F.col("opens").alias("runs"))
    free = calls.where(~F.coalesce(guarded, F.lit(False))).select("call_id", F.unix_micros("ts").alias("us"), "tool", F.lit(True).alias("runs"))
    return told.unionByName(free)
