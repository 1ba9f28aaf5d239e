"""Held bodies as a stream: handles whose state expires by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.functions import vocab as V

_DAY_MS = 86_400_000


class HeldBodies(StatefulProcessor):
    """One handle: when it was put or read last, and whether it is held or a tomb.

    Rows are (handle, kind, tool, chars, ts), kind ``put`` or ``read``. Each gives a
    row (handle, action, tool, chars, ts): held, touched or revived for a put;
    touched, expired or missing for a read. A handle that was not touched for
    ``ttl_days`` ends by a timer (action swept, with the time of its last touch); its
    tomb is forgotten ``tomb_days`` later, and the handle is unknown from then on.
    Rows of a batch are taken in order of their time, so a handle that was too old
    when it was touched is swept first even if its timer has not fired yet.
    """

    def __init__(self, ttl_days: int = V.TTL_DAYS, tomb_days: int = 30):
        self.ttl, self.tomb = ttl_days * _DAY_MS, tomb_days * _DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("body", "touched long, tool string, chars long, live boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values(["ts", "kind"])
        now = self.state.get() if self.state.exists() else None
        out = []
        for kind, tool, chars, ts in every[["kind", "tool", "chars", "ts"]].itertuples(index=False):
            at = int(ts.value // 1_000_000)
            if now and now[3] and at - now[0] > self.ttl:
                out.append(("swept", now[1], now[2], now[0]))
                now = (*now[:3], False)
            if kind == "put":
                out.append(("held" if now is None else "touched" if now[3] else "revived", tool, int(chars), at))
                now = (max(at, now[0]) if now and now[3] else at, tool, int(chars), True)
            elif now and now[3]:
                out.append(("touched", now[1], now[2], at))
                now = (max(at, now[0]), *now[1:])
            else:
                out.append(("expired", now[1], now[2], at) if now else ("missing", None, None, at))
        if now:
            self.state.update(now)
            self._wake(now[0] + self.ttl + (0 if now[3] else self.tomb))
        yield self._rows(key, out)

    def _wake(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at + 1)

    def _rows(self, key, out: list[tuple]) -> pd.DataFrame:
        actions, tools, chars, times = zip(*out, strict=True) if out else ((), (), (), ())
        return pd.DataFrame(
            {
                "handle": [key[0]] * len(out), "action": list(actions), "tool": list(tools),
                "chars": pd.array(chars, dtype="Int64"), "ts": pd.to_datetime(pd.Series(times, dtype="int64"), unit="ms"),
            }
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        touched, tool, chars, live = self.state.get()
        if live:
            self.state.update((touched, tool, chars, False))
            self._wake(touched + self.ttl + self.tomb)
            yield self._rows(key, [("swept", tool, chars, touched)])
        else:
            self.state.clear()

    def close(self) -> None:
        pass


def held_stream(events: DataFrame, delay: str = "1 hour", ttl_days: int = V.TTL_DAYS, tomb_days: int = 30) -> DataFrame:
    """What becomes of a stream of puts and reads, see ``HeldBodies``. Needs the RocksDB state store."""
    timed = events.withWatermark("ts", delay)
    schema = "handle string, action string, tool string, chars long, ts timestamp"
    return timed.groupBy("handle").transformWithStateInPandas(HeldBodies(ttl_days, tomb_days), schema, "Append", "EventTime")
