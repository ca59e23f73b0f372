"""Streams with state and timers: leases on work that expire without a heartbeat, and groups that are emitted once when
all their parts have come.

Both keep a state per key in the state store, so a key's events may be spread over any number of batches and restarts.
The store must be one with column families: call with_store(spark) before the first start.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STALE_SECONDS = 900
LEASE = "spec string, session string, event string, at long"
GROUP = "grp string, n int, parts array<int>, vals array<string>"


def with_store(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


class Leases(StatefulProcessor):
    """Who holds a spec, and until when. A claim on a free spec is granted, one by the holder renews, one by another session
    is refused; a beat of the holder renews, a done by the holder frees. Without either a timer frees the spec."""

    def __init__(self, stale_seconds: float):
        self.stale = int(1000 * stale_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.holder = handle.getValueState("holder", "session string, until long")

    def _renew(self, session: str, now: int) -> None:
        if self.holder.exists():
            self.handle.deleteTimer(self.holder.get()[1])
        self.holder.update((session, now + self.stale))
        self.handle.registerTimer(now + self.stale)

    def _free(self) -> None:
        self.handle.deleteTimer(self.holder.get()[1])
        self.holder.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentProcessingTimeInMs(), []
        events = pd.concat(list(rows)).sort_values(["at", "session", "kind"])
        for session, kind in zip(events["session"], events["kind"], strict=True):
            holder = self.holder.get()[0] if self.holder.exists() else None
            if kind == "claim" and holder is None:
                self._renew(session, now)
                out.append((session, "granted"))
            elif holder != session:
                out.append((session, "refused"))
            elif kind == "done":
                self._free()
                out.append((session, "released"))
            else:
                self._renew(session, now)
                out.append((session, "renewed"))
        yield pd.DataFrame([(key[0], s, e, now) for s, e in out], columns=["spec", "session", "event", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.holder.exists():
            return
        session, until = self.holder.get()
        if until <= expiredTimerInfo.getExpiryTimeInMs():
            self.holder.clear()
            yield pd.DataFrame([(key[0], session, "expired", timerValues.getCurrentProcessingTimeInMs())], columns=["spec", "session", "event", "at"])

    def close(self) -> None:
        pass


def leases(events: DataFrame, stale_seconds: float = STALE_SECONDS) -> DataFrame:
    """spec, session, event (granted, renewed, refused, released, expired), at (ms) from a stream of (spec, session, kind:
    claim, beat or done, at). Null specs, sessions and kinds go."""
    own = events.select("spec", "session", "kind", "at").where("spec IS NOT NULL AND session IS NOT NULL AND kind IN ('claim', 'beat', 'done')")
    return own.groupBy("spec").transformWithStateInPandas(Leases(stale_seconds), LEASE, "append", "processingTime")


class Completion(StatefulProcessor):
    """The parts of a group as they come; the group is emitted with the last of them, and only then."""

    def __init__(self, forget_seconds: float | None):
        self.ttl = None if forget_seconds is None else int(1000 * forget_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getMapState("parts", "part int", "value string", self.ttl)
        self.emitted = handle.getValueState("emitted", "done boolean", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        wanted = None
        done = self.emitted.exists()
        for batch in rows:
            if done:
                continue
            for part, value, n in zip(batch["part"], batch["value"], batch["n"], strict=True):
                wanted = int(n)
                if not self.parts.containsKey((int(part),)):  # the first value of a part counts
                    self.parts.updateValue((int(part),), (value,))
        if done or wanted is None:
            return
        held = sorted((k[0], v[0]) for k, v in self.parts.iterator())
        if len(held) >= wanted:
            self.emitted.update((True,))
            self.parts.clear()
            yield pd.DataFrame([(key[0], wanted, [k for k, _ in held], [v for _, v in held])], columns=["grp", "n", "parts", "vals"])

    def close(self) -> None:
        pass


def complete_once(parts: DataFrame, forget_seconds: float | None = None) -> DataFrame:
    """grp, n, parts, vals of each group of (grp, part, value, n) once all its n different parts have come; later and
    repeated parts change nothing. Groups are forgotten after forget_seconds without a part, if given."""
    own = parts.select("grp", "part", "value", "n").where("grp IS NOT NULL AND part IS NOT NULL AND n IS NOT NULL")
    return own.groupBy("grp").transformWithStateInPandas(Completion(forget_seconds), GROUP, "append", "processingTime" if forget_seconds is not None else "none")
