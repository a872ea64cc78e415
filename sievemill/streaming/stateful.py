"""Streaming jobs that keep a state for each key: what a validation changes in its file, and claims of files that meet.

State is typed maps and values of transformWithState with timers in event time, so only what a batch changes is written. Streams need the state store that keeps such state:
spark.sql.streaming.stateStore.providerClass = STORE."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ARRIVED = "event_id long, resolved string, new string, stayed int, running map<string,int>, regression boolean"
ALERTS = "event_id long, file_path string, session_id string, other string, severity string"


class Keyed(StatefulProcessor):
    """A map and a value for each key, which are forgotten `keep` seconds of event time after the key's last row."""

    MAP: tuple[str, str]
    VALUE: str

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.map = handle.getMapState("map", *self.MAP)
        self.value = handle.getValueState("value", f"until long, {self.VALUE}")

    def read(self) -> tuple[dict, tuple | None]:
        return {k[0]: tuple(v) for k, v in self.map.iterator()}, tuple(self.value.get()) if self.value.exists() else None

    def write(self, before: dict, now: dict, last: float, *value) -> None:
        """Write what has changed, and set the timer anew."""
        for name in before.keys() - now.keys():
            self.map.removeKey((name,))
        for name, entry in now.items():
            if before.get(name) != entry:
                self.map.updateValue((name,), entry)
        until = int(1000 * (last + self.keep)) + 1
        if self.value.exists():
            until = max(until, old := self.value.get()[0])
            self.handle.deleteTimer(old)
        self.handle.registerTimer(until)
        self.value.update((until, *value))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the names that Spark calls
        self.map.clear()
        self.value.clear()
        return iter(())

    def close(self) -> None:
        pass


class Arrivals(Keyed):
    MAP, VALUE = ("rule string", "n int"), "security boolean"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        before, value = self.read()
        runs, out = before, []
        until, security = value or (None, None)
        for event, ts, rules, found in zip(frame["event_id"], frame["ts"], frame["rules"], frame["has_security"], strict=True):
            if until is None or 1000 * ts.timestamp() > until:
                runs, security = {}, None
            now = {r: (runs.get(r, (0,))[0] + 1,) for r in sorted(rules)}
            if security is not None:
                stayed = {r: n for r, (n,) in now.items() if r in runs}
                out.append((event, ",".join(sorted(runs.keys() - now.keys())), ",".join(r for r in now if r not in runs), len(stayed), stayed, bool(found) and not security))
            runs, security, until = now, bool(found), 1000 * (ts.timestamp() + self.keep) + 1
        self.write(before, runs, frame["ts"].max().timestamp(), security)
        yield pd.DataFrame(out, columns=["event_id", "resolved", "new", "stayed", "running", "regression"])


class Claims(Keyed):
    MAP, VALUE = ("session string", "kind string, at double"), "claims int"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        before, _ = self.read()
        held, out = dict(before), []
        for event, session, ts, kind in zip(frame["event_id"], frame["session_id"], frame["ts"], frame["kind"], strict=True):
            at = ts.timestamp()
            held = {s: c for s, c in held.items() if at - c[1] <= self.keep}
            if kind == "end":
                held.pop(session, None)
                continue
            for other, (their, _) in sorted(held.items()):
                if other != session and "write" in (kind, their):
                    out.append((event, key[0], session, other, "warning" if kind == their else "info"))
            held[session] = ("write" if "write" in (kind, held.get(session, [""])[0]) else kind, at)
        self.write(before, held, frame["ts"].max().timestamp(), len(held))
        yield pd.DataFrame(out, columns=["event_id", "file_path", "session_id", "other", "severity"])


def arrivals(validations: DataFrame, late: str = "1 day", forget: int = 30 * 86_400) -> DataFrame:
    """event_id, resolved, new, stayed, running, regression of each validation against the file's one before, as it arrives: rules that it resolves, brings and keeps, how many validations
    running each kept rule has been met, and whether a security finding is new to the file.

    State: a file's last rules with their run lengths; forgotten `forget` seconds of event time after its last validation. The first validation of a file, or after it was forgotten, gives
    no row. Within a batch, events go by ts, then event_id."""
    keyed = validations.withWatermark("ts", late).groupBy("session_id", "file_path")
    return keyed.transformWithStateInPandas(Arrivals(forget), outputStructType=ARRIVED, outputMode="Append", timeMode="EventTime")


def claim_alerts(claims: DataFrame, late: str = "1 hour", live: int = 1800) -> DataFrame:
    """event_id, file_path, session_id, other, severity: claims (event_id, file_path, session_id, ts, kind: write, read or end) that meet another session's live claim of the file. Two
    writes are a warning; a write and a read, either first, an info; two reads are none.

    State: a file's live claims, one a session (a write outweighs a read). A session's end releases its claim; so do `live` seconds."""
    keyed = claims.withWatermark("ts", late).groupBy("file_path")
    return keyed.transformWithStateInPandas(Claims(live), outputStructType=ALERTS, outputMode="Append", timeMode="EventTime")
