"""Sessions and cached permissions with state: limits on idle time, lifetime and number, and a deny list asked on each call.

The streams need the RocksDB state store: set ``spark.sql.streaming.stateStore.providerClass``
to ``STATE_STORE``. What they keep of a principal is bounded by its sessions or its repositories.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Milliseconds of idleness and of a whole session, and sessions of one principal.
IDLE_MS, LIFE_MS, MOST = 30 * 60_000, 8 * 3_600_000, 5
ENDS = "principal string, session_id string, began long, ended long, reason string"


class Register:
    """The open sessions of one principal: {session: [began, last call]} in milliseconds."""

    def __init__(self, held: dict[str, list[int]], idle: int = IDLE_MS, life: int = LIFE_MS, most: int = MOST):
        self.held, self.idle, self.life, self.most = held, idle, life, most

    def deadline(self, session: str) -> tuple[int, str]:
        """When a session ends if nothing is called, and why; both limits at once count as idleness."""
        began, last = self.held[session]
        return min((last + self.idle, "idle"), (began + self.life, "lifetime"))

    def expire(self, now: int) -> list[tuple[str, int, int, str]]:
        """Sessions that ended before now, in the order of their ends."""
        due = sorted((*self.deadline(s), s) for s in self.held if self.deadline(s)[0] < now)
        return [(s, self.held.pop(s)[0], at, why) for at, why, s in due]

    def call(self, session: str, now: int) -> list[tuple[str, int, int, str]]:
        """A call: what ended before it, and the session that makes room for a new one, longest without a call."""
        out = self.expire(now)
        if session in self.held:
            self.held[session][1] = max(self.held[session][1], now)
            return out
        if len(self.held) >= self.most:
            oldest = min(self.held, key=lambda s: (self.held[s][1], s))
            out.append((oldest, self.held.pop(oldest)[0], now, "evicted"))
        self.held[session] = [now, now]
        return out


def _calls(pdf: pd.DataFrame) -> Iterable[tuple[int, str]]:
    return sorted(zip(pdf["at_ms"].tolist(), pdf["session_id"].tolist()))


class _Sessions(StatefulProcessor):
    """Keeps the register in map state and one timer a principal, at the first deadline that may be due."""

    def __init__(self, idle: int, life: int, most: int):
        self.limits = (idle, life, most)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("sessions", "session_id string", "began long, last long")
        self.armed = handle.getValueState("armed", "at long")

    def _register(self) -> Register:
        return Register({k[0]: [v[0], v[1]] for k, v in self.open.iterator()}, *self.limits)

    def _keep(self, old: dict[str, list[int]], register: Register, fired: bool) -> None:
        for s in old.keys() - register.held.keys():
            self.open.removeKey((s,))
        for s, v in register.held.items():
            if old.get(s) != v:
                self.open.updateValue((s,), tuple(v))
        armed = None if fired or not self.armed.exists() else self.armed.get()[0]
        wanted = min((register.deadline(s)[0] for s in register.held), default=None)
        # Calls only move deadlines on: a timer that comes too early is set again when it fires.
        if wanted is not None and (armed is None or wanted < armed):
            if armed is not None:
                self.handle.deleteTimer(armed)
            self.handle.registerTimer(wanted + 1)
            self.armed.update((wanted + 1,))
        elif fired:
            self.armed.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        register = self._register()
        old = {s: list(v) for s, v in register.held.items()}
        ended: list[tuple] = []
        # Rows of a batch come in no order; those of one principal in one batch are sorted here.
        for ms, session in _calls(pd.concat([pdf[["at_ms", "session_id"]] for pdf in rows])):
            ended += register.call(session, ms)
        self._keep(old, register, False)
        yield _ends(key[0], ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        register = self._register()
        old = {s: list(v) for s, v in register.held.items()}
        ended = register.expire(expiredTimerInfo.getExpiryTimeInMs())
        self._keep(old, register, True)
        yield _ends(key[0], ended)


def _ends(principal: str, ended: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(principal, *e) for e in ended], columns=["principal", "session_id", "began", "ended", "reason"])


def _timed(calls: DataFrame) -> DataFrame:
    """calls with their milliseconds; those without principal, session or time belong to no session."""
    return calls.where("principal is not null and session_id is not null and ts is not null").select(F.col("principal").cast("string").alias("principal"), F.col("session_id").cast("string").alias("session_id"), "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))


def session_stream(calls: DataFrame, late: str = "1 minute", idle: int = IDLE_MS, life: int = LIFE_MS, most: int = MOST) -> DataFrame:
    """The ends of sessions of a stream of calls (principal, session_id, ts): idle, lifetime, or evicted.

    Idle and lifetime are by event time, so a session ends when the watermark has passed its deadline.
    The calls of one principal in one micro-batch are sorted in memory: bound the size of a trigger at the source.
    """
    rows = _timed(calls).withWatermark("ts", late)
    return rows.groupBy("principal").transformWithStateInPandas(_Sessions(idle, life, most), ENDS, "Append", "EventTime")


def session_ends(calls: DataFrame, idle: int = IDLE_MS, life: int = LIFE_MS, most: int = MOST) -> DataFrame:
    """The same of a table, with the sessions still open at a principal's last call by their deadline.

    Calls of a principal stream through one task in the order of time; it holds the register only.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, register = None, Register({}, idle, life, most)
        for pdf in batches:
            parts = []
            for principal, ms, session in zip(pdf["principal"], pdf["at_ms"].tolist(), pdf["session_id"]):
                if principal != who:
                    parts += [(who, *e) for e in register.expire(1 << 62)]
                    who, register = principal, Register({}, idle, life, most)
                parts += [(who, *e) for e in register.call(session, ms)]
            yield pd.DataFrame(parts, columns=["principal", "session_id", "began", "ended", "reason"])
        yield _ends(who, register.expire(1 << 62))

    rows = _timed(calls).select("principal", "at_ms", "session_id").repartition("principal").sortWithinPartitions("principal", "at_ms", "session_id")
    return rows.mapInPandas(run, ENDS)


ANSWERS = "principal string, request_id string, state string, permissions array<string>"


class _Permissions(StatefulProcessor):
    """The last snapshot of a principal and the repositories taken from it since."""

    def __init__(self, fresh: int, hard: int):
        self.fresh, self.hard = fresh, hard

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.snapshot = handle.getValueState("snapshot", "at long, permissions array<string>")
        self.denied = handle.getMapState("denied", "repo string", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.snapshot.get() if self.snapshot.exists() else None
        before = held[0] if held else None
        denied = {k[0] for k, _ in self.denied.iterator()}
        out = []
        every = pd.concat(list(rows)).sort_values(["at_ms", "is_request"], kind="stable")
        for ms, kind, request, listed in zip(every["at_ms"].tolist(), every["kind"], every["request_id"], every["permissions"]):
            names = [] if listed is None else list(listed)
            if kind == "snapshot":
                held = (ms, names) if held is None or ms >= held[0] else held
            elif kind == "deny":
                for r in set(names) - denied:
                    self.denied.updateValue((r,), (ms,))
                denied |= set(names)
            elif kind == "allow":
                for r in set(names) & denied:
                    self.denied.removeKey((r,))
                denied -= set(names)
            elif kind == "request":
                age = None if held is None else ms - held[0]
                state = "expired" if age is None or age > self.hard else "stale" if age > self.fresh else "fresh"
                out.append((key[0], request, state, None if state == "expired" else [r for r in held[1] if r not in denied]))
        if held is not None and held[0] != before:
            self.snapshot.update((held[0], held[1]))
            self.handle.registerTimer(held[0] + self.hard + 1)
        yield pd.DataFrame(out, columns=["principal", "request_id", "state", "permissions"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Of several timers only the last snapshot's clears it; denials stay until they are taken back.
        if self.snapshot.exists() and self.snapshot.get()[0] + self.hard < expiredTimerInfo.getExpiryTimeInMs():
            self.snapshot.clear()
        yield pd.DataFrame([], columns=["principal", "request_id", "state", "permissions"])


def permission_stream(rows: DataFrame, late: str = "1 minute", ttl_seconds: int = 300, hard_seconds: int = 3600) -> DataFrame:
    """Answers to the requests in a stream of (principal, ts, kind, request_id, permissions).

    kind is snapshot (the permissions as a provider gave them), deny and allow (repositories
    taken away and given back), or request. A request has the last snapshot's permissions
    without the denied ones: fresh, stale past ttl_seconds, and none, expired, past
    hard_seconds. Denials hold at once, however fresh the snapshot; at one time they and
    snapshots come before requests. Rows without principal or time are left out.
    """
    order = F.when(F.col("kind") == "request", 1).otherwise(0)
    x = rows.where("principal is not null and ts is not null").select(F.col("principal").cast("string").alias("principal"), "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), "kind", order.alias("is_request"), F.col("request_id").cast("string").alias("request_id"), "permissions").withWatermark("ts", late)
    return x.groupBy("principal").transformWithStateInPandas(_Permissions(ttl_seconds * 1000, hard_seconds * 1000), ANSWERS, "Append", "EventTime")
