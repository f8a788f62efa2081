"""Streams of access and push events: breadth windows, coalesced pushes, idempotent jobs, sessions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

REPOS, MODULES, WINDOW_MS = 40, 150, 3_600_000


def hourly_breadth(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Touches by hour and caller, streaming or batch: calls, and distinct repositories by sketch."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "principal").agg(F.count("*").alias("calls"), F.approx_count_distinct("repo", 0.02).alias("repos"))


def exact_hourly_breadth(events: DataFrame) -> DataFrame:
    """Batch: hour, principal, calls, distinct repositories."""
    return events.groupBy(F.date_trunc("hour", "ts").alias("hour"), "principal").agg(F.count("*").alias("calls"), F.countDistinct("repo").alias("repos"))


def breadth_alerts(events: DataFrame, repos: int = REPOS, modules: int = MODULES, window_ms: int = WINDOW_MS) -> DataFrame:
    """One alert a window when a caller has touched too many repositories or modules.

    A window starts at a caller's first event and the first after it has run out, so it is
    state and not a grid of hours. State holds at most as many names as the limits need and
    times out with the window by event time.
    """

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, held, seen, calls, told = (0, set(), set(), 0, False)
        if state.exists:
            start, a, b, calls, told = state.get
            held, seen = set(json.loads(a)), set(json.loads(b))
        out = []
        for pdf in batches:
            for ms, repo, module in sorted(zip((pdf["ts"].astype("int64") // 1_000_000 if str(pdf["ts"].dtype).endswith("[ns]") else pdf["ts"].astype("datetime64[ns]").astype("int64") // 1_000_000).tolist(), pdf["repo"].tolist(), pdf["module"].tolist())):
                if not start or ms - start > window_ms:
                    start, held, seen, calls, told = ms, set(), set(), 0, False
                calls += 1
                if not told:
                    held.add(str(repo)), seen.add(str(module))
                    if len(held) >= repos or len(seen) >= modules:
                        told = True
                        out.append((key[0], len(held), len(seen), calls))
        state.update((start, json.dumps(sorted(held)), json.dumps(sorted(seen)), calls, told))
        state.setTimeoutTimestamp(max(start + window_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["principal", "repos", "modules", "calls"])

    return events.withWatermark("ts", "10 minutes").groupBy("principal").applyInPandasWithState(watch, "principal string, repos long, modules long, calls long", "start long, repos string, modules string, calls long, told boolean", "append", GroupStateTimeout.EventTimeTimeout)


def coalesced_pushes(pushes: DataFrame, gap: str = "60 seconds", late: str = "60 seconds") -> DataFrame:
    """The last push of each run of pushes to a (repo, ref) without a gap; emitted after the gap in a stream."""
    rows = pushes.withWatermark("ts", late) if pushes.isStreaming else pushes
    return rows.groupBy(F.session_window("ts", gap), "repo", "ref").agg(F.max_by("sha", "ts").alias("sha"), F.count("*").alias("pushes")).select("repo", "ref", F.col("session_window.start").alias("first"), "sha", "pushes")


def once(jobs: DataFrame, key: str = "job_id", keep: str = "24 hours") -> DataFrame:
    """Jobs whose id was not seen within the time that ids are kept."""
    return jobs.withWatermark("ts", keep).dropDuplicatesWithinWatermark([key]) if jobs.isStreaming else jobs.dropDuplicates([key])


def bounded_sessions(events: DataFrame, idle: str = "30 minutes", most_seconds: int = 8 * 3600) -> DataFrame:
    """Sessions by idle gap that also end a fixed time after they began: principal, start, events.

    An event past that time opens a session of its own. Events of a principal stream through
    one task in the order of time, which carries the open session only. Events without a
    time are in none; those without a principal share their sessions.
    """
    kind, most = dict(events.dtypes)["principal"], most_seconds * 1_000_000
    w = Window.partitionBy("who").orderBy("at")
    rows = events.where("ts is not null").select(F.col("principal").cast("string").alias("who"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    rows = rows.withColumn("fresh", F.coalesce(F.timestamp_micros("at") >= F.timestamp_micros(F.lag("at").over(w)) + F.expr(f"interval {idle}"), F.lit(True)))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list | None = None  # principal, start, events
        for pdf in batches:
            out = []
            for who, at, fresh in zip(pdf["who"], pdf["at"].tolist(), pdf["fresh"].tolist()):
                # The first event of a principal is fresh, so a new principal always opens a session.
                if fresh or at - held[1] >= most:
                    out += [held] if held else []
                    held = [who, at, 0]
                held[2] += 1
            yield pd.DataFrame(out, columns=["who", "start", "events"])
        yield pd.DataFrame([held] if held else [], columns=["who", "start", "events"])

    # The window leaves each principal's rows in one task and in order.
    return rows.mapInPandas(fold, "who string, start long, events long").select(F.col("who").cast(kind).alias("principal"), F.timestamp_micros("start").alias("start"), "events")


def cached_permissions(requests: DataFrame, snapshots: DataFrame, ttl_seconds: int = 300, hard_seconds: int = 3600) -> DataFrame:
    """requests (principal, ts, request_id) with the permissions of the last snapshot before: fresh, stale or expired by its age.

    Requests and snapshots of a principal are one ordered run, so there is no join on times.
    """
    a = requests.select("principal", "ts", "request_id", F.lit(None).cast(dict(snapshots.dtypes)["permissions"]).alias("permissions"), F.lit(1).alias("_is"))
    b = snapshots.select("principal", "ts", F.lit(None).cast(dict(requests.dtypes)["request_id"]).alias("request_id"), "permissions", F.lit(0).alias("_is"))
    w = Window.partitionBy("principal").orderBy("ts", "_is").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_last", F.last(F.when(F.col("_is") == 0, F.struct("ts", "permissions")), ignorenulls=True).over(w)).where("_is = 1")
    age = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_last.ts").cast("timestamp"))) / 1e6
    state = F.when(F.col("_last").isNull() | (age > hard_seconds), "expired").when(age > ttl_seconds, "stale").otherwise("fresh")
    return both.select("request_id", "principal", state.alias("state"), F.when(state != "expired", F.col("_last.permissions")).alias("permissions"))


def sessions(events: DataFrame, idle: str = "30 minutes") -> DataFrame:
    """Sessions by idle gap: principal, start, end, events."""
    return events.groupBy(F.session_window("ts", idle), "principal").agg(F.count("*").alias("events")).select("principal", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")
