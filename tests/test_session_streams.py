"""Sessions and permissions over several batches, stopped and started again from the checkpoint, beside plain loops."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.streaming import sessions

ZERO = datetime.datetime(2024, 1, 1)
KEY = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(KEY)
    spark.conf.set(KEY, sessions.STATE_STORE)
    yield spark
    spark.conf.set(KEY, before)


def at(ms):
    return ZERO + datetime.timedelta(milliseconds=ms)


def drain(spark, build, batches, schema, folder):
    """Each batch in a run of its own: the query is stopped and resumes from its checkpoint."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = build(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        run = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start(f"{folder}/out")
        run.awaitTermination(120)
        run.stop()
    return spark.read.parquet(f"{folder}/out").collect()


def ends(calls, idle, life, most):
    """A plain loop over all open sessions at every call."""
    out = []
    for who in sorted({c[0] for c in calls}):
        live = {}
        for _, s, ms in sorted((c for c in calls if c[0] == who), key=lambda c: (c[2], c[1])):
            for o, (a, b) in list(live.items()):
                stop = min(b + idle, a + life)
                if stop < ms:
                    out.append((who, o, a, stop, "idle" if b + idle <= a + life else "lifetime"))
                    del live[o]
            if s not in live and len(live) == most:
                o = sorted(live, key=lambda o: (live[o][1], o))[0]
                out.append((who, o, live.pop(o)[0], ms, "evicted"))
            live[s] = (live.get(s, (ms, ms))[0], ms)
        for o, (a, b) in live.items():
            out.append((who, o, a, min(b + idle, a + life), "idle" if b + idle <= a + life else "lifetime"))
    return sorted(out)


def test_session_ends_of_a_table_and_a_stream(rocks, tmp_path):
    rng = random.Random(8)
    idle, life, most = 60_000, 90_000, 3
    calls = [(f"p{rng.randrange(3)}", f"s{rng.randrange(4)}", 9_000_000 + k * 4000 + rng.randrange(3000)) for k in range(240)]
    base = int(ZERO.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
    want = sorted((w, s, a + base, b + base, why) for w, s, a, b, why in ends(calls, idle, life, most))
    assert {w[4] for w in want} == {"idle", "lifetime", "evicted"}
    schema = "principal string, session_id string, ts timestamp"
    rows = [(p, s, at(ms)) for p, s, ms in calls]
    table = rocks.createDataFrame([*rows, (None, "s", at(1)), ("p", None, at(1)), ("p", "s", None)], schema)
    assert sorted(map(tuple, sessions.session_ends(table, idle, life, most).collect())) == want
    assert sessions.session_ends(table.where("false")).count() == 0
    # Batches in the order of time; late rows would only move ends in a stream.
    rows.sort(key=lambda r: r[2])
    far = ("far", "x", at(9_000_000 + 10_000_000))
    got = drain(rocks, lambda s: sessions.session_stream(s, "0 seconds", idle, life, most), [rows[:90], rows[90:160], rows[160:], [far], [(*far[:2], far[2] + datetime.timedelta(seconds=1))]], schema, str(tmp_path))
    assert sorted(tuple(r) for r in got if r.principal != "far") == want


def test_permissions_ask_the_deny_list_on_each_call(rocks, tmp_path):
    schema = "principal string, ts timestamp, kind string, request_id string, permissions array<string>"
    s = lambda sec: at(9_000_000 + sec * 1000)
    batches = [
        [("p", s(0), "snapshot", None, ["a", "b"]), ("p", s(10), "request", "r1", None), ("q", s(11), "request", "r2", None)],
        [("p", s(20), "request", "r4", None), ("p", s(20), "deny", None, ["b"]), ("p", s(15), "request", "r3", None), ("p", s(400), "request", "r5", None)],
        [("p", s(500), "snapshot", None, ["a", "b", "c"]), ("p", s(501), "request", "r6", None), ("p", s(510), "allow", None, ["b"]), ("p", s(511), "request", "r7", None)],
        [("q", s(9000), "request", "r8", None), (None, s(9000), "request", "none", None)],
        [("p", s(9001), "request", "r9", None)],
    ]
    got = drain(rocks, sessions.permission_stream, batches, schema, str(tmp_path))
    assert {r.request_id: (r.state, r.permissions) for r in got} == {"r1": ("fresh", ["a", "b"]), "r2": ("expired", None), "r3": ("fresh", ["a", "b"]), "r4": ("fresh", ["a"]), "r5": ("stale", ["a"]), "r6": ("fresh", ["a", "c"]), "r7": ("fresh", ["a", "b", "c"]), "r8": ("expired", None), "r9": ("expired", None)}
    assert len(got) == 9


def test_bounded_sessions_beside_a_loop(spark):
    from corpusloom.streaming.access import bounded_sessions

    rng = random.Random(6)
    rows = [(rng.choice([None, 1, 2**60 + 1]), at(rng.randrange(40) * 600_000)) for _ in range(150)]
    want, held = [], {}
    for who, ts in sorted(rows, key=lambda r: r[1]):
        s = held.get(who)
        if s is None or ts - s[1] >= datetime.timedelta(minutes=30) or ts - s[0] >= datetime.timedelta(hours=2):
            want.append(s := [ts, ts, 0, who])
            held[who] = s
        s[1], s[2] = ts, s[2] + 1
    x = spark.createDataFrame([*rows, (1, None)], "principal long, ts timestamp")
    found = bounded_sessions(x, "30 minutes", 7200)
    assert sorted((str(r.principal), r.start, r.events) for r in found.collect()) == sorted((str(w[3]), w[0], w[2]) for w in want)
    assert bounded_sessions(x.where("false")).count() == 0
