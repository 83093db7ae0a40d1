"""Live session operators against plain folds: order within the delay, late events, bounded state, restarts."""

import random
from datetime import datetime, timedelta

from tallgrass.streaming import sessions

T0 = datetime(2026, 1, 1)
SCHEMA = "session_id string, timestamp timestamp, id long, event_type string"


def made(seed, n):
    rnd = random.Random(seed)
    kinds = ["suggested"] * 4 + ["accepted", "rejected", "partially_accepted"]
    return [(f"s{rnd.randrange(5)}", T0 + timedelta(seconds=2 * k + rnd.randrange(3), milliseconds=rnd.randrange(900)), k, rnd.choice(kinds)) for k in range(n)]


def ignored(events):
    shown, out = {}, []
    for s, at, i, kind in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        if kind == "suggested" and s in shown:
            out.append((s, shown.pop(s), at))
        if kind == "suggested":
            shown[s] = i
        elif kind in ("accepted", "rejected"):
            shown.pop(s, None)
    return sorted(out)


def batches(events, most, seconds, now):
    out, held = [], {}
    done = {}

    def send(s):
        b = held.pop(s)
        out.append((s, done.get(s, 0), len(b), b[0], b[-1]))
        done[s] = done.get(s, 0) + 1

    for s, at, _, _ in sorted(events, key=lambda e: (e[1], e[2])):
        if s in held and (at - held[s][0]).total_seconds() >= seconds:
            send(s)
        held.setdefault(s, []).append(at)
        if len(held[s]) == most:
            send(s)
    for s in [s for s, b in held.items() if b[0] + timedelta(seconds=seconds) < now - timedelta(milliseconds=1)]:
        send(s)
    return sorted(out)


def run(spark, base, parts, make):
    """Files in one after another, a micro-batch each; the query is stopped and started again after every one."""
    rows = []
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = make(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"))
        write = lambda df, epoch: rows.extend(map(tuple, df.collect()))
        query = stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        progress = query.recentProgress
    return sorted(rows), progress


def test_ignored_in_any_order_within_the_delay(spark, tmp_path):
    events = made(1, 150)
    shaken = sorted(events, key=lambda e: e[1] + timedelta(seconds=random.Random(e[2]).randrange(40)))
    parts = [shaken[k : k + 50] for k in range(0, 150, 50)]
    got, progress = run(spark, str(tmp_path), parts, lambda e: sessions.live_ignored(e, "60 seconds"))
    final = max(e[1] for e in events) - timedelta(seconds=60)
    assert got == ignored([e for e in events if e[1] < final.replace(microsecond=final.microsecond // 1000 * 1000)]) and len(got) > 20
    assert sum(s.numRowsTotal for s in progress[-1].stateOperators) < 150  # events that are done are gone


def test_late_events_are_dropped(spark, tmp_path):
    events = made(2, 60)
    late = [("s0", T0 - timedelta(hours=2), 900 + k, "suggested") for k in range(3)]
    odd = [("s1", None, 990, "suggested"), (None, T0, 991, "suggested")]
    ends = [("s9", T0 + timedelta(hours=9), 999, "suggested")]
    got, _ = run(spark, str(tmp_path), [events, late + odd + ends], lambda e: sessions.live_ignored(e, "10 seconds"))
    assert got == ignored(events)


def test_batches_of_clients(spark, tmp_path):
    events = made(3, 120)
    parts = [events[:70], events[70:]]
    got, _ = run(spark, str(tmp_path), parts, lambda e: sessions.live_batches(e, 3, 15.0, "20 seconds"))
    final = max(e[1] for e in events) - timedelta(seconds=20)
    final = final.replace(microsecond=final.microsecond // 1000 * 1000)
    assert got == batches([e for e in events if e[1] < final], 3, 15.0, final) and {r[2] for r in got} >= {1, 3}
