import random
from datetime import datetime, timedelta

from lotlens.streaming.watch import watched_alerts

SCHEMA = "key bigint, op string, kind string, event_id bigint, at timestamp"


def brute(batches, silence, delay):
    """Row by row, with the watermark of the batches before."""
    top, changes, alerted, out = None, {}, {}, []
    for batch in batches:
        mark = top - delay if top else datetime(1970, 1, 1)
        rows = [r for r in batch if r[0] is not None and r[4] is not None and r[4] > mark]
        rows.sort(key=lambda r: (r[4], r[1] == "event", r[1], r[2] or "", r[3] or 0))
        for key, op, _, _, at in rows:
            if op != "event":
                changes.setdefault(key, []).append((at, op == "watch"))
        for key, op, kind, event_id, at in rows:
            before = [on for t, on in sorted(changes.get(key, []), key=lambda c: c[0]) if t <= at]
            if op == "event" and before and before[-1]:
                name = (key, kind, event_id)
                if name not in alerted or alerted[name] + silence < at:
                    alerted[name] = at
                    out.append((*name, at))
        top = max([x for x in [top, *(r[4] for r in batch if r[0] is not None and r[4] is not None)] if x])
    return sorted(out)


def test_alerts_over_five_batches_and_restarts(spark, tmp_path):
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    batches = [[(None, "watch", None, None, start), (0, "event", "a", 1, None), *[(k, "watch", None, None, start) for k in range(6)]]]
    for b in range(5):
        day = start + timedelta(days=4 * b)
        rows = [(rng.randrange(8), "event", rng.choice("ab"), rng.randrange(6), day + timedelta(hours=rng.randrange(-72, 96))) for _ in range(60)]
        rows += [(rng.randrange(8), rng.choice(["watch", "unwatch"]), None, None, day + timedelta(hours=rng.randrange(0, 96), minutes=1 + k)) for k in range(4)]
        rows += rng.sample(rows[:60], 10)  # pulled twice
        batches[min(b, len(batches) - 1) if b == 0 else b : b + 1] = [batches[0] + rows] if b == 0 else [rows]
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        q = watched_alerts(stream, "5 days", "1 day").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == brute(batches, timedelta(days=5), timedelta(days=1)) and len(got) > 30


def test_batches_of_a_replay_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    """A pull written by one task would put it whole into that task."""
    from lotlens.plans import catalog, streams

    monkeypatch.setattr(streams, "scratch", lambda _: str(tmp_path))
    assert catalog.QUERIES["late_window_replay"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(list((tmp_path / "in").glob("part-*"))) > 5
