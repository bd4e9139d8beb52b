"""Alerts with state: a watchlist that changes while the stream runs, repeats forgotten after a while, restarts.

One stream carries changes of the watchlist and events. Per key the state holds the changes (when, on or off) and the
events alerted (until when a repeat is silent), so an event's fate depends on times and not on how rows fall into
batches: it raises an alert if the last change at or before its time is "watch", it is not late, and no earlier alert
of the same kind and id is at most `silence` older. Entries leave the state when the watermark has passed them; a key
without entries has no state.

Late rows (at or before the watermark, which trails the latest time of the batches before by `delay`) are dropped by
Spark. Of a key's rows in one batch, changes come first at equal times, then events by kind and id. Rows without a
time or a key are dropped.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "key bigint, kind string, event_id bigint, at timestamp"


def _settled(changes: list[list[int]], watermark: int) -> list[list[int]]:
    """Without the changes that a later one at or before the watermark replaces."""
    old = [c for c in changes if c[0] <= watermark]
    return old[-1:] + [c for c in changes if c[0] > watermark] if old and old[-1][1] else [c for c in changes if c[0] > watermark]


def watched_alerts(rows: DataFrame, silence: str, delay: str) -> DataFrame:
    """key, kind, event_id, at of the alerts of a stream (key, op: watch, unwatch or event, kind, event_id, at)."""
    seconds = int(pd.Timedelta(silence).total_seconds())

    def run(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs() // 1000
        changes, alerted = (json.loads(x) for x in state.get) if state.exists else ([], {})
        if not state.hasTimedOut:
            # plain lists: a key has few rows, for which a frame's own steps cost more than the work
            new, events = [], []
            for part in parts:
                at = part["at"]
                rows = zip(at.astype("datetime64[s]").astype("int64").tolist(), part["op"].tolist(), part["kind"].tolist(), part["event_id"].tolist(), at.tolist())
                for second, op, kind, event_id, moment in rows:
                    if op == "event":
                        events.append((second, kind, event_id, moment))
                    else:
                        new.append((second, op))
            changes += [[second, int(op == "watch")] for second, op in sorted(new)]
            changes.sort(key=lambda c: c[0])
            moments = [at for at, _ in changes]
            out = []
            for second, kind, event_id, moment in sorted(events, key=lambda e: e[:3]):
                known = bisect_right(moments, second)
                name = f"{kind}|{event_id}"
                if known and changes[known - 1][1] and alerted.get(name, -1) < second:
                    alerted[name] = second + seconds
                    out.append((int(key[0]), kind, int(event_id), moment))
            if out:
                yield pd.DataFrame(out, columns=["key", "kind", "event_id", "at"])
        changes, alerted = _settled(changes, watermark), {k: v for k, v in alerted.items() if v > watermark}
        if not changes and not alerted:
            state.remove()
            return
        state.update((json.dumps(changes), json.dumps(alerted)))
        # the next time at which an entry can go
        waits = [*alerted.values(), *[at for at, _ in changes]]
        state.setTimeoutTimestamp(1000 * (max(watermark, min((x for x in waits if x > watermark), default=watermark + seconds)) + 1))

    timed = rows.filter("key is not null and at is not null").withColumn("kind", F.coalesce("kind", F.lit(""))).withColumn("event_id", F.coalesce("event_id", F.lit(0)).cast("bigint")).withWatermark("at", delay)
    return timed.groupBy("key").applyInPandasWithState(run, OUTPUT, "changes string, alerted string", "append", GroupStateTimeout.EventTimeTimeout)
