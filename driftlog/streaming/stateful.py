"""Streams with state of their own: hints replayed when a node is back, token buckets, writes taken once for a time.

Each holds bounded state per key; timeouts are of event time, so a stream needs a watermark on event_time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _rows(batches: Iterator, order: list[str]) -> list[tuple]:
    import pandas as pd

    return list(pd.concat(list(batches)).sort_values(order).itertuples(index=False))


def replayed_hints(events: DataFrame, ttl: int = 10_800, retries: int = 10, most: int = 1000) -> DataFrame:
    """hint_id, target_node_id and outcome of hints, as they are settled.

    `events` has target_node_id, ts (seconds), seq, kind (hint, up or down) and hint_id. A node that is up gets its hints at once.
    While it is down they wait: the oldest goes as full where there are more than `most`, one older than `ttl` as expired, and each
    further down event is a failed try, of which `retries` drop a hint.
    """

    def run(key, batches, state: GroupState):
        import pandas as pd

        up, held = state.get if state.exists else (True, [])
        held, out = [tuple(h) for h in held], []
        for e in _rows(batches, ["ts", "seq"]):
            live = [h for h in held if e.ts - h[1] <= ttl]
            out += [(h[0], "expired") for h in held if e.ts - h[1] > ttl]
            held = live
            if e.kind == "hint":
                held.append((e.hint_id, int(e.ts), 0))
                if not up and len(held) > most:
                    out.append((held.pop(0)[0], "full"))
            elif e.kind == "up":
                up = True
            else:
                up = False
                held = [(h, t, n + 1) for h, t, n in held]
                out += [(h, "dropped") for h, _, n in held if n >= retries]
                held = [x for x in held if x[2] < retries]
            if up:
                out += [(h[0], "replayed") for h in held]
                held = []
        state.update((up, held))
        yield pd.DataFrame([(h, key[0], o) for h, o in out], columns=["hint_id", "target_node_id", "outcome"])

    asked = events.select("target_node_id", "ts", "seq", "kind", "hint_id")
    return asked.groupBy("target_node_id").applyInPandasWithState(run, "hint_id string, target_node_id string, outcome string", "up boolean, held array<struct<hint_id:string,ts:bigint,tries:int>>", "append", GroupStateTimeout.NoTimeout)


def limited(requests: DataFrame, rate: float = 1.0, burst: float = 3.0) -> DataFrame:
    """request_id, tenant_id and passed, by a token bucket for each tenant."""

    def run(key, batches, state: GroupState):
        import pandas as pd

        left, at = state.get if state.exists else (burst, None)
        out = []
        for r in _rows(batches, ["ts", "request_id"]):
            left = min(burst, left + (0 if at is None else max(0, r.ts - at)) * rate)
            at = int(r.ts) if at is None else max(at, int(r.ts))
            out.append((r.request_id, key[0], left >= 1))
            left -= left >= 1
        state.update((float(left), at))
        yield pd.DataFrame(out, columns=["request_id", "tenant_id", "passed"])

    return requests.select("tenant_id", "ts", "request_id").groupBy("tenant_id").applyInPandasWithState(run, "request_id long, tenant_id string, passed boolean", "left_ double, at long", "append", GroupStateTimeout.NoTimeout)


def accepted(requests: DataFrame, ttl: int = 86_400) -> DataFrame:
    """request_id and store_key of the requests (with event_time, ts and store_key) that are carried out: the first of a key, and
    again the first more than `ttl` seconds after. A key's state goes when the watermark has passed that time."""

    def run(key, batches, state: GroupState):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        last, out = state.get[0] if state.exists else None, []
        for r in _rows(batches, ["ts", "request_id"]):
            if last is None or r.ts - last > ttl:
                last = int(r.ts)
                out.append((r.request_id, key[0]))
        state.update((last,))
        state.setTimeoutTimestamp(max((last + ttl + 1) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["request_id", "store_key"])

    asked = requests.withWatermark("event_time", f"{ttl} seconds").select("store_key", "ts", "request_id", "event_time")
    return asked.groupBy("store_key").applyInPandasWithState(run, "request_id long, store_key string", "last long", "append", GroupStateTimeout.EventTimeTimeout)
