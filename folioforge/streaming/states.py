"""The state of a stage for each key, as a stateful stream: asked once, answered once, tried again, expired, late.

Events are rows (key, kind, text, ts): an ask for a key's work, an answer, or a failure. What leaves is a row for each
change of a key's state, numbered by key: asked (work is to be done, again after a failure), answered, failed (after
most_tries failures), expired (no answer within wait of the last ask), late (an answer after that, still taken). Asks
for a key that has a state change nothing, nor do answers after an answer, so a key's work is asked for once however
often its rows come, and its result is there once. Keys that are settled are forgotten after keep, by the watermark:
state is bounded by the keys of that time, and a key that comes later begins anew. Keys are dealt by hash to states of
many keys, each with its own times.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioforge.shipping import ship
from folioforge.sources.keyed import KeyedTable

EVENTS = "key string, kind string, text string, ts timestamp"
CHANGES = "key string, state string, text string, tries int, number int, ts timestamp"
#: A shard's keys; timer is when a key is looked at without events: as due, but after the watermark of its last events.
_STATE = "keys array<struct<key:string,state:string,tries:int,number:int,due:bigint,timer:bigint>>"
#: A call of a state's function costs some milliseconds, whatever it does, so keys share states: so many for a whole
#: stream, fixed by its checkpoint. A state holds that share of the keys and is written again with any of them.
SHARDS = 4096
_ORDER = {"ask": 0, "fail": 1, "answer": 2}


def change(state: tuple, kind: str, text: str | None, ms: int, wait_ms: int, keep_ms: int, most_tries: int) -> tuple[tuple, str | None]:
    """(state after an event, the text that a change carries); a state is (name, tries, number of changes, when it is due)."""
    name, tries, number, _ = state
    if kind == "ask" and name == "new":
        return ("asked", 1, number + 1, ms + wait_ms), None
    if kind == "answer" and name in ("new", "asked", "expired"):
        return ("late" if name == "expired" else "answered", tries, number + 1, ms + keep_ms), text
    if kind == "fail" and name == "asked":
        if tries < most_tries:
            return ("asked", tries + 1, number + 1, ms + wait_ms), text
        return ("failed", tries, number + 1, ms + keep_ms), text
    return state, None


def track(events: DataFrame, wait_s: int = 3600, keep_s: int = 7 * 86400, late: str = "10 minutes", most_tries: int = 3, shards: int = SHARDS) -> DataFrame:
    """The changes (CHANGES) that a stream of events (EVENTS) makes, in the order of their times, asks before failures before answers."""
    wait_ms, keep_ms = 1000 * wait_s, 1000 * keep_s

    def advance(shard: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.getCurrentWatermarkMs()
        known = {r[0]: tuple(r[1:]) for r in held.get[0]} if held.exists else {}
        rows: dict[str, list] = {}
        if not held.hasTimedOut:
            for f in frames:
                for key, *event in zip(f["key"], f["ts"], f["kind"], f["text"]):
                    rows.setdefault(key, []).append(event)
        out = []

        def note(key: str, state: tuple, text: str | None, ms: int) -> None:
            out.append((key, state[0], text, state[1], state[2], pd.Timestamp(ms, unit="ms")))

        def expired(key: str, state: tuple) -> tuple:
            after = ("expired", state[1], state[2] + 1, state[3] + keep_ms)
            note(key, after, None, state[3])
            return after

        for key in [k for k, v in known.items() if v[4] < now and k not in rows]:
            *state, _ = known.pop(key)
            if state[0] == "asked":
                state = expired(key, state)
                known[key] = (*state, max(state[3], now + 1))
        for key, found in rows.items():
            state = known.get(key, ("new", 0, 0, 0))[:4]
            for ts, kind, text in sorted(found, key=lambda r: (r[0], _ORDER.get(r[1], 3), r[2] or "")):
                ms = int(ts.timestamp() * 1000)
                if state[0] == "asked" and ms > state[3]:  # due before this came
                    state = expired(key, state)
                after, said = change(state, kind, text, ms, wait_ms, keep_ms, most_tries)
                if after != state:
                    state = after
                    note(key, state, said, ms)
            if state[0] != "new":
                known[key] = (*state, max(state[3], now + 1))
        if known:
            held.update(([(k, *v) for k, v in known.items()],))
            held.setTimeoutTimestamp(min(v[4] for v in known.values()))
        elif held.exists:
            held.remove()
        if out:
            yield pd.DataFrame(out, columns=["key", "state", "text", "tries", "number", "ts"])

    ship(events.sparkSession)
    timed = events.where(F.col("key").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", late)
    sharded = timed.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    return sharded.groupBy("shard").applyInPandasWithState(advance, CHANGES, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def settle(events: DataFrame, sink: KeyedTable, checkpoint: str, **options) -> StreamingQuery:
    """Runs track() over all that is new and keeps each key's last state in a keyed table by key; a repeated batch changes nothing."""

    def batch(df: DataFrame, number: int) -> None:
        name = df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        sink.write(df, order=F.col("number"), batch=(name, number))

    return track(events, **options).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
