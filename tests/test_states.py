"""Stage states: transitions, and a stream with repeats, failures, expiry and a batch that breaks off."""

import datetime as dt

import pytest

from folioforge.sources.keyed import KeyedTable
from folioforge.streaming import incremental, states


@pytest.mark.parametrize(
    ("before", "kind", "after"),
    [
        (("new", 0, 0, 0), "ask", ("asked", 1, 1, 15)),
        (("asked", 1, 1, 15), "ask", ("asked", 1, 1, 15)),
        (("asked", 1, 1, 15), "answer", ("answered", 1, 2, 105)),
        (("asked", 1, 1, 15), "fail", ("asked", 2, 2, 15)),
        (("asked", 2, 2, 15), "fail", ("failed", 2, 3, 105)),
        (("expired", 1, 2, 50), "answer", ("late", 1, 3, 105)),
        (("expired", 1, 2, 50), "fail", ("expired", 1, 2, 50)),
        (("answered", 1, 2, 50), "answer", ("answered", 1, 2, 50)),
        (("failed", 2, 3, 50), "answer", ("failed", 2, 3, 50)),
        (("new", 0, 0, 0), "answer", ("answered", 0, 1, 105)),
        (("new", 0, 0, 0), "fail", ("new", 0, 0, 0)),
        (("asked", 1, 1, 15), "what", ("asked", 1, 1, 15)),
    ],
)
def test_changes(before, kind, after):
    assert states.change(before, kind, "t", 5, 10, 100, 2)[0] == after


def test_each_key_once(spark, tmp_path):
    """Three batches with a repeat and a failure, the second of which breaks off once."""
    day = dt.datetime(2024, 1, 1)
    at = lambda minutes: day + dt.timedelta(minutes=minutes)
    batches = [
        [("a", "ask", None, at(0)), ("a", "answer", "A", at(1)), ("b", "ask", None, at(0)), ("c", "ask", None, at(0)), ("d", "ask", None, at(0)), (None, "ask", None, at(0)), ("x", "ask", None, None)],
        [("a", "ask", None, at(5)), ("a", "answer", "other", at(6)), ("b", "ask", None, at(5)), ("b", "answer", "B", at(6)), ("c", "fail", "no", at(5))],
        [("e", "ask", None, at(300))],
        [("d", "answer", "D", at(301)), ("e", "answer", "E", at(302)), ("b", "answer", "again", at(302))],
    ]
    kept, seen = KeyedTable(spark, f"file://{tmp_path}/states", "key", buckets=2), []
    first = KeyedTable.write

    def breaks(self, rows, **options):
        seen.append(options["batch"])
        if len(seen) == 2:
            raise RuntimeError("executor lost")
        return first(self, rows, **options)

    kept.write = breaks.__get__(kept)
    failed = 0
    for rows in batches:
        spark.createDataFrame(rows, states.EVENTS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/events")
        for _ in range(2):
            try:
                states.settle(incremental.new_files(spark, f"file://{tmp_path}/events", states.EVENTS, "parquet"), kept, f"file://{tmp_path}/state", wait_s=3600).awaitTermination()
                break
            except Exception as e:
                assert "executor lost" in str(e)
                failed += 1
    got = {r["key"]: (r["state"], r["text"], r["tries"]) for r in kept.read().collect()}
    assert failed == 1 and got == {"a": ("answered", "A", 1), "b": ("answered", "B", 1), "c": ("expired", None, 2), "d": ("late", "D", 1), "e": ("answered", "E", 1)}
    assert kept.read().count() == 5 and len(kept.versions()) == len(set(seen))


def test_keys_share_states(spark, tmp_path):
    """Many keys in few states: each has its own changes and its own time, with events of others or without any."""
    day, n = dt.datetime(2024, 1, 1), 300
    at = lambda minutes: day + dt.timedelta(minutes=minutes)
    kept, sizes = KeyedTable(spark, f"file://{tmp_path}/states", "key", buckets=2), []
    batches = [
        [(f"k{i}", "ask", None, at(i % 3)) for i in range(n)] + [(f"k{i}", "answer", f"A{i}", at(5)) for i in range(0, n, 3)],
        [("other", "ask", None, at(200))],
        [(f"k{i}", "answer", f"L{i}", at(201)) for i in range(1, n, 3)] + [("k0", "answer", "again", at(201))],
        [("later", "ask", None, at(60 * 24 * 9))],
        [("k0", "ask", None, at(60 * 24 * 9 + 1))],
    ]
    for rows in batches:
        spark.createDataFrame(rows, states.EVENTS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/events")
        stream = incremental.new_files(spark, f"file://{tmp_path}/events", states.EVENTS, "parquet")
        query = states.settle(stream, kept, f"file://{tmp_path}/state", wait_s=3600, shards=4)
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert max(sizes) <= 4
    got = {r["key"]: tuple(r)[1:5] for r in kept.read().select("key", "state", "text", "tries", "number").collect()}
    want = {f"k{i}": (("answered", f"A{i}", 1, 2), ("late", f"L{i}", 1, 3), ("expired", None, 1, 2))[i % 3] for i in range(n)}
    # All others are forgotten by the watermark of the ninth day; k0 begins anew.
    assert got == want | {"k0": ("asked", None, 1, 1), "other": ("expired", None, 1, 2), "later": ("asked", None, 1, 1)}
