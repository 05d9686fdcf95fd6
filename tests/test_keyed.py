"""Keyed tables: versions, layers, removed keys, killed and repeated batches, writers that meet."""

import os

import pytest
from pyspark.sql import functions as F

from folioforge.sources.keyed import Conflict, KeyedTable
from folioforge.streaming import incremental


def table(spark, tmp_path, **options):
    return KeyedTable(spark, f"file://{tmp_path}/t", "k", **{"buckets": 4, **options})


def rows(spark, n, v, start=0):
    return spark.range(start, start + n).select(F.col("id").alias("k"), F.lit(v).alias("v"))


def data_files(tmp_path):
    return [f for _, _, names in os.walk(f"{tmp_path}/t/data") for f in names if f.startswith("part-")]


def held(kept, version=None):
    return {r["k"]: r["v"] for r in kept.read(version).collect()}


def test_files_do_not_follow_keys(spark, tmp_path):
    kept = table(spark, tmp_path)
    kept.write(rows(spark, 5000, "a"))
    assert len(data_files(tmp_path)) == 4 and kept.read().count() == 5000
    kept.write(rows(spark, 10, "b", 4995))
    assert len(data_files(tmp_path)) <= 8
    got = held(kept)
    assert len(got) == 5005 and got[4994] == "a" and got[4995] == "b" == got[5004]
    assert held(kept, 1)[4995] == "a" and 5004 not in held(kept, 1)


def test_a_killed_batch_leaves_the_old_version(spark, tmp_path, monkeypatch):
    kept = table(spark, tmp_path)
    kept.write(rows(spark, 20, "a"))

    def killed(self, manifest):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            kept.write(rows(spark, 20, "b"), batch=("w", 0))
    assert set(held(kept).values()) == {"a"} and kept.versions() == [1]
    kept.write(rows(spark, 20, "b"), batch=("w", 0))
    assert set(held(kept).values()) == {"b"} and kept.versions() == [1, 2]
    kept.write(rows(spark, 20, "c"), batch=("w", 0))  # the number was written
    assert set(held(kept).values()) == {"b"} and kept.versions() == [1, 2]
    assert len(data_files(tmp_path)) == 12
    kept.vacuum()  # what the killed batch left goes
    assert set(held(kept).values()) == {"b"} and len(data_files(tmp_path)) == 8 and kept.versions() == [2]


def test_layers_are_rewritten(spark, tmp_path):
    kept = table(spark, tmp_path, most_layers=2)
    for k in range(6):
        kept.write(rows(spark, 30, f"v{k}", k))
    assert max(kept.manifest().depth().values()) <= 2
    got = held(kept)
    assert len(got) == 35 and all(got[k] == f"v{min(k, 5)}" for k in range(35))
    kept.compact()
    assert set(kept.manifest().depth().values()) == {1} and held(kept) == got
    assert "Aggregate" not in kept.read()._jdf.queryExecution().executedPlan().toString()


def test_removed_keys_and_more_columns(spark, tmp_path):
    kept = table(spark, tmp_path)
    kept.write(rows(spark, 10, "a"))
    kept.remove(rows(spark, 3, "x"))
    assert sorted(held(kept)) == list(range(3, 10))
    kept.write(rows(spark, 1, "back").withColumn("more", F.lit(1)))
    got = {r["k"]: (r["v"], r["more"]) for r in kept.read().collect()}
    assert got[0] == ("back", 1) and got[5] == ("a", None) and 1 not in got
    kept.compact()
    assert {r["k"]: (r["v"], r["more"]) for r in kept.read().collect()} == got


def test_of_equal_keys_one_counts_and_nulls_are_a_key(spark, tmp_path):
    kept = table(spark, tmp_path)
    df = spark.createDataFrame([(1, "a", 5), (1, "z", 1), (None, "n", 0), (None, "m", 1)], "k int, v string, o int")
    kept.write(df, order=F.col("o"))
    assert held(kept) == {1: "a", None: "m"}
    kept.write(spark.createDataFrame([(None, "p", 2)], "k int, v string, o int"))
    assert held(kept) == {1: "a", None: "p"}
    kept.write(df.where("false"))
    assert held(kept) == {1: "a", None: "p"}


def test_few_keys_read_few_files(spark, tmp_path):
    kept = table(spark, tmp_path, buckets=32)
    kept.write(rows(spark, 1000, "a"))
    kept.write(rows(spark, 1, "b", 7))
    found = kept.read(keys=[7, 8, 5000])
    assert {r["k"]: r["v"] for r in found.collect()} == {7: "b", 8: "a"} and len(found.inputFiles()) <= 4


def test_writers_that_meet(spark, tmp_path, monkeypatch):
    one, other = table(spark, tmp_path), table(spark, tmp_path, buckets=9)
    assert other.buckets == 4  # as it was made
    one.write(rows(spark, 10, "a"))
    first = KeyedTable._commit

    def late(self, manifest):
        if manifest.version == 2 and "c" not in manifest.written:
            monkeypatch.setattr(KeyedTable, "_commit", first)
            other.write(rows(spark, 5, "other"), batch=("c", 1))
        return first(self, manifest)

    monkeypatch.setattr(KeyedTable, "_commit", late)
    assert one.write(rows(spark, 2, "one")) == 3
    got = held(one)
    assert [got[k] for k in (0, 1, 2, 4, 5)] == ["one", "one", "other", "other", "a"]
    monkeypatch.setattr(KeyedTable, "_commit", lambda self, manifest: False)
    with pytest.raises(Conflict):
        one.write(rows(spark, 1, "x"), tries=2)


def test_nothing_yet(spark, tmp_path):
    with pytest.raises(ValueError, match="no version"):
        table(spark, tmp_path).read()


def test_a_stream_that_fails_in_the_middle(spark, tmp_path):
    """Three batches with a repeated key; the second fails once: each key is there once, with its last row."""
    kept, source = table(spark, tmp_path), f"{tmp_path}/in"
    for n, (k, v) in enumerate([(1, "a"), (1, "b"), (2, "c")]):
        spark.createDataFrame([(k, v)], "k int, v string").coalesce(1).write.mode("append").json(source)
    seen = []

    def change(df):
        seen.append(1)
        if len(seen) == 2:
            raise RuntimeError("executor lost")
        return df

    def run():
        new = incremental.new_files(spark, source, "k int, v string", per_batch=1, multi_line=False)
        return incremental.upsert(new, change, kept, f"file://{tmp_path}/state")

    with pytest.raises(Exception, match="executor lost"):
        run().awaitTermination()
    assert len(kept.versions()) == 1
    run().awaitTermination()
    assert len(kept.versions()) == 3 and held(kept) == {1: "b", 2: "c"}
