"""Books in parts: what is done is not done again, broken runs, changed parts, global order."""

import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.plans import parts
from folioforge.plans.stages import tables


def pages(spark, *names, text="x"):
    return spark.createDataFrame([(p, k, f"{text}{k}") for p in names for k in range(5)], "part string, page int, text string")


def test_parts_are_done_once(spark, tmp_path):
    kept, seen = parts.Parts(spark, f"file://{tmp_path}/p", "part"), []

    def plan(df):
        seen.append(sorted({r["part"] for r in df.collect()}))
        return df.withColumn("run", F.lit(len(seen)))

    assert kept.run(pages(spark, "b.10", "b.9"), plan) == ["b.9", "b.10"]
    assert kept.run(pages(spark, "b.9", "b.10"), plan) == [] and len(seen) == 1
    # One part more, and one whose rows are others now.
    more = pages(spark, "b.9", "b.11").union(pages(spark, "b.10", text="y"))
    assert kept.run(more, plan) == ["b.10", "b.11"] and seen[1] == ["b.10", "b.11"]
    got = {(r["part"], r["text"]): r["run"] for r in kept.read().collect()}
    assert got == {(p, f"{t}{k}"): n for p, t, n in (("b.9", "x", 1), ("b.10", "y", 2), ("b.11", "x", 2)) for k in range(5)}


def test_a_run_that_breaks_off_keeps_what_is_done(spark, tmp_path):
    kept = parts.Parts(spark, f"file://{tmp_path}/p", "part")
    with pytest.raises(ValueError, match="no part"):
        kept.read()

    def breaks(df):
        if "2" in {r["part"] for r in df.collect()}:
            raise RuntimeError("lost")
        return df

    with pytest.raises(RuntimeError, match="lost"):
        kept.run(pages(spark, "1", "2", "10"), breaks, at_once=1)
    assert {r["part"] for r in kept.read().collect()} == {"1"}
    assert kept.run(pages(spark, "1", "2", "10"), lambda df: df, at_once=1) == ["2", "10"]
    assert kept.read().count() == 15


def test_global_order(spark, tmp_path):
    ids = [f"{a}.{b}" for a in range(1, 30) for b in (1, 2, 10, "x")]
    rows = spark.createDataFrame([(i,) for i in ids], "s string").repartition(7)
    out = parts.numbered(rows, [T.natural_key(F.col("s"))], tables(spark, f"file://{tmp_path}"), ranges=5)
    assert [r["s"] for r in out.orderBy("rank").collect()] == ids and sorted(r["rank"] for r in out.collect()) == list(range(1, len(ids) + 1))
    assert "SinglePartition" not in out.select("s")._jdf.queryExecution().executedPlan().toString()
    parts.in_order(rows, [T.natural_key(F.col("s"))], 3).write.text(f"file://{tmp_path}/text")
    lines = [x for f in sorted((tmp_path / "text").glob("part-*")) for x in f.read_text().split()]
    assert lines == ids
