"""Resumable runs: a file source that takes what is new, and a keyed table as sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioforge.sources.files import SECTION_SCHEMA
from folioforge.sources.keyed import KeyedTable


def new_files(spark: SparkSession, path: str, schema: str = SECTION_SCHEMA, format: str = "json", per_batch: int | None = None, multi_line: bool = True) -> DataFrame:
    """A stream of the files in a folder; per_batch bounds how many a batch takes. multi_line: a JSON document a file, else one a line."""
    reader = spark.readStream.schema(schema).format(format)
    if per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    if format == "json":
        reader = reader.option("multiLine", multi_line)
    return reader.load(path)


def upsert(stream: DataFrame, change: Callable[[DataFrame], DataFrame], sink: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Runs change() over all that is new, writes each batch into the keyed table, and ends.

    A batch that is run again after a failure has its number in the table's manifest, or has left no version:
    the table has each key once, and is readable as of the last whole batch at any time.
    """

    def batch(df: DataFrame, number: int) -> None:
        name = df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        sink.write(change(df), batch=(name, number))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts_col: str, by: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per window, for streams and tables alike; state of a window goes once it is too late for it."""
    counted = events.withWatermark(ts_col, late) if events.isStreaming else events
    return counted.groupBy(F.window(ts_col, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, ts_col: str, by: list[str], gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    counted = events.withWatermark(ts_col, late) if events.isStreaming else events
    return counted.groupBy(F.session_window(ts_col, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def progress_of(query: StreamingQuery) -> dict[str, int]:
    """Batches and rows so far."""
    done = query.recentProgress
    return {"batches": len(done), "rows": sum(p.numInputRows for p in done)}
