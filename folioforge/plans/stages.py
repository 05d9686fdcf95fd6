"""Stage tables: what a plan has computed so far, written once and read by everything after it.

Model answers must not be asked for twice, and a plan of many stages must not grow without bound, so
plans write their stages. The folder comes from spark.checkpoint.dir, or from the caller; what a plan
wrote goes at the driver's end, or with discard().
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

Persist = Callable[[DataFrame, str], DataFrame]


_runs: dict[str, SparkSession] = {}
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset and the master is one local process, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("give a folder that driver and executors share, or set spark.checkpoint.dir")
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="folioforge-plan-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def discard(run: str) -> None:
    """Deletes the tables of a run."""
    spark = _runs.pop(run, None)
    if spark is not None and spark.sparkContext._jsc is not None:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clear() -> None:
    for run in list(_runs):
        discard(run)


def tables(spark: SparkSession, folder: str | None = None) -> Persist:
    """persist(df, name): writes df to a new table of that name in the folder and returns a scan of it. persist.run is the run's folder."""
    run = f"{(folder or shared_folder(spark)).rstrip('/')}/plan-{uuid.uuid4().hex}"
    if not _runs:
        atexit.register(_clear)
    _runs[run] = spark

    def persist(df: DataFrame, name: str) -> DataFrame:
        path = f"{run}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    persist.run = run
    return persist


def spread(scan: DataFrame, *keys: str | Column) -> DataFrame:
    """The rows of a scan dealt by keys to all cores, for tables of few bytes and much work a row.

    A scan has tasks by its files' bytes and row groups, which may be a single one; only the columns that are read
    after it are shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(max(cores, scan.rdd.getNumPartitions()), *keys)
