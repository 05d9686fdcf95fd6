"""Helpers shared by the corpus operators: the shared folder, stage tables, batch access."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.shipping import ship

#: ASCII white space as the query contracts define it: \x20 and \x09-\x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]"

_own_dirs: dict[str, str] = {}
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where that is unset and the master is a single local process (tests) a temporary
    folder takes its place; on a cluster an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="folioforge-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return f"file://{_own_dirs[app]}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and return a scan of it.

    Cuts lineage: a lost executor costs only tasks of the current stage, and every reader sees
    the same rows. discard() deletes the table once later tables have replaced it; stage_tables()
    deletes all that a block of code left.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    if not _written:
        atexit.register(_clear)
    _written[path] = spark
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table that materialise() wrote for df; any other DataFrame is left alone."""
    path = getattr(df, "_stage_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written.pop(path, None)


def tables_now() -> frozenset[str]:
    """The tables written so far and not deleted."""
    return frozenset(_written)


def settle(before: frozenset[str], *kept: DataFrame) -> None:
    """Deletes the tables written since before was taken, but for those of kept: all that a result still reads."""
    stay = {getattr(df, "_stage_path", None) for df in kept}
    for path in [p for p in _written if p not in before and p not in stay]:
        _delete(_written.pop(path), path)


@contextmanager
def stage_tables() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables written inside the block at its end, but for those given to the function that it yields.

    Results of operators are lazy and read their tables: write what is wanted and keep that.
    """
    before, kept = tables_now(), []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        settle(before, *kept)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clear() -> None:
    """At the driver's end: results are lazy and read their tables until then."""
    for path, spark in _written.items():
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)


#: Rows and bytes that are Python objects at once.
SLICE_ROWS, SLICE_BYTES = 256, 1_000_000
#: Bytes of an Arrow batch, on both sides of the pipe, while an operator writes a table of its own. What it returns
#: runs with the caller's setting (64 MB by default). Buffers of batches lie outside the JVM's heap, and the allocator
#: keeps blocks of up to 32 MB that were freed, so small batches bound what an executor holds over many stages.
BATCH_BYTES = 1 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most BATCH_BYTES for what is run inside; the session's setting is as before at the end."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id long, text binary): the bytes of the whole text, null as empty. Other columns are not read."""
    ship(df.sparkSession)
    return df.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"),
    )


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows and bytes; a row of more bytes is a part of its own."""
    for batch in batches:
        step = SLICE_ROWS
        if batch.num_rows and batch.nbytes > SLICE_BYTES:
            step = max(1, min(SLICE_ROWS, SLICE_BYTES * batch.num_rows // batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Ids and texts as Python lists, a slice at a time."""
    for part in slices(batches):
        yield part.column(0).to_pylist(), part.column(1).to_pylist()


_held: list = [None, None]


def held(key: str, make: Callable[[], object]) -> object:
    """What make() gives, kept in this Python worker until another key is asked for.

    Workers are used again by later stages; with one place only, caches of earlier stages do not
    add up to more memory than an executor has. A worker that idles keeps its cache until it is used again.
    """
    if _held[0] != key:
        _held[:] = [None, None]
        _held[:] = [key, make()]
    return _held[1]


def drop_held(but: str | None) -> None:
    """Lets go of what this Python worker holds, unless it has that key."""
    if _held[0] is not None and _held[0] != but:
        _held[:] = [None, None]
        give_back()


def tidied(
    fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], holds: str | None = None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn for mapInArrow, giving memory back to the system on the way and at its end.

    Python workers outlive their tasks, and Arrow's pool and the allocator keep what was freed: on an
    executor with several workers that adds up to more than they use at any time. What an earlier
    stage held() goes at the start, unless it has the key that fn holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held(holds)
        try:
            for k, out in enumerate(fn(batches)):
                yield out
                if k % 32 == 31:
                    pa.default_memory_pool().release_unused()
        finally:
            give_back()

    return run


def give_back() -> None:
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it keeps its own counsel


def row_numbers(start_at: int = 0):
    """A function giving numbers that no other task of the stage gives, in the order of the rows.

    A task that is run again over the same rows (a file split) gives the same numbers.
    """
    from pyspark import TaskContext

    context = TaskContext.get()
    base = (context.partitionId() if context else 0) << 40
    state = [base + start_at]

    def take(n: int) -> range:
        first = state[0]
        state[0] += n
        return range(first, first + n)

    return take


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Keys with more rows than one in so many of the whole are fewer than that, whatever the data.
HEAVY_KEYS = 4096


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """left joined with right, which has one row per key, holding in count how many of left's total rows have that key.

    Keys with more than 1 / HEAVY_KEYS of all rows are fewer than HEAVY_KEYS, as their counts add up to
    no more than the total: they are broadcast, with that bound. All other rows are shuffled by key, so
    no task gets more than that share of the rows for one key.
    """
    heavy = F.broadcast(right.where(F.col(count) * HEAVY_KEYS > total))
    light = right.where(F.col(count) * HEAVY_KEYS <= total)
    return left.join(heavy, keys).unionByName(left.join(heavy.select(*keys), keys, "left_anti").join(light, keys))


#: Bits of a bitmap for each number marked, and the powers of two that bound a bitmap's size: 128 KB to 8 MB.
#: One number in 64 that is not marked passes at most, up to a million marked ones; beyond, a bitmap thins less and
#: less, and what follows it is exact at any size.
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 20, 26


def bitmap(df: DataFrame, column: str) -> bytes:
    """A bitmap with the places of the column's numbers (null as 0), to thin a scan before an exact join.

    Its size follows their count, within bounds; it is gathered as words of 32 bits.
    """
    size = 1 << min(MOST_BITS, max(LEAST_BITS, (df.count() * BITS_EACH - 1).bit_length()))
    v = f"(coalesce({column}, 0L) & {(1 << 62) - 1}L)"
    cell = F.expr(f"(({v} div {1 << 40}L) * 1000003L + {v} % {1 << 40}L) % {size}L")
    words = df.select(cell.alias("cell")).select(F.expr("cell div 32").alias("word"), F.expr("shiftleft(1L, cast(cell % 32 as int))").alias("bits"))
    found = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most 2^(MOST_BITS - 5) rows of two numbers
    out = np.zeros(size // 32, np.uint32)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return out.astype("<u4").tobytes()


def in_bitmap(bits: np.ndarray, numbers: pa.Array) -> np.ndarray:
    """Which of the numbers (null as 0) have their place set; bits are a bitmap's, unpacked by unpack()."""
    v = numbers.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) & ((1 << 62) - 1)
    return bits[((v // (1 << 40)) * 1000003 + v % (1 << 40)) % len(bits)]


def unpack(found: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(found, np.uint8), bitorder="little").astype(bool)


def split(df: DataFrame, column: str, found: bytes) -> tuple[DataFrame, DataFrame]:
    """(rows whose number may be in the bitmap, rows whose number surely is not), with all columns."""
    at = df.columns.index(column)

    def part(wanted: bool):
        def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = unpack(found)
            for batch in slices(batches):
                hit = in_bitmap(bits, batch.column(at).cast(pa.int64()))
                yield batch.filter(pa.array(hit if wanted else ~hit))

        return df.mapInArrow(tidied(select), df.schema)

    return part(True), part(False)


def whole_rows(df: DataFrame) -> Column:
    """All columns as one struct, so that no name of the caller's clashes with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])
