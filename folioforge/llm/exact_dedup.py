"""Exact duplicates by deterministic block naming.

Each normalised text is cut into blocks of a fixed size. Equal blocks get the same integer name
from a sort of all blocks (here: the dense rank inside a hash range, prefixed by the range); then
adjacent names are paired and the pairs named the same way, until one name is left for each text.
Names come from comparing contents, so two texts share an identity only if they are equal: there
is no fingerprint that could collide. The number of blocks belongs to the identity, as a text of
m blocks is named in exactly ceil(log2 m) rounds.

Scale: the texts are read once and their blocks written once, equal blocks of a batch as one row, with
the places that they stand at. What crosses the network for naming are the blocks alone, not their
places; copies of blocks that are frequent in a batch are merged first, dealt out by task, so that no
task gets one copy from each batch of the corpus. Names go back to places by a 128-bit key of the
block's content, checked to be free of collisions (else other keys are drawn); keys with many places
are joined by a bounded broadcast, so a block that a third of all rows hold is no task of its own.
Later rounds move integers only, joined the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, bitmap, discard, id_and_text, join_counted, materialise, parallelism, row_numbers, rows, settle, split, tables_now, tidied, whole_rows

BLOCK_BYTES = 4096
_RANGE_BITS = 40
_WHITE = b" \t\n\r\x0b\x0c"

_BLOCKS = "k1 bigint, k2 bigint, block binary, frequent boolean, refs array<struct<row:bigint,id:bigint,idx:int,m:int,sha:string>>"
_REFS = pa.list_(
    pa.struct([("row", pa.int64()), ("id", pa.int64()), ("idx", pa.int32()), ("m", pa.int32()), ("sha", pa.string())])
)


def normalise(text: bytes) -> bytes:
    """Each run of ASCII white space becomes one space; nothing is trimmed."""
    body = b" ".join(text.split())
    if not body:
        return b" " if text else b""
    return (b" " if text[0] in _WHITE else b"") + body + (b" " if text[-1] in _WHITE else b"")


#: Distinct bytes and references that a task folds together before it sends them on.
_FOLD_BYTES, _FOLD_REFS = 16_000_000, 50_000
#: A block with so many places in one fold is merged with its copies of other folds before it is named.
_FREQUENT = 8


def _keys(block: bytes, attempt: int) -> tuple[int, int]:
    digest = hashlib.blake2b(block, digest_size=16, salt=attempt.to_bytes(4, "little")).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _cut(block_bytes: int, attempt: int):
    def sent(found: dict[bytes, list]) -> Iterator[pa.RecordBatch]:
        blocks = list(found)
        for at in range(0, len(blocks), 1024):
            part = blocks[at : at + 1024]
            k1, k2 = zip(*[_keys(b, attempt) for b in part])
            refs = [[dict(zip(("row", "id", "idx", "m", "sha"), r)) for r in found[b]] for b in part]
            frequent = [len(r) >= _FREQUENT for r in refs]
            arrays = [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(part, pa.binary()), pa.array(frequent, pa.bool_()), pa.array(refs, _REFS)]
            yield pa.RecordBatch.from_arrays(arrays, ["k1", "k2", "block", "frequent", "refs"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = row_numbers()
        found: dict[bytes, list] = {}
        size = refs = 0
        for ids, texts in rows(batches):
            for row, key, text in zip(number(len(ids)), ids, texts):
                flat = normalise(text)
                m = max(1, -(-len(flat) // block_bytes))
                sha = hashlib.sha256(flat).hexdigest()
                for i in range(m):
                    block = flat[i * block_bytes : (i + 1) * block_bytes]
                    if block in found:
                        found[block].append((row, key, i, m, sha if i == 0 else None))
                    else:
                        found[block] = [(row, key, i, m, sha if i == 0 else None)]
                        size += len(block)
                refs += m
                if size > _FOLD_BYTES or refs > _FOLD_REFS:
                    yield from sent(found)
                    found, size, refs = {}, 0, 0
        yield from sent(found)

    return cut


#: Rows that a task names at most on average, so that tasks of a larger corpus are more, not larger.
_ROWS_NAMED = 16_384


def _named(df: DataFrame, cols: list[str], rows_named: int) -> DataFrame:
    """Adds name: equal for equal cols, different otherwise. rows_named: how many rows there are, about."""
    least = parallelism(df.sparkSession)
    parts = max(least, rows_named // _ROWS_NAMED)
    w = Window.partitionBy("range").orderBy(*cols)
    ranged = df.withColumn("range", F.pmod(F.xxhash64(*cols), F.lit(4 * parts)))
    if parts > least:
        ranged = ranged.repartition(parts, "range")
    return ranged.withColumn(
        "name", F.shiftleft(F.col("range"), _RANGE_BITS) + F.dense_rank().over(w)
    ).drop("range")


def _block_names(found: DataFrame) -> DataFrame:
    """(k1, k2, name, other, places): a key whose name and other differ stands for blocks that are not equal."""
    places = F.size("refs").cast("bigint").alias("places")
    rare = found.where("not frequent").select("k1", "k2", "block", places)
    # Copies of a frequent block meet by the part of the table they lie in first, then once per part.
    part = F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(parallelism(found.sparkSession))).alias("part")
    merged = found.where("frequent").select("k1", "k2", "block", part, places).groupBy("k1", "k2", "block", "part").agg(F.sum("places").alias("places")).drop("part")
    named = _named(rare.unionByName(merged), ["block"], found.count())
    return named.groupBy("k1", "k2").agg(F.min("name").alias("name"), F.max("name").alias("other"), F.sum("places").alias("places"))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: row, id, sha, m, name; texts are equal iff (m, name) are."""
    attempt = 0
    while True:
        found = materialise(id_and_text(docs, id_col, text_col).mapInArrow(tidied(_cut(block_bytes, attempt)), _BLOCKS), "blocks")
        names = materialise(_block_names(found), "blocknames")
        state = names.agg(F.sum("places").alias("places"), F.max(F.col("name") != F.col("other")).alias("clash")).first()
        if not state["clash"]:
            break
        attempt += 1  # two blocks of 2^128 keys met: draw other keys
    refs = found.select("k1", "k2", F.explode("refs").alias("r")).select("k1", "k2", "r.*")
    level = join_counted(refs, names.drop("other"), ["k1", "k2"], "places", state["places"] or 0)
    level = materialise(level.select("row", "id", "idx", "m", "sha", "name"), "level")
    discard(found)
    discard(names)
    done = level.where("m = 1").select("row", "id", "sha", "m", "name")
    heads = level.where("m > 1 and idx = 0").select("row", "id", "sha")
    rest = level.where("m > 1").select("row", "m", "idx", "name")
    longest = level.agg(F.max("m")).first()[0] or 1
    width = 1
    while width < longest:
        width *= 2
        pairs = rest.groupBy("row", "m", F.expr("idx div 2").cast("int").alias("k")).agg(
            F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        pairs = materialise(pairs, "blockpairs")
        total = pairs.count()
        names = materialise(_named(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("places")), ["a", "b"], total // 64), "pairnames")
        joined = join_counted(pairs, names, ["a", "b"], "places", total).select("row", "m", F.col("k").alias("idx"), "name")
        rest = materialise(joined, "pairlevel")
        discard(pairs)
        discard(names)
        ready = rest.where((F.col("m") <= width) & (F.col("m") > width // 2)).join(heads, "row")
        done = done.unionByName(ready.select("row", "id", "sha", "m", "name"))
        rest = rest.where(F.col("m") > width)
    return done


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty; the empty text is a text like any other. Of equal texts the row
    with the smallest id stays; null ids come after all others; of rows that repeat an id with an
    equal text exactly one stays. An empty table gives an empty result. Other columns are ignored.
    """
    before = tables_now()
    found = materialise(identities(docs, id_col, text_col, block_bytes), "identities")
    settle(before, found)
    groups = found.groupBy("m", "name").agg(
        F.min(F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("row"))).alias("keep"),
        F.count(F.lit(1)).alias("group_size"),
    )
    groups = materialise(groups, "groups")
    return join_counted(found, groups, ["m", "name"], "group_size", found.count()).select(
        F.col("id").alias(id_col),
        F.col("keep.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all columns, that exact_duplicates() keeps.

    Rows whose id cannot be that of a dropped row pass by a map; only the others are shuffled, and
    matched by id and digest of the normalised text. Of rows that repeat both, one stays: the one
    with the least text, then the least other columns. Nulls, empty tables as in exact_duplicates().
    """
    before = tables_now()
    judged = exact_duplicates(docs, id_col, text_col, block_bytes)
    gone = judged.where(~F.col("kept")).select(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha"), "keep_id")
    gone = materialise(gone, "dropped")
    settle(before, gone)
    # Where the row that stays has the same id, the id and text stay once.
    whole = gone.where(~F.col("id").eqNullSafe(F.col("keep_id"))).select("id", "sha").distinct()
    doubtful, sure = split(docs, id_col, bitmap(gone, "id"))
    sha = F.sha2(F.encode(F.regexp_replace(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), SPACE_CLASS + "+", " "), "utf-8"), 256)
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]))
    keyed = doubtful.select(F.col(f"`{id_col}`").cast("long").alias("id"), sha.alias("sha"), F.struct(F.col(f"`{text_col}`").alias("t"), others.alias("o")).alias("least"), whole_rows(docs).alias("doc"))
    once = keyed.groupBy("id", "sha").agg(F.min_by("doc", "least").alias("doc")).alias("d")
    left = once.join(whole.alias("w"), F.col("d.id").eqNullSafe(F.col("w.id")) & (F.col("d.sha") == F.col("w.sha")), "left_anti")
    return sure.unionByName(left.select("doc.*"))
