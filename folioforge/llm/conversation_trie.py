"""Prefix trie of rebuilt conversations, merged family first.

Conversations of one family (the same base id) share their first turns by construction, so a family's
small trie already merges most of what can be merged. Each turn becomes a digest of its role and text
before anything moves, so texts are not shuffled. Rows meet by base id and arrive sorted, the base
conversation first: a task rebuilds one conversation after the other with the base's first turns at hand
and counts its nodes into the family's trie, where a node is the digest of all turns that lead to it.
What crosses the network next are the families' combined nodes, summed up by digest.

A node is named by its smallest member. The nodes of one name are consecutive depths of that
conversation: the trie is a tree of such chains, each hanging on a node of a chain with a smaller name.
Sums over subtrees are therefore sums along chains (a window by conversation) of what hangs on them, and
the totals of whole chains come by pointer doubling: in each round a chain adds its sum to the ancestor
2^i steps up. Rounds are logarithmic in how deep chains hang on chains, which is not the length of
conversations. Nodes with a great many children or members are counted by partial sums, and joins on
them broadcast the bounded number of such nodes (common.join_counted).

The digest of a node's ending members is over their ids in order. Families hold disjoint ranges of ids,
so a family's list is already a run of that order; runs are range-partitioned by node and family, merged
into chunks, and a task then feeds the chunks of a node to SHA-256 one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.shipping import ship

from .common import SPACE_CLASS, discard, join_counted, materialise, parallelism, settle, slices, tables_now, tidied

#: Nodes of a family that a task holds; a family with more sends them in parts, which are summed up all the same.
FAMILY_NODES = 100_000
#: Bytes of a chunk of ids.
CHUNK_BYTES = 1 << 16

_WORDS = SPACE_CLASS.replace("[", "[^") + "+"
_NODES = "d1 bigint, d2 bigint, p1 bigint, p2 bigint, depth bigint, conv_id bigint, n bigint, words bigint, family bigint, ends binary"
_ENDS = "d1 bigint, d2 bigint, family bigint, ends binary"
_NONE = hashlib.sha256(b"").hexdigest()
_ROOT = hashlib.blake2b(b"", digest_size=16).digest()


def _longs(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


class Family:
    """The small trie of one family: for each node its parent, depth, smallest member, members and words; lists of ids that end there."""

    def __init__(self):
        self.nodes: dict[bytes, list] = {}
        self.ends: dict[bytes, list[int]] = {}

    def count(self, digest: bytes, parent: bytes, depth: int, conv: int, members: int, words: int) -> None:
        node = self.nodes.get(digest)
        if node is None:
            self.nodes[digest] = [parent, depth, conv, members, words]
        else:
            node[2] = min(node[2], conv)
            node[3] += members

    def batch(self, family: int) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in range(10)]
        for digest, (parent, depth, conv, members, words) in self.nodes.items():
            ends = ",".join(map(str, sorted(self.ends.get(digest, ())))).encode()
            for c, v in zip(columns, (*_longs(digest), *_longs(parent), depth, conv, members, words, family, ends)):
                c.append(v)
        arrays = [pa.array(c, pa.int64()) for c in columns[:9]] + [pa.array(columns[9], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in _NODES.split(", ")])


class Walk:
    """One rebuilt conversation as it is read: where it stands in the trie."""

    def __init__(self, trie: Family, conv: int):
        self.trie, self.conv = trie, conv
        self.at, self.parent, self.depth, self.words = _ROOT, _ROOT, 0, 0
        trie.count(_ROOT, _ROOT, 0, conv, 1, 0)

    def step(self, turn: bytes, words: int) -> None:
        self.parent, self.at = self.at, hashlib.blake2b(self.at + turn, digest_size=16).digest()
        self.depth += 1
        self.words = words
        self.trie.count(self.at, self.parent, self.depth, self.conv, 1, words)

    def end(self) -> None:
        self.trie.count(self.at, self.parent, self.depth, self.conv, 0, self.words)  # there again, if the trie was sent meanwhile
        self.trie.ends.setdefault(self.at, []).append(self.conv)


def _families(family_nodes: int, most_shared: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (family, conv_id, h, turn, words), sorted by family, base first, conversation, turn."""
        family = trie = walk = None
        start: list[tuple[bytes, int]] = []
        seen = h = 0
        for part in slices(batches):
            for f, conv, shared, turn, words in zip(*(c.to_pylist() for c in part.columns)):
                if f != family:
                    if trie is not None:
                        walk.end()
                        yield trie.batch(family)
                    family, trie, walk, start = f, Family(), None, []
                if walk is None or conv != walk.conv:
                    if walk is not None:
                        walk.end()
                    walk, seen, h = Walk(trie, conv), 0, shared
                    if conv != f:
                        for t, w in start[:h]:
                            walk.step(t, w)
                if conv == f:
                    if len(start) < most_shared:
                        start.append((turn, words))
                    walk.step(turn, words)
                elif seen >= h:
                    walk.step(turn, words)
                seen += 1
                if len(trie.nodes) >= family_nodes:
                    yield trie.batch(family)
                    trie.nodes.clear()
                    trie.ends.clear()
        if trie is not None:
            walk.end()
            yield trie.batch(family)

    return build


def _chunks(chunk_bytes: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of ids of one node, in order, joined to chunks."""
        now, held, size = None, [], 0

        def sent() -> pa.RecordBatch:
            cells = [[now[0]], [now[1]], [first], [b",".join(held)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, [pa.int64()] * 3 + [pa.binary()])], ["d1", "d2", "family", "ends"])

        for part in slices(batches):
            for a, b, family, ends in zip(*(c.to_pylist() for c in part.columns)):
                if now != (a, b) or size >= chunk_bytes:
                    if held:
                        yield sent()
                    now, held, size, first = (a, b), [], 0, family
                held.append(ends)
                size += len(ends)
        if held:
            yield sent()

    return merge


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of one node, in order, through SHA-256."""
    now = sha = None
    out: list[tuple[int, int, str]] = []

    def sent() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))], ["d1", "d2", "sha"])

    for part in slices(batches):
        for a, b, _, ends in zip(*(c.to_pylist() for c in part.columns)):
            if now != (a, b):
                if now is not None:
                    out.append((*now, sha.hexdigest()))
                    if len(out) == 4096:
                        yield sent()
                        out.clear()
                now, sha = (a, b), hashlib.sha256(ends)
            else:
                sha.update(b"," + ends)
    if now is not None:
        out.append((*now, sha.hexdigest()))
        yield sent()


def family_nodes(conversations: DataFrame, id_col: str, family_size: int, shared: int, held: int = FAMILY_NODES) -> DataFrame:
    """The nodes of every family's trie: one row for each family and node, or a few where a family has very many."""
    ship(conversations.sparkSession)
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    conv = F.col(f"`{id_col}`").cast("long")
    turns = conversations.where(conv.isNotNull()).select(
        (conv - conv % family_size).alias("family"),
        conv.alias("conv_id"),
        (F.crc32(conv.cast("string").cast("binary")) % shared).alias("h"),
        F.unhex(F.sha2(F.concat(F.length(text("role")).cast("string"), F.lit(":"), text("role"), text("text")), 256)).alias("turn"),
        F.regexp_count(text("text"), F.lit(_WORDS)).cast("long").alias("words"),
        F.col("`turn`").cast("long").alias("at"),
        text("role").alias("role"),
    )
    met = turns.repartition("family").sortWithinPartitions("family", F.col("conv_id") != F.col("family"), "conv_id", F.asc_nulls_first("at"), "role", "turn")
    return met.select("family", "conv_id", "h", "turn", "words").mapInArrow(tidied(_families(held, shared - 1)), _NODES)


def _end_digests(found: DataFrame, chunk_bytes: int) -> DataFrame:
    """(d1, d2, sha) of the nodes where a conversation ends."""
    n = parallelism(found.sparkSession)
    runs = found.where(F.length("ends") > 0).select("d1", "d2", "family", "ends")
    runs = runs.repartitionByRange(n, "d1", "d2", "family").sortWithinPartitions("d1", "d2", "family")
    chunks = runs.mapInArrow(tidied(_chunks(chunk_bytes)), _ENDS)
    chunks = chunks.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "family")
    return chunks.mapInArrow(tidied(_digests), "d1 bigint, d2 bigint, sha string")


def _totals(chains: DataFrame) -> DataFrame:
    """(conv_id, gain, leaves): sums over a chain and all that hangs on it. chains: conv_id, up (the chain it hangs on), gain, leaves."""
    now = materialise(chains.select("conv_id", "up", "gain", "leaves"), "chaintotals")
    while True:
        linked = now.where("up is not null")
        below = linked.groupBy(F.col("up").alias("conv_id")).agg(F.sum("gain").alias("more_gain"), F.sum("leaves").alias("more_leaves"), F.count(F.lit(1)).alias("n"))
        below = materialise(below, "chainsums")
        total = below.agg(F.sum("n")).first()[0]
        if not total:
            discard(below)
            return now.drop("up")
        # The ancestor of the ancestor: few ancestors have most of the rows.
        ups = now.join(below.select("conv_id", "n"), "conv_id").select(F.col("conv_id").alias("up"), F.col("up").alias("upper"), "n")
        raised = join_counted(linked.select("conv_id", "up"), ups, ["up"], "n", total).select("conv_id", "upper")
        summed = now.drop("up").join(below.drop("n"), "conv_id", "left").join(raised, "conv_id", "left")
        zero = F.lit(0).cast("long")
        after = summed.select(
            "conv_id",
            F.col("upper").alias("up"),
            (F.col("gain") + F.coalesce("more_gain", zero)).alias("gain"),
            (F.col("leaves") + F.coalesce("more_leaves", zero)).alias("leaves"),
        )
        after = materialise(after, "chaintotals")
        discard(now)
        discard(below)
        now = after


def prefix_trie(
    conversations: DataFrame, id_col: str = "conv_id", family_size: int = 20, shared: int = 4, family_nodes_held: int = FAMILY_NODES, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation c is rebuilt from the first h turns of conversation c - c % family_size, then its own after
    the first h, where h is its id's CRC-32 modulo shared. Turns are in order of turn, null first; turns that
    tie are in order of role, then of a digest of role and text, and each counts, repeated rows included. Null
    roles and texts are empty. Rows without an id are of no conversation. An empty table has no node, not even
    a root. Other columns are not read. Two nodes are equal if their turns' 128-bit digests are.
    """
    before = tables_now()
    found = materialise(family_nodes(conversations, id_col, family_size, shared, family_nodes_held), "familynodes")
    ends = materialise(_end_digests(found, chunk_bytes), "ends")
    same: list[Column] = [F.first(c).alias(c) for c in ("p1", "p2", "depth", "words")]
    nodes = found.groupBy("d1", "d2").agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), *same)
    nodes = materialise(nodes.withColumn("gain", (F.col("n") - 1) * F.col("words")), "nodes")
    settle(before, nodes, ends)

    chains = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "p1", "p2")).alias("top"), F.max("depth").alias("bottom"), F.sum("gain").alias("gain"))
    chains = materialise(chains.select("conv_id", "top.*", "bottom", "gain"), "chains")
    hung = chains.where("depth > 0").select("conv_id", "depth", "p1", "p2")
    kids = hung.groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("kids"))
    over = nodes.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("up")).join(kids, ["p1", "p2"])
    hung = materialise(join_counted(hung, over, ["p1", "p2"], "kids", hung.count()).select("conv_id", "depth", "up"), "hung")
    # Chains that hang below a chain's last node: that node is no leaf.
    at_end = hung.groupBy(F.col("up").alias("conv_id"), (F.col("depth") - 1).alias("bottom")).agg(F.lit(0).cast("long").alias("leaf"))
    linked = chains.select("conv_id", "bottom", "gain").join(hung.select("conv_id", "up"), "conv_id", "left").join(at_end, ["conv_id", "bottom"], "left")
    totals = _totals(linked.select("conv_id", "up", "gain", F.coalesce("leaf", F.lit(1)).cast("long").alias("leaves")))

    zero = F.lit(0).cast("long")
    below = hung.join(totals, "conv_id").groupBy(F.col("up").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    below = below.agg(F.count(F.lit(1)).alias("hanging"), F.sum("gain").alias("more_gain"), F.sum("leaves").alias("more_leaves"))
    tops = hung.select("conv_id", "depth", "up", F.lit(True).alias("is_top"))
    joined = nodes.join(below, ["conv_id", "depth"], "left").join(tops, ["conv_id", "depth"], "left").join(ends, ["d1", "d2"], "left")
    up = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    so_far = up.rowsBetween(Window.unboundedPreceding, 0)
    hanging, last = F.coalesce("hanging", zero), F.row_number().over(up) == 1
    leaf = F.when(F.col("last") & (F.col("hanging") == 0), 1).otherwise(0)
    counted = joined.withColumns({"hanging": hanging, "last": last})
    out = counted.select(
        F.col("conv_id").alias(id_col),
        "depth",
        F.when(F.col("depth") == 0, F.lit(None)).when(F.col("is_top"), F.col("up")).otherwise(F.col("conv_id")).cast("long").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        (F.col("hanging") + F.when(F.col("last"), 0).otherwise(1)).cast("long").alias("n_children"),
        F.sum(leaf + F.coalesce("more_leaves", zero)).over(so_far).cast("long").alias("n_leaves"),
        F.sum(F.col("gain") + F.coalesce("more_gain", zero)).over(so_far).cast("long").alias("saved_tokens"),
        F.coalesce("sha", F.lit(_NONE)).alias("ends_sha256"),
    )
    out = materialise(out, "trie")
    settle(before, out)
    return out


#: The same result in SQL: prefixes as lists of digests, sums over subtrees by a join of each node with those it leads to.
TRIE_SQL = r"""
    WITH RECURSIVE crc_table AS (
        SELECT list(list_reduce(list_prepend(b::BIGINT, list_transform(range(8), lambda z: 0::BIGINT)),
                    lambda c, z: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY b) AS t
        FROM range(256) AS r(b)),
    own AS (
        SELECT conv_id AS c, conv_id - conv_id % 20 AS base,
               list({'d': sha256(coalesce(role, '') || chr(1) || coalesce(text, '')),
                     'w': len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))} ORDER BY turn NULLS FIRST) AS turns
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    hashed AS (
        SELECT own.*, (xor(4294967295, list_reduce(
                   list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
                   lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 4)::BIGINT AS h
        FROM own, crc_table),
    rebuilt AS (
        SELECT a.c, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns
        FROM hashed AS a LEFT JOIN own AS b ON a.base = b.c),
    steps AS (
        SELECT c, 0::BIGINT AS depth, 'root' AS path, '' AS parent, 0::BIGINT AS w, turns FROM rebuilt
        UNION ALL
        SELECT c, depth + 1, sha256(path || turns[depth + 1].d), path, turns[depth + 1].w, turns FROM steps WHERE depth < len(turns)),
    nodes AS (
        SELECT path, any_value(parent) AS parent, depth, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
               sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len(turns) = depth), '')) AS ends_sha256
        FROM steps GROUP BY path, depth),
    sums AS (
        SELECT path AS top, path, conv_id FROM nodes
        UNION ALL
        SELECT s.top, n.path, n.conv_id FROM sums AS s JOIN nodes AS n ON n.parent = s.path),
    kids AS (SELECT parent AS path, count(*) AS k FROM nodes WHERE depth > 0 GROUP BY parent),
    totals AS (
        SELECT s.top, count(*) FILTER (WHERE k.k IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.w) AS saved
        FROM sums AS s JOIN nodes AS n ON n.path = s.path LEFT JOIN kids AS k ON k.path = s.path GROUP BY s.top)
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.k, 0)::BIGINT AS n_children,
           t.n_leaves, t.saved::BIGINT AS saved_tokens, n.ends_sha256
    FROM nodes AS n LEFT JOIN nodes AS p ON p.path = n.parent LEFT JOIN kids AS k ON k.path = n.path JOIN totals AS t ON t.top = n.path"""
