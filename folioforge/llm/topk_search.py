"""Exact top-k search by inner product over an impact-ordered index, score at a time.

Components are integers, floor(scale * x). A posting says that a vector has a component of some size
in some dimension; its quantised impact is the component's sign and power of two (one and a half times
that power, the middle of its range). Postings of one dimension and impact are a segment, and segments
are stored by descending impact: the largest components of all vectors of a block come first.

A block of queries takes the segments of a block of vectors in that order and adds the impact times the
query's weight to the scores of the vectors listed. After each level the index knows, for each vector,
how long the rest is that has not been counted (what is left of its components, and what quantising
took), so by Cauchy-Schwarz a score is off by no more than that length times the query's. A pair whose
score cannot reach the query's k-th best one is out by proof; work on the block stops where it is
cheaper to score the pairs that are still possible exactly than to read on, and those are scored from
the integer components themselves. Nothing else decides what is returned.

Scale: vectors are packed in blocks of BLOCK_ROWS, queries of all blocks in groups of about GROUP_QUERIES,
and each cell (group of queries, slice of SLICE_BLOCKS blocks of vectors) is a task's work: its memory does
not depend on the size of the tables, and its thresholds carry on from block to block. A cell returns k
rows a query, so what is merged at the end is k rows for each query and slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.shipping import ship

from .common import materialise, parallelism, row_numbers, settle, slices, tables_now, tidied

BLOCK_ROWS, GROUP_QUERIES, SLICE_BLOCKS, TILE_QUERIES = 1024, 1024, 32, 128

_BLOCKS = "block bigint, ids array<bigint>, dim int, x binary, segments binary, postings binary, rest binary"
_PACKS = "pack bigint, ids array<bigint>, blocks array<bigint>, places array<bigint>, dim int, x binary"
_FOUND = "query_block bigint, query_place bigint, query_id bigint, vec_id bigint, score bigint"
_ARROW = pa.schema([("query_block", pa.int64()), ("query_place", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def whole_numbers(vectors: list[list[float]], scale: float) -> np.ndarray:
    """floor(scale * x) of each component as int64, shorter vectors filled with zeros; beyond 64 bits the nearest long."""
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = [min(_MOST, max(_LEAST + 1, int(c))) for c in np.floor(np.asarray(v, np.float64) * scale).tolist()]
    return out


class Index:
    """The postings of a block of vectors, by descending quantised impact.

    segments: rows (level, dimension, impact, first posting), by level; postings: places in the block;
    rest: for each level and vector, the length of what is not counted once that level is.
    """

    def __init__(self, x: np.ndarray, segments: np.ndarray, postings: np.ndarray, rest: np.ndarray):
        self.x, self.segments, self.postings, self.rest = x, segments, postings, rest

    @classmethod
    def build(cls, x: np.ndarray) -> Index:
        n, dim = x.shape
        power = np.frexp(np.abs(x).astype(np.float64))[1].astype(np.int64) - 1  # of zero: -1
        used = sorted({int(p) for p in np.unique(power[x != 0])}, reverse=True)
        segments, postings, rest = [], [], []
        left = x.astype(np.float64)
        first = 0
        for level, p in enumerate(used):
            middle = 1 if p == 0 else min(3 << (p - 1), 1 << 62)
            for sign in (1, -1):
                dims, places = np.nonzero(((power == p) & (x * sign > 0)).T)
                if len(dims):
                    kinds, starts = np.unique(dims, return_index=True)
                    segments += [(level, d, sign * middle, first + s) for d, s in zip(kinds.tolist(), starts.tolist())]
                    postings.append(places)
                    first += len(places)
                    left[places, dims] -= sign * middle
            rest.append(np.sqrt((left * left).sum(axis=1)))
        return cls(
            x,
            np.array(segments, np.int64).reshape(-1, 4),
            np.concatenate(postings).astype(np.int32) if postings else np.zeros(0, np.int32),
            np.array(rest, np.float64).reshape(len(used), n),
        )

    def possible(self, q: np.ndarray, own: list[tuple[int, int]], k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, queries) of all pairs that may be among a query's k best. own: pairs (place, query) that take no part; least: k-th best scores so far."""
        n, m = len(self.x), len(q)
        weights, length = np.ascontiguousarray(q.T), np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        scores = np.zeros((n, m), np.int64)
        could = np.ones((n, m), bool)
        first_block = n > k and not np.isfinite(least).all()  # else blocks before this one have set bounds
        places, queries = (np.array(own, np.int64).reshape(-1, 2)).T
        ends = np.append(self.segments[1:, 3], len(self.postings))
        at = 0
        for level, rest in enumerate(self.rest):
            while at < len(self.segments) and self.segments[at, 0] == level:
                _, dim, impact, first = self.segments[at].tolist()
                scores[self.postings[first : ends[at]]] += weights[dim] * impact
                at += 1
            slack = np.outer(rest, length) * (1 + 1e-9) + 1
            if first_block:
                sure = scores - slack
                sure[places, queries] = -np.inf
                least = np.maximum(least, np.partition(sure, n - k, axis=0)[n - k])
            could = scores + slack >= least
            could[places, queries] = False
            unread = len(self.postings) - (self.segments[at, 3] if at < len(self.segments) else len(self.postings))
            if 2 * np.count_nonzero(could) * q.shape[1] <= unread * m:
                break
        could[places, queries] = False
        return np.nonzero(could)


def exact_scores(x: np.ndarray, q: np.ndarray, places: np.ndarray, queries: np.ndarray) -> np.ndarray:
    out = np.empty(len(places), np.int64)
    for at in range(0, len(places), 1 << 14):
        p, r = places[at : at + (1 << 14)], queries[at : at + (1 << 14)]
        out[at : at + (1 << 14)] = np.einsum("ij,ij->i", x[p], q[r])
    return out


def _size(a: np.ndarray) -> int:
    return max(abs(int(a.min(initial=0))), abs(int(a.max(initial=0))))


class Best:
    """The k best of each query so far: by score, then id, null ids last."""

    def __init__(self, n_queries: int, k: int):
        self.k, self.n = k, n_queries
        self.query, self.score, self.id, self.null = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))
        self.least = np.full(n_queries, -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        ids, null = np.concatenate([self.id, ids]), np.concatenate([self.null, null])
        order = np.lexsort((ids, null, ~score, query))  # ~score falls as score rises, for every long
        query = query[order]
        starts = np.searchsorted(query, np.arange(self.n))
        rank = np.arange(len(query)) - starts[query]
        stay = order[rank < self.k]
        last = rank == self.k - 1
        self.least[query[last]] = np.nextafter(score[order[last]].astype(np.float64), -np.inf)
        self.query, self.score, self.id, self.null = query[rank < self.k], score[stay], ids[stay], null[stay]


def search_block(index: Index, ids: np.ndarray, null: np.ndarray, q: np.ndarray, own: list[tuple[int, int]], best: Best) -> None:
    """Takes the block's vectors into the best of all queries q, own pairs left out."""
    dim = index.x.shape[1]
    if q.shape[1] < dim:
        q = np.pad(q, ((0, 0), (0, dim - q.shape[1])))
    q = q[:, :dim]
    if dim * (_size(index.x) + 1) * (_size(q) + 1) >= 1 << 61:  # products could pass 64 bits: whole numbers of any size
        places, queries = np.nonzero(np.ones((len(index.x), len(q)), bool))
        keep = np.array([(p, r) not in set(own) for p, r in zip(places.tolist(), queries.tolist())], bool)
        places, queries = places[keep], queries[keep]
        big = index.x.astype(object) @ q.T.astype(object)
        score = np.array([min(_MOST, max(_LEAST, big[p, r])) for p, r in zip(places, queries)], np.int64)
        best.add(queries, score, ids[places], null[places])
        return
    for at in range(0, len(q), TILE_QUERIES):
        tile = q[at : at + TILE_QUERIES]
        mine = [(p, r - at) for p, r in own if at <= r < at + len(tile)]
        places, queries = index.possible(tile, mine, best.k, best.least[at : at + len(tile)])
        score = exact_scores(index.x, tile, places, queries)
        queries = queries + at
        good = score >= best.least[queries]
        if good.any():
            best.add(queries[good], score[good], ids[places[good]], null[places[good]])


def _packed(scale: float, block_rows: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = row_numbers()
        ids: list = []
        vectors: list = []

        def sent() -> pa.RecordBatch:
            index = Index.build(whole_numbers(vectors, scale))
            cells = [[number(1)[0]], [list(ids)], [index.x.shape[1]], [index.x.tobytes()], [index.segments.tobytes()], [index.postings.tobytes()], [index.rest.tobytes()]]
            types = [pa.int64(), pa.list_(pa.int64()), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], ["block", "ids", "dim", "x", "segments", "postings", "rest"])

        for part in slices(batches):
            for i, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids.append(i)
                vectors.append(v)
                if len(ids) == block_rows:
                    yield sent()
                    ids.clear()
                    vectors.clear()
        if ids:
            yield sent()

    return pack


def _rows_of(block: dict) -> np.ndarray:
    return np.frombuffer(block["x"], np.int64).reshape(len(block["ids"]), block["dim"])


def _asked(every: int, group_queries: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = row_numbers()
        ids: list = []
        blocks: list = []
        places: list = []
        rows: list[np.ndarray] = []

        def sent() -> pa.RecordBatch:
            width = max(map(len, rows))
            x = np.array([np.pad(r, (0, width - len(r))) for r in rows], np.int64)
            cells = [[number(1)[0]], [list(ids)], [list(blocks)], [list(places)], [width], [x.tobytes()]]
            types = [pa.int64(), *[pa.list_(pa.int64())] * 3, pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], ["pack", "ids", "blocks", "places", "dim", "x"])

        for batch in batches:
            for b in batch.to_pylist():
                x = _rows_of(b)
                for place, i in enumerate(b["ids"]):
                    if i is not None and i % every == 0:
                        ids.append(i)
                        blocks.append(b["block"])
                        places.append(place)
                        rows.append(x[place])
                        if len(ids) == group_queries:
                            yield sent()
                            for held in (ids, blocks, places, rows):
                                held.clear()
        if ids:
            yield sent()

    return ask


def _cell(k: int):
    def search(packs: pa.Table, blocks: pa.Table) -> pa.Table:
        asked = packs.to_pylist()
        ids, own_blocks, own_places = ([v for p in asked for v in p[c]] for c in ("ids", "blocks", "places"))
        width = max((p["dim"] for p in asked), default=0)
        if not ids or not blocks.num_rows:
            return _ARROW.empty_table()
        q = np.concatenate([np.pad(_rows_of(p), ((0, 0), (0, width - p["dim"]))) for p in asked])
        at: dict[int, list[tuple[int, int]]] = {}
        for r, (b, p) in enumerate(zip(own_blocks, own_places)):
            at.setdefault(b, []).append((p, r))
        best = Best(len(ids), k)
        for row in range(blocks.num_rows):
            b = blocks.slice(row, 1).to_pylist()[0]
            n = len(b["ids"])
            rest = np.frombuffer(b["rest"], np.float64)
            index = Index(_rows_of(b), np.frombuffer(b["segments"], np.int64).reshape(-1, 4), np.frombuffer(b["postings"], np.int32), rest.reshape(len(rest) // n, n))
            null = np.array([i is None for i in b["ids"]], bool)
            search_block(index, np.array([i or 0 for i in b["ids"]], np.int64), null, q, at.get(b["block"], []), best)
        places = best.query.tolist()
        columns = [[own_blocks[p] for p in places], [own_places[p] for p in places], [ids[p] for p in places], [None if n else i for i, n in zip(best.id.tolist(), best.null.tolist())], best.score.tolist()]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_ARROW)

    return search


def top_k(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    every: int = 50,
    scale: float = 256.0,
    block_rows: int = BLOCK_ROWS,
    group_queries: int = GROUP_QUERIES,
    slice_blocks: int = SLICE_BLOCKS,
) -> DataFrame:
    """query_id, rank (from 1), the candidate's id, score: of each query row the k rows with the highest inner products.

    Queries are the rows whose id is divisible by every, candidates all rows but the query's own; fewer than k
    are returned if there are fewer. Ties go to the smaller id, null ids last. Vectors that are null or hold a
    null or non-finite component take no part, nor does a null id ask. Of vectors of different lengths the
    shorter one counts as filled with zeros; the empty vector scores 0 with all. Rows that repeat an id are rows
    of their own: each is asked, and each is a candidate of the other. Components beyond 64 bits count as the
    nearest long, and so do scores. An empty table gives an empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    before = tables_now()
    wide = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    finite = F.expr("v is not null and forall(v, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    blocks = materialise(wide.where(finite).mapInArrow(tidied(_packed(scale, block_rows)), _BLOCKS), "vectorblocks")
    packs = materialise(blocks.mapInArrow(tidied(_asked(every, group_queries)), _PACKS), "querypacks")
    n_blocks = blocks.count()
    n_queries = packs.agg(F.sum(F.size("ids"))).first()[0] or 0
    groups = max(1, -(-n_queries // group_queries))
    cut = max(1, -(-n_blocks // slice_blocks), min(n_blocks, -(-2 * parallelism(spark) // groups)))
    asked = packs.withColumn("g", F.pmod(F.xxhash64("pack"), F.lit(groups))).withColumn("s", F.explode(F.expr(f"sequence(0L, {cut - 1}L)")))
    held = blocks.withColumn("s", F.pmod(F.xxhash64("block"), F.lit(cut))).withColumn("g", F.explode(F.expr(f"sequence(0L, {groups - 1}L)")))
    cells = _without_keys(_cell(k))
    found = asked.groupBy("g", "s").cogroup(held.groupBy("g", "s")).applyInArrow(cells, _FOUND)
    found = materialise(found, "found")
    settle(before, found)
    w = Window.partitionBy("query_block", "query_place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("query_id"), "rank", F.col("vec_id").alias(id_col), "score")


def _without_keys(fn):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return fn(left.drop_columns(["g", "s"]), right.drop_columns(["g", "s"]))

    return run


#: The same result for tables with distinct ids, in SQL.
TOP_K_SQL = """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    s AS (
        SELECT q.vec_id AS query_id, v.vec_id,
               list_sum(list_transform(list_zip(q.x, v.x), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0)))::BIGINT AS score
        FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, rank::INTEGER AS rank, vec_id, coalesce(score, 0) AS score FROM r WHERE rank <= 5"""
