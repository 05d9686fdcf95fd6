"""Exact Jaccard self-join on word n-grams, with set-relation skipping.

A document is its set of distinct n-grams; two documents link from a similarity on. What is skipped:

* Sets that are equal answer alike: one of each class is joined.
* Two sets that link differ in few n-grams, a bound D by their sizes. Each set is cut by ranges of its
  n-grams' hashes into more than D blocks; as a differing n-gram touches one block, a set with more than
  D blocks that no other set has as a whole has no answer. A block is several n-grams together, so what
  texts share by chance or custom, which grows faster than the corpus, lets no set pass.
* A set with more than 1 - t of its n-grams in no other of the sets left has no answer.
* Index lists. N-grams are ordered by how many sets hold them, and only a set's prefix is indexed:
  linked sets share an n-gram there. A list is in order of size and position and cut into blocks;
  a block is skipped if no set in it is of a size or has enough n-grams left after its position.
  Long lists are cut by size first: sets link within a class of sizes and the next class only.
* Answers. Every set is first compared with one set that is as similar as its index lists can tell,
  its lead. Sets that link to a lead have its answers as far as components go, so no list emits a
  pair inside a component; and for two sets with the same lead the difference of their distances
  from it bounds their own distance, which skips the pair or leaves it to be verified.

All links between components that the bounds leave are verified on whole sets, so components are exact.

Scale: of most sets only blocks are shuffled, about one for three n-grams; n-grams of candidates only are
shuffled in full. Lists that are longer than LIST_BLOCK are
dealt out as pairs of blocks to different tasks, of near classes of sizes only; the entries of the
component that holds most of a list meet those of others alone, so a list of near copies of one text
costs its length times what else is in it. Sets that many pairs name reach them by a bounded
broadcast, once for all. Nothing of the size of the corpus is broadcast or
collected: the candidates' filter is a bitmap of bounded size, thinning a scan that an exact join follows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, discard, held, id_and_text, in_bitmap, join_counted, materialise, row_numbers, rows, settle, slices, split, tables_now, tidied, unpack, whole_rows
from .graph import components

SHINGLE = 4
PERCENT = 85
LIST_BLOCK = 512
_SKIP_BLOCK = 64
#: Sizes of sets are dealt into classes of this ratio, or of 1 / t if that is more: sets that link are of one class or of neighbours.
_CLASS_RATIO = 1.5
_CACHE_WORDS = 60_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> bytes:
        import xxhash

        made = xxhash.xxh3_64_digest(word)
        if len(word) <= 64:
            if len(self) >= _CACHE_WORDS:
                self.clear()
            self[word] = made
        return made


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64(seed)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams; a shorter text is one n-gram, one without words none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.int64)
    hashes = held("word hashes", _WordHashes)
    h = np.frombuffer(b"".join(map(hashes.__getitem__, words)), dtype=">u8").astype(np.uint64)
    short = len(words) < size
    n = 1 if short else len(words) - size + 1
    out = np.full(n, len(words) if short else 0, np.uint64)
    for k in range(len(words) if short else size):
        out = _mix(out ^ h[k : k + n], 0x9E3779B97F4A7C15 + k)
    return np.unique(out.view(np.int64))


def _identity(found: np.ndarray) -> tuple[int, int]:
    """Two independent order-free hashes of a set."""
    u = found.view(np.uint64)
    with np.errstate(over="ignore"):
        both = (_mix(u, 0x1234567).sum(dtype=np.uint64), _mix(u, 0xABCDEF987).sum(dtype=np.uint64))
    return int(both[0].view(np.int64)), int(both[1].view(np.int64))


def size_classes(percent: int) -> np.ndarray:
    """The smallest size of each class, ascending; the last class is beyond any set."""
    low, ratio = [1], max(_CLASS_RATIO, 100 / percent)
    while low[-1] < 1 << 31:
        low.append(max(low[-1] + 1, math.ceil(low[-1] * ratio)))
    return np.array(low, np.int64)


def _differing(classes: np.ndarray, c: np.ndarray, percent: int) -> np.ndarray:
    """In how many n-grams two sets that link differ at most, if the larger is of class c."""
    return 2 * (classes[c + 1] - 1) * (100 - percent) // (100 + percent)


def set_blocks(toks: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, block, own, next): hashes of the blocks of sets, and how many blocks of a set a linked one may lack.

    toks holds the sorted n-grams of all sets in turn, n their sizes. A set is cut as sets of its own
    class are, owner 2 * its place, and if one of the next class may link to it as those are too, owner
    2 * its place + 1. Of more than own (next) blocks that another set lacks, no link follows; next is
    -1 for sets that are not cut twice. Blocks without n-grams are left out, as if another set had them.
    """
    classes = size_classes(percent)
    own_class = np.searchsorted(classes, n, side="right") - 1
    own = np.where(n > 0, _differing(classes, np.maximum(own_class, 0), percent), -1)
    reaches = (n > 0) & (100 * n >= percent * classes[own_class + 1])
    following = np.where(reaches, _differing(classes, np.minimum(own_class + 1, len(classes) - 2), percent), -1)
    starts = np.concatenate([[0], np.cumsum(n)])
    mixed, high = _mix(toks.view(np.uint64), 0x5EED5EED), toks.view(np.uint64) >> np.uint64(32)
    owners, blocks = [], []
    for k, most in enumerate((own, following)):
        sets = np.flatnonzero(most >= 0)
        if not len(sets):
            continue
        # Two blocks more than need be and an eighth of them, for those that are empty or agree by chance.
        cuts = (most + 3 + most // 8)[sets].astype(np.uint64)
        at = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in sets])
        which = np.repeat(np.arange(len(sets)), n[sets])
        block = (high[at] * cuts[which]) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (block[1:] != block[:-1])]))
        with np.errstate(over="ignore"):
            whole = np.add.reduceat(mixed[at], first)
            place = block[first] + (((own_class[sets] + k).astype(np.uint64) << np.uint64(40))[which[first]])
        owners.append(2 * sets[which[first]] + k)
        blocks.append(_mix(whole ^ _mix(place, 0xB10C), 0xB10CB10C).view(np.int64))
    empty = np.empty(0, np.int64)
    return (np.concatenate(owners) if owners else empty), (np.concatenate(blocks) if blocks else empty), own, following


_SETS = "row bigint, id bigint, n bigint, f1 bigint, f2 bigint, toks array<bigint>"


def _sets(size: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = row_numbers()
        for ids, texts in rows(batches):
            sets = [shingle_set(t, size) for t in texts]
            prints = [_identity(s) for s in sets]
            offsets = np.zeros(len(sets) + 1, np.int32)
            np.cumsum([len(s) for s in sets], out=offsets[1:])
            values = pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64), pa.int64())
            arrays = [
                pa.array(number(len(ids)), pa.int64()),
                pa.array(ids, pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([p[0] for p in prints], pa.int64()),
                pa.array([p[1] for p in prints], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "id", "n", "f1", "f2", "toks"])

    return make


def _cut(found: bytes, percent: int):
    """Blocks of the sets (row, toks) whose rows are in a bitmap, as rows (row, tok): row is twice the set's, and one more for the next class's cut."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = unpack(found)
        for part in slices(batches):
            part = part.filter(pa.array(in_bitmap(bits, part.column(0))))
            toks, row = part.column(1), part.column(0).to_numpy()
            n = np.diff(toks.offsets.to_numpy()).astype(np.int64)
            owner, block, _, _ = set_blocks(toks.flatten().to_numpy(), n, percent)
            yield pa.RecordBatch.from_arrays([pa.array(2 * row[owner // 2] + owner % 2), pa.array(block)], ["row", "tok"])

    return make


def _lacking(percent: int) -> tuple[Column, Column]:
    """own and next of set_blocks() for a set of n n-grams, by its class."""
    classes = size_classes(percent)
    c = np.arange(len(classes) - 2)
    known = F.array(*[F.struct(*[F.lit(int(v)) for v in row]) for row in zip(classes[c + 1], _differing(classes, c, percent), _differing(classes, c + 1, percent))])
    mine = F.filter(known, lambda k: k["col1"] > F.col("n"))[0]
    return mine["col2"], F.when(100 * F.col("n") >= percent * mine["col1"], mine["col3"]).otherwise(-1)


def _needed(n: Column, percent: int) -> Column:
    """The least overlap that a set of n has with any set it links to."""
    return F.ceil(n * percent / 100.0 - 1e-9)


def _lone(grams: DataFrame) -> DataFrame:
    """(row, u): at least how many of a row's n-grams (row, tok) no other row has.

    N-grams are told apart by their upper 42 bits: two that share them count as shared, so u is never too
    large, and fewer bytes are shuffled.
    """
    alone = grams.groupBy(F.shiftright("tok", 22).alias("bucket")).agg(F.min("row").alias("row"), F.max("row").alias("other")).where("row = other")
    return alone.groupBy("row").agg(F.count(F.lit(1)).alias("u"))


#: A set that more than one pair in so many names is broadcast if it has no more n-grams than that: 100 MB together at most.
_HOT_SETS, _HOT_GRAMS = 256, 50_000


def _with_sets(pairs: DataFrame, sets: DataFrame, end: str, n: str, toks: str) -> DataFrame:
    """pairs with size and n-grams of the sets at one end; pairs is read three times."""
    named = sets.select(F.col("row").alias(end), F.col("n").alias(n), F.col("toks").alias(toks))
    total = pairs.count()
    often = pairs.groupBy(end).count().where(F.col("count") * _HOT_SETS > total)
    hot = F.broadcast(named.where(F.col(n) <= _HOT_GRAMS).join(F.broadcast(often.select(end)), end))
    return pairs.join(hot, end).unionByName(pairs.join(hot.select(end), end, "left_anti").join(named, end))


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) of rows with overlap and both sizes; sets has row, n and the shared toks."""
    pairs = materialise(pairs, "pairs")
    # The end that many pairs share is the lead, or the smaller row.
    both = _with_sets(pairs, sets, "b", "nb", "tb").join(sets.select(F.col("row").alias("a"), F.col("n").alias("na"), F.col("toks").alias("ta")), "a")
    overlap = F.size(F.array_intersect("ta", "tb")).cast("bigint")
    out = both.select("a", "b", "na", "nb", overlap.alias("o"))
    return out.withColumn("linked", 100 * F.col("o") >= percent * (F.col("na") + F.col("nb") - F.col("o")))


def _dealt(long: DataFrame, percent: int, list_block: int) -> DataFrame:
    """Entries of long lists, once for each pair of blocks they take part in: b1, b2 and the entry's own block.

    A block is a part of a cell: the entries of a list in one class of sizes, either of the component
    that holds most of the list or of others. Two cells meet if their classes are the same or
    neighbours, unless both are of that component.
    """
    size_class = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) * (1 + 1e-9))).cast("long") if percent < 100 else F.col("n")
    entries = long.withColumn("g", size_class)
    most = entries.groupBy("tok", "comp").count().groupBy("tok").agg(F.max_by("comp", F.struct("count", "comp")).alias("most"))
    entries = materialise(entries.join(most, "tok").withColumn("cell", 2 * F.col("g") + (F.col("comp") == F.col("most")).cast("long")).drop("g", "most"), "longlists")
    cells = materialise(entries.groupBy("tok", "cell").agg(F.ceil(F.count(F.lit(1)) / list_block).cast("long").alias("parts")), "cells")
    near = F.explode(F.sequence(F.expr("cell div 2") - 1, F.expr("cell div 2") + 1)).alias("g2")
    other = cells.select("tok", F.expr("cell div 2").alias("g2"), F.col("cell").alias("cell2"), F.col("parts").alias("parts2"))
    meets = cells.select("tok", "cell", "parts", near).join(other, ["tok", "g2"]).where("cell % 2 = 0 or cell2 % 2 = 0")
    meets = meets.groupBy("tok", "cell", "parts").agg(F.collect_list(F.struct("cell2", "parts2")).alias("others"))
    part = F.pmod(F.xxhash64("row"), F.col("parts"))
    spread = entries.join(meets, ["tok", "cell"]).withColumn("block", F.shiftleft(F.col("cell"), 32) + part).withColumn("o", F.explode("others"))
    first = F.shiftleft(F.col("o.cell2"), 32)
    spread = spread.withColumn("other", F.explode(F.sequence(first, first + F.col("o.parts2") - 1)))
    return spread.select("tok", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "row", "n", "pos", "comp", "lead", "dist", "block")


def list_pairs(n: np.ndarray, pos: np.ndarray, comp: np.ndarray, lead: np.ndarray, dist: np.ndarray, block: np.ndarray, cross: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in one index list, ordered by size and position, that no bound rules out.

    cross: only pairs of entries of different blocks (this is one of a long list's pairs of blocks).
    """
    size = len(n)
    left = n - pos  # how many n-grams a set has from the shared one on
    starts = np.arange(0, size, _SKIP_BLOCK)
    most_left = np.maximum.reduceat(left, starts) if size else left
    block_low, block_high = n[starts], n[np.minimum(starts + _SKIP_BLOCK, size) - 1]
    one, two = [], []
    for i in range(size - 1):
        # Partners stand after i, so they are no smaller: at most n / t of them, and enough left on both sides.
        first = (i + 1) // _SKIP_BLOCK
        lows = np.maximum(block_low[first:], n[i])
        need = -((-percent * (n[i] + lows)) // (100 + percent))
        open_ = np.flatnonzero((lows * percent <= 100 * n[i]) & (most_left[first:] >= need) & (left[i] >= need)) + first
        for b in open_:
            lo, hi = max(i + 1, b * _SKIP_BLOCK), min(size, (b + 1) * _SKIP_BLOCK)
            m = n[lo:hi]
            need = -((-percent * (n[i] + m)) // (100 + percent))
            keep = (np.minimum(left[i], left[lo:hi]) >= need) & (comp[lo:hi] != comp[i])
            if cross:
                keep &= block[lo:hi] != block[i]
            # |x - y| is at least the difference of the distances from a common lead, and at most what a link allows.
            same = lead[lo:hi] == lead[i]
            keep &= ~same | (np.abs(dist[lo:hi] - dist[i]) <= n[i] + m - 2 * need)
            at = np.flatnonzero(keep)
            if len(at):
                one.append(np.full(len(at), i))
                two.append(at + lo)
    empty = np.empty(0, np.int64)
    return (np.concatenate(one), np.concatenate(two)) if one else (empty, empty)


def _scan_lists(percent: int):
    """Reads entries sorted by list, size and position; emits the pairs of each list."""
    columns = ["tok", "b1", "b2", "row", "n", "pos", "comp", "lead", "dist", "block"]

    def emit(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        key = np.stack([x["tok"], x["b1"], x["b2"]])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        a, b = [], []
        for s, e in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(x["tok"])]])):
            if e - s > 1 and (x["comp"][s:e] != x["comp"][s]).any():
                part = [x[c][s:e] for c in ("n", "pos", "comp", "lead", "dist", "block")]
                i, j = list_pairs(*part, bool(x["b1"][s] != x["b2"][s]), percent)
                a.append(x["row"][s:e][i])
                b.append(x["row"][s:e][j])
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            both = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
            for at in range(0, both.shape[1], 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(both[k, at : at + 100_000], pa.int64()) for k in (0, 1)], ["a", "b"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(columns)}
            if held is not None:
                x = {c: np.concatenate([held[c], x[c]]) for c in columns}
            last = (x["tok"] == x["tok"][-1]) & (x["b1"] == x["b1"][-1]) & (x["b2"] == x["b2"][-1])
            cut = len(last) - int(last.sum())
            if cut:
                yield from emit({c: v[:cut] for c, v in x.items()})
            held = {c: v[cut:] for c, v in x.items()}
        if held is not None:
            yield from emit(held)

    return scan


def similar_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, list_block: int = LIST_BLOCK
) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (the smallest id reachable by links).

    Null texts and texts without words have no n-grams, link with nothing and are their own component.
    Rows that repeat a text are linked with each other. Null ids stand after all others; a component
    of null ids alone has a null component_id. An empty table gives an empty result.
    """
    before = tables_now()
    sets = materialise(id_and_text(docs, id_col, text_col).mapInArrow(tidied(_sets(shingle), "word hashes"), _SETS), "sets")
    meta = materialise(sets.select("row", "id", "n", "f1", "f2"), "setmeta")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("row")))
    classes = materialise(
        meta.where("n > 0").groupBy("f1", "f2", "n").agg(first.alias("r")).select("f1", "f2", "n", F.col("r.row").alias("row"), F.col("r.id").alias("id")),
        "setclasses",
    )

    # Blocks that only one class has. A copy that the bitmap lets by only makes them fewer.
    slack = F.col("n") - _needed(F.col("n"), percent)
    blocks = sets.where("n > 0").select("row", "toks").mapInArrow(tidied(_cut(bitmap(classes, "row"), percent)), "row bigint, tok bigint")
    single = _lone(blocks).groupBy(F.shiftright("row", 1).alias("row")).agg(*[F.sum(F.when(F.col("row") % 2 == k, F.col("u"))).alias(f"u{k}") for k in (0, 1)])
    own, following = _lacking(percent)
    may = [F.coalesce(F.col(f"u{k}"), F.lit(0)) <= most for k, most in enumerate((own, following))]
    possible = materialise(classes.join(single, "row", "left").where(may[0] | may[1]).select("row", "n"), "candidates")

    thinned, _ = split(sets.select("row", "toks"), "row", bitmap(possible, "row"))
    whole = materialise(possible.join(thinned, "row"), "candidatesets")
    discard(sets)

    # The count of every n-gram among what is left.
    spread = whole.select("row", "n", F.explode("toks").alias("tok"))
    counts = spread.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = spread.join(counts, "tok").groupBy("row", "n").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("l"))
    u = F.col("n") - F.size("l")
    shared = shared.withColumn("u", u).where(F.col("u") <= slack)
    kept = materialise(shared.select("row", "n", "u", F.transform("l", lambda x: x["tok"]).alias("toks")), "sharedsets")
    discard(whole)

    # Index: what of each prefix other sets have too. A prefix has n - needed + 1 n-grams, the u lone ones first.
    prefix = (slack + 1 - F.col("u")).cast("int")
    entries = kept.select("row", "n", "u", F.posexplode(F.slice("toks", F.lit(1), prefix)).alias("k", "tok"))
    entries = materialise(entries.select("tok", "row", "n", "u", (F.col("k") + F.col("u")).alias("pos")), "index")

    # Answers by the lead: of all sets in its lists, the one with the fewest n-grams of its own.
    heads = entries.groupBy("tok").agg(F.min(F.struct("u", "row")).alias("head"))
    leads = entries.join(heads, "tok").groupBy("row").agg(F.min("head").alias("head")).select(F.col("row").alias("a"), F.col("head.row").alias("b"))
    led = materialise(_links(leads.where("a <> b"), kept, percent), "leads")
    discard(entries)
    comp = materialise(components(led.where("linked").select("a", "b")), "leadcomponents")
    place = kept.select("row", "n").join(comp.withColumnRenamed("node", "row"), "row", "left").join(led.select(F.col("a").alias("row"), "b", "na", "nb", "o"), "row", "left")
    place = materialise(
        place.select(
            "row",
            F.coalesce("component", "row").alias("comp"),
            F.coalesce("b", "row").alias("lead"),
            F.coalesce(F.col("na") + F.col("nb") - 2 * F.col("o"), F.lit(0)).alias("dist"),
        ),
        "places",
    )

    # Pairs across components, from the lists that have more than one. Places meet prefixes as wholes, entry by entry they would be copied.
    placed = kept.select("row", "n", "u", F.slice("toks", F.lit(1), prefix).alias("toks")).join(place, "row")
    placed = materialise(placed, "placed")
    # Taken apart once: counts, short lists and long ones, these four times over, read the entries.
    listed = placed.select("row", "n", "comp", "lead", "dist", F.col("u"), F.posexplode("toks").alias("k", "tok")).withColumn("pos", F.col("k") + F.col("u")).drop("k", "u")
    listed = materialise(listed, "listed")
    discard(placed)
    mixed = listed.groupBy("tok").agg(F.count(F.lit(1)).alias("len"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2")
    mixed = materialise(mixed.select("tok", "len"), "mixed")
    none = F.lit(0).cast("long")
    short = listed.join(mixed.where(F.col("len") <= list_block).select("tok"), "tok")
    dealt = short.select("tok", none.alias("b1"), none.alias("b2"), "row", "n", "pos", "comp", "lead", "dist", none.alias("block"))
    long = mixed.where(F.col("len") > list_block)
    if not long.isEmpty():
        total = mixed.agg(F.sum("len")).first()[0]
        dealt = dealt.unionByName(_dealt(join_counted(listed, long, ["tok"], "len", total).drop("len"), percent, list_block))
    keys = ["tok", "b1", "b2"]
    sorted_ = dealt.repartition(*keys).sortWithinPartitions(*keys, "n", "pos", "row")
    pairs = sorted_.mapInArrow(tidied(_scan_lists(percent)), "a bigint, b bigint").distinct()
    more = materialise(_links(pairs, kept, percent).where("linked").select("a", "b"), "links")
    whose = place.select("row", "comp")
    ties = more.join(whose.select(F.col("row").alias("a"), F.col("comp").alias("ca")), "a").join(whose.select(F.col("row").alias("b"), F.col("comp").alias("cb")), "b")
    merged = components(ties.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    final = whose.join(merged.select(F.col("node").alias("comp"), "component"), "comp", "left").select("row", F.coalesce("component", "comp").alias("comp"))

    # Names: the smallest id of a component, given to all rows of its classes.
    named = classes.join(final, "row", "left").select("f1", "f2", "n", "id", F.coalesce("comp", "row").alias("comp"))
    named = materialise(named, "classcomponents")
    settle(before, meta, named)
    names = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    of_class = named.join(names, "comp").select("f1", "f2", "n", "component_id")
    out = meta.join(of_class, ["f1", "f2", "n"], "left")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all columns, whose id names a component; all other members of components go.

    Rows that repeat an id stand or fall together: they stay if the id names a component. Rows
    without an id stay. Rows that no link concerns pass by a map; only the others are shuffled.
    """
    before = tables_now()
    found = similar_classes(docs, id_col, text_col, shingle, percent)
    named = F.max(F.col(id_col) == F.col("component_id"))
    gone = found.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(named.alias("named")).where(~F.col("named")).select(id_col)
    gone = materialise(gone, "linkedaway")
    settle(before, gone)
    doubtful, sure = split(docs, id_col, bitmap(gone, id_col))
    nested = doubtful.select(F.col(f"`{id_col}`").alias("id"), whole_rows(docs).alias("doc"))
    stay = nested.join(gone.select(F.col(id_col).alias("id")), "id", "left_anti")
    return sure.unionByName(stay.select("doc.*"))
