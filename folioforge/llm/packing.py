"""Packing token sequences into fixed-length training sequences.

Texts become ids, longer documents are cut into pieces, and the pieces are packed into bins of one
capacity. The start is cheap: best fit in the order that pieces come in, without a sort (and, where the
search from there ends above the lower bound, a second one in order of length). Then a local search empties the emptiest bins into the other underfull ones: it moves one piece or two, or exchanges
one or two pieces for a smaller one, always the step that raises the sum of squared fills most, until
bins run empty, the lower bound is reached or no step is left.

Scale: pieces are dealt by hash into groups of about GROUP_PIECES, and of GROUP_BINS bins at least,
each packed by one task, so the work grows in proportion to the input and no task grows with it. Bins
that a group left loose are opened and packed across groups in further passes, each smaller by orders
of magnitude, as long as a pass saves bins.
"""

from __future__ import annotations

import math
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import discard, held, id_and_text, materialise, row_numbers, rows, tidied

CAPACITY = 4096
GROUP_PIECES = 8192
#: A group's tokens fill so many bins at least, so that what one group cannot fill is little.
GROUP_BINS = 64
#: Bins that are filled less than this are packed again across groups.
REOPEN_BELOW = 0.98
#: A further pass must have saved this share of the bins that it opened for another to follow.
_SAVED = 0.01
#: Words whose ids a Python worker keeps, twice over: more save time, fewer save memory.
CACHE_WORDS = 120_000
_LONG_WORD = 64
_MARKS = b".,;:!?*#$%&|"

_PIECES = "row bigint, id bigint, piece int, start bigint, length bigint, crc bigint"


class WordCache(dict):
    """Ids of words as little-endian unsigned 32-bit bytes, from the library, for a text split at white space.

    The vocabulary's normaliser and pre-tokenizer never look across ASCII white space and drop it,
    so a text's ids are those of its words. A word that ends in marks is two: the pre-tokenizer
    always parts letters and digits from marks. A word of lower-case letters in normal form is one
    pre-token and goes to the library's model at once; any other word takes the library's whole way.
    When size entries are held they become the older half, of which what is used again is kept.
    """

    def __init__(self, path: str, size: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.alphabet = dict(byte_alphabet())
        self.size, self.old = size, {}

    def __call__(self, text: bytes) -> bytes:
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()
        # The strings of special tokens are case-sensitive; the vocabulary folds all else to lower case.
        folded = text if b"<|" in text else text.lower()
        return b"".join(map(self.__getitem__, folded.split()))

    def __missing__(self, word: bytes) -> bytes:
        made = self.old.get(word)
        if made is None:
            made = self._ids(word)
        if len(word) <= _LONG_WORD:
            self[word] = made
        return made

    def _ids(self, word: bytes) -> bytes:
        core = word.rstrip(_MARKS)
        text = word.decode("utf-8", "replace")
        if len(core) < len(word) and core and (core[-1] > 0x7F or core[-1:].isalnum()) and b"<|" not in word:
            last = core.decode("utf-8", "replace")[-1]
            if core[-1] < 0x80 or unicodedata.normalize("NFC", last).lower().isalpha():
                return self[core] + self[word[len(core) :]]
        if text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text) and len(word) <= _LONG_WORD:
            mapped = text if text.isascii() else word.decode("latin-1").translate(self.alphabet)
            return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(mapped)])
        return b"".join([i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids])


def _tokenised(path: str, end_id: int, capacity: int, cache_words: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        cache = held(f"packing {path}", lambda: WordCache(path, cache_words))
        end, width, number = end_id.to_bytes(4, "little"), 4 * capacity, row_numbers()
        for ids, texts in rows(batches):
            out = ([], [], [], [], [], [])
            for row, key, text in zip(number(len(ids)), ids, texts):
                made = cache(text) + end
                for piece, at in enumerate(range(0, len(made), width)):
                    part = made[at : at + width]
                    for column, value in zip(out, (row, key, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["row", "id", "piece", "start", "length", "crc"])

    return pieces


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """The start: bins of indexes, pieces in the order given, each to the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i, size in enumerate(lengths):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[at].append(i)
        else:
            room, at = capacity, len(bins)
            bins.append([i])
        by_room[room - size].append(at)
        if room > size:
            rooms |= 1 << (room - size)
    return bins


class LocalSearch:
    """Bins of indexes into lengths, and the steps that empty them."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.bins, self.capacity, self.steps = bins, capacity, 0
        self.size = np.asarray(lengths, dtype=np.int64)
        self.fill = np.array([self.size[b].sum() for b in bins], dtype=np.int64)
        self.where = np.zeros(len(self.size), dtype=np.int64)
        for k, members in enumerate(bins):
            self.where[members] = k

    def _values(self, source: int) -> tuple[np.ndarray, list[tuple[int, ...]]]:
        """The distinct lengths of one or two pieces of a bin, in order, each with pieces that make it up."""
        by_size: dict[int, list[int]] = {}
        for i in self.bins[source]:
            by_size.setdefault(int(self.size[i]), []).append(i)
        made: dict[int, tuple[int, ...]] = {}
        sizes = sorted(by_size)
        for x, a in enumerate(sizes):
            if len(by_size[a]) > 1:
                made.setdefault(2 * a, (by_size[a][0], by_size[a][1]))
            for b in sizes[x + 1 :]:
                made.setdefault(a + b, (by_size[a][0], by_size[b][0]))
        made |= {a: (of[0],) for a, of in by_size.items()}
        values = sorted(made)
        return np.array(values), [made[v] for v in values]

    def _step(self, source: int) -> bool:
        """The move or exchange out of the source that raises the sum of squared fills most, if any does."""
        values, pieces = self._values(source)
        open_bins = np.flatnonzero((self.fill < self.capacity) & (self.fill > 0))
        open_bins = open_bins[open_bins != source]
        underfull = np.zeros(len(self.fill), dtype=bool)
        underfull[open_bins] = True
        theirs = np.flatnonzero(underfull[self.where])
        # What comes back: nothing (a move) or one piece of the target.
        back = np.concatenate([np.zeros(len(open_bins), np.int64), self.size[theirs]])
        target = np.concatenate([open_bins, self.where[theirs]])
        at = np.searchsorted(values, back + self.capacity - self.fill[target], side="right") - 1
        gain = np.where(at >= 0, values[at] - back, 0)
        rise = np.where(gain > 0, gain * (self.fill[target] - self.fill[source] + gain), 0)
        if not len(rise) or rise.max() <= 0:
            return False
        k = int(rise.argmax())
        to, give = int(target[k]), pieces[at[k]]
        take = [int(theirs[k - len(open_bins)])] if k >= len(open_bins) else []
        self.bins[source] = [i for i in self.bins[source] if i not in give] + take
        self.bins[to] = [i for i in self.bins[to] if i not in take] + list(give)
        self.where[list(give)], self.where[take] = to, source
        self.fill[source] -= gain[k]
        self.fill[to] += gain[k]
        self.steps += 1
        return True

    def run(self) -> list[list[int]]:
        """Rounds over the underfull bins, emptiest first, until the lower bound or a round without a step."""
        left, least = len(self.bins), -(-int(self.size.sum()) // self.capacity)
        moved = True
        while moved and left > least:
            moved, tried = False, np.zeros(len(self.bins), dtype=bool)
            while left > least:
                free = np.flatnonzero(~tried & (self.fill > 0) & (self.fill < self.capacity))
                if not len(free):
                    break
                source = int(free[self.fill[free].argmin()])
                tried[source] = True
                while self.bins[source] and self._step(source):
                    moved = True
                left -= not self.bins[source]
        return [b for b in self.bins if b]


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indexes into lengths: best fit in the order given, then the local search.

    Where that ends above the lower bound, the search runs again from best fit in order of decreasing
    lengths, and the fewer bins stay: never more than best fit decreasing itself gives.
    """
    found = LocalSearch(best_fit(lengths, capacity), lengths, capacity).run()
    if len(found) * capacity < sum(lengths) + capacity:
        return found
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    longest_first = [[order[k] for k in b] for b in best_fit([lengths[i] for i in order], capacity)]
    return min(found, LocalSearch(longest_first, lengths, capacity).run(), key=len)


def _pack_group(capacity: int, base: int):
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending"), ("piece", "ascending")])
        lengths = table.column("length").to_pylist()
        group = table.column("grp")[0].as_py()
        sequence, offset, fill = [0] * len(lengths), [0] * len(lengths), [0] * len(lengths)
        for k, members in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for i in members:
                sequence[i], offset[i] = base + (group << 24) + k, at
                at += lengths[i]
            for i in members:
                fill[i] = at
        out = table.select(["row", "id", "piece", "start", "length", "crc"])
        for name, values in (("sequence_id", sequence), ("offset", offset), ("fill", fill)):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    return pack


_PACKED = _PIECES + ", sequence_id bigint, offset bigint, fill bigint"


def _pass(pieces: DataFrame, groups: int, capacity: int, base: int) -> DataFrame:
    dealt = pieces.select("row", "id", "piece", "start", "length", "crc").withColumn("grp", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))
    return dealt.groupBy("grp").applyInArrow(_pack_group(capacity, base), _PACKED)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    capacity: int = CAPACITY,
    group_pieces: int = GROUP_PIECES,
    group_bins: int = GROUP_BINS,
    cache_words: int = CACHE_WORDS,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are documents of the end id alone. Null or repeated ids are packed row by
    row like any others. Only documents longer than the capacity are cut; only a document's last
    piece may be shorter. An empty table gives no rows. Pieces of a sequence lie without gaps from 0.
    """
    made = id_and_text(docs, id_col, text_col).mapInArrow(tidied(_tokenised(tokenizer_path, end_id, capacity, cache_words), f"packing {tokenizer_path}"), _PIECES)
    pieces = materialise(made, "pieces")
    cut, every = int(capacity * REOPEN_BELOW), pieces.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total")).first()
    todo, n, total, packed, opened, level = pieces, every["n"], every["total"] or 0, None, math.inf, 0
    while True:
        groups = max(1, min(-(-n // group_pieces), total // (group_bins * capacity)))
        out = materialise(_pass(todo, groups, capacity, level << 56), "packed")
        if level == 0:
            discard(pieces)
        first, loose = F.col("offset") == 0, F.col("fill") < cut
        seen = out.agg(
            F.count_if(first).alias("bins"), F.count_if(first & loose).alias("loose"), F.count_if(loose).alias("n"), F.sum(F.when(loose, F.col("length"))).alias("total")
        ).first()
        if seen["bins"] < opened:
            done, still = out.where(~loose), out.where(loose)
        else:  # nothing saved: the bins stay as the pass before left them
            done, still, seen = todo, None, None
        packed = done if packed is None else packed.unionByName(done)
        # One group saw all that is loose, the rest is too little for a bin, or a pass saved too little for another to pay.
        enough = seen is None or groups == 1 or seen["loose"] <= -(-(seen["total"] or 0) // capacity) or (level > 0 and opened - seen["bins"] < _SAVED * opened)
        if enough:
            packed = packed if still is None else packed.unionByName(still)
            break
        todo, n, total, opened, level = still, seen["n"], seen["total"], seen["loose"], level + 1
    return packed.select(
        F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset"
    )
