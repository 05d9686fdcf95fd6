"""Byte-level BPE encoding and decoding over contiguous rank arrays.

A word is held as one array of part boundaries and one array of the ranks of adjacent parts. The
array is scanned for the smallest rank, that boundary is deleted and the two ranks beside it are
looked up again, until no adjacent parts can be merged. For words longer than SHORT_WORD bytes the
repeated scan would be quadratic, so they take the same merges from a heap. Words that were
encoded before come from a cache of bounded size, and so does the decoding of a word's ids.

Scale: a map over rows without any exchange; the vocabulary is read once per Python worker.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, id_and_text, rows, tidied

#: Fixed value: how the byte-level pre-tokenizer cuts a text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT_WORD = 96
#: Words kept, twice over: when so many are new, they become the older half, of which what is used again is kept.
_CACHE_WORDS = 300_000
#: Characters of a word that is kept at most, so that the cache is bounded in bytes.
_CACHED_CHARS = 64
_NONE = 1 << 60


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class BytePairCodec:
    def __init__(self, path: str, cache_words: int = _CACHE_WORDS):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        alphabet = byte_alphabet()
        back = {c: b for b, c in alphabet.items()}
        self.byte_ids = [vocab[alphabet[b]] for b in range(256)]
        self.content = {i: bytes(back[c] for c in token) for token, i in vocab.items()}
        #: (left id << 32 | right id) -> (rank << 32 | merged id); one dictionary look-up for each adjacent pair
        self.pairs: dict[int, int] = {}
        for rank, merge in enumerate(merges):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs.setdefault(vocab[left] << 32 | vocab[right], rank << 32 | vocab[left + right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.content |= {i: s.encode() for s, i in self.special.items()}
        self.words = regex.compile(WORD_PATTERN)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.cache_words = cache_words
        self.encoded: dict[str, str] = {}
        self.decoded: dict[str, bytes] = {}
        self.older: tuple[dict[str, str], dict[str, bytes]] = ({}, {})

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        parts = [self.byte_ids[b] for b in word]
        if len(parts) < 2:
            return parts
        if len(parts) > SHORT_WORD:
            return self._merge_long(parts)
        get = self.pairs.get
        ranks = [get(a << 32 | b, _NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == _NONE:
                break
            at = ranks.index(low)
            parts[at] = low & 0xFFFFFFFF
            del parts[at + 1]
            del ranks[at]
            if at:
                ranks[at - 1] = get(parts[at - 1] << 32 | parts[at], _NONE)
            if at < len(ranks):
                ranks[at] = get(parts[at] << 32 | parts[at + 1], _NONE)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, get = len(parts), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(low >> 32, i, low) for i in range(n - 1) if (low := get(parts[i] << 32 | parts[i + 1], _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            _, i, low = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or get(parts[i] << 32 | parts[j], _NONE) != low:
                continue
            parts[i], parts[j] = low & 0xFFFFFFFF, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (low := get(parts[k] << 32 | parts[after[k]], _NONE)) != _NONE:
                    heapq.heappush(heap, (low >> 32, k, low))
        return [p for p in parts if p >= 0]

    def _encode_word(self, word: str) -> str:
        if len(self.encoded) >= self.cache_words:
            self.older = (self.encoded, self.decoded)
            self.encoded, self.decoded = {}, {}
        made = self.older[0].get(word)
        if made is None:
            made = ",".join(map(str, self.merge(word.encode())))
        if len(word) <= _CACHED_CHARS:
            self.encoded[word] = made
        return made

    def encode(self, text: str) -> list[str]:
        """The ids of each word of the text, as decimals joined by commas."""
        pieces = [text]
        if self.split_special and any(s in text for s in self.special):
            pieces = self.split_special.split(text)
        out: list[str] = []
        for piece in pieces:
            if piece in self.special:
                out.append(str(self.special[piece]))
                continue
            get = self.encoded.get
            out += [get(w) or self._encode_word(w) for w in self.words.findall(piece)]
        return out

    def encode_ids(self, text: str) -> list[int]:
        return [int(i) for ids in self.encode(text) for i in ids.split(",")]

    def _decode_word(self, ids: str) -> bytes:
        made = self.older[1].get(ids)
        if made is None:
            made = b"".join([self.content[int(i)] for i in ids.split(",")])
        if len(made) <= 4 * _CACHED_CHARS and len(self.decoded) < 2 * self.cache_words:
            self.decoded[ids] = made
        return made

    def decode(self, groups: list[str]) -> bytes:
        """UTF-8 text of ids given as by encode(); bytes that are no UTF-8 become U+FFFD."""
        get = self.decoded.get
        return b"".join([get(g) or self._decode_word(g) for g in groups]).decode("utf-8", "replace").encode()


def codec(path: str) -> BytePairCodec:
    return held(f"bpe {path}", lambda: BytePairCodec(path))


_OUT = "id bigint, ids string, n_tokens bigint, decoded string"
_DIGEST = "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _coded(path: str, digest: bool):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for keys, texts in rows(batches):
            counts, listed, decoded = [], [], []
            for text in texts:
                groups = c.encode(text.decode("utf-8", "replace"))
                ids, back = ",".join(groups), c.decode(groups)
                counts.append(ids.count(",") + 1 if ids else 0)
                listed.append(hashlib.sha256(ids.encode()).hexdigest() if digest else ids)
                decoded.append(hashlib.sha256(back).hexdigest() if digest else back.decode())
            columns = [pa.array(keys, pa.int64())]
            named = [pa.array(counts, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())]
            if digest:
                yield pa.RecordBatch.from_arrays(columns + named, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays(columns + [named[1], named[0], named[2]], ["id", "ids", "n_tokens", "decoded"])

    return code


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per row of docs: id, ids array<int>, n_tokens, decoded text; with digest their SHA-256 instead.

    Null and empty texts have no ids. Rows are independent of each other, so repeated and null ids
    are returned as they come; an empty table gives an empty result; other columns are not read.
    """
    made = id_and_text(docs, id_col, text_col).mapInArrow(tidied(_coded(tokenizer_path, digest), f"bpe {tokenizer_path}"), _DIGEST if digest else _OUT)
    if digest:
        return made.withColumnRenamed("id", id_col)
    ids = F.when(F.col("ids") == "", F.array().cast("array<int>")).otherwise(F.split("ids", ",").cast("array<int>"))
    return made.select(F.col("id").alias(id_col), ids.alias("ids"), "n_tokens", "decoded")
