"""Phrase mining, conversation tries and exact search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioforge.llm import collocations, conversation_trie, topk_search

# --- Collocations ------------------------------------------------------------------------------


def brute_collocations(rows, least=10, top=2000, covered=50):
    """rows: (text, lang). The contract, word by word."""
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for n in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, c in counts.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                continue
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(t, l, "x", 1) for t, l in rows], "text string, lang string, word string, f int")
    return sorted(tuple(r) for r in collocations.collocations(df, **options).collect())


def phrase_rows(seed=3, n=300):
    r = random.Random(seed)
    vocabulary = ["the", "The", "of", "new", "york", "times", "a", "ü", "x|y", "Ärger", "日本", "don't", *(f"w{i}" for i in range(40))]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    out = []
    for _ in range(n):
        words = r.choices(vocabulary, weights, k=r.randint(0, 60))
        gaps = r.choices([" ", "  ", "\t", ", ", ".", "\n", "\r\n", " ; ", "!?", "\x0b"], [20, 1, 1, 1, 1, 1, 1, 1, 1, 1], k=len(words))
        text = "".join(w + g for w, g in zip(words, gaps)) + r.choice(["", " New York Times", "new york", "a a a a"])
        out.append((text, r.choice(["en", "de", None, "und"])))
    return out + [(None, "en"), ("", None), (" \t. ,", "fr"), ("new york times " * 3000, "long"), ("b" * 200 + " c " + "b" * 200, "en")] * 12


@pytest.mark.parametrize(
    "options",
    [
        {},
        {"dictionary_words": 8},
        {"dictionary_words": 0},
        {"range_keys": 64, "fold_keys": 50, "window_bytes": 40},
        {"dictionary_words": 20, "window_bytes": 1, "fold_keys": 4},
    ],
)
def test_collocations_by_brute_force(spark, options):
    rows = phrase_rows()
    assert mined(spark, rows, **options) == brute_collocations(rows)


def test_collocations_take_the_first_rows(spark):
    rows = phrase_rows(5, 200)
    assert mined(spark, rows, top=7, least=3, covered_percent=30) == brute_collocations(rows, 3, 7, 30)
    assert mined(spark, []) == [] and mined(spark, [(None, None)]) == []


def test_collocation_products_pass_64_bits(spark):
    row = spark.sql("select 3000000000000L as a, 3000000000001L as l, 3000000000007L as r").select(collocations._floor_score("a", "l", "r")).first()
    assert row[0] == 1_000_000 * 3_000_000_000_000**2 // (3_000_000_000_001 * 3_000_000_000_007)


def test_radix_sort_and_runs():
    r = np.random.default_rng(1)
    for size in (0, 1, 2, 1000):
        keys = r.integers(0, 1 << 62, size) >> r.integers(0, 60, size)
        assert (collocations.radix_sorted(keys) == np.sort(keys)).all()
        distinct, starts = collocations.runs(np.sort(keys))
        assert distinct.tolist() == sorted(set(keys.tolist())) and len(starts) == len(distinct)
        k, n = collocations.merged(keys % 7, np.ones(size, np.int64))
        assert dict(zip(k.tolist(), n.tolist())) == dict(Counter((keys % 7).tolist()))
        assert (collocations.from_planes(collocations.planes(keys), "i8") == keys).all()


def test_ranges_follow_the_keys():
    r = random.Random(4)
    d = collocations.Dictionary([r.choice(["a", "b"]) for _ in range(300)], [f"w{i}".encode() for i in range(300)], [r.randint(10, 10_000) for _ in range(300)])
    same = collocations.Dictionary.unpacked(d.packed())
    assert same.words == d.words and same.langs == d.langs and (same.counts == d.counts).all()
    ids = [list(of.values()) for of in d.number.values()]
    keys = []
    for _ in range(20_000):
        own = r.choice(ids)
        keys.append(r.choice(own) << 42 | r.choice(own) << 21 | r.choice([0, *own]))
    keys = np.sort(np.array(keys))
    at = d.ranges(keys, 50)
    assert (np.diff(at) >= 0).all() and at.min() >= 0 and at.max() == 49


# --- Conversations -----------------------------------------------------------------------------


def brute_trie(rows):
    """rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()
            own[c].append((turn is not None, turn or 0, role or "", digest, (role or "", text or "")))
    own = {c: [t[-1] for t in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        turns = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, sums = [], {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves = sum(sums[k][0] for k in children[node]) or 1
        saved = (len(members[node]) - 1) * words + sum(sums[k][1] for k in children[node])
        sums[node] = leaves, saved
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]), leaves, saved, sha))
    return sorted(out, key=str)


def tried(spark, rows, **options):
    schema = "conv_id long, turn int, role string, text string, family string, n int, depth string"
    df = spark.createDataFrame([(*r, "x", 5, "y") for r in rows], schema).repartition(3)
    return sorted((tuple(r) for r in conversation_trie.prefix_trie(df, **options).collect()), key=str)


def conversation_rows(seed=2):
    r = random.Random(seed)
    said = ["hello there", "hello", "a b  c", "", None, "Ünïcode\ttext here", "x" * 3000]
    rows = []
    for c in [*range(0, 45), *range(61, 75), 400, 1000, 1001, 1020, 5_000_000_000]:
        kind = r.random()
        n = 0 if c == 40 else r.choice([1, 2, 2, 3, 5, 8])
        for t in range(n):
            text = said[min(t, 2)] if kind < 0.4 else r.choice(said)
            rows.append((c, None if t == 0 and kind > 0.8 else t, ("user", "assistant", None)[t % 3 if kind > 0.5 else t % 2], text))
    rows += [(7, 1, "user", "again"), (7, 1, "user", "again"), (7, 1, "user", "b"), (None, 0, "user", "lost"), (9, None, None, None)]
    return rows


@pytest.mark.parametrize("options", [{}, {"family_nodes_held": 2, "chunk_bytes": 3}, {"family_nodes_held": 1}])
def test_trie_by_brute_force(spark, options):
    rows = conversation_rows()
    assert tried(spark, rows, **options) == brute_trie(rows)


def test_trie_of_deep_chains_and_equal_conversations(spark):
    """Each conversation leaves the one before it a turn later; a block of equal ones ends in one node."""
    deep = [(20 * c, t, "user", f"turn {t}" if t < c or t == c and c % 2 else f"turn {t} of {c}") for c in range(40) for t in range(c + 2)]
    equal = [(10_000 + 20 * c, t, "user", f"turn {t}") for c in range(120) for t in range(60)]
    assert tried(spark, deep + equal, chunk_bytes=50) == brute_trie(deep + equal)


def test_trie_of_nothing(spark):
    assert tried(spark, []) == [] and tried(spark, [(None, 1, "user", "x")]) == []


def test_turnless_conversations_are_members_of_the_root(spark):
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 >= 1)
    rows = [(c, 0, "user", "taken away"), (100, 0, "user", "one")]
    got = tried(spark, rows)
    assert got == brute_trie(rows) and (c, 0, None, 2, 1, 1, 0, hashlib.sha256(str(c).encode()).hexdigest()) in got


# --- Search ------------------------------------------------------------------------------------


def brute_search(rows, k=5, every=50):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, v) in enumerate(usable):
        if i is not None and i % every == 0:
            scored = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0) for n, (j, w) in enumerate(usable) if n != at]
            out += [(i, rank, None if none else j, -s) for rank, (s, none, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def searched(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id long, embedding array<double>, block string, rank int").repartition(3)
    return sorted((tuple(r) for r in topk_search.top_k(df, **options).collect()), key=str)


def vector_rows(seed=1, n=400, dim=12):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dim))
    x = centres[r.integers(0, 6, n)] + 0.4 * r.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [None] * dim, [nan] * dim, [inf] + [0.0] * (dim - 1), [0.0] * dim, [1.0, -1.0], [0.5] * (dim + 3)]
    rows += [(n + i, v) for i, v in enumerate(odd)] + [(1000 + 50 * i, v) for i, v in enumerate(odd)]
    return rows + [(2000 + i, rows[50][1]) for i in range(30)] + [(50, rows[50][1]), (100, rows[7][1]), (None, rows[100][1]), (-50, rows[3][1])]


@pytest.mark.parametrize("options", [{}, {"block_rows": 7, "group_queries": 3, "slice_blocks": 2}, {"block_rows": 1, "group_queries": 1000}, {"k": 1}])
def test_search_by_brute_force(spark, options):
    rows = vector_rows()
    assert searched(spark, rows, **options) == brute_search(rows, options.get("k", 5))


def test_search_of_few_and_of_large_numbers(spark):
    assert searched(spark, []) == [] and searched(spark, [(0, [1.0])]) == []
    few = [(0, [1.0, 2.0]), (50, [0.5, 0.25]), (3, [-1.0, 0.0])]
    assert searched(spark, few) == brute_search(few)
    large = [(50 * i, [float(10 ** (i % 7)), -(2.0**17) * i, 0.3]) for i in range(40)]
    assert searched(spark, large) == brute_search(large)
    beyond = searched(spark, [(0, [1e30]), (1, [1e30]), (50, [-1e30])])
    assert (0, 1, 1, 2**63 - 1) in beyond and len(beyond) == 4


def test_pairs_are_dropped_by_proof_only():
    """Whatever the index leaves out cannot be among the best, and it leaves out most."""
    r = np.random.default_rng(7)
    centres = r.normal(size=(12, 64))
    x = centres[r.integers(0, 12, 1024)] + 0.3 * r.normal(size=(1024, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    q = x[:100]
    places, queries = topk_search.Index.build(x).possible(q, [(i, i) for i in range(100)], 5, np.full(100, -np.inf))
    kept = set(zip(places.tolist(), queries.tolist()))
    scores = x @ q.T
    scores[np.arange(100), np.arange(100)] = np.iinfo(np.int64).min
    for j in range(100):
        fifth = np.sort(scores[:, j])[-5]
        assert all((i, j) in kept for i in np.flatnonzero(scores[:, j] >= fifth))
    assert len(kept) < 0.3 * 1024 * 100
