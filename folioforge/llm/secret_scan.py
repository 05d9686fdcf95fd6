"""Secrets by pattern and by tests of randomness.

Three patterns give base spans. Any other unbroken run of key characters that is long enough is a
candidate: what of it no base span covers, its parts between "=" and, where no alphabet holds them,
their parts in either base64 alphabet. A candidate's encoding is inferred from its characters, and a
battery of three tests looks at it twice:

* Is it random in that encoding? Chi-squared for a uniform use of the alphabet, the number of runs above
  and below the middle of the alphabet, and the serial correlation of neighbours, by Fisher's method.
* Is it no ordinary text? The same three aspects against the corpus: how its letters are used, how often
  the kind of character changes from place to place (the runs of letters, capitals, digits and signs),
  and how neighbours depend on each other. Each is a likelihood ratio of random over ordinary
  characters, whose mean over ordinary text is one; so the reciprocal of their product is a p-value
  (by Markov's inequality), with the length of the candidate in it: each character adds its part.

Candidates that are random enough enter the Benjamini-Hochberg rule with that p-value, among the
candidates of all documents; so evidence, not a list of shapes, turns them into findings.

Scale: one pass over the texts leaves spans and candidates, which are few, in the shared folder.
Letter counts, one row a task, and the histogram of p-values have a fixed size whatever the corpus.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, materialise, rows, slices, small_batches, tidied
from .spans import Covered, Span, digest, joined

KINDS = ("assign", "access", "hex")
#: Below this not even random hex, which needs least, has the evidence that one secret in a hundred candidates asks for.
MIN_CANDIDATE = 12
#: Shorter candidates, mostly words, are ranked for themselves: they do not raise the bar for longer ones.
LONG_CANDIDATE = 20
FALSE_DISCOVERIES = 0.001
MIN_RANDOMNESS = 0.001

_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LONG = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % MIN_CANDIDATE)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_CANDIDATE)
_PIECE = re.compile(r"[^=]++(?:=++(?![A-Za-z0-9+/_-]))?")
_PARTS = (re.compile(r"[A-Za-z0-9+/]+=*"), re.compile(r"[A-Za-z0-9_-]+=*"))
#: p-values are counted in steps of exp(-_STEP), up to exp(-_STEP * (_STEPS - 1)).
_STEP, _STEPS = 0.25, 800

_ALPHABETS = (
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("lower", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("upper36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)

_ALPHABET_SETS = [(name, alphabet, frozenset(alphabet)) for name, alphabet in _ALPHABETS]


def infer_encoding(token: str) -> tuple[str, str] | None:
    """The smallest known alphabet that holds the token, padding aside."""
    used = set(token.rstrip("="))
    for name, alphabet, characters in _ALPHABET_SETS:
        if used <= characters:
            return name, alphabet
    return None


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def randomness(token: str, alphabet: str) -> float:
    """Fisher's combined p-value of three tests for the token being random over its alphabet."""
    token = token.rstrip("=")
    n, k = len(token), len(alphabet)
    counts = Counter(token)
    chi = sum(c * c for c in counts.values()) * k / n - n
    spread = math.sqrt(2 * (k - 1) * max(1e-9, 1 - 1 / n))
    p_chi = _normal_tail((chi - (k - 1)) / spread)
    place = {c: i for i, c in enumerate(alphabet)}
    x = np.array([place[c] for c in token], dtype=float)
    high = x >= (k / 2)
    n1 = int(high.sum())
    n2 = n - n1
    if not n1 or not n2:
        p_runs = 2.0 ** (1 - n)
    else:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * n1 * n2 / n
        var = max(1e-9, (mean - 1) * (mean - 2) / max(1, n - 1))
        p_runs = 2 * _normal_tail(abs(runs - mean) / math.sqrt(var))
    centred = x - x.mean()
    power = float((centred**2).sum())
    r = float((centred[1:] * centred[:-1]).sum()) / power if power else 1.0
    p_serial = 2 * _normal_tail(abs(r) * math.sqrt(n))
    half = -sum(math.log(max(1e-300, min(1.0, p))) for p in (p_chi, p_runs, p_serial))
    return math.exp(-half) * (1 + half + half * half / 2)


#: How ordinary names change between kinds of characters: a change to each other kind after one character in ten (letters) or
#: eight (digits) on average, and after most signs. Words of text, with hardly any change, would make every name with a number a secret.
_ORDINARY = {
    "lower": {"lower": 0.70, "upper": 0.10, "digit": 0.10, "sign": 0.10},
    "upper": {"lower": 0.10, "upper": 0.70, "digit": 0.10, "sign": 0.10},
    "digit": {"lower": 0.12, "upper": 0.12, "digit": 0.64, "sign": 0.12},
    "sign": {"lower": 0.50, "upper": 0.20, "digit": 0.20, "sign": 0.10},
}
#: What of a letter's or pair's probability is the corpus's; the rest allows for names and abbreviations, and bounds what one place may say.
_CORPUS_LETTERS, _CORPUS_PAIRS = 0.9, 0.5


def _character(c: str) -> str:
    return "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "sign"


class TextModel:
    """Letters of ordinary text, one by one and in pairs (cases folded), from the corpus's counts; 27th is any other byte."""

    def __init__(self, pairs: np.ndarray):
        n = np.asarray(pairs, dtype=float).reshape(27, 27)[:26, :26] + 1e-3
        single = n.sum(axis=0) / n.sum()
        self.letters = _CORPUS_LETTERS * single + (1 - _CORPUS_LETTERS) / 26
        follows = n / n.sum(axis=1, keepdims=True)
        # P(letter) over P(letter | letter before): above one where neighbours are strange to each other.
        self.strange = -np.log(_CORPUS_PAIRS * follows / single + (1 - _CORPUS_PAIRS))


def battery(token: str, alphabet: str, model: TextModel) -> tuple[float, float, float]:
    """Log likelihood ratios of random over ordinary characters: of the letters used, of the runs of kinds, of neighbours."""
    token = token.rstrip("=")
    kinds = [_character(c) for c in token]
    of_alphabet = Counter(map(_character, alphabet))
    share = {k: n / len(alphabet) for k, n in of_alphabet.items()}
    # Kinds that the encoding lacks take no part, so the ordinary changes between the others sum to one.
    ordinary = {a: {b: p / sum(_ORDINARY[a][x] for x in share) for b, p in _ORDINARY[a].items() if b in share} for a in share}
    places = [ord(c) - (97 if k == "lower" else 65) if k in ("lower", "upper") else -1 for c, k in zip(token, kinds)]
    letters = sum(-math.log(of_alphabet[k]) - math.log(model.letters[x]) for x, k in zip(places, kinds) if x >= 0)
    runs = sum(math.log(share[b]) - math.log(ordinary[a][b]) for a, b in zip(kinds, kinds[1:]))
    serial = sum(float(model.strange[x, y]) for x, y in zip(places, places[1:]) if x >= 0 and y >= 0)
    return letters, runs, serial


def evidence(token: str, alphabet: str, model: TextModel) -> float:
    """Minus the log of the battery's p-value against ordinary text."""
    return sum(battery(token, alphabet, model))


def base_spans(text: bytes, decoded: str | None = None) -> list[Span]:
    """Base spans by start, then kind; leftmost and without overlap in each kind."""
    low = text.lower()
    assign = any(w in low for w in _ASSIGN_WORDS)
    longs = _LONG.search(text) is not None
    if not assign and not longs:
        return []
    decoded = decoded if decoded is not None else text.decode("utf-8", "replace")
    out: list[tuple[int, int, int]] = []
    if assign:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(decoded) if len(m[2]) >= 6]
    if longs:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(decoded)]
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(decoded)]
    return [(KINDS[k], a, b) for a, k, b in sorted(out)]


def candidates_in(text: str, base: Covered | None = None) -> Iterator[Span]:
    """(token, start, end) of what is tested, outside base spans. Only parts of a run that no alphabet holds can overlap each other."""
    base = base or Covered()
    for run in _CANDIDATE.finditer(text):
        for first, last in base.gaps(*run.span()):
            for piece in _PIECE.finditer(text, first, last):
                at, found = piece.start(), {(0, piece.end() - piece.start())}
                if not infer_encoding(piece[0]):
                    found = {m.span() for pattern in _PARTS for m in pattern.finditer(piece[0])}
                yield from ((piece[0][a:b], at + a, at + b) for a, b in sorted(found) if b - a >= MIN_CANDIDATE)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_CAND = pa.struct([("token", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_FOUND = (
    "id bigint, base array<struct<kind:string,start:bigint,end:bigint>>, "
    "candidates array<struct<token:string,start:bigint,end:bigint>>, pairs array<bigint>"
)
_FOLDED = np.full(256, 26, np.int32)
_FOLDED[65:91] = _FOLDED[97:123] = np.arange(26)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans and candidates of each text; at a task's end one row without them holds the counts of its pairs of letters."""
    counts = np.zeros(27 * 27, dtype=np.int64)

    def made(ids: list, base: list, candidates: list, pairs: list) -> pa.RecordBatch:
        arrays = [pa.array(ids, pa.int64()), pa.array(base, pa.list_(_SPAN)), pa.array(candidates, pa.list_(_CAND)), pa.array(pairs, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, ["id", "base", "candidates", "pairs"])

    for ids, texts in rows(batches):
        base, candidates = [], []
        folded = _FOLDED[np.frombuffer(b"\n".join(texts), np.uint8)]
        counts += np.bincount(folded[:-1] * 27 + folded[1:], minlength=27 * 27)
        for text in texts:
            found, more = base_spans(text), []
            if _LONG.search(text) is not None:
                more = [dict(zip(("token", "start", "end"), c)) for c in candidates_in(text.decode("utf-8", "replace"), Covered(found))]
            base.append([dict(zip(("kind", "start", "end"), s)) for s in found])
            candidates.append(more)
        yield made(ids, base, candidates, [None] * len(ids))
    yield made([None], [None], [None], [counts.tolist()])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", false_discoveries: float = FALSE_DISCOVERIES) -> DataFrame:
    """One row per row of docs: id, base and added spans as arrays of (kind, start, end).

    Added spans (kind random) never overlap base ones or each other. Null and empty texts have none.
    Every row counts once for the false-discovery rule, repeated ones too. An empty table gives an
    empty result; other columns are not read.
    """
    written = materialise(id_and_text(docs, id_col, text_col).mapInArrow(tidied(_scan), _FOUND), "secrets")
    found = written.where("base is not null")
    counted = written.where("pairs is not null").select(F.posexplode("pairs").alias("b", "n")).groupBy("b").agg(F.sum("n").alias("n"))
    counts = np.zeros(27 * 27)
    for r in counted.collect():  # at most 729 rows
        counts[r["b"]] = r["n"]
    model = TextModel(counts)
    least = -math.log(false_discoveries)

    def measured(token: str) -> float | None:
        encoding = infer_encoding(token)
        if encoding is None:
            return None
        # No cut is lower than the rate itself, so less evidence than that never passes.
        value = evidence(token, encoding[1], model)
        return value if value >= least and randomness(token, encoding[1]) >= MIN_RANDOMNESS else None

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            tokens = batch.column(0).to_pylist()
            steps = [-1 if (v := measured(t)) is None else int(min(_STEPS - 1, max(0, v // _STEP))) for t in tokens]
            longs = [len(t) >= LONG_CANDIDATE for t in tokens]
            yield pa.RecordBatch.from_arrays([pa.array(longs, pa.bool_()), pa.array(steps, pa.int32())], ["long", "step"])

    tokens = found.select(F.explode("candidates.token").alias("token"))
    histogram = {False: np.zeros(_STEPS), True: np.zeros(_STEPS)}
    total = {False: 0, True: 0}
    with small_batches(docs.sparkSession):
        measured_tokens = tokens.mapInArrow(tidied(measure), "long boolean, step int").groupBy("long", "step").count().collect()
    for r in measured_tokens:  # at most 2 * (_STEPS + 1) rows
        total[r["long"]] += r["count"]
        if r["step"] >= 0:
            histogram[r["long"]][r["step"]] = r["count"]
    # Benjamini-Hochberg: the smallest step whose p-value is at most q * (rank of its last candidate) / candidates.
    cut = {}
    for long, counted_steps in histogram.items():
        rank = counted_steps[::-1].cumsum()[::-1]
        passing = [s for s in range(_STEPS) if rank[s] and math.exp(-s * _STEP) <= false_discoveries * rank[s] / max(1, total[long])]
        cut[long] = passing[0] * _STEP if passing else math.inf

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            added = []
            for candidates in batch.column(2).to_pylist():
                hits = [(v, c["start"], c["end"]) for c in candidates or () if (v := measured(c["token"])) is not None and v >= cut[len(c["token"]) >= LONG_CANDIDATE]]
                taken = Covered()
                for _, a, b in sorted(hits, key=lambda h: (-h[0], h[1])):  # of overlapping parts the one with most evidence
                    taken.take(a, b)
                added.append([{"kind": "random", "start": a, "end": b} for a, b in zip(taken.starts, taken.ends)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(added, pa.list_(_SPAN))], ["id", "base", "added"])

    schema = "array<struct<kind:string,start:bigint,end:bigint>>"
    return found.select("id", "base", "candidates").mapInArrow(tidied(decide), f"id bigint, base {schema}, added {schema}").withColumnRenamed("id", id_col)


def scan_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of scan_secrets()' spans."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = {k: i for i, k in enumerate((*KINDS, "random"))}
        for batch in slices(batches):
            out = ([], [], [], [], [])
            for base, added in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                spans = [(s["kind"], s["start"], s["end"]) for s in base]
                both = sorted(spans + [(s["kind"], s["start"], s["end"]) for s in added], key=lambda s: (s[1], order[s[0]]))
                kinds = Counter(k for k, _, _ in spans)
                for column, value in zip(out, (*(kinds[k] for k in KINDS), digest(spans), joined(both))):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, types))], names)

    schema = "id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return found.select(F.col(id_col).alias("id"), "base", "added").mapInArrow(tidied(digests), schema).withColumnRenamed("id", id_col)
