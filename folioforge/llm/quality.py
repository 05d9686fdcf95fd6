"""Quality by weak supervision.

Each rule votes good (+1), bad (-1) or abstains (0) on a text. Expectation-maximisation over the
votes of all texts estimates, for each rule, how it votes on good and on bad texts, and the share
of good texts; a text's posterior probability of being good follows from its votes. No rule
decides alone, except a contract's hard base rules.

Scale: one pass over the texts leaves a row of a few numbers each, written to the shared folder.
EM needs the texts' vote patterns only, which are counted in Spark: at most 3^rules patterns, of
which few occur, whatever the size of the corpus. Posteriors are computed from the votes in
expressions of the second, small pass.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, materialise, rows, tidied

_SYMBOLS = b"#*$%&|<>"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_digits", "n_stops")
_METRICS = "id bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS)
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_LOWER = re.compile(r"[a-zß-öø-ÿ]")
_KEPT_BYTES = bytes(set(range(256)) - set(_SYMBOLS))
_SPACES = b" \t\n\r\x0b\x0c"
_MARKS = bytes(set(range(256)) - set(b"!?"))
_DIGITS = bytes(set(range(256)) - set(b"0123456789"))
_CONTINUATION = bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a window of three words that occurs twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == n - 2:
        return 0
    counts: dict[tuple, int] = {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def text_counts(text: bytes) -> tuple[int, ...]:
    """The numbers that the rules vote on, in the order of _COUNTS, over the whole text."""
    words = text.split()
    points = text.translate(None, _CONTINUATION)
    seen: set[bytes] = set()
    lines = dup = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    decoded = text.decode("utf-8", "replace")
    upper, lower = len(_UPPER.findall(decoded)), len(_LOWER.findall(decoded))
    return (
        len(words),
        len(points.translate(None, _SPACES)),
        len(text.translate(None, _KEPT_BYTES)),
        dup,
        repeated_words(words),
        lines,
        upper,
        upper + lower,
        len(text.translate(None, _MARKS)),
        len(text.translate(None, _DIGITS)),
        text.count(b". ") + text.count(b", ") + text.count(b".\n"),
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in rows(batches):
        columns = list(zip(*map(text_counts, texts))) or [()] * len(_COUNTS)
        arrays = [pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in columns)]
        yield pa.RecordBatch.from_arrays(arrays, ["id", *_COUNTS])


def _band(value: Column, good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")


def default_rules() -> dict[str, Column]:
    """Votes as expressions over the counts. A text without words gets bad votes where a rule can tell, else abstentions."""
    words, lines, letters = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "n_lines", "n_letters"))
    symbols, repeats, dups = F.col("n_symbols") / words, F.col("n_repeat_words") / words, F.col("n_dup_lines") / lines
    length, upper = F.col("word_chars") / words, F.col("n_upper") / letters
    marks, digits = F.col("n_marks") / words, F.col("n_digits") / F.greatest(F.col("word_chars"), F.lit(1))
    per_line = F.col("n_words") / lines
    stops = F.col("n_stops") / words
    n = F.col("n_words")
    never = F.lit(False)
    return {
        # The one rule that knows what is good: sentences, and none of what the other rules look for.
        "prose": _band(stops, (stops >= 0.04) & (symbols < 0.1) & (repeats < 0.2) & (upper < 0.4) & (n >= 40), never),
        # The others know what is bad only: to be free of it says little for a text, so they abstain.
        "symbols": _band(symbols, never, symbols > 0.2),
        "repeats": _band(repeats, never, repeats > 0.3),
        "dup_lines": _band(dups, never, dups > 0.5),
        "no_sentences": _band(stops, never, (stops < 0.01) & (n >= 30)),
        "word_length": _band(length, never, (length < 2) | (length > 14)),
        "upper": _band(upper, never, upper > 0.5),
        "marks": _band(marks, never, marks > 0.3),
        "digits": _band(digits, never, digits > 0.3),
        "words": _band(n, never, n < 20),
        "per_line": _band(per_line, never, (per_line < 2) & (F.col("n_lines") > 3)),
    }


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, steps: int = 200, smooth: float = 1.0) -> dict:
    """EM on distinct vote patterns (rows of -1, 0, 1) and how often each occurs.

    Returns the share of good texts and, per rule, log P(vote | good) - log P(vote | bad) for the
    votes -1, 0, 1, with the estimated accuracy (votes in line with the posterior). An empty table
    gives a model that leaves every text at probability one half.
    """
    n_rules = patterns.shape[1]
    if not len(patterns):
        return {"prior": 0.5, "weights": np.zeros((n_rules, 3)), "accuracy": np.full(n_rules, 0.5)}
    hot = np.stack([(patterns == v) for v in (-1, 0, 1)], axis=2).astype(float)
    # Bad votes are the rarer and the more telling, so at first one outweighs the good votes of three rules.
    q = 1 / (1 + np.exp(-((patterns > 0).sum(axis=1) - 4.0 * (patterns < 0).sum(axis=1))))
    prior, weights = 0.5, np.zeros((n_rules, 3))
    for _ in range(steps):
        good, bad = counts * q, counts * (1 - q)
        # A rule's votes start from the belief that it is right more often than not.
        pg = np.einsum("p,prv->rv", good, hot) + smooth * np.array([0.5, 1.0, 2.0])
        pb = np.einsum("p,prv->rv", bad, hot) + smooth * np.array([2.0, 1.0, 0.5])
        weights = np.log(pg / pg.sum(axis=1, keepdims=True)) - np.log(pb / pb.sum(axis=1, keepdims=True))
        # An abstention says nothing about the text: rules abstain by kind of text, not by its quality.
        weights[:, 1] = 0.0
        prior = (good.sum() + 1) / (counts.sum() + 2)
        z = math.log(prior / (1 - prior)) + np.einsum("prv,rv->p", hot, weights)
        new = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        moved, q = float(np.abs(new - q).max()), new
        if moved < 1e-9:
            break
    cast = hot[:, :, 0] + hot[:, :, 2]
    right = np.einsum("p,pr->r", counts * q, hot[:, :, 2]) + np.einsum("p,pr->r", counts * (1 - q), hot[:, :, 0])
    return {"prior": prior, "weights": weights, "accuracy": right / np.maximum(1e-9, np.einsum("p,pr->r", counts, cast))}


def weak_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: id, the counts, a vote per rule (vote_<rule>), p_good.

    Null texts are texts without words. Rows are independent but for EM, in which every row counts
    once, repeated ones too. An empty table gives an empty result. Other columns are ignored.
    """
    rules = rules or default_rules()
    measured = id_and_text(docs, id_col, text_col).mapInArrow(tidied(_measure), _METRICS)
    voted = materialise(measured.withColumns({f"vote_{k}": v for k, v in rules.items()}), "votes")
    names = [f"vote_{k}" for k in rules]
    found = voted.groupBy(*names).count().collect()
    patterns = np.array([[r[c] for c in names] for r in found], dtype=int).reshape(-1, len(names))
    model = fit_label_model(patterns, np.array([r["count"] for r in found], dtype=float))
    z = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for name, (low, _, high) in zip(names, model["weights"]):
        z = z + F.when(F.col(name) == -1, float(low)).when(F.col(name) == 1, float(high)).otherwise(0.0)
    return voted.withColumn("p_good", 1 / (1 + F.exp(-z))).withColumnRenamed("id", id_col)
