"""A knowledge table (title, extract) in place of an encyclopedia: search, fallback, claims checked against it.

A search asks which title shares most of a few words. The index holds each word of the titles with the number of
titles that have it. Rare words, in at most most_titles titles, come with those titles. Common words never meet
their titles: for every set of up to so many common words that some title holds, the index has the one title that
wins among all that hold it. A query of m words thus meets at most m rows of words and 2^m - 1 of sets, however
common its words are, and only sets that can still win after the rare words: no set is larger than the number of
the query's common words, which bounds what it can share.

The index grows with the titles' postings, and with the sets of a title's common words: for c of them c^m / m! at
most, which suits titles and not texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T

MOST_TITLES = 32


@dataclass(frozen=True)
class TitleIndex:
    """words: (word, n_titles, held): held has a rare word's titles with their lengths and words, null for a common word.
    sets: (set, title): common words in order, joined by blanks, and the title that wins among those that hold them."""

    words: DataFrame
    sets: DataFrame
    most_terms: int


def _words_of(title: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(title), "[^a-z0-9-]+")), lambda w: w != "")


def _sets(words: Column, most: int) -> Column:
    """All sets of up to most of the words, which are in order, each joined by blanks, with its size."""
    after = lambda s: F.filter(F.sequence(F.lit(0), F.size(words)), lambda j: (j > s["last"]) & (j < F.size(words)))

    def larger(s: Column) -> Column:
        return F.transform(after(s), lambda j: F.struct(F.concat_ws(" ", s["set"], F.get(words, j)).alias("set"), j.alias("last"), (s["n"] + 1).alias("n")))

    levels = [F.transform(words, lambda w, i: F.struct(w.alias("set"), i.alias("last"), F.lit(1).alias("n")))]
    for _ in range(1, most):
        levels.append(F.flatten(F.transform(levels[-1], larger)))
    return F.concat(*levels)


def title_index(kb: DataFrame, most_terms: int = 4, most_titles: int = MOST_TITLES, persist: Callable[[DataFrame, str], DataFrame] | None = None) -> TitleIndex:
    """The index of a knowledge table, whose titles are distinct; persist(df, name) stores its parts."""
    store = persist or (lambda df, _: df)
    titles = kb.select("title", _words_of(F.col("title")).alias("words"))
    postings = titles.select("title", "words", F.explode("words").alias("word"))
    counts = store(postings.groupBy("word").agg(F.count(F.lit(1)).alias("n_titles")), "titlecounts")
    rare, common = counts.where(F.col("n_titles") <= most_titles), counts.where(F.col("n_titles") > most_titles)
    entry = F.struct(F.length("title").alias("n"), "title", "words")
    held = postings.join(rare, "word").groupBy("word", "n_titles").agg(F.collect_list(entry).alias("held"))
    none = F.lit(None).cast(held.schema["held"].dataType).alias("held")
    words = held.unionByName(common.select("word", "n_titles", none))
    shared = postings.join(common, "word").groupBy("title").agg(F.array_sort(F.collect_set("word")).alias("words"))
    each = shared.select("title", F.explode(_sets(F.col("words"), most_terms)).alias("s"))
    sets = each.groupBy(F.col("s.set").alias("set")).agg(F.min_by("title", F.struct(F.length("title"), "title")).alias("title"))
    return TitleIndex(store(words, "titlewords"), store(sets, "titlesets"), most_terms)


def search(queries: DataFrame, kb: DataFrame, id_col: str, terms: Column, most_terms: int = 4, index: TitleIndex | None = None) -> DataFrame:
    """(id, title, extract, overlap): the title that shares most words with the query's first terms; ties by shorter, then lesser title."""
    index = index or title_index(kb, most_terms)
    if index.most_terms < most_terms:
        raise ValueError(f"the index is for {index.most_terms} terms")
    asked = queries.select(id_col, F.array_distinct(F.transform(F.slice(terms, 1, most_terms), F.lower)).alias("asked"))
    # An outer explode, as a filter for the others would take the terms from every text twice more; words that are null join nothing.
    known = asked.select(id_col, "asked", F.explode_outer("asked").alias("word")).join(index.words, "word")
    met = known.groupBy(id_col, "asked").agg(F.collect_list(F.struct("word", "held")).alias("met"))
    rare = F.flatten(F.transform(F.filter("met", lambda m: m["held"].isNotNull()), lambda m: m["held"]))
    scored = F.transform(rare, lambda t: F.struct((-F.size(F.array_intersect(t["words"], F.col("asked")))).alias("less"), t["n"].alias("n"), t["title"].alias("title")))
    common = F.array_sort(F.transform(F.filter("met", lambda m: m["held"].isNull()), lambda m: m["word"]))
    best = met.select(id_col, F.array_min(scored).alias("best"), common.alias("common"))
    # Sets that share fewer words than a rare word's title does cannot win.
    wanted = F.filter(_sets(F.col("common"), most_terms), lambda s: s["n"] >= F.coalesce(-F.col("best.less"), F.lit(1)))
    by_set = best.select(id_col, F.explode(wanted).alias("s")).select(id_col, F.col("s.set").alias("set"), F.col("s.n").alias("shared")).join(index.sets, "set")
    found = by_set.select(id_col, F.struct((-F.col("shared")).alias("less"), F.length("title").alias("n"), "title").alias("best"))
    top = best.where("best is not null").select(id_col, "best").unionByName(found).groupBy(id_col).agg(F.min("best").alias("best"))
    named = top.select(id_col, F.col("best.title").alias("title"), (-F.col("best.less")).cast("long").alias("overlap"))
    return named.join(kb.select("title", "extract"), "title").select(id_col, "title", "extract", "overlap")


def lookup(queries: DataFrame, kb: DataFrame, id_col: str, term_col: str, broader: str = " mathematics", longer: int = 50) -> DataFrame:
    """(id, term, title, extract): the entry named like the term, else like the term with the broader word; extracts must be longer than that."""
    usable = kb.where(F.length("extract") > longer).select(F.lower("title").alias("_k"), "title", "extract")
    first = usable.select("_k", F.struct("title", "extract").alias("_1"))
    second = usable.select("_k", F.struct("title", "extract").alias("_2"))
    asked = queries.select(id_col, term_col, F.lower(term_col).alias("_a"), F.lower(F.concat(F.col(term_col), F.lit(broader))).alias("_b"))
    both = asked.join(first.withColumnRenamed("_k", "_a"), "_a", "left").join(second.withColumnRenamed("_k", "_b"), "_b", "left")
    found = F.coalesce("_1", "_2")
    return both.select(id_col, term_col, found["title"].alias("title"), found["extract"].alias("extract"))


def word_support(claim: Column, extract: Column) -> Column:
    """A deterministic stand-in for a model's fact check: at least half of the claim's search terms are in the extract."""
    terms = T.search_terms(claim)
    hits = F.filter(terms, lambda t: F.contains(F.lower(extract), F.lower(t)))
    return (F.size(terms) > 0) & (2 * F.size(hits) >= F.size(terms))


def top_claims(claims: DataFrame, id_col: str, most: int = 5) -> DataFrame:
    w = Window.partitionBy(id_col).orderBy("claim_idx")
    return claims.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank")
