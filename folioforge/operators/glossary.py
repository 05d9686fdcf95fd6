"""Glossary joins: terms that a text holds, and terms whose gloss a translation lacks.

A glossary is a table (ord, term, gloss) whose order counts. Matching is by substring, inside words too, so
the join has no key. Terms are dealt by hash into shards of at most about SHARD_TERMS terms and SHARD_CHARS
characters; a shard is what goes to the tasks at once, and passes the driver alone, whatever the glossary's
size. Each text is read once for each shard: by an automaton over the shard's terms, or term by term in order
while there are few, which ends with the last term that is wanted. A text gives at most as many rows as are
wanted of it, so what is grouped afterwards is bounded by texts, not by matches.

Rows with one id are one text in parts, and a term counts once for it. Glossary rows that tie in ord are in
order of term, then gloss. Null and empty terms match nothing, null texts hold nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioforge.shipping import ship

SHARD_TERMS, SHARD_CHARS = 100_000, 4_000_000
#: Up to so many terms a text is searched term by term.
FEW = 64

_last: list = [None, None]


class Finder:
    """The places in a list of needles, in order, whose needle a text holds."""

    def __init__(self, needles: list[str]):
        self.needles = needles
        self.automaton = None
        if len(needles) > FEW:
            self.automaton = ahocorasick.Automaton()
            places: dict[str, list[int]] = {}
            for k, needle in enumerate(needles):
                places.setdefault(needle, []).append(k)
            for needle, same in places.items():
                self.automaton.add_word(needle, tuple(same))
            self.automaton.make_automaton()

    def places(self, text: str) -> Iterator[int]:
        if self.automaton is None:
            yield from (k for k, needle in enumerate(self.needles) if needle in text)
        else:
            yield from sorted(k for same in {same for _, same in self.automaton.iter(text)} for k in same)


def _finder(shard: str, terms: pa.Table) -> Finder:
    """One finder is kept in a worker: tasks of a shard come one after the other."""
    if _last[0] != shard:
        _last[:] = [None, None]
        _last[:] = [shard, Finder(terms.column("needle").to_pylist())]
    return _last[1]


def _shards(glossary: DataFrame, fold: bool) -> Iterator[pa.Table]:
    """The shards: tables of needle, ord, term, gloss in the glossary's order."""
    needle = F.lower("term") if fold else F.col("term")
    terms = glossary.select(needle.alias("needle"), "ord", "term", "gloss").where(F.length("needle") > 0)
    size = terms.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("term") + F.length(F.coalesce("gloss", F.lit("")))).alias("chars")).first()
    parts = max(1, -(-size["n"] // SHARD_TERMS), -(-(size["chars"] or 0) // SHARD_CHARS))
    dealt = terms.withColumn("part", F.pmod(F.xxhash64("needle", "ord"), F.lit(parts)))
    order = [(c, "ascending") for c in ("ord", "term", "gloss")]
    for part in range(parts):
        shard = dealt.where(F.col("part") == part).drop("part").toArrow()
        yield shard.take(pc.sort_indices(shard, sort_keys=order, null_placement="at_start"))


def _first_terms(texts: DataFrame, glossary: DataFrame, id_col: str, fold: bool, most: int, lacking: bool) -> DataFrame:
    """(id, ord, term, gloss): the first terms that column hay of each row holds; if lacking, of those whose gloss column t does not hold."""
    spark = texts.sparkSession
    ship(spark)
    asked = texts.select(id_col, "hay", "t") if lacking else texts.select(id_col, "hay")
    schema = StructType([texts.schema[id_col], *(glossary.schema[c] for c in ("ord", "term", "gloss"))])
    out = None
    for shard in _shards(glossary, fold):
        told, name = spark.sparkContext.broadcast(shard), uuid.uuid4().hex

        def search(batches: Iterator[pa.RecordBatch], told=told, name=name) -> Iterator[pa.RecordBatch]:
            terms = told.value
            finder, glosses = _finder(name, terms), terms.column("gloss")
            for batch in batches:
                rows, places = [], []
                for row in range(batch.num_rows):
                    hay = batch.column(1)[row].as_py()
                    if hay is None:
                        continue
                    found = finder.places(hay)
                    if lacking:
                        t = batch.column(2)[row].as_py() or ""
                        found = (k for k in found if (gloss := glosses[k].as_py()) is not None and gloss not in t)
                    first = list(islice(found, most))
                    rows += [row] * len(first)
                    places += first
                for at in range(0, len(rows), 10_000):
                    part = terms.take(pa.array(places[at : at + 10_000], pa.int64())).combine_chunks()
                    columns = [batch.column(0).take(pa.array(rows[at : at + 10_000], pa.int64())), *(part.column(c).combine_chunks() for c in ("ord", "term", "gloss"))]
                    yield pa.RecordBatch.from_arrays(columns, [id_col, "ord", "term", "gloss"])

        part = asked.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return out


def _ranked(found: DataFrame, id_col: str, most: int) -> DataFrame:
    """A term of a text once, however many rows of the text hold it, with its rank."""
    once = found.groupBy(id_col, "ord", "term", "gloss").agg(F.lit(1).alias("one"))
    w = Window.partitionBy(id_col).orderBy("ord", "term", "gloss")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def hints(docs: DataFrame, glossary: DataFrame, id_col: str, text_col: str, most: int = 15, fold_term: bool = True) -> DataFrame:
    """(id, hint, n_terms): 'term → gloss' lines of the first terms, in glossary order, that the text holds."""
    texts = docs.select(id_col, F.lower(text_col).alias("hay"))
    ranked = _ranked(_first_terms(texts, glossary, id_col, fold_term, most, False), id_col, most)
    lines = F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(" → ", "term", "gloss").alias("s"))))
    return ranked.groupBy(id_col).agg(F.array_join(F.transform(lines, lambda x: x["s"]), "\n").alias("hint"), F.count(F.lit(1)).alias("n_terms"))


def issues(pairs: DataFrame, glossary: DataFrame, id_col: str, original: str, translated: str, longer: int = 4, most: int = 5) -> DataFrame:
    """(id, rank, term, gloss): terms of the original, longer than that, whose gloss the translation lacks; the first in glossary order."""
    texts = pairs.select(id_col, F.lower(original).alias("hay"), F.col(translated).alias("t"))
    found = _first_terms(texts, glossary.where(F.length("term") > longer), id_col, True, most, True)
    return _ranked(found, id_col, most).select(id_col, "rank", "term", "gloss")
